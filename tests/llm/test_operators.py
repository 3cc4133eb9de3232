"""Each operator against brute force on rows with every hard case."""

from __future__ import annotations

import hashlib
import re
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import bpe, chat, edit_embedding, line_rules, packing, parity_join, quality_vote, substring, toxicity, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 1 WARC


def test_warc_round_trip(spark):
    big = "<p>" + "x" * 200 + "</p>"
    rows = [(3, "http://a/ b\r\n", big), (1, None, big), (2, "http://c", "short"), (4, "http://d", "short"), (5, None, None), (None, "http://e", big), (1, "http://f", big), (6, "u", "é" * 100000)]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1))).collect()
    assert len(got) == len(rows) and all(r["error"] is None for r in got)
    want = Counter((i, len((h or "").encode()), sha(h or ""), "revisit" if h == big and i != 1 else "response", 1 if h == big and i != 1 else None) for i, _, h in rows)
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert {r["url"] for r in got if r["page_id"] == 3} == {"http://a/%20b%0D%0A"}


def test_warc_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_warc_dictionary_and_damage():
    records = [warc.record(i, "http://x", (f"<html>{i}" + "body " * 50).encode(), sha(f"<html>{i}" + "body " * 50), None) for i in range(40)]
    packed = warc.archive(records)
    assert struct.unpack_from("<I", packed)[0] == warc.DICTIONARY_MAGIC
    assert [r for r, e in warc.frames(packed)] == records
    assert [warc.parse(r)["page_id"] for r in records] == list(range(40))
    with pytest.raises(ValueError, match="length"):
        warc.parse(records[0][:-5] + b"\r\n\r\n")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(records[0].replace(b"body body", b"bodY body"))
    assert list(warc.frames(packed[:-3]))[-1][1]
    assert list(warc.frames(packed + b"junk and more"))[-1][1]


# 2 edit embedding


def test_edited_fingerprints(hard, hard_rows):
    got = edit_embedding.edited_fingerprints(hard).collect()
    order = sorted(((i is not None, i or 0, t or ""), i) for i, t, *_ in hard_rows)
    want = Counter()
    for k, ((_, _, t), i) in enumerate(order):
        after, cut = order[(k + 1) % len(order)][0][2], len(t) // 4
        want[(i, len(t), sha(t[: len(t) - cut] + after[:cut]))] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    prints = {}
    for r in got:
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        prints.setdefault(r["doc_id"], r["fingerprint"])
    assert prints[3] == prints[1] == prints[17]
    long_one = next(r for r in got if r["doc_id"] == 15)
    assert long_one["near_edited"] > 0.6 > 0.3 > long_one["near_next"]


def test_edited_fingerprints_of_nothing_and_of_one(empty, hard):
    assert edit_embedding.edited_fingerprints(empty).count() == 0
    r = edit_embedding.edited_fingerprints(hard.where("doc_id = 3")).first()
    assert r["near_next"] == 1.0
    r = edit_embedding.edited_fingerprints(hard.where("doc_id = 4")).first()
    assert (r["n_chars"], r["near_edited"], r["near_next"]) == (0, 1.0, 1.0)


def test_edit_distance_shows_in_likeness():
    text = "".join(chr(97 + (i * i + i // 7) % 26) for i in range(4000))
    points = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    near, far = text[:500] + "zz" + text[500:], text[::-1]
    a, b, c = edit_embedding.fingerprints([points(text), points(near), points(far)])
    assert edit_embedding.likeness(a[None], b[None])[0] > 0.7 > 0.2 > edit_embedding.likeness(a[None], c[None])[0]


def test_near_copies(hard):
    got = {r["doc_id"]: r["component_id"] for r in edit_embedding.near_copies(hard.where("doc_id is not null")).collect()}
    assert got[3] == got[17] == got[1] == 1 and got[5] == 5 and got[15] == 15


def _least_linked(ids, alike):
    label = {i: i for i in ids}
    for a, b in alike:
        low, high = sorted((label[a], label[b]))
        label = {i: low if v == high else v for i, v in label.items()}
    return label


def test_near_copies_behind_an_unlike_lead(spark, monkeypatch):
    r = np.random.default_rng(3)
    cut = np.random.Generator(np.random.PCG64(7)).permutation(edit_embedding.SLOTS)
    a = r.integers(1, 120, edit_embedding.WALKS * edit_embedding.SLOTS).astype(np.uint8)
    b, c = a.copy(), a.copy()
    for w in range(edit_embedding.WALKS):
        for band in range(6):
            at = w * edit_embedding.SLOTS + cut[band * 8 : band * 8 + 8]
            b[at] += 120
            c[at] = b[at]
            c[at[0]] += 1
    prints = spark.createDataFrame([(i, i, 9, bytearray(p.tobytes())) for i, p in enumerate((a, b, c), 1)], "doc_id long, text_key long, n_chars long, fingerprint binary")
    monkeypatch.setattr(edit_embedding, "plain_fingerprints", lambda *_: prints)
    for rows in (1024, 1):
        monkeypatch.setattr(edit_embedding, "BLOCK_ROWS", rows)
        got = {x["doc_id"]: x["component_id"] for x in edit_embedding.near_copies(prints.select("doc_id", "text_key")).collect()}
        assert got == {1: 1, 2: 2, 3: 2}


def test_components_of_planted_edits(spark):
    import random

    from conftest import invented

    r = random.Random(11)
    template = invented(40, 250)
    texts = [template + " " + invented(50 + k, 120) for k in range(30)]
    for t in list(texts):
        for edits in (1, 3):
            c = list(t)
            for _ in range(edits):
                c[r.randrange(len(c))] = r.choice("qxz")
            texts.append("".join(c))
    df = spark.createDataFrame([(i, t, None, None, len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {x["doc_id"]: x["component_id"] for x in edit_embedding.edited_and_near(df).collect()}
    points = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    prints = np.hstack([edit_embedding.fingerprints(points, m) for m in edit_embedding._MOVES])
    alike = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if edit_embedding.walks_likeness(prints[i : i + 1], prints[j : j + 1])[0] >= 0.8]
    assert len(alike) >= 60
    want = _least_linked(range(len(texts)), alike)
    found = sum(got[i] == got[j] for i, j in alike)
    assert found >= 0.97 * len(alike)
    assert all(want[got[i]] == want[i] for i in got)


# 3 and 6 classifiers


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    r = random.Random(4)
    good = lambda: " ".join(r.choice(["the", "ing", "of", "tion", "and", "was", "er"]) + r.choice(["", "ly", "ed"]) for _ in range(60)) + "."
    rows, labels = [], []
    for i in range(400):
        bad, toxic = i % 3 == 0, i % 4 == 0
        text = " ".join([r.choice(["BUY", "NOW"]) + "!!"] * 40) if bad else good()
        if toxic:
            text += f" That {r.choice(['idiot', 'moron'])} left. " + good()
        rows.append((i, text))
        labels.append((i, None if i == 7 else int(not bad), int(toxic)))
    rows += [(1000, None), (1001, "")]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_vote_held_out(labelled, empty):
    docs, labels = labelled
    held = F.col("doc_id") % 3 == 1
    model = quality_vote.fit(docs, labels, ~held)
    got = quality_vote.scores(docs, model).join(labels.where(held & F.col("quality").isNotNull()), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in got]) >= 0.95
    assert all(0 <= r["score"] <= 1 for r in quality_vote.scores(docs, model).where("doc_id >= 1000").collect())
    kept = quality_vote.keep_good(docs, model)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_vote.scores(empty, model).count() == 0
    none = quality_vote.fit(docs, labels.limit(0), ~held)
    assert {r["score"] for r in quality_vote.scores(docs, none).collect()} == {0.5}


def test_neighbours_are_exact():
    r = np.random.Generator(np.random.PCG64(1))
    settings = quality_vote.VoteSettings(neighbours=5)
    terms = r.random((300, quality_vote.WIDTH)).astype(np.float32)
    axes = r.standard_normal((quality_vote.WIDTH, 8)).astype(np.float32)
    model = quality_vote.VoteModel(np.ones(quality_vote.WIDTH, np.float32), axes, np.zeros((0, 8), np.float32), np.zeros(0), np.zeros(0), 0.5, settings)
    vectors, y = model.latent(terms[:100]), (np.arange(100) % 2).astype(float)
    model = quality_vote.VoteModel(model.idf, axes, vectors, y, np.ones(100), 0.5, settings)
    got = model.score(terms[100:])
    for row, s in zip(model.latent(terms[100:]), got, strict=True):
        near = vectors @ row
        top = np.argsort(-near)[:5]
        w = np.exp(settings.sharpness * 8 * (near[top] - 1))
        assert abs((w * y[top]).sum() / w.sum() - s) < 1e-3


def test_toxicity_held_out_and_place(labelled, empty):
    docs, labels = labelled
    held = F.col("doc_id") % 5 == 0
    model = toxicity.fit(docs, labels, ~held)
    got = toxicity.scores(docs, model).join(labels.where(held), "doc_id").collect()
    assert np.mean([(r["score"] >= 0.5) == (r["toxic"] == 1) for r in got]) >= 0.95
    places = toxicity.offending(docs, model).collect()
    assert places and np.mean(["idiot" in r["sentence"] or "moron" in r["sentence"] for r in places]) > 0.9
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in places[:20]:
        assert texts[r["doc_id"]][r["start"] : r["start"] + r["chars"]] == r["sentence"]
    assert [r["score"] for r in toxicity.scores(docs, model).where("doc_id >= 1000").collect()] == [0.0, 0.0]
    assert toxicity.scores(empty, model).count() == 0
    blank = toxicity.fit(docs, labels.limit(0), ~held)
    assert toxicity.scores(docs, blank).agg(F.max("score")).first()[0] < 1e-6


# 4 line rules


def brute_lines(text):
    w, rules = words(text), line_rules.LineRules()
    lines = [x for x in (text or "").split("\n") if words(x)]
    grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
    lost = 0
    for x in lines:
        n = len(words(x))
        bare = sum(v in ("|", ">", "/") for v in words(x))
        noise = sum(33 <= ord(c) < 127 and not c.isalnum() for c in x)
        if noise > rules.noise_per_word * n + 4 or (bare >= 2 and bare >= 0.25 * n) or any(p in x.lower() for p in line_rules.BOILERPLATE):
            lost += n
    base = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit), base, not base and lost <= 0.4 * len(w)


def test_line_rules(spark, hard, hard_rows, empty):
    more = [(100, "Home | About | Us\nclick here now please\n" + "real words here and there again\n" * 1 + "###!!!&&&$$$ x", None, None, None), (101, "a b c d e f g h i j\n\na b c d e f g h i j\r\n", None, None, None)]
    df = hard.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(more, hard.select("doc_id", "text", "lang", "source", "n_chars").schema))
    got = Counter(tuple(r)[:8] for r in line_rules.figures(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect())
    assert got == Counter((i, *brute_lines(t)) for i, t, *_ in [*hard_rows, *more])
    assert line_rules.figures(empty).count() == 0


def test_clean_removes_lines_and_documents(spark):
    text = "one two three four five six seven eight nine ten eleven twelve\nAll rights reserved\nthirteen fourteen fifteen sixteen seventeen"
    df = spark.createDataFrame([(1, text, "k"), (2, "a | b | c | d | e | f | g | h | i | j | k", "k"), (3, None, None)], "doc_id long, text string, kept string")
    rows = line_rules.clean(df).collect()
    assert [(r["doc_id"], r["text"], r["kept"]) for r in rows] == [(1, text.replace("All rights reserved\n", ""), "k")]


# 5 chat


def test_chat(spark):
    rows = [(1, 2, "assistant", "b \\s <x> </turn>\n"), (1, 1, "user", None), (1, 1, "assistant", "a"), (2, 1, None, "\\l>"), (None, 1, "assis>tant\n", "z"), (1, None, "system", "é🙂"), (1, 2, "assistant", "b \\s <x> </turn>\n")]
    got = {r["conv_id"]: r for r in chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", F.lit(1)).withColumn("at", F.lit(2))).collect()}
    for conv in (1, 2, None):
        turns = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        assert (got[conv]["n_turns"], got[conv]["turns_sha256"], got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(turns), sha(said), len(loss), sha(loss))


def test_chat_attachments(spark):
    part = lambda **k: tuple(k.get(n) for n in ("kind", "text", "ref", "width", "height", "seconds", "pages"))
    parts = [part(kind="text", text="see <image:0/> "), part(kind="image", ref="i.png", width=600, height=100), part(kind="audio", ref="a.wav", seconds=1.5), part(kind="document", ref="d.pdf", pages=3), part(kind="odd", ref="q")]
    df = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    r = chat.format_chat(df).first()
    assert r["formatted"] == "<turn:user>\nsee \\limage:0/\\g <image:1/><audio:2/><document:3/><document:4/></turn>\n<turn:assistant>\n</turn>\n"
    assert [(a["kind"], a["ref"], a["tokens"], a["place"]) for a in r["attachments"]] == [("image", "i.png", 425, 1), ("audio", "a.wav", 38, 2), ("document", "d.pdf", 2400, 3), ("document", "q", 800, 4)]
    assert r["n_tokens"] == 4 + 425 + 38 + 2400 + 800


def test_chat_empty(spark):
    assert chat.digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


# 7 parity join


def brute_components(rows, n, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for _, t, *_ in rows:
        w = words((t or "").translate(low))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    lead = list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                lead[root(i)] = root(j)
    least = {}
    for i, (k, *_) in enumerate(rows):
        if k is not None:
            least[root(i)] = min(least.get(root(i), k), k)
    return Counter((k, len(s), least.get(root(i)) if s else k) for i, ((k, *_), s) in enumerate(zip(rows, sets, strict=True)))


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80), (1, 50)])
def test_parity_join(hard, hard_rows, n, percent):
    got = parity_join.linked_components(hard, parity_join.JaccardRule(n, percent)).collect()
    assert Counter(tuple(r) for r in got) == brute_components(hard_rows, n, percent)


def test_parity_join_of_chained_copies(spark, monkeypatch):
    import random

    r = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(r.randint(0, 9)):
            w[r.randrange(200)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(parity_join, "BLOCK_ROWS", 16)
    got = parity_join.linked_components(spark.createDataFrame(rows, "doc_id long, text string"), parity_join.JaccardRule(3, 90)).collect()
    assert Counter(tuple(x) for x in got) == brute_components(rows, 3, 90)


def test_sketch_bounds_the_difference():
    r = np.random.Generator(np.random.PCG64(3))
    pool = r.integers(0, 1 << 63, 400, dtype=np.uint64)
    for percent in (80, 90):
        rule = parity_join.JaccardRule(3, percent)
        for size in (1, 3, 9, 40, 200):
            for _ in range(20):
                a = np.sort(r.choice(pool, size, replace=False))
                b = a.copy()
                d = rule.most_apart(2 * size) // 2
                b[r.choice(size, d, replace=False)] = r.integers(0, 1 << 63, d, dtype=np.uint64)
                b = np.sort(b)
                keys = [set(parity_join.piece_keys(x, np.zeros(size, np.int64), np.array([size]), rule)[0].tolist()) for x in (a, b)]
                assert keys[0] & keys[1]


def test_one_of_each(hard):
    kept = parity_join.one_of_each(hard)
    assert kept.columns == hard.columns
    ids = Counter(r["doc_id"] for r in kept.collect())
    # 1, 3, 17 and 17 are copies, 8 and 9 differ in case only; the second text of 16 and the one without an id are near copies.
    assert ids[1] == 1 and not ids[3] and not ids[17] and ids[8] == 1 and not ids[9] and ids[4] == ids[5] == ids[6] == 1 and ids[16] == 2


def test_parity_join_empty(empty):
    assert parity_join.linked_components(empty).count() == 0
    assert parity_join.one_of_each(empty).columns == empty.columns


# 8 packing


def test_borders_are_optimal():
    from itertools import combinations

    r = np.random.Generator(np.random.PCG64(2))
    for _ in range(30):
        m = int(r.integers(1, 8))
        lengths = np.sort(r.choice(np.arange(1, 60), m, replace=False))
        counts = r.integers(1, 20, m)
        for k in (1, 2, 3, 9):
            cost = lambda bs: sum(c * min(b for b in bs if b >= n) for n, c in zip(lengths, counts, strict=True))  # noqa: E731, B023
            best = min(cost((*some, lengths[-1])) for size in range(min(k, m)) for some in combinations(lengths[:-1].tolist(), size))
            got = packing.best_borders(lengths, counts, k)
            assert len(got) <= k and cost(got) == best


def test_borders_of_many_lengths_equal_the_plain_programme():
    r = np.random.Generator(np.random.PCG64(4))
    lengths = np.sort(r.choice(np.arange(1, 60_000), 700, replace=False))
    counts = np.where(r.random(700) < 0.05, 5000, 1) * r.integers(1, 9, 700)
    total = np.concatenate(([0], np.cumsum(counts)))
    cost = lengths * total[1:]
    for _ in range(1, 16):
        before = np.concatenate(([0], cost[:-1]))
        cost = np.array([min(before[i] + lengths[j] * (total[j + 1] - total[i]) for i in range(j + 1)) for j in range(700)])
    got = packing.best_borders(lengths, counts, 16)
    assert len(got) <= 16 and sum(int(c) * got[int(np.searchsorted(got, n))] for n, c in zip(lengths, counts, strict=True)) == cost[-1]


def test_batches_fill_in_order_of_ids(spark):
    rows = [(i, "w " * (1 + i % 7)) for i in range(300)]
    rule = packing.PackRule(buckets=3, budget=40, chunk=1000)
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), rule).collect()
    for bucket in {r["bucket"] for r in got}:
        mine = sorted((r for r in got if r["bucket"] == bucket), key=lambda r: r["doc_id"])
        room = max(1, 40 // bucket)
        assert [(r["batch"], r["slot"]) for r in mine] == [(k // room, k % room) for k in range(len(mine))]


def test_pack(hard, hard_rows, empty):
    rule = packing.PackRule(buckets=4, budget=200)
    got = packing.pack(hard, rule).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == Counter((i, len(words(t))) for i, t, *_ in hard_rows)
    batches = Counter()
    for r in got:
        assert r["padding"] == r["bucket"] - r["n_tokens"] >= 0
        batches[(r["bucket"], r["chunk"], r["batch"])] += 1
    assert len({r["bucket"] for r in got}) <= 4
    assert all(n * b <= rule.budget or n == 1 for (b, _, _), n in batches.items())
    assert packing.pack(empty).count() == 0


# 9 substring dedup


def brute_substring(rows, k=20):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault((i is not None, i or 0), set()).add(t or "")
    return texts, k


def test_substring(hard, hard_rows, empty):
    # Ids with several texts are ordered by a hash, so those are left to the next test.
    plain = [r for r in hard_rows if r[0] != 16]
    got = Counter(tuple(r) for r in substring.digests(hard.where("doc_id is null or doc_id <> 16")).collect())
    seen, want = {}, Counter()
    for i, t, *_ in sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0)):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - 19):
            g = tuple(w[s : s + 20])
            if seen.setdefault(g, (i, s)) != (i, s):
                gone[s : s + 20] = [True] * 20
        want[(i, len(w), sum(gone), sha(" ".join(x for x, z in zip(w, gone, strict=True) if not z)))] += 1
    assert got == want
    assert substring.digests(empty).count() == 0


def test_substring_cut_and_spans(hard):
    cut = substring.cut(hard)
    assert cut.columns == hard.columns and cut.count() == hard.count()
    removed = {(r["doc_id"], r["n_removed"]) for r in substring.digests(hard).collect()}
    spans = Counter()
    for r in substring.maximal_repeats(hard).where("doc_id is not null and doc_id not in (16, 17)").collect():
        spans[r["doc_id"]] += r["n_words"]
        assert len(words(r["text"])) == r["n_words"] >= 20
    assert {(i, n) for i, n in spans.items()} == {(i, n) for i, n in removed if n and i not in (None, 16, 17)}
    assert {r["doc_id"]: r["text"] for r in cut.where("doc_id = 3").collect()}[3].strip() == ""


# 10 BPE


def test_bpe(hard, hard_rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    want = Counter()
    for i, x, *_ in hard_rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(t.decode(ids, skip_special_tokens=False)))] += 1
    assert Counter(tuple(r) for r in bpe.digests(hard, path).collect()) == want
    assert bpe.digests(empty, path).count() == 0
    some = bpe.encoded(hard.where("doc_id = 7"), path).first()
    assert some["ids"] == t.encode("one", add_special_tokens=False).ids


def test_bpe_words_of_odd_letters():
    import random

    path = public_tokenizers.path("word_bpe_49k.json")
    t, b, r = Tokenizer.from_file(path), bpe.WordBpe(bpe.read_spec(path), kept=500), random.Random(5)
    alphabet = ["a", "thing", "é", "Σ", "İ", "ß", "½", "٣", "Ⅷ", "'s", "'LL", "’", "\x1c", "\x85", "　", "<|startoftext|>", "<|end", "日本", "🙂", "\n", " ", "###", "$5", "\xad", "क्षि", "ª", "</w>", "ing", "tion"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 12))) for _ in range(600)]
    for x, (ids, text) in zip(texts, (p for at in range(0, 600, 100) for p in b.encode(texts[at : at + 100])), strict=True):
        want = t.encode(x, add_special_tokens=False).ids
        assert ids.tolist() == want
        assert text.decode() == t.decode(want, skip_special_tokens=False) == b.decode(ids)


def test_bpe_long_words():
    model = bpe.WordBpe(bpe.read_spec(public_tokenizers.path("word_bpe_49k.json")))
    r = np.random.default_rng(5)
    word = "".join(chr(97 + x) for x in r.integers(0, 26, 3000))
    symbols = model._symbols(word, True)
    assert model._merged_long(list(symbols)) == Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(word, add_special_tokens=False).ids
    assert len(model.exact(word * 100)) > 3000


def test_chat_equal_turns_stand_by_plain_text(spark):
    rows = [(1, 1, "user", "<z"), (1, 1, "user", "A")]
    got = chat.digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert got["turns_sha256"] == sha("user\n<z\nuser\nA\n")


def test_draw_of_repeated_rows(spark):
    docs = spark.range(20000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    labels = spark.createDataFrame([(1, 1), (1, 1)], "doc_id long, toxic int")
    assert [r["text"] for r in toxicity.draw(docs, labels, "toxic", F.lit(True), 5, 5).collect()] == ["text 0"]


def test_votes_of_ties_are_whole():
    terms = np.ones((4, quality_vote.WIDTH), np.float32)
    model = quality_vote.VoteModel(np.ones(quality_vote.WIDTH, np.float32), np.ones((quality_vote.WIDTH, 1), np.float32), np.ones((4, 1), np.float32), np.array([1.0, 0, 0, 0]), np.ones(4), 0.0, quality_vote.VoteSettings(neighbours=1))
    assert np.allclose(model.score(terms), 0.25)
    assert model.score(np.zeros((1, quality_vote.WIDTH), np.float32))[0] == 0.0


def test_warc_of_another_writer():
    body = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nhello"
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:1>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:VL2MMHO4YXUKFWV63YHTWSBM3GXKSQ2N\r\nContent-Length: "
    got = warc.parse(head + str(len(body)).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")
    assert (got["page_id"], got["record_id"], got["payload"]) == (None, "<urn:uuid:1>", b"hello")
    with pytest.raises(ValueError, match="digest"):
        warc.parse(head + str(len(body)).encode() + b"\r\n\r\n" + body[:-1] + b"p\r\n\r\n")
