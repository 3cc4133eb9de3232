"""Alignment, MinHash components and the Merkle manifest against brute force."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quern.llm import alignment, merkle, minhash, toxicity
from quern.llm import textbatch as tb
from tests.llm.conftest import invented

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 alignment


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=B)


def plain_alignment(text, libraries):
    """Ids, groups and links of a whole text by the libraries, with every pair of tokens compared inside a group."""
    if not text:
        return [], [], "", []
    a, b = libraries
    raw = (" " + text).encode()
    enc = a.encode(" " + text, add_special_tokens=False)
    byte = {c: i for i, c in ((i, a.id_to_token(a.encode(bytes([i]).decode("latin-1"), add_special_tokens=False).ids[0])) for i in range(33, 127))}
    byte |= alignment._byte_of()
    bytes_a = [bytes(byte[c] for c in a.id_to_token(i)) for i in enc.ids]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if b"".join(bytes_a) != raw or b"".join(bytes_b) != raw:
        return [], [], "", []
    ea, eb = np.cumsum([len(x) for x in bytes_a]).tolist(), np.cumsum([len(x) for x in bytes_b]).tolist()
    groups, p, q = [], 0, 0
    at_a, at_b = {e: i + 1 for i, e in enumerate(ea)}, {e: i + 1 for i, e in enumerate(eb)}
    for end in sorted(set(ea) & set(eb)):
        i, j = at_a[end], at_b[end]
        groups.append(",".join(map(str, enc.ids[p:i])) + "|" + ",".join(map(str, ids_b[q:j])))
        p, q = i, j
    links, j = [], 0
    for i, x in enumerate(enc.ids):
        s, e = ea[i] - len(bytes_a[i]), ea[i]
        while j and eb[j - 1] > s:
            j -= 1
        while j < len(ids_b) and eb[j] - len(bytes_b[j]) < e:
            if eb[j] > s:
                links.append((x, ids_b[j]))
            j += 1
    return enc.ids, ids_b, ";".join(groups), links


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.sampled_from([" ", "  ", "\n", " \n ", "\t", " ", " ", "\x1c", "\x00", "the", "don't", "<s>", "<|endoftext|>", "▁", "<0x41>", "é", "é", "日本語", "x" * 300, "123", "!?", "\r\n"]), st.text(max_size=6)), max_size=14).map("".join))
def test_units_equal_whole_texts(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    a = Tokenizer.from_file(A) if not hasattr(test_units_equal_whole_texts, "libs") else None
    if a is not None:
        a.encode_special_tokens = True
        test_units_equal_whole_texts.libs = (a, sentencepiece.SentencePieceProcessor(model_file=B))
        test_units_equal_whole_texts.pair = alignment.Pair(*alignment.read_files(A, B))
    ids_a, ids_b, groups, links = plain_alignment(text, test_units_equal_whole_texts.libs)
    numbers, got, _, pairs = test_units_equal_whole_texts.pair.documents([text, None, text])
    assert got == [groups, "", groups]
    assert numbers[0].tolist() == [len(ids_a), len(ids_b), groups.count("|") if ids_a else 0, len(links)] == numbers[2].tolist()
    assert Counter(pairs.tolist()) == Counter({(x << 16 | y): 2 * n for (x, y), n in Counter(links).items()})


def test_slice_links_overlap_without_shared_ends():
    a, b = np.array([2, 5, 9, 12]), np.array([4, 9, 12])
    cuts = [np.array(x) for x in alignment.common_ends(a.tolist(), b.tolist())]
    assert [x.tolist() for x in cuts] == [[2, 3], [1, 2]] and alignment.common_ends([3], [3], 7, 9) == ([7], [9])
    assert list(zip(*(x.tolist() for x in alignment.slice_links(a, b, *cuts)), strict=True)) == [(0, 0), (1, 0), (1, 1), (2, 1), (3, 2)]


@pytest.mark.parametrize("hot", [1 << 18, 40])
def test_alignment_of_hard_rows(spark, hard, hard_rows, libraries, hot, monkeypatch):
    monkeypatch.setattr(alignment, "HOT_PAIRS", hot)
    want = [(i, *plain_alignment(t, libraries)) for i, t, *_ in hard_rows]
    docs_of = Counter(p for *_, links in want for p in set(links))
    best = defaultdict(int)
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    rows = Counter((i, len(a), len(b), g.count("|") if a else 0, len(links), sum(docs_of[p] == best[p[0]] for p in links), sum(docs_of[p] for p in links), sha(g) if a else "") for i, a, b, g, links in want)
    assert Counter(map(tuple, alignment.figures(hard, A, B).collect())) == rows


def test_alignment_of_an_empty_table(empty):
    assert alignment.figures(empty, A, B).count() == 0


def test_units_are_forgotten_when_there_are_many(monkeypatch):
    monkeypatch.setattr(alignment, "MOST_UNITS", 5)
    pair = alignment.Pair(*alignment.read_files(A, B))
    texts = ["one two three", "four five six seven " + "y" * 900, "one two three"]
    first = [pair.documents([t])[1][0] for t in texts]
    assert first == pair.documents(texts)[1] and first[0] == first[2]
    assert all(len(u) <= alignment.MOST_KEPT_CHARS for u in pair.at) and len(pair.at) == len(pair.groups) == len(pair.links.counts)


# 12 minhash


def grams_of(text, n):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def plain_components(rows, n, percent):
    sets = [grams_of(t, n) for _, t, *_ in rows]
    lead = list(range(len(rows)))

    def root(i):
        while lead[i] != i:
            i = lead[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                lead[root(i)] = root(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[root(i)].append(i)
    out = Counter()
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            own = min(ids) if ids else None
            out[rows[i][0], len(sets[i]), own, rows[i][0] is not None and rows[i][0] == own] += 1
    return out


@pytest.mark.parametrize("n", [2, 5])
def test_minhash_of_hard_rows(hard, hard_rows, n):
    got = minhash.near_components(hard, minhash.NearRule(ngram=n))
    assert Counter(map(tuple, got.collect())) == plain_components(hard_rows, n, 80)


def test_minhash_of_chains_and_borders(spark, monkeypatch):
    """A chain of texts each near the next only, a template that many texts share below 0.8, copies, and pairs at the threshold, in small blocks."""
    monkeypatch.setattr(minhash, "BLOCK_ROWS", 16)
    words = invented(40, 200).split()
    rows = [(1000 - k, " ".join(words[: k * 4] + [f"new{k}x{j}" for j in range(k * 4)] + words[k * 4 :]) if k else " ".join(words)) for k in range(8)]
    chain = list(words)
    for k in range(40):
        chain = chain[:]
        for j in range(9):
            chain[(k * 9 + j) % 200] = f"c{k}_{j}"
        rows.append((2000 + (k * 7) % 40, " ".join(chain)))
    for k in range(120):  # about 0.7 alike
        rows.append((3000 + k, " ".join(words[:165] + [f"t{k}_{j}" for j in range(35)])))
    rows += [(4000 + k, invented(77, 60)) for k in range(30)]
    exact = [f"e{j}" for j in range(41)]  # 40 shingles; 36 of 40 + 4 others share 36 / 44
    rows += [(5000, " ".join(exact)), (5001, " ".join(exact[:37] + [f"f{j}" for j in range(4)])), (5002, " ".join(exact[:36] + [f"g{j}" for j in range(5)]))]
    got = minhash.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), minhash.NearRule(ngram=2))
    assert Counter(map(tuple, got.collect())) == plain_components(rows, 2, 80)


def test_minima_estimate_the_likeness():
    r = np.random.default_rng(3)
    both = r.integers(0, 1 << 63, 800, dtype=np.uint64)
    x, y = (np.unique(np.concatenate((both, r.integers(0, 1 << 63, 100, dtype=np.uint64)))) for _ in range(2))
    low = minhash.minima(np.concatenate((x, y)), np.repeat([0, 1], [len(x), len(y)]), 2)
    assert abs((low[0] == low[1]).mean() - 0.8) < 0.08
    assert minhash.NearRule(percent=80).least_equal < 0.65 * minhash.MINIMA


def test_minhash_of_an_empty_table(empty):
    assert minhash.near_components(empty).count() == 0


# 13 merkle


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """Levels of a tree, lowest first."""
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def plain_path(tree, i):
    out = []
    for level in tree[:-1]:
        lo = i // 16 * 16
        out.append((level[lo:i], level[i + 1 : lo + 16]))
        i //= 16
    return out


def plain_manifest(rows):
    leaf = lambda r, low=False: H(*(field(v) for v in (r[0], r[3], r[2], r[4])), field(r[1] if not low or r[1] is None else re.sub("[A-Z]", lambda m: m.group().lower(), r[1])))
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = {s: plain_tree([leaf(r) for r in by[s]]) for s in names}
    top = plain_tree([trees[s][-1][0] for s in names])
    out = Counter()
    for k, s in enumerate(names):
        for i, r in enumerate(by[s]):
            path = plain_path(trees[s], i) + plain_path(top, k)
            now = leaf(r, low=r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0)
            for before, after in path:
                now = H(*before, now, *after)
            out[r[0], leaf(r), trees[s][-1][0], top[-1][0], H(*(h for before, after in path for h in before + after)), now, now == top[-1][0]] += 1
    return out


def test_manifest_of_hard_rows(hard, hard_rows):
    assert Counter(map(tuple, merkle.manifest(hard).collect())) == plain_manifest(hard_rows)


@pytest.mark.parametrize("tier_levels", [2, 1])
def test_manifest_of_many_rows(spark, tier_levels):
    """Sources of 1, 16, 17, 256, 257 and 700 rows and two dozen small ones; one tier a level as well."""
    rows, i = [], 0
    for s, n in [("one", 1), ("run", 16), ("more", 17), ("full", 256), ("over", 257), (None, 700), ("", 3), *((f"s{k}é", 2) for k in range(24))]:
        for _ in range(n):
            i += 1
            rows.append(((i * 7919) % 5003, f"Text {i} É", "en" if i % 3 else None, s, i if i % 5 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    assert Counter(map(tuple, merkle.manifest(df, tier_levels=tier_levels).collect())) == plain_manifest(rows)


def test_places_follow_completion():
    for n in (1, 2, 16, 17, 100, 256):
        top = len(merkle.levels(n)) - 1
        log = merkle.append_log((bytes([k % 256]) * 32 for k in range(n)), n, top)
        assert len(log) == sum(merkle.levels(n))
        level = [bytes([k % 256]) * 32 for k in range(n)]
        for at in range(top + 1):
            assert [log[merkle.place(at, k, n, top)] for k in range(len(level))] == level
            level = [merkle.joined(level[k : k + 16]) for k in range(0, len(level), 16)]


def test_manifest_of_an_empty_table(empty):
    assert merkle.manifest(empty).count() == 0


def test_manifest_needs_only_its_fields(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", 1)], "doc_id int, text string, lang string, source string, n_chars long")
    row = merkle.manifest(df.withColumn("tree", F.lit(1)).withColumn("idx", F.lit(2)).withColumn("payload", F.lit(3))).first()
    assert row["verified"] and row["leaf"] == row["subroot"] == row["root"] and row["proof_sha256"] == sha("")


# 6 toxicity: the noisy-or and its gradient by plain loops


def test_noisy_or_by_a_plain_loop(spark):
    r = np.random.default_rng(8)
    weights = np.zeros(toxicity.WEIGHTS, np.float32)
    texts = ["One calm day. You idiot! You idiot idiot moron", "", None, "no marks at all", "A\n\nb. c? d! " * 30, "... !!! ???", "é è. ü ö"]
    for _, _, buf, offs in tb.slices(pa.array(texts, pa.string())):
        _, _, _, _, whole, stems = toxicity.sentences(buf, offs, 5)
        for f in np.unique(np.concatenate((whole, stems))):
            weights[f] = r.normal()
    model = toxicity.Model(weights, -1.5, 5)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in toxicity.scores(df, model).collect()}
    for i, text in enumerate(texts):
        row, first, _, _, whole, stems = toxicity.sentences(*next(tb.slices(pa.array([text], pa.string())))[2:], 5)
        none, hot = 1.0, 0
        for k in range(len(first)):
            end = first[k + 1] if k + 1 < len(first) else len(whole)
            z = -1.5 + sum(float(weights[f]) for f in set(whole[first[k] : end].tolist())) + sum(float(weights[f]) for f in set(stems[first[k] : end].tolist()))
            p = 1 / (1 + math.exp(-z))
            none, hot = none * (1 - p), hot + (p >= 0.5)
        assert abs(got[i]["score"] - (1 - none)) < 1e-6 and got[i]["n_offending"] == hot and got[i]["n_sentences"] == len(first)


def test_gradient_by_differences():
    r = np.random.default_rng(5)
    doc = np.sort(r.integers(0, 6, 15))
    doc[:6] = np.arange(6)
    doc.sort()
    cell, feature = r.integers(0, 15, 40), r.integers(0, 7, 40)
    y, decay = np.array([True, False, True, True, False, False]), 0.01

    def loss(w, bias):
        total = 0.0
        for d in range(6):
            none = 1.0
            for s in np.flatnonzero(doc == d):
                z = bias + sum(w[f] for c, f in zip(cell, feature, strict=True) if c == s)
                none *= 1 - 1 / (1 + math.exp(-z))
            total -= math.log(1 - none if y[d] else none)
        return total / 6 + decay / 2 * float((w**2).sum())

    w, bias, step = r.normal(size=7), -0.7, 1e-5
    got = toxicity.gradient(w, bias, cell, feature, doc, y, decay)
    for k in range(7):
        move = np.zeros(7)
        move[k] = step
        assert abs(got[k] - (loss(w + move, bias) - loss(w - move, bias)) / (2 * step)) < 1e-6
    assert abs(got[7] - (loss(w, bias + step) - loss(w, bias - step)) / (2 * step)) < 1e-6
