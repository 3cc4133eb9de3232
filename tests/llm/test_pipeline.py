"""Stages 2 to 5 of the pipeline, each on its own input, against plain versions; no rows; names that clash."""

from __future__ import annotations

import random
import re
import string

import pytest
from pyspark.sql import functions as F

from quern.llm import line_rules, packing
from tests.llm.conftest import SCHEMA, invented
from tests.llm.test_new_operators import WORD, grams_of

CLASH = ("id", "_tag", "_gone", "_again", "t1", "t2", "row", "sid", "comp", "key", "bucket", "_nth")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(21)
    passages = [invented(300 + k, 45) for k in range(4)]
    out = []
    for k in range(70):
        kind = k % 7
        text = invented(k if kind != 1 else k - 1, 90)
        if kind == 1:
            text = text.replace(" the", " thee", 1)
        if kind == 2:
            text = invented(900 + k, 30) + "\n" + r.choice(passages) + "\n" + invented(950 + k, 40)
        if kind == 3:
            text = invented(k, 60) + "\nHome | News | About\nAll rights reserved by us\n!!! ... ??? ;;; --- ***\n" + invented(k + 500, 30) + "\n\n"
        if kind == 4:
            text = "Home | News | About | More | Links\n" * 9 + invented(k, 12)
        if kind == 5:
            text = r.choice(["", None, "few words only", "again and again " * 30, "\n \n", invented(k, 60).replace(" ", "\t", 9)])
        out.append((1000 - k * 3, text, None if k % 5 == 0 else "en", "hot" if k % 3 else None, None if text is None else len(text)))
    return out + [out[0], out[9], (None, invented(7000, 50), "en", "x", 9), (None, out[2][1], "de", None, 3)]


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for name in CLASH:
        df = df.withColumn(name, F.concat(F.lit(f"{name}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))))
    return df


def read(df, clash=True):
    got = df.collect()
    if clash:
        assert all(r[name] == f"{name}:{'-' if r['doc_id'] is None else r['doc_id']}" for r in got for name in CLASH)
    return sorted(((r["doc_id"], r["text"]) for r in got), key=repr)


def words(text):
    return WORD.findall(text or "")


def plain_rules(text):
    """The kept text, or None where the document goes."""
    rules, w = line_rules.LineRules(), words(text)
    runs = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    inside = {i + j for i, x in enumerate(runs) if runs.count(x) > 1 for j in range(5)}
    lost, kept = 0, []
    for line in (text or "").split("\n"):
        n = len(words(line))
        noise = sum(c in string.punctuation for c in line) > rules.noise_per_word * n + 4
        menus = sum(x in "|>/" for x in words(line) if len(x) == 1)
        site = any(p in re.sub("[A-Z]", lambda m: m.group().lower(), line) for p in rules.boilerplate)
        if n and (noise or (menus >= 2 and menus >= 0.25 * n) or site):
            lost += n
        else:
            kept.append(line)
    if len(w) < 10 or 100 * len(inside) > 20 * len(w) or lost > 0.4 * len(w):
        return None
    return "\n".join(kept)


def test_quality_rules(spark, rows, stages):
    want = [(i, plain_rules(t)) for i, t, *_ in rows]
    got = stages["quality rules"](spark, frame(spark, rows), "")
    assert got.columns == frame(spark, rows).columns
    assert read(got) == sorted(((i, t) for i, t in want if t is not None), key=repr) and 10 < got.count() < len(rows)
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect())


def test_near_copies(spark, rows, stages):
    sets = [grams_of(t, 5) for _, t, *_ in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    want = set()
    for g in set(group):
        members = [(rows[i][0], rows[i][1]) for i in range(len(rows)) if group[i] == g]
        ids = [i for i, _ in members if i is not None]
        want |= {(i, t) for i, t in members if i == min(ids)} if ids else set(members)
    got = read(stages["near copies"](spark, frame(spark, rows), ""))
    assert len(got) == len(set(got)) and set(got) == want and len(want) < len(rows) - 8


def test_repeated_passages(spark, rows, stages):
    real = sorted({r[0]: r for r in rows if r[0] is not None}.values())
    seen, want = set(), []
    for i, t, *_ in real:
        spans = [(m.start(), m.end()) for m in WORD.finditer(t or "")]
        w, gone = words(t), set()
        for k in range(len(w) - 19):
            run = tuple(w[k : k + 20])
            gone |= set(range(k, k + 20)) if run in seen else set()
            seen.add(run)
        out, at = "", 0
        for k, (start, end) in enumerate(spans):
            if k in gone:
                out += (t or "")[at:start] if k - 1 not in gone else ""
                at = spans[k + 1][0] if k + 1 < len(spans) else end
        want.append((i, (t or "") if not gone else out + t[at:]))
    got = [(i, t or "") for i, t in read(stages["repeated passages"](spark, frame(spark, real), ""))]
    assert got == sorted(want, key=repr) and sum(t != (r[1] or "") for (_, t), r in zip(want, real, strict=True)) > 8


def test_packing(spark, rows, stages):
    got = stages["packing"](spark, frame(spark, rows), "").collect()
    sizes = sorted(max(1, len(words(t))) for _, t, *_ in rows)
    rule = packing.PackRule()
    borders = packing.best_borders(*__import__("numpy").unique(sizes, return_counts=True), rule.buckets)
    assert sorted((r["n_tokens"], r["bucket"], r["padding"]) for r in got) == sorted((n, b, b - n) for n in (len(words(t)) for _, t, *_ in rows) for b in [min(x for x in borders if x >= n)])
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["chunk"], r["batch"]), []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) and len(s) <= max(1, rule.budget // b) for (b, _, _), s in batches.items())


def test_no_rows(spark, stages, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
