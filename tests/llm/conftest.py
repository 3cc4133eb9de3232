from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def invented(seed: int, words: int) -> str:
    r = random.Random(seed)
    parts = ["the", "of", "ing", "tion", "re", "ou", "é", "sch", "ent", "ha"]
    out = []
    for i in range(words):
        out.append("".join(r.choice(parts) for _ in range(r.randint(1, 3))) + ("." if i % 9 == 8 else ""))
    return " ".join(out)


@pytest.fixture(scope="session")
def hard_rows():
    """Nulls, empties, copies, near copies, shared passages, short and long texts, a repeated row."""
    base = invented(1, 120)
    passage = invented(2, 60)
    rows = [
        (3, base), (1, base), (2, base.replace("the ", "the the ", 1)), (4, None), (5, ""), (6, "  \n\t "), (7, "one"), (8, "one two"), (9, "One TWO"),
        (10, invented(3, 50) + "\n" + passage + "\n" + invented(4, 40)), (11, passage + " " + invented(5, 30)), (12, invented(6, 9)),
        (13, "x " * 400), (14, "word " * 25 + "\nword " * 25), (15, invented(7, 20000)), (16, "<|endoftext|> Σ ½ ’s\x1c\x85 é é <|startoftext|>"), (16, "other text under one id " + passage),
        (17, base), (17, base), (None, "no id " + passage), (-5, "clown " + invented(8, 30)),
    ]
    return [(i, t, None if i == 2 else "en", None, None if t is None else len(t)) for i, t in rows]


@pytest.fixture(scope="session")
def hard(spark, hard_rows):
    """With columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(hard_rows, SCHEMA).repartition(3)
    for name in ("id", "d", "at", "n", "score", "sid", "comp", "label", "bucket", "_id", "h", "kept", "u", "v", "_tag", "_gone", "_again", "_text", "_doc", "t1", "t2", "row", "key", "tree", "idx", "n_chars_"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
