"""The subpackage's queries on the smallest tables, their SQL twins, and the pipeline."""

from __future__ import annotations

import os

import duckdb
import pytest

from quern.llm.oracles import ORACLES
from quern.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=repr)
    table = {"op1_warc": "pages", "op5_chat": None}.get(name, "documents")
    if table:
        assert len(got) == spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name in ORACLES:
        c = duckdb.connect()
        for t in ("documents", "pages", "conversations", "labels"):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
        q = c.execute(ORACLES[name])
        names = [d[0] for d in q.description]
        assert sorted(names) == sorted(df.columns)
        assert got == sorted((tuple(dict(zip(names, r, strict=True))[x] for x in sorted(names)) for r in q.fetchall()), key=repr)


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n, columns = docs.count(), docs.columns
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 0 < docs.count() <= n
        n = docs.count()
    last = p.STAGES[-1][1](spark, docs, SF)
    assert last.count() == n
    assert p.run(spark, SF).count() == n
