"""Streams of workers against batch folds, whatever the files' number and order."""

from __future__ import annotations

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quern.streaming import monitor as M
from quern.streaming.events import STORE, drained

START = datetime(2024, 3, 1)
SHAPE = "worker long, ts timestamp, id long, status string, done string, ok boolean, state string"


def events(seed, n=160, hours=100):
    r = random.Random(seed)
    out = []
    for i in range(n):
        at = START + timedelta(microseconds=r.randint(0, hours * 3_600_000_000))
        out.append((None if i == 5 else r.choice([1, 1, 1, 2, 3, 4]), None if i == 6 else at, i, r.choice([None, "running", "paused"]), r.choice([None, str(i)]), r.random() < 0.7, r.choice(["CLOSED", "CLOSED", "HALF_OPEN", "OPEN", None])))
    out += [(9, START, 900, "running", None, False, None), (8, START + timedelta(hours=hours), 901, None, None, True, "HALF_OPEN")]
    return out


def files(spark, folder, rows, order):
    """Rows by time in six files that a stream takes two at a time, in that order of their names' and modification times."""
    rows = sorted(rows, key=lambda x: (x[1] or START, x[2]))
    if order == "reversed":
        rows = rows[::-1]
    if order == "mixed":
        random.Random(3).shuffle(rows)
    for k in range(6):
        path = f"{folder}/{order}/{k}"
        spark.createDataFrame(rows[k::6] if order == "mixed" else rows[k * len(rows) // 6 : (k + 1) * len(rows) // 6], SHAPE).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + k * 60,) * 2)
    return spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 2).parquet(f"{folder}/{order}/*")


@pytest.mark.parametrize("order", ["reversed", "mixed"])
def test_streams_equal_batch_folds(spark, tmp_path, order):
    rows = events(4)
    real = [x for x in rows if x[0] is not None and x[1] is not None]
    stream = files(spark, tmp_path, rows, order)

    fields = F.create_map(F.lit("status"), F.col("status"), F.lit("done"), F.col("done"))
    got = drained(M.merged_fields(stream.select("worker", F.unix_micros("ts").alias("at"), "id", fields.alias("fields"))), ["worker", "field"], "t", within=["at"])
    want = {}
    for w, at, i, status, done, *_ in real:
        for field, value in (("status", status), ("done", done)):
            if value is not None and want.get((w, field), (START - timedelta(1), 0, ""))[:2] < (at, i):
                want[w, field] = (at, i, value)
    assert {(x["worker"], x["field"]): x["value"] for x in got.collect()} == {k: v[2] for k, v in want.items()}

    now = max(x[1] for x in real)
    for silence in (3_600_000, 86_400_000):
        got = drained(M.dead_man(stream.select("worker", "ts"), silence_ms=silence), ["worker"], "t", within=["seq"])
        want = {}
        for w, at, *_ in real:
            seen, n = want.get(w, (at, 0))
            want[w] = (max(seen, at), n + 1)
        assert {x["worker"]: (x["n"], x["is_stale"]) for x in got.collect()} == {w: (n, now - seen > timedelta(milliseconds=silence)) for w, (seen, n) in want.items()}

    got = drained(M.rollup(stream.select("worker", "ts", "ok", "state")), ["all"], "t", within=["seq"], mode="append").first()
    by = {}
    for w, at, _, _, _, ok, state in real:
        d, t, s, k = by.get(w, (0, 0, at, 0))
        by[w] = (d + ok, t + 1, min(s, at), max(k, M.STATES.index(state or "CLOSED")))
    rates = [d / t * 100 for d, t, *_ in by.values() if d]
    assert (got["workers"], got["done"], got["total"], got["worst"]) == (len(by), sum(x[0] for x in by.values()), sum(x[1] for x in by.values()), M.STATES[max(x[3] for x in by.values())])
    assert abs(got["mean_rate"] - sum(rates) / len(rates)) < 1e-9 and got["started"] == int(min(x[2] for x in by.values()).timestamp() * 1_000_000)


def test_a_late_sign_revives_a_stale_worker(spark, tmp_path):
    hour = timedelta(hours=1)
    row = lambda w, h: (w, START + h * hour, h, None, None, True, None)
    for k, rows in enumerate([[row(1, 0), row(2, 0)], [row(2, 30)], [row(2, 31)], [row(1, 32), row(2, 32)]]):
        path = f"{tmp_path}/in/{k}"
        spark.createDataFrame(rows, SHAPE).coalesce(1).write.parquet(path)
        for name in os.listdir(path):
            os.utime(f"{path}/{name}", (1_700_000_000 + k * 60,) * 2)
    stream = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    out = str(tmp_path / "out")
    spark.conf.set(*STORE)
    M.dead_man(stream.select("worker", "ts")).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("append").parquet(out)).start().awaitTermination()
    spark.conf.unset(STORE[0])
    got = [(x["is_stale"], x["n"]) for x in sorted(spark.read.parquet(out).where("worker = 1").collect(), key=lambda x: x["seq"])]
    assert got == [(False, 1), (True, 1), (False, 2)]


def test_session_is_left_as_it_was(spark, tmp_path):
    before = spark.conf.get(STORE[0], None)
    stream = files(spark, tmp_path, events(5, 10), "sorted")
    drained(M.dead_man(stream.select("worker", "ts")), ["worker"], "t", within=["seq"])
    assert spark.conf.get(STORE[0], None) == before
