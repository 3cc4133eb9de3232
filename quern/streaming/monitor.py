"""Workers watched over a stream: partial updates merged, silence noticed, rollups kept live.

The operators keep their state with `transformWithState`: a map of fields, a value
with a timer, sums with what each worker last added to them.  Rows are combined by
key inside each task before they are shuffled, so a worker with a large part of all
events sends a row a task and batch.  Results do not depend on the number or the
order of files.  Rows with a null key or time are left out; null fields change
nothing; empty streams give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quern.streaming.events import drained, source

#: How late a sign of life may come and still count, and silence after which a worker is stale.
LATE_MS = 3650 * 86_400_000
SILENCE_MS = 86_400_000
STATES = ("CLOSED", "HALF_OPEN", "OPEN")


class FieldMerge(StatefulProcessor):
    """The last value of each field of a key by (at, id); fields that an update lacks keep theirs."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fields = handle.getMapState("fields", "field string", "at long, id long, value string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        changed: dict[str, tuple] = {}
        for f in rows:
            for field, *new in zip(f["field"], f["at"], f["id"], f["value"], strict=True):
                new = (int(new[0]), int(new[1]), new[2])
                if field not in changed or changed[field][:2] < new[:2]:
                    changed[field] = new
        out = []
        for field, new in changed.items():
            old = self.fields.getValue((field,)) if self.fields.containsKey((field,)) else None
            if old is None or (old[0], old[1]) < new[:2]:
                self.fields.updateValue((field,), new)
                out.append((key[0], field, new[2], new[0]))
        yield pd.DataFrame(out, columns=["worker", "field", "value", "at"])

    def close(self) -> None:
        pass


class DeadMan(StatefulProcessor):
    """A key is stale once the clock (the latest event of all) is over the silence past its last sign; a later sign revives it.

    The watermark is `late` behind the clock, so timers are set that much earlier and no row is dropped.
    """

    def __init__(self, silence_ms: int, late_ms: int) -> None:
        self.wait = silence_ms - late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sign = handle.getValueState("sign", "seen long, n long, stale boolean, seq long")

    def _said(self, key, seen, n, stale, seq) -> pd.DataFrame:
        self.sign.update((seen, n, stale, seq))
        return pd.DataFrame({"worker": [key[0]], "seen": [seen], "n": [n], "is_stale": [stale], "seq": [seq]})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen, n, stale, seq = self.sign.get() if self.sign.exists() else (None, 0, False, 0)
        new, more = seen, 0
        for f in rows:
            last = int(f["micros"].max())
            new, more = last if new is None else max(new, last), more + int(f["n"].sum())
        if new != seen:
            if seen is not None and not stale:
                self.handle.deleteTimer(-(-seen // 1000) + self.wait)
            self.handle.registerTimer(-(-new // 1000) + self.wait)
            stale = False
        yield self._said(key, new, n + more, stale, seq + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seen, n, stale, seq = self.sign.get()
        if not stale:
            yield self._said(key, seen, n, True, seq + 1)

    def close(self) -> None:
        pass


class WorkerDeltas(StatefulProcessor):
    """A worker's sums, and what they change in the rollup of all: its new figures less those it gave before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "done long, total long, started long, state int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        old = self.sums.get() if self.sums.exists() else None
        done, total, started, state = old or (0, 0, None, 0)
        for f in rows:
            done, total, state = done + int(f["done"].sum()), total + int(f["total"].sum()), max(state, int(f["state"].max()))
            first = int(f["started"].min())
            started = first if started is None else min(started, first)
        self.sums.update((done, total, started, state))
        now, before = _figures(done, total, state), _figures(*old[:2], old[3]) if old else [0] * 8
        yield pd.DataFrame([[0, started, *(x - y for x, y in zip(now, before, strict=True))]], columns=["all", "started", *FIGURES])

    def close(self) -> None:
        pass


FIGURES = ("workers", "done", "total", "busy", "rates", *STATES)


def _figures(done: int, total: int, state: int) -> list:
    return [1, done, total, int(done > 0), done / total * 100 if done else 0.0, *(int(state == k) for k in range(len(STATES)))]


class Rollup(StatefulProcessor):
    """Sums of all workers' changes; the worst state that any worker has."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("all", "started long, workers long, done long, total long, busy long, rates double, CLOSED long, HALF_OPEN long, OPEN long, seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        started, *sums, seq = self.sums.get() if self.sums.exists() else (None, 0, 0, 0, 0, 0.0, 0, 0, 0, 0)
        for f in rows:
            first = int(f["started"].min())
            started = first if started is None else min(started, first)
            sums = [x + (float(f[c].sum()) if c == "rates" else int(f[c].sum())) for x, c in zip(sums, FIGURES, strict=True)]
        self.sums.update((started, *sums, seq + 1))
        has = dict(zip(FIGURES, sums, strict=True))
        worst = next((s for s in reversed(STATES) if has[s] > 0), None)
        rate = has["rates"] / has["busy"] if has["busy"] else None
        yield pd.DataFrame({"all": [0], "workers": [has["workers"]], "done": [has["done"]], "total": [has["total"]], "mean_rate": [rate], "started": [started], "worst": [worst], "seq": [seq + 1]}).astype({"mean_rate": "float64"})

    def close(self) -> None:
        pass


def combined(rows: DataFrame, keys: list[str], how: dict[str, str], shape: str) -> DataFrame:
    """Rows of a stream folded by key inside each task's batches: sums, minima, maxima."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.groupby(keys, as_index=False, sort=False).agg(how)[[*keys, *how]]

    return rows.select(*keys, *how).mapInPandas(run, shape)


def _last_fields(rows: DataFrame) -> DataFrame:
    """Of (worker, field, at, id, value) the last row of each field inside each task's batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield f.sort_values(["at", "id"]).drop_duplicates(["worker", "field"], keep="last")

    return rows.mapInPandas(run, rows.schema)


def merged_fields(updates: DataFrame) -> DataFrame:
    """(worker, field, value, at): each worker's fields as they change, from a stream of (worker, at, id, fields map)."""
    each = updates.where("worker is not null and at is not null").select("worker", "at", "id", F.explode("fields").alias("field", "value")).where("value is not null").select("worker", "field", "at", "id", "value")
    return _last_fields(each).groupBy("worker").transformWithStateInPandas(FieldMerge(), "worker long, field string, value string, at long", "Update", "None")


def dead_man(signs: DataFrame, silence_ms: int = SILENCE_MS, late_ms: int = LATE_MS) -> DataFrame:
    """(worker, seen, n, is_stale, seq): a row for each change, from a stream of (worker, ts)."""
    each = signs.where("worker is not null and ts is not null").select("worker", F.unix_micros("ts").alias("micros"), F.lit(1).cast("long").alias("n"))
    met = combined(each, ["worker"], {"micros": "max", "n": "sum"}, "worker long, micros long, n long")
    met = met.withColumn("clock", F.timestamp_micros("micros")).withWatermark("clock", f"{late_ms} milliseconds")
    return met.groupBy("worker").transformWithStateInPandas(DeadMan(silence_ms, late_ms), "worker long, seen long, n long, is_stale boolean, seq long", "Update", "EventTime")


def rollup(visits: DataFrame) -> DataFrame:
    """One row for all workers as it changes, from a stream of (worker, ts, ok, state): two stateful steps in one query."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("state")).cast("int") - 1, F.lit(0))
    each = visits.where("worker is not null and ts is not null").select("worker", F.col("ok").cast("long").alias("done"), F.lit(1).cast("long").alias("total"), F.unix_micros("ts").alias("started"), rank.alias("state"))
    met = combined(each, ["worker"], {"done": "sum", "total": "sum", "started": "min", "state": "max"}, "worker long, done long, total long, started long, state int")
    shape = "all int, started long, workers long, done long, total long, busy long, rates double, CLOSED long, HALF_OPEN long, OPEN long"
    deltas = met.groupBy("worker").transformWithStateInPandas(WorkerDeltas(), shape, "Append", "None")
    met = combined(deltas, ["all"], {"started": "min", **{c: "sum" for c in FIGURES}}, shape)
    return met.groupBy("all").transformWithStateInPandas(Rollup(), "all int, workers long, done long, total long, mean_rate double, started long, worst string, seq long", "Append", "None")


def stream_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers' status after partial updates: each kind of event sets some fields, and what it lacks stays."""
    e = F.col("event_type")
    sets = {
        "status": F.when(e == "signup", "running").when(e == "error", "failed").when(e == "purchase", "done"), "current": F.when(e == "view", F.get_json_object("props", "$.k")), "processed": F.when(e == "click", F.floor("value").cast("string")),
        "error": F.when((e == "error") & (F.col("value") > 10), F.get_json_object("props", "$.k")),
    }
    fields = F.map_from_arrays(F.array(*[F.lit(k) for k in sets]), F.array(*sets.values()))
    updates = source(spark, sf_dir).select(F.col("user_id").alias("worker"), F.unix_micros("ts").alias("at"), F.col("event_id").alias("id"), fields.alias("fields"))
    last = drained(merged_fields(updates), ["worker", "field"], "fields", within=["at"])
    return last.select("worker", "field", "value")


def stream_staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users without an event in the day before the latest one are stale, as the stream's timers say."""
    s = dead_man(source(spark, sf_dir).select(F.col("user_id").alias("worker"), "ts"))
    return drained(s, ["worker"], "seen", within=["seq"]).select(F.col("worker").alias("user_id"), "n", "is_stale")


def stream_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All users as one row: sums, mean rate of the busy ones, first start, the worst breaker state."""
    k = F.col("event_id")
    state = F.when(k % 10 == 0, "OPEN").when(k % 10 == 1, "HALF_OPEN").otherwise("CLOSED")
    v = source(spark, sf_dir).select(F.col("user_id").alias("worker"), "ts", (F.col("event_type") != "error").alias("ok"), state.alias("state"))
    last = drained(rollup(v), ["all"], "rollup", within=["seq"], mode="append")
    return last.select("workers", "done", "total", F.round("mean_rate", 6).alias("mean_rate"), F.timestamp_micros("started").cast("timestamp_ntz").alias("started"), "worst")


QUERIES = {f.__name__: f for f in (stream_fields, stream_staleness, stream_rollup)}

SQL = {
    "stream_fields": """WITH u AS (SELECT user_id AS worker, ts, event_id, 'status' AS field, CASE event_type WHEN 'signup' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' END AS value FROM events
UNION ALL SELECT user_id, ts, event_id, 'current', CASE WHEN event_type = 'view' THEN json_extract_string(props, '$.k') END FROM events
UNION ALL SELECT user_id, ts, event_id, 'processed', CASE WHEN event_type = 'click' THEN CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) END FROM events
UNION ALL SELECT user_id, ts, event_id, 'error', CASE WHEN event_type = 'error' AND value > 10 THEN json_extract_string(props, '$.k') END FROM events)
SELECT worker, field, arg_max(value, (ts, event_id)) AS value FROM u WHERE value IS NOT NULL GROUP BY worker, field""",
    "stream_staleness": "SELECT user_id, count(*) AS n, epoch_us((SELECT max(ts) FROM events)) - epoch_us(max(ts)) > 86400000000 AS is_stale FROM events GROUP BY user_id",
    "stream_rollup": """WITH w AS (SELECT user_id, count(*) FILTER (event_type <> 'error') AS done, count(*) AS total, min(ts) AS started, max(CASE event_id % 10 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END) AS state FROM events GROUP BY user_id)
SELECT count(*) AS workers, CAST(sum(done) AS BIGINT) AS done, CAST(sum(total) AS BIGINT) AS total, round(avg(CASE WHEN done > 0 THEN done / total * 100 END), 6) AS mean_rate, min(started) AS started, ['CLOSED', 'HALF_OPEN', 'OPEN'][max(state) + 1] AS worst FROM w""",
}
