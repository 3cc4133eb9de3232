"""Structured Streaming over the events table: keyed merges, windows, rolling buffers, staleness.

Every stream reads the files with `availableNow`, keeps its checkpoint and its
output in the shared folder, and gives back the last value of each key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quern.plans.base import table
from quern.sources.shared import new_path


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream, their time in the session's zone so that watermarks work."""
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", F.col("ts").cast("timestamp"))


#: The state store that `transformWithState` needs; set while a stream starts.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def drained(stream: DataFrame, keys: list[str], name: str, within: list[str] | None = None, mode: str = "update") -> DataFrame:
    """Runs the stream over all that is there and returns each key's last row: of its last batch, and there the largest `within`."""
    spark = stream.sparkSession
    out = new_path(spark, name)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number).cast("long")).write.mode("append").parquet(out)

    before = spark.conf.get(STORE[0], None)
    spark.conf.set(*STORE)
    try:
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{name}-log")).trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        if before is None:
            spark.conf.unset(STORE[0])
        else:
            spark.conf.set(STORE[0], before)
    schema = stream.withColumn("_batch", F.lit(0).cast("long")).schema
    rows = spark.read.schema(schema).parquet(out)
    rest = [c for c in stream.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_batch", *(within or []))).alias("_r"))
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def stream_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of each user and how many came."""
    last = F.max_by(F.struct("event_type", "value"), F.struct("ts", "event_id"))
    s = source(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), last.alias("l")).select("user_id", "n", "l.event_type", "l.value")
    return drained(s, ["user_id"], "latest")


def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each day and kind, however late; the state is a row per day and kind."""
    s = source(spark, sf_dir).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"))
    return drained(s.select(F.to_date("window.start").alias("day"), "event_type", "n"), ["day", "event_type"], "daily")


def stream_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts and successes of each kind, as feedback comes in."""
    s = source(spark, sf_dir).groupBy("event_type").agg(F.count("*").alias("attempts"), F.count_if(F.col("value") > 50).alias("successes"))
    return drained(s, ["event_type"], "success")


def _rolling(n: int) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(zip(*state.get, strict=True)) if state.exists else []
        for f in frames:
            held += list(zip(f["at"].tolist(), f["event_id"].tolist(), strict=True))
            held = sorted(held)[-n:]
        state.update(([a for a, _ in held], [e for _, e in held]))
        yield pd.DataFrame({"user_id": [key[0]], "events": [",".join(str(e) for _, e in held)]})

    return step


def stream_last_n(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    """The last n events of each user in a buffer of that size."""
    s = source(spark, sf_dir).select("user_id", F.unix_micros("ts").alias("at"), "event_id")
    s = s.groupBy("user_id").applyInPandasWithState(_rolling(n), "user_id long, events string", "at array<long>, ids array<long>", "update", GroupStateTimeout.NoTimeout)
    return drained(s, ["user_id"], "last-n")


QUERIES = {f.__name__: f for f in (stream_latest, stream_daily, stream_success, stream_last_n)}

SQL = {
    "stream_latest": "SELECT user_id, count(*) AS n, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY user_id",
    "stream_daily": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_success": "SELECT event_type, count(*) AS attempts, count(*) FILTER (value > 50) AS successes FROM events GROUP BY 1",
    "stream_last_n": "SELECT user_id, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY ts, event_id) AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 5 GROUP BY user_id",
}
