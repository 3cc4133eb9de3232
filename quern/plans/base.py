"""Tables and derived stand-ins that the query modules share, for Spark and for SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.exprs import NOT_FOUND


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts about customers, with missing, empty and sentinel values."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("fact_id"),
        F.col("o_custkey").alias("child_id"),
        F.when(k % 3 == 0, "AdorationSchedule").when(k % 3 == 1, "ReconciliationSchedule").otherwise("MassSchedule").alias("fact_type"),
        F.when(k % 7 == 0, None).when(k % 11 == 0, "").when(k % 5 == 0, NOT_FOUND).otherwise(F.col("o_orderpriority")).alias("fact_value"),
        F.when(F.col("o_orderstatus") == "F", "ai").otherwise("keyword").alias("method"),
        (k % 101).cast("int").alias("score"),
        F.concat(F.lit('{"has_weekly_schedule": '), F.when(k % 2 == 0, "true").otherwise("false"), F.lit(', "frequency": "'), F.lower("o_orderpriority"), F.lit('"}')).alias("data"),
        F.col("o_orderdate").alias("created_at"),
    )


FACTS_SQL = f"""facts AS (
  SELECT o_orderkey AS fact_id, o_custkey AS child_id,
         CASE WHEN o_orderkey % 3 = 0 THEN 'AdorationSchedule' WHEN o_orderkey % 3 = 1 THEN 'ReconciliationSchedule' ELSE 'MassSchedule' END AS fact_type,
         CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 5 = 0 THEN '{NOT_FOUND}' ELSE o_orderpriority END AS fact_value,
         CASE WHEN o_orderstatus = 'F' THEN 'ai' ELSE 'keyword' END AS method,
         CAST(o_orderkey % 101 AS INTEGER) AS score,
         '{{"has_weekly_schedule": ' || CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END || ', "frequency": "' || lower(o_orderpriority) || '"}}' AS data,
         o_orderdate AS created_at
  FROM orders
)"""

HAS_DATA_SQL = f"coalesce(fact_value, '') NOT IN ('', '{NOT_FOUND}')"


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as page visits of workers: state, success, response seconds, quality."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("worker"),
        "event_type",
        "value",
        "props",
        F.when(e % 5 == 0, 404).when(e % 17 == 0, 500).otherwise(200).alias("status"),
        (F.col("event_type") != "error").alias("ok"),
        F.when(e % 9 == 0, None).otherwise(F.col("value")).alias("seconds"),
        F.when(e % 4 == 0, None).otherwise((e % 11) / 10.0).alias("quality"),
        F.when(e % 10 == 0, "OPEN").when(e % 10 == 1, "HALF_OPEN").otherwise("CLOSED").alias("state"),
    )


VISITS_SQL = """visits AS (
  SELECT event_id, ts, user_id AS worker, event_type, value, props,
         CASE WHEN event_id % 5 = 0 THEN 404 WHEN event_id % 17 = 0 THEN 500 ELSE 200 END AS status,
         event_type <> 'error' AS ok,
         CASE WHEN event_id % 9 = 0 THEN NULL ELSE value END AS seconds,
         CASE WHEN event_id % 4 = 0 THEN NULL ELSE (event_id % 11) / 10.0 END AS quality,
         CASE WHEN event_id % 10 = 0 THEN 'OPEN' WHEN event_id % 10 = 1 THEN 'HALF_OPEN' ELSE 'CLOSED' END AS state
  FROM events
)"""
