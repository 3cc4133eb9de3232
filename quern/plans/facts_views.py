"""Views over facts, and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.operators import relational as R
from quern.plans.base import FACTS_SQL, facts, table

_KINDS = (("Adoration", "adoration"), ("Reconciliation", "reconciliation"))


def fact_summary_view(spark: SparkSession, d: str) -> DataFrame:
    """Each child's facts of two types, as flags, confidences and frequencies.

    The frequency is a maximum of texts, so 'unknown' wins over most others.
    """
    f = facts(spark, d).where(F.col("fact_type").isin("AdorationSchedule", "ReconciliationSchedule"))
    c = table(spark, d, "customer")
    ai, keyword = F.col("method") == "ai", F.col("method") != "ai"
    out = []
    for word, name in _KINDS:
        kind = F.col("fact_type").like(f"%{word}%")
        weekly = F.when(kind & ai & (F.col("score") >= 70), F.get_json_object("data", "$.has_weekly_schedule").cast("boolean")).when(kind & keyword, F.col("fact_value").isNotNull() & (F.col("fact_value") != X.NOT_FOUND)).otherwise(False)
        out += [
            F.bool_or(weekly).alias(f"has_weekly_{name}"),
            F.max(F.when(kind & ai, F.col("score")).when(kind & keyword, 50)).alias(f"{name}_confidence"),
            F.max(F.when(kind & ai, F.get_json_object("data", "$.frequency")).otherwise("unknown")).alias(f"{name}_frequency"),
        ]
    g = f.groupBy("child_id").agg(*out, F.count_if(ai).alias("ai_extractions"), F.count_if(keyword).alias("keyword_extractions"), F.max("created_at").alias("last_updated"))
    return c.select("c_custkey", "c_name", "c_nationkey").join(g, F.col("c_custkey") == F.col("child_id")).drop("child_id")


def high_quality_view(spark: SparkSession, d: str) -> DataFrame:
    f, c = facts(spark, d), table(spark, d, "customer").select("c_custkey", "c_name")
    return f.where((F.col("method") == "ai") & (F.col("score") >= 90) & F.col("fact_type").isin("AdorationSchedule", "ReconciliationSchedule")).join(c, F.col("child_id") == F.col("c_custkey"), "left").select("fact_id", "child_id", "c_name", "fact_type", "score").orderBy(F.col("score").desc(), "fact_id")


def active_keywords_view(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where((F.col("p_size") > 10) & F.col("p_brand").isNotNull()).select("p_partkey", "p_type", "p_size").orderBy("p_type", F.col("p_size").desc(), "p_partkey")


def newest_joined(spark: SparkSession, d: str) -> DataFrame:
    f, c = facts(spark, d), table(spark, d, "customer").select("c_custkey", "c_name")
    return f.join(c, F.col("child_id") == F.col("c_custkey"), "left").select("fact_id", "c_name", "created_at").orderBy(F.col("created_at").desc(), "fact_id").limit(50)


def _slices(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    f = facts(spark, d).select("child_id", "fact_type", "fact_value", "score", "fact_id")
    old = R.latest_by(f.where("fact_id % 2 = 0"), ["child_id", "fact_type"], ["fact_id"])
    return old, f.where("fact_id % 2 = 1")


def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    old, new = _slices(spark, d)
    return R.upsert(old, new, ["child_id", "fact_type"], ["fact_id"])


def upsert_partial(spark: SparkSession, d: str) -> DataFrame:
    """New rows give a value only; score and id stay."""
    old, new = _slices(spark, d)
    return R.partial_upsert(old, R.latest_by(new, ["child_id", "fact_type"], ["fact_id"]), ["child_id", "fact_type"], ["fact_value"])


def insert_or_update(spark: SparkSession, d: str) -> DataFrame:
    """New rows matched by name, then by segment and balance, and whether they add or update."""
    c = table(spark, d, "customer")
    old = c.where("c_custkey % 3 <> 0").select("c_custkey", "c_nationkey", "c_name", F.col("c_acctbal").alias("web"))
    new = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("new_id"), "c_nationkey", F.when(F.col("c_custkey") % 5 == 0, F.lit("renamed")).otherwise(F.col("c_name")).alias("c_name"), F.col("c_acctbal").alias("web"))
    return R.resolve_by_two_keys(new, old, ["c_nationkey", "c_name"], ["c_nationkey", "web"], "c_custkey").select("new_id", "existing_id", "outcome")


def conditional_update(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 4 == 0), "failed").otherwise(F.col("o_orderstatus"))
    return o.select("o_orderkey", status.alias("status"))


QUERIES = {f.__name__: f for f in (fact_summary_view, high_quality_view, active_keywords_view, newest_joined, upsert_latest, upsert_partial, insert_or_update, conditional_update)}


def _kind_sql(word: str, name: str) -> str:
    return f"""bool_or(CASE WHEN fact_type LIKE '%{word}%' AND method = 'ai' AND score >= 70 THEN CAST(json_extract_string(data, '$.has_weekly_schedule') AS BOOLEAN)
  WHEN fact_type LIKE '%{word}%' AND method <> 'ai' THEN fact_value IS NOT NULL AND fact_value <> '{X.NOT_FOUND}' ELSE false END) AS has_weekly_{name},
max(CASE WHEN fact_type LIKE '%{word}%' AND method = 'ai' THEN score WHEN fact_type LIKE '%{word}%' THEN 50 END) AS {name}_confidence,
max(CASE WHEN fact_type LIKE '%{word}%' AND method = 'ai' THEN json_extract_string(data, '$.frequency') ELSE 'unknown' END) AS {name}_frequency"""


_LATEST = "SELECT child_id, fact_type, fact_value, score, fact_id FROM (SELECT *, row_number() OVER (PARTITION BY child_id, fact_type ORDER BY fact_id DESC) AS rn FROM facts WHERE fact_id % 2 = {k}) WHERE rn = 1"
_BOTH = f"WITH {FACTS_SQL}, o AS ({_LATEST.format(k=0)}), n AS ({_LATEST.format(k=1)})"

SQL = {
    "fact_summary_view": f"""WITH {FACTS_SQL} SELECT c_custkey, c_name, c_nationkey, {_kind_sql(*_KINDS[0])}, {_kind_sql(*_KINDS[1])},
count(*) FILTER (method = 'ai') AS ai_extractions, count(*) FILTER (method <> 'ai') AS keyword_extractions, max(created_at) AS last_updated
FROM customer LEFT JOIN facts ON c_custkey = child_id WHERE fact_type IN ('AdorationSchedule', 'ReconciliationSchedule') GROUP BY 1, 2, 3""",
    "high_quality_view": f"WITH {FACTS_SQL} SELECT fact_id, child_id, c_name, fact_type, score FROM facts LEFT JOIN customer ON child_id = c_custkey WHERE method = 'ai' AND score >= 90 AND fact_type IN ('AdorationSchedule', 'ReconciliationSchedule')",
    "active_keywords_view": "SELECT p_partkey, p_type, p_size FROM part WHERE p_size > 10 AND p_brand IS NOT NULL",
    "newest_joined": f"WITH {FACTS_SQL} SELECT fact_id, c_name, created_at FROM facts LEFT JOIN customer ON child_id = c_custkey ORDER BY created_at DESC, fact_id LIMIT 50",
    "upsert_latest": f"{_BOTH} SELECT * FROM n UNION ALL SELECT * FROM o ANTI JOIN n USING (child_id, fact_type)",
    "upsert_partial": f"{_BOTH} SELECT child_id, fact_type, coalesce(n.fact_value, o.fact_value) AS fact_value, o.score, o.fact_id FROM o FULL OUTER JOIN n USING (child_id, fact_type)",
    "insert_or_update": """WITH o AS (SELECT c_custkey, c_nationkey, c_name, c_acctbal AS web FROM customer WHERE c_custkey % 3 <> 0),
n AS (SELECT c_custkey AS new_id, c_nationkey, CASE WHEN c_custkey % 5 = 0 THEN 'renamed' ELSE c_name END AS c_name, c_acctbal AS web FROM customer WHERE c_custkey % 2 = 0),
x AS (SELECT new_id, coalesce((SELECT min(c_custkey) FROM o WHERE o.c_nationkey = n.c_nationkey AND o.c_name = n.c_name), (SELECT min(c_custkey) FROM o WHERE o.c_nationkey = n.c_nationkey AND o.web = n.web)) AS existing_id FROM n)
SELECT new_id, existing_id, CASE WHEN existing_id IS NULL THEN 'added' ELSE 'updated' END AS outcome FROM x""",
    "conditional_update": "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 4 = 0 THEN 'failed' ELSE o_orderstatus END AS status FROM orders",
}
