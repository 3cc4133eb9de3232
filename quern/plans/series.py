"""Time series, last-N, rates, rollups, leases and costs."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.operators import relational as R
from quern.plans.base import VISITS_SQL, table, visits

_EPOCH = lambda c: F.unix_micros(F.col(c).cast("timestamp"))


def daily_cumulative(spark: SparkSession, d: str) -> DataFrame:
    return R.daily_cumulative(table(spark, d, "orders"), F.col("o_orderdate"))


def last_n_per_key(spark: SparkSession, d: str) -> DataFrame:
    """The last 20 visits of each worker, newest first."""
    v = visits(spark, d)
    rn = F.row_number().over(Window.partitionBy("worker").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return v.withColumn("rn", rn).where("rn <= 20").select("worker", "rn", "event_id")


def recent_mean(spark: SparkSession, d: str) -> DataFrame:
    """Mean of the latest five against the running mean, as a factor."""
    w = Window.partitionBy("worker").orderBy("ts", "event_id")
    # Decimal sums do not depend on their order.
    mean = lambda rows: F.sum(F.col("value").cast("decimal(18,6)")).over(rows).cast("double") / F.count("value").over(rows)
    v = visits(spark, d).select("worker", "event_id", mean(w.rowsBetween(-4, 0)).alias("recent"), mean(w.rowsBetween(Window.unboundedPreceding, 0)).alias("overall"))
    factor = F.when(F.col("recent") > F.col("overall") * 1.5, 1.3).when(F.col("recent") < F.col("overall") * 0.7, 0.9).otherwise(1.0)
    return v.select("worker", "event_id", (F.floor(F.col("recent") * 10000 + 0.5) / 10000).alias("recent"), (F.floor(F.col("overall") * 10000 + 0.5) / 10000).alias("overall"), factor.alias("factor"))


def trailing_rate(spark: SparkSession, d: str) -> DataFrame:
    """Visits of a worker in the hour before each, and whether that exceeds the limit."""
    w = Window.partitionBy("worker").orderBy("at").rangeBetween(-3600 * 1_000_000, 0)
    v = visits(spark, d).withColumn("at", _EPOCH("ts"))
    return v.select("event_id", F.count("*").over(w).alias("in_window")).withColumn("limited", F.col("in_window") > 3)


def key_stats_p95(spark: SparkSession, d: str) -> DataFrame:
    """Mean, exclusive 95th percentile and success rate of each worker's last 100 visits."""
    rn = F.row_number().over(Window.partitionBy("worker").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    v = visits(spark, d).withColumn("rn", rn).where("rn <= 100")
    g = v.groupBy("worker").agg(F.avg("seconds").alias("m"), F.sort_array(F.collect_list("seconds")).alias("s"), F.avg(F.col("ok").cast("double")).alias("r"))
    return g.select("worker", F.round(F.coalesce("m", F.lit(10.0)), 4).alias("mean_seconds"), F.round(X.exclusive_p95(F.col("s")), 4).alias("p95"), F.round("r", 6).alias("success_rate"))


def visit_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts and means; quality counts missing values as 0, seconds leaves them out."""
    v = visits(spark, d)
    return v.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.count_if("ok").alias("n_ok"),
        F.count_if(F.col("status") >= 400).alias("n_http_errors"),
        F.round(F.sum(F.coalesce("quality", F.lit(0.0))) / F.count("*"), 6).alias("avg_quality"),
        F.round(F.coalesce(F.avg(F.nullif(F.col("seconds"), F.lit(0.0))), F.lit(0.0)), 4).alias("avg_seconds"),
    )


def worker_rollup(spark: SparkSession, d: str) -> DataFrame:
    """One row over all workers: sums, mean rate of the busy ones, first start, names in one text."""
    g = visits(spark, d).groupBy("worker").agg(F.count_if("ok").alias("done"), F.count("*").alias("total"), F.min("ts").alias("started"))
    g = g.withColumn("rate", F.col("done") / F.col("total") * 100)
    names = F.array_join(F.transform(F.sort_array(F.collect_list("worker")), lambda k: k.cast("string")), ", ")
    return g.agg(F.sum("done").alias("done"), F.sum("total").alias("total"), F.round(F.avg(F.when(F.col("done") > 0, F.col("rate"))), 6).alias("mean_rate"), F.min("started").alias("started"), names.alias("workers"))


def _breakers(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("state") == "OPEN", 3).when(F.col("state") == "HALF_OPEN", 2).otherwise(1)
    g = visits(spark, d).where("event_id % 10 <> 0 or worker % 3 = 0").groupBy("worker").agg(F.max(rank).alias("r"), F.count("*").alias("requests"), F.count_if("ok").alias("successes"), F.count_if(F.col("status") == 500).alias("blocked"))
    state = F.when(F.col("r") == 3, "OPEN").when(F.col("r") == 2, "HALF_OPEN").otherwise("CLOSED")
    return g.select("worker", state.alias("state"), "requests", "successes", "blocked", F.round(F.col("successes") / F.greatest("requests", F.lit(1)) * 100, 1).alias("success_rate"))


def worst_state(spark: SparkSession, d: str) -> DataFrame:
    """The worst breaker state of each worker, with sums and a rate."""
    return _breakers(spark, d)


def breaker_health(spark: SparkSession, d: str) -> DataFrame:
    """Health scores of the breakers, least healthy first."""
    base = F.when(F.col("state") == "CLOSED", 70).when(F.col("state") == "HALF_OPEN", 40).otherwise(10)
    score = base * 0.3 + F.col("success_rate") * 0.7
    score = F.when(F.col("blocked") > 0, F.greatest(F.lit(0.0), score - F.col("blocked") / F.col("requests") * 100 * 0.5)).otherwise(score)
    score = F.when(F.col("requests") == 0, 50).otherwise(F.floor(score + 0.5)).cast("long")
    b = _breakers(spark, d).select("worker", "state", score.alias("health"))
    return b.select("*", X.band(F.col("health"), ((80, "good"), (60, "fair"), (40, "poor")), "bad").alias("label")).orderBy("health", "worker")


def activity_class(spark: SparkSession, d: str) -> DataFrame:
    """Workers by the age of their last sign of life, counted from the latest event."""
    v = visits(spark, d)
    now = F.broadcast(v.agg(F.max("ts").alias("now")))
    g = v.groupBy("worker").agg(F.max("ts").alias("last_at")).crossJoin(now)
    age = F.floor((_EPOCH("now") - _EPOCH("last_at")) / 1_000_000)
    g = g.withColumn("age", age.cast("long"))
    kind = F.when(F.col("age") <= 7200, "active").when(F.col("age") <= 36000, "recent").otherwise("stale")
    return g.select("worker", "age", kind.alias("activity")).orderBy(F.when(F.col("activity") == "active", 0).when(F.col("activity") == "recent", 1).otherwise(2), "age", "worker")


def lease_expiry(spark: SparkSession, d: str) -> DataFrame:
    """Workers silent for a day fail, and so do their open leases."""
    v = visits(spark, d)
    now = F.broadcast(v.agg(F.max("ts").alias("now")))
    dead = v.groupBy("worker").agg(F.max("ts").alias("seen")).crossJoin(now).where(_EPOCH("now") - _EPOCH("seen") > 86400 * 1_000_000).select(F.col("worker").alias("dead"))
    leases = v.where("event_type = 'view'").select("event_id", "worker", F.when(F.col("event_id") % 2 == 0, "processing").otherwise("completed").alias("status"))
    j = leases.join(dead, leases["worker"] == F.col("dead"), "left")
    return j.select("event_id", F.when(F.col("dead").isNotNull() & (F.col("status") == "processing"), "failed").otherwise(F.col("status")).alias("status"))


def lease_assign(spark: SparkSession, d: str) -> DataFrame:
    """Work without an open lease, up to a limit, with an estimate."""
    open_ = table(spark, d, "customer").where("c_custkey % 50 = 0").select("c_nationkey")
    n = table(spark, d, "nation")
    free = R.without_rows(n, open_, "n_nationkey", "c_nationkey")
    stamp = F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00"))
    return free.orderBy("n_nationkey").limit(10).select("n_nationkey", (stamp + F.expr("INTERVAL 1 HOUR")).alias("estimated_completion"))


def chunked(spark: SparkSession, d: str) -> DataFrame:
    """Batches of 25 children inside each parent."""
    rn = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.floor((rn - 1) / 25).alias("batch"))


TERMS = ("the", "of", "le", "de", "der", "que", "tion", "ing", "ment", "heit")


def _requests(spark: SparkSession, d: str) -> DataFrame:
    text = F.lower(F.coalesce("text", F.lit("")))
    task = F.when(F.col("role") == "assistant", 0.8).when(F.col("role") == "system", 0.6).otherwise(0.5)
    score = F.round(0.2 * F.least(F.length(text) / 2000, F.lit(1.0)) + 0.5 * task + 0.3 * F.least(X.hits(text, TERMS) / 10, F.lit(1.0)), 3)
    c = table(spark, d, "conversations").select("conv_id", "turn", "role", score.alias("complexity"), F.length(text).alias("n_in"), F.ceil(F.length(text) / 4).alias("n_out"))
    return c.withColumn("tier", F.when(F.col("complexity") > 0.7, "high").when(F.col("complexity") > 0.4, "medium").otherwise("low"))


def routing(spark: SparkSession, d: str) -> DataFrame:
    """Complexity of each request and the model tier it goes to."""
    return _requests(spark, d).select("conv_id", "turn", "complexity", "tier")


def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Cost by tier over each conversation's last four requests, totals over all.

    Prices are decimals, so sums are exact and do not depend on the order of rows.
    """
    price = spark.createDataFrame([("high", Decimal("0.00125"), Decimal("0.01")), ("medium", Decimal("0.0003"), Decimal("0.0025")), ("low", Decimal("0.0001"), Decimal("0.0004"))], "tier string, p_in decimal(9,5), p_out decimal(9,5)")
    r = _requests(spark, d).join(F.broadcast(price), "tier").withColumn("per_1000", F.col("n_in") * F.col("p_in") + F.col("n_out") * F.col("p_out"))
    rn = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))
    r = r.withColumn("rn", rn)
    cost = lambda c: (F.sum(c) * F.lit(Decimal("0.001"))).cast("decimal(24,8)")
    shown = lambda c: F.round(c, 6).cast("double")
    g = r.groupBy("tier").agg(cost(F.when(F.col("rn") <= 4, F.col("per_1000"))).alias("recent"), cost("per_1000").alias("total"), F.count("*").alias("n"))
    return g.select("tier", shown(F.col("recent")).alias("recent_cost"), shown(F.col("total")).alias("total_cost"), "n", shown(F.col("total") / F.col("n").cast("decimal(12,0)")).alias("mean_cost"))


def recent_costs(spark: SparkSession, d: str, last: int = 1000) -> DataFrame:
    """Cost of the last requests by model and by task, beside the totals over all.

    The last ones are a limit that each task applies before anything is shuffled.
    """
    price = spark.createDataFrame([("high", 0.00125, 0.01), ("medium", 0.0003, 0.0025), ("low", 0.0001, 0.0004)], "tier string, p_in double, p_out double")
    cost = F.col("n_in") / 1000 * F.col("p_in") + F.col("n_out") / 1000 * F.col("p_out")
    r = _requests(spark, d).join(F.broadcast(price), "tier").select("conv_id", "turn", "tier", "role", cost.alias("cost"))
    recent = r.orderBy(F.col("conv_id").desc(), F.col("turn").desc(), "role").limit(last)
    one = lambda df, kind, c: df.groupBy(F.lit(kind).alias("kind"), F.coalesce(c, F.lit("unknown")).alias("name"))
    out = None
    for kind, c in (("model", "tier"), ("task", "role")):
        mine = one(recent, kind, c).agg(F.round(F.sum("cost"), 6).alias("recent_cost"), F.count("*").alias("recent")).join(one(r, kind, c).agg(F.round(F.sum("cost"), 6).alias("total_cost"), F.count("*").alias("total")), ["kind", "name"], "right")
        out = mine if out is None else out.unionByName(mine)
    return out.select("kind", "name", F.coalesce("recent_cost", F.lit(0.0)).alias("recent_cost"), F.coalesce("recent", F.lit(0)).alias("recent"), "total_cost", "total")


def throughput(spark: SparkSession, d: str) -> DataFrame:
    """Visits per minute, of each kind, over the kind's whole span."""
    v = visits(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("ok").alias("n_ok"), ((F.max(_EPOCH("ts")) - F.min(_EPOCH("ts"))) / 60_000_000).alias("minutes"))
    return v.select("event_type", F.round(F.col("n") / F.greatest("minutes", F.lit(1.0)), 6).alias("per_minute"), F.round(100.0 * F.col("n_ok") / F.greatest("n", F.lit(1)), 4).alias("success_percent"))


def json_props(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the events' JSON, the first alias that is present."""
    e = table(spark, d, "events")
    k = F.coalesce(F.get_json_object("props", "$.key"), F.get_json_object("props", "$.k")).cast("long")
    return e.select("event_id", k.alias("k")).groupBy((F.col("k") % 10).alias("k10")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


def numeric_average(spark: SparkSession, d: str) -> DataFrame:
    """Mean of what is a number; 0 where nothing is."""
    v = visits(spark, d).select("event_type", F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("shown"))
    return v.groupBy("event_type").agg(F.round(F.coalesce(F.avg(F.expr("try_cast(shown AS double)")), F.lit(0.0)), 4).alias("mean"))


QUERIES = {f.__name__: f for f in (daily_cumulative, last_n_per_key, recent_mean, trailing_rate, key_stats_p95, visit_stats, worker_rollup, worst_state, breaker_health, activity_class, lease_expiry, lease_assign, chunked, routing, cost_rollup, recent_costs, throughput, json_props, numeric_average)}

_V = f"WITH {VISITS_SQL}"
_HITS = " + ".join(f"CAST(contains(t, '{t}') AS INTEGER)" for t in TERMS)
_REQ = f"""WITH q AS (SELECT conv_id, turn, role, lower(coalesce(text, '')) AS t FROM conversations),
r AS (SELECT conv_id, turn, role, round(0.2 * least(length(t) / 2000, 1.0) + 0.5 * CASE role WHEN 'assistant' THEN 0.8 WHEN 'system' THEN 0.6 ELSE 0.5 END + 0.3 * least(({_HITS}) / 10, 1.0), 3) AS complexity,
  length(t) AS n_in, ceil(length(t) / 4) AS n_out FROM q),
s AS (SELECT *, CASE WHEN complexity > 0.7 THEN 'high' WHEN complexity > 0.4 THEN 'medium' ELSE 'low' END AS tier FROM r)"""
_BREAK = f"""{_V}, g AS (SELECT worker, max(CASE state WHEN 'OPEN' THEN 3 WHEN 'HALF_OPEN' THEN 2 ELSE 1 END) AS r, count(*) AS requests, count(*) FILTER (ok) AS successes, count(*) FILTER (status = 500) AS blocked
FROM visits WHERE event_id % 10 <> 0 OR worker % 3 = 0 GROUP BY worker),
b AS (SELECT worker, CASE r WHEN 3 THEN 'OPEN' WHEN 2 THEN 'HALF_OPEN' ELSE 'CLOSED' END AS state, requests, successes, blocked, round(successes / greatest(requests, 1) * 100, 1) AS success_rate FROM g)"""

SQL = {
    "daily_cumulative": """WITH c AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
s AS (SELECT CAST(unnest(generate_series(CAST((SELECT min(day) FROM c) AS TIMESTAMP), CAST((SELECT max(day) FROM c) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS day)
SELECT s.day, coalesce(c.n, 0) AS n, CAST(sum(coalesce(c.n, 0)) OVER (ORDER BY s.day) AS BIGINT) AS total FROM s LEFT JOIN c ON s.day = c.day""",
    "last_n_per_key": f"{_V} SELECT worker, CAST(rn AS INTEGER) AS rn, event_id FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) AS rn FROM visits) WHERE rn <= 20",
    "recent_mean": f"""{_V}, m AS (SELECT worker, event_id, CAST(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS DOUBLE) / count(value) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS recent,
CAST(sum(CAST(value AS DECIMAL(18,6))) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / count(value) OVER (PARTITION BY worker ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS overall FROM visits)
SELECT worker, event_id, floor(recent * 10000 + 0.5) / 10000 AS recent, floor(overall * 10000 + 0.5) / 10000 AS overall, CAST(CASE WHEN recent > overall * 1.5::DOUBLE THEN 1.3 WHEN recent < overall * 0.7::DOUBLE THEN 0.9 ELSE 1.0 END AS DOUBLE) AS factor FROM m""",
    "trailing_rate": f"{_V}, w AS (SELECT event_id, count(*) OVER (PARTITION BY worker ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS in_window FROM visits) SELECT event_id, in_window, in_window > 3 AS limited FROM w",
    "key_stats_p95": f"""{_V}, r AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) AS rn FROM visits),
g AS (SELECT worker, avg(seconds) AS m, list_sort(list(seconds) FILTER (seconds IS NOT NULL)) AS s, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS r FROM r WHERE rn <= 100 GROUP BY worker),
j AS (SELECT *, coalesce(len(s), 0) AS n, greatest(1, least(CAST(floor(19 * (coalesce(len(s), 0) + 1) / 20) AS INTEGER), coalesce(len(s), 0) - 1)) AS j FROM g)
SELECT worker, round(coalesce(m, 10.0), 4) AS mean_seconds,
round(CASE WHEN n >= 5 THEN (s[j] * (20 - (19 * (n + 1) - j * 20)) + s[j + 1] * (19 * (n + 1) - j * 20)) / 20 WHEN n > 0 THEN m * 1.5 END, 4) AS p95, round(r, 6) AS success_rate FROM j""",
    "visit_stats": f"""{_V} SELECT event_type, count(*) AS n, count(*) FILTER (ok) AS n_ok, count(*) FILTER (status >= 400) AS n_http_errors,
round(sum(coalesce(quality, 0.0)) / count(*), 6) AS avg_quality, round(coalesce(avg(nullif(seconds, 0.0)), 0.0), 4) AS avg_seconds FROM visits GROUP BY event_type""",
    "worker_rollup": f"""{_V}, g AS (SELECT worker, count(*) FILTER (ok) AS done, count(*) AS total, min(ts) AS started FROM visits GROUP BY worker)
SELECT CAST(sum(done) AS BIGINT) AS done, CAST(sum(total) AS BIGINT) AS total, round(avg(CASE WHEN done > 0 THEN done / total * 100 END), 6) AS mean_rate, min(started) AS started, string_agg(CAST(worker AS VARCHAR), ', ' ORDER BY worker) AS workers FROM g""",
    "worst_state": f"{_BREAK} SELECT * FROM b",
    "breaker_health": f"""{_BREAK}, s AS (SELECT *, (CASE state WHEN 'CLOSED' THEN 70 WHEN 'HALF_OPEN' THEN 40 ELSE 10 END) * 0.3 + success_rate * 0.7 AS x FROM b),
h AS (SELECT worker, state, CAST(floor(CASE WHEN blocked > 0 THEN greatest(0.0, x - blocked / requests * 100 * 0.5) ELSE x END + 0.5) AS BIGINT) AS health FROM s)
SELECT *, CASE WHEN health >= 80 THEN 'good' WHEN health >= 60 THEN 'fair' WHEN health >= 40 THEN 'poor' ELSE 'bad' END AS label FROM h""",
    "activity_class": f"""{_V}, g AS (SELECT worker, CAST(floor((epoch_us((SELECT max(ts) FROM visits)) - epoch_us(max(ts))) / 1000000) AS BIGINT) AS age FROM visits GROUP BY worker)
SELECT worker, age, CASE WHEN age <= 7200 THEN 'active' WHEN age <= 36000 THEN 'recent' ELSE 'stale' END AS activity FROM g""",
    "lease_expiry": f"""{_V}, dead AS (SELECT worker FROM visits GROUP BY worker HAVING epoch_us((SELECT max(ts) FROM visits)) - epoch_us(max(ts)) > 86400000000)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CASE WHEN worker IN (SELECT worker FROM dead) THEN 'failed' ELSE 'processing' END ELSE 'completed' END AS status FROM visits WHERE event_type = 'view'""",
    "lease_assign": "SELECT n_nationkey, TIMESTAMP '2024-01-01 01:00:00' AS estimated_completion FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_custkey % 50 = 0) ORDER BY n_nationkey LIMIT 10",
    "chunked": "SELECT c_custkey, c_nationkey, CAST((row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1) // 25 AS BIGINT) AS batch FROM customer",
    "routing": f"{_REQ} SELECT conv_id, turn, complexity, tier FROM s",
    "cost_rollup": f"""{_REQ}, p AS (SELECT * FROM (VALUES ('high', 0.00125, 0.01), ('medium', 0.0003, 0.0025), ('low', 0.0001, 0.0004)) v(tier, p_in, p_out)),
c AS (SELECT s.tier, n_in / 1000 * CAST(p_in AS DOUBLE) + n_out / 1000 * CAST(p_out AS DOUBLE) AS cost, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM s JOIN p ON s.tier = p.tier)
SELECT tier, round(sum(CASE WHEN rn <= 4 THEN cost END), 6) AS recent_cost, round(sum(cost), 6) AS total_cost, count(*) AS n, round(sum(cost) / greatest(count(*), 1), 6) AS mean_cost FROM c GROUP BY tier""",
    "recent_costs": f"""{_REQ}, p AS (SELECT * FROM (VALUES ('high', 0.00125, 0.01), ('medium', 0.0003, 0.0025), ('low', 0.0001, 0.0004)) v(tier, p_in, p_out)),
c AS (SELECT s.tier, coalesce(s.role, 'unknown') AS role, n_in / 1000 * CAST(p_in AS DOUBLE) + n_out / 1000 * CAST(p_out AS DOUBLE) AS cost, row_number() OVER (ORDER BY conv_id DESC, turn DESC, s.role) <= 1000 AS late FROM s JOIN p ON s.tier = p.tier),
k AS (SELECT 'model' AS kind, tier AS name, cost, late FROM c UNION ALL SELECT 'task', role, cost, late FROM c)
SELECT kind, name, round(coalesce(sum(cost) FILTER (late), 0.0), 6) AS recent_cost, count(*) FILTER (late) AS recent, round(sum(cost), 6) AS total_cost, count(*) AS total FROM k GROUP BY 1, 2""",
    "throughput": f"""{_V}, g AS (SELECT event_type, count(*) AS n, count(*) FILTER (ok) AS k, (max(epoch_us(ts)) - min(epoch_us(ts))) / 60000000 AS m FROM visits GROUP BY event_type)
SELECT event_type, round(n / greatest(m, 1.0), 6) AS per_minute, round(100.0 * k / greatest(n, 1), 4) AS success_percent FROM g""",
    "json_props": "SELECT k % 10 AS k10, count(*) AS n, CAST(sum(k) AS BIGINT) AS total FROM (SELECT CAST(coalesce(json_extract_string(props, '$.key'), json_extract_string(props, '$.k')) AS BIGINT) AS k FROM events) GROUP BY 1",
    "numeric_average": f"{_V} SELECT event_type, round(coalesce(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 0.0), 4) AS mean FROM visits GROUP BY event_type",
}
