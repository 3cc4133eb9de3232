"""Listings, summaries, pages, joins and set operations over parents, children and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.operators import relational as R
from quern.plans.base import FACTS_SQL, HAS_DATA_SQL, facts, table


def parent_listing_page(spark: SparkSession, d: str) -> DataFrame:
    """Second page of the parents whose name has an 'a', with counts of children and of children with data."""
    parents, children = table(spark, d, "nation"), table(spark, d, "customer")
    with_data = facts(spark, d).where(X.has_data(F.col("fact_value")))
    n = children.groupBy("c_nationkey").agg(F.count("*").alias("n_children"))
    m = R.with_rows(children, with_data, "c_custkey", "child_id").groupBy("c_nationkey").agg(F.count("*").alias("n_with_data"))
    listing = (
        parents.where(X.contains_ci(F.col("n_name"), "a"))
        .join(n.withColumnRenamed("c_nationkey", "_n"), F.col("n_nationkey") == F.col("_n"), "left")
        .join(m.withColumnRenamed("c_nationkey", "_m"), F.col("n_nationkey") == F.col("_m"), "left")
        .select("n_nationkey", "n_name", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("n_with_data", F.lit(0)).alias("n_with_data"))
    )
    return R.page(listing, R.sort_key(listing, "n_children", {"n_children": "n_children", "name": "n_name"}, "n_nationkey", True), 2, 5)


def global_summary(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    p = table(spark, d, "nation").agg(F.count("*").alias("n_parents"))
    c = table(spark, d, "customer").agg(F.count("*").alias("n_children"), F.count_distinct("c_nationkey").alias("n_parents_with_children"))
    g = f.agg(F.count("*").alias("n_facts"), F.count_distinct(F.when(X.has_data(F.col("fact_value")), F.col("child_id"))).alias("n_children_with_data"))
    return p.crossJoin(c).crossJoin(g).select("*", (F.col("n_parents") - F.col("n_parents_with_children")).alias("n_parents_without_children"), (F.col("n_children") - F.col("n_children_with_data")).alias("n_children_without_data"))


def children_with_parent_name(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).where(F.col("c_name").ilike("%customer%0_1%") & (F.col("c_mktsegment") != "") & (F.col("c_acctbal") < 9000)).select("c_custkey", "c_name", "n_name")


def children_with_data(spark: SparkSession, d: str) -> DataFrame:
    return R.with_rows(table(spark, d, "customer"), facts(spark, d).where(X.has_data(F.col("fact_value"))), "c_custkey", "child_id").select("c_custkey", "c_name")


def children_without_data(spark: SparkSession, d: str) -> DataFrame:
    rest = R.without_rows(table(spark, d, "customer"), facts(spark, d).where(X.has_data(F.col("fact_value")) & (F.col("score") > 60)), "c_custkey", "child_id")
    return rest.select("c_custkey", "c_name").orderBy("c_custkey").limit(100)


def pivot_two_fact_types(spark: SparkSession, d: str) -> DataFrame:
    value = lambda t: F.max(F.when((F.col("fact_type") == t) & X.has_data(F.col("fact_value")), F.col("fact_value")))
    return facts(spark, d).groupBy("child_id").agg(value("AdorationSchedule").alias("adoration"), value("ReconciliationSchedule").alias("reconciliation"))


def child_with_fact_array(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    a = facts(spark, d).groupBy("child_id").agg(F.sort_array(F.collect_list(F.concat_ws(":", F.lpad(F.col("fact_id").cast("string"), 10, "0"), "fact_type"))).alias("found"))
    return c.join(a, c["c_custkey"] == a["child_id"], "left").select("c_custkey", "c_name", F.coalesce(F.array_join("found", ","), F.lit("")).alias("facts"))


def counted_page(spark: SparkSession, d: str) -> DataFrame:
    """A page with the exact total beside it; flags re-sorted inside the page only."""
    c = table(spark, d, "customer").where(X.tri_state(F.col("c_acctbal") > 0, "true")).select("c_custkey", "c_name", "c_acctbal")
    total = c.agg(F.count("*").alias("total_count"))
    part = R.page(c, [F.col("c_acctbal").desc_nulls_first(), F.col("c_custkey")], 3, 20)
    return part.crossJoin(F.broadcast(total)).withColumn("flag", F.col("c_custkey") % 2 == 0).orderBy(F.col("flag").desc(), "c_custkey")


def override_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The override where one exists, else the directory's row, with the source's tag."""
    n = table(spark, d, "nation")
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.min("s_name").alias("directory_name"))
    o = n.where(F.col("n_nationkey") % 4 == 0).select(F.col("n_nationkey").alias("_o"), F.concat(F.lit("override "), F.col("n_name")).alias("override_name"))
    j = n.join(o, n["n_nationkey"] == F.col("_o"), "left").join(s, n["n_nationkey"] == s["s_nationkey"], "left")
    tag = F.when(F.col("override_name").isNotNull(), "override").when(F.col("directory_name").isNotNull(), "directory").otherwise("none")
    return j.select("n_nationkey", F.coalesce("override_name", "directory_name").alias("resolved"), tag.alias("source"))


def full_outer_compare(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages").select("page_id", X.comparable_url(F.col("url")).alias("u"))
    left = p.where(F.col("page_id") % 3 != 0)
    right = p.where(F.col("page_id") % 3 != 1).select("page_id", F.when(F.col("page_id") % 5 == 0, F.concat("u", F.lit("/changed"))).otherwise(F.col("u")).alias("u"))
    return R.compare(left, right, "page_id", "u")


def compare_rate(spark: SparkSession, d: str) -> DataFrame:
    g = full_outer_compare(spark, d).agg(F.count_if(F.col("outcome") == "match").alias("matches"), F.count_if(F.col("outcome").isin("match", "mismatch")).alias("common"))
    return g.select("matches", "common", F.round(100.0 * F.col("matches") / F.greatest("common", F.lit(1)), 4).alias("rate"))


def two_tier_priority(spark: SparkSession, d: str) -> DataFrame:
    """Never-tested children by id descending, then tested ones by their oldest date."""
    c = table(spark, d, "customer").where(F.col("c_name").isNotNull()).select("c_custkey")
    t = facts(spark, d).where("child_id % 2 = 0").groupBy("child_id").agg(F.max("created_at").alias("tested_at"))
    j = c.join(t, c["c_custkey"] == t["child_id"], "left").select("c_custkey", F.when(F.col("tested_at").isNull(), 0).otherwise(1).alias("tier"), "tested_at")
    return j.orderBy("tier", F.when(F.col("tier") == 0, -F.col("c_custkey")), "tested_at", "c_custkey").limit(1000)


def oldest_first(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").orderBy("o_orderdate", "o_orderkey").limit(25).select("o_orderkey", "o_orderdate")


def set_difference(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_nationkey").distinct().subtract(table(spark, d, "supplier").where("s_suppkey % 3 = 0").select("s_nationkey"))


def set_intersection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_nationkey").intersect(table(spark, d, "supplier").select("s_nationkey"))


def ordered_union(spark: SparkSession, d: str) -> DataFrame:
    """Two ordered sources in one list, each key once at its first place."""
    c = table(spark, d, "customer").select(F.lit(0).alias("source"), F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("key"))
    s = table(spark, d, "supplier").select(F.lit(1).alias("source"), F.col("s_suppkey").alias("pos"), (F.col("s_nationkey") + F.col("s_suppkey") % 3).cast("int").alias("key"))
    return c.unionByName(s).groupBy("key").agg(F.min(F.struct("source", "pos")).alias("m")).select("key", "m.source", "m.pos")


def keyword_merge(spark: SparkSession, d: str) -> DataFrame:
    """Keywords fanned out to their types, the largest weight of equal ones."""
    p = table(spark, d, "part").select(F.lower(F.element_at(F.split("p_type", " "), 1)).alias("keyword"), F.when(F.col("p_size") % 3 == 0, "both").when(F.col("p_size") % 3 == 1, "all").otherwise("mass").alias("scope"), "p_size")
    kinds = F.when(F.col("scope") == "both", F.array(F.lit("reconciliation"), F.lit("adoration"))).when(F.col("scope") == "all", F.array(F.lit("reconciliation"), F.lit("adoration"), F.lit("mass"))).otherwise(F.array("scope"))
    return p.select("keyword", F.explode(kinds).alias("kind"), "p_size").groupBy("keyword", "kind").agg(F.max("p_size").alias("weight"))


def parent_child_statistics(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    return n.join(c, n["n_nationkey"] == c["c_nationkey"], "left").groupBy("n_name").agg(F.count("c_custkey").alias("n_children"), F.count_distinct("c_mktsegment").alias("n_segments"))


def display_names(spark: SparkSession, d: str) -> DataFrame:
    """Names with a default for keys that have none."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation").where("n_nationkey % 5 <> 0")
    name = F.coalesce("n_name", F.concat(F.lit("Unknown ("), F.col("s_nationkey").cast("string"), F.lit(")")))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"], "left").select("s_suppkey", name.alias("shown"))


def grouped_by_status(spark: SparkSession, d: str) -> DataFrame:
    """Orders of each customer as a list by status: a list is as long as a customer's orders."""
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("o_orderkey")), lambda k: k.cast("string")), ",").alias("ids"))


def coverage_ratios(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").agg(F.count("*").alias("parents"))
    c = table(spark, d, "customer").agg(F.count("*").alias("children"))
    f = facts(spark, d).agg(F.count_distinct("child_id").alias("with_facts"))
    return n.crossJoin(c).crossJoin(f).select(F.round(F.col("children") / F.greatest("parents", F.lit(1)), 6).alias("children_per_parent"), F.round(100.0 * F.col("with_facts") / F.greatest("children", F.lit(1)), 6).alias("coverage_percent"))


def newest_facts(spark: SparkSession, d: str) -> DataFrame:
    """The three facts that came last, of facts with data."""
    return facts(spark, d).where(X.has_data(F.col("fact_value"))).orderBy(F.col("created_at").desc(), F.col("fact_id").desc()).limit(3).select("fact_id", "child_id", "fact_type", "created_at")


def export_summary(spark: SparkSession, d: str) -> DataFrame:
    """The six figures of an export's summary sheet."""
    f = facts(spark, d)
    return f.agg(F.count("*").alias("n_rows"), F.count_distinct("child_id").alias("n_children"), F.count("fact_value").alias("n_values"), F.count_distinct("fact_type").alias("n_types"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def export_envelope(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each parent as one JSON text."""
    c = table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name")
    rows = F.transform(F.sort_array(F.collect_list(F.struct("c_custkey", "c_name"))), lambda r: F.to_json(r))
    return c.groupBy("c_nationkey").agg(F.count("*").alias("n"), rows.alias("r")).select("c_nationkey", F.concat(F.lit('{"count":'), F.col("n").cast("string"), F.lit(',"rows":['), F.array_join("r", ","), F.lit("]}")).alias("document"))


def address_assembly(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    full = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.lit("Full "), F.col("c_name"))).when(F.col("c_custkey") % 4 == 1, "")
    parts = F.concat_ws(", ", F.nullif(F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")), F.lit("")), "n_name", "c_mktsegment")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"], "left").select("c_custkey", F.coalesce(F.nullif(full, F.lit("")), parts).alias("address"))


QUERIES = {f.__name__: f for f in (parent_listing_page, global_summary, children_with_parent_name, children_with_data, children_without_data, pivot_two_fact_types, child_with_fact_array, counted_page, override_resolution, full_outer_compare, compare_rate, two_tier_priority, oldest_first, set_difference, set_intersection, ordered_union, keyword_merge, parent_child_statistics, display_names, grouped_by_status, coverage_ratios, newest_facts, export_summary, export_envelope, address_assembly)}

_COMPARABLE = r"regexp_replace(CASE WHEN regexp_matches({u}, '^https?://') THEN {u} ELSE 'https://' || {u} END, '^http://', 'https://')".replace("{u}", "regexp_replace(lower(trim(url)), '/$', '')")
_COMPARE = f"""WITH p AS (SELECT page_id, {_COMPARABLE} AS u FROM pages),
l AS (SELECT * FROM p WHERE page_id % 3 <> 0),
r AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN u || '/changed' ELSE u END AS u FROM p WHERE page_id % 3 <> 1),
o AS (SELECT coalesce(l.page_id, r.page_id) AS page_id, l.u AS left_value, r.u AS right_value,
       CASE WHEN r.page_id IS NULL THEN 'only_left' WHEN l.page_id IS NULL THEN 'only_right' WHEN l.u = r.u THEN 'match' ELSE 'mismatch' END AS outcome
     FROM l FULL OUTER JOIN r ON l.page_id = r.page_id)"""

SQL = {
    "parent_listing_page": f"""WITH {FACTS_SQL}, n AS (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1),
m AS (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_custkey IN (SELECT child_id FROM facts WHERE {HAS_DATA_SQL}) GROUP BY 1)
SELECT n_nationkey, n_name, coalesce(n.n, 0) AS n_children, coalesce(m.n, 0) AS n_with_data
FROM nation LEFT JOIN n ON n_nationkey = n.c_nationkey LEFT JOIN m ON n_nationkey = m.c_nationkey
WHERE lower(n_name) LIKE '%a%' ORDER BY n_children DESC, n_nationkey LIMIT 5 OFFSET 5""",
    "global_summary": f"""WITH {FACTS_SQL}, x AS (SELECT (SELECT count(*) FROM nation) AS n_parents, (SELECT count(*) FROM customer) AS n_children,
(SELECT count(DISTINCT c_nationkey) FROM customer) AS n_parents_with_children, (SELECT count(*) FROM facts) AS n_facts,
(SELECT count(DISTINCT child_id) FROM facts WHERE {HAS_DATA_SQL}) AS n_children_with_data)
SELECT *, n_parents - n_parents_with_children AS n_parents_without_children, n_children - n_children_with_data AS n_children_without_data FROM x""",
    "children_with_parent_name": "SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_name ILIKE '%customer%0_1%' AND c_mktsegment <> '' AND c_acctbal < 9000",
    "children_with_data": f"WITH {FACTS_SQL} SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM facts WHERE child_id = c_custkey AND {HAS_DATA_SQL})",
    "children_without_data": f"WITH {FACTS_SQL} SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM facts WHERE child_id = c_custkey AND {HAS_DATA_SQL} AND score > 60) ORDER BY c_custkey LIMIT 100",
    "pivot_two_fact_types": f"""WITH {FACTS_SQL} SELECT child_id, max(fact_value) FILTER (fact_type = 'AdorationSchedule' AND {HAS_DATA_SQL}) AS adoration,
max(fact_value) FILTER (fact_type = 'ReconciliationSchedule' AND {HAS_DATA_SQL}) AS reconciliation FROM facts GROUP BY child_id""",
    "child_with_fact_array": f"""WITH {FACTS_SQL}, a AS (SELECT child_id, string_agg(lpad(CAST(fact_id AS VARCHAR), 10, '0') || ':' || fact_type, ',' ORDER BY fact_id) AS found FROM facts GROUP BY child_id)
SELECT c_custkey, c_name, coalesce(found, '') AS facts FROM customer LEFT JOIN a ON c_custkey = child_id""",
    "counted_page": """WITH c AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal > 0)
SELECT p.*, (SELECT count(*) FROM c) AS total_count, c_custkey % 2 = 0 AS flag FROM (SELECT * FROM c ORDER BY c_acctbal DESC NULLS FIRST, c_custkey LIMIT 20 OFFSET 40) p""",
    "override_resolution": """WITH s AS (SELECT s_nationkey, min(s_name) AS dn FROM supplier GROUP BY 1)
SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'override ' || n_name ELSE dn END AS resolved,
CASE WHEN n_nationkey % 4 = 0 THEN 'override' WHEN dn IS NOT NULL THEN 'directory' ELSE 'none' END AS source FROM nation LEFT JOIN s ON n_nationkey = s_nationkey""",
    "full_outer_compare": f"{_COMPARE} SELECT * FROM o",
    "compare_rate": f"{_COMPARE}, g AS (SELECT count(*) FILTER (outcome = 'match') AS matches, count(*) FILTER (outcome IN ('match', 'mismatch')) AS common FROM o) SELECT matches, common, round(100.0 * matches / greatest(common, 1), 4) AS rate FROM g",
    "two_tier_priority": f"""WITH {FACTS_SQL}, t AS (SELECT child_id, max(created_at) AS tested_at FROM facts WHERE child_id % 2 = 0 GROUP BY 1)
SELECT c_custkey, CASE WHEN tested_at IS NULL THEN 0 ELSE 1 END AS tier, tested_at FROM customer LEFT JOIN t ON c_custkey = child_id
ORDER BY tier, CASE WHEN tested_at IS NULL THEN -c_custkey END, tested_at, c_custkey LIMIT 1000""",
    "oldest_first": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 25",
    "set_difference": "SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey % 3 = 0",
    "set_intersection": "SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "ordered_union": """WITH u AS (SELECT 0 AS source, c_custkey AS pos, c_nationkey AS key FROM customer UNION ALL SELECT 1, s_suppkey, CAST(s_nationkey + s_suppkey % 3 AS INTEGER) FROM supplier)
SELECT key, source, pos FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source, pos) AS rn FROM u) WHERE rn = 1""",
    "keyword_merge": """WITH p AS (SELECT lower(split_part(p_type, ' ', 1)) AS keyword, p_size % 3 AS k, p_size FROM part),
f AS (SELECT keyword, p_size, unnest(CASE WHEN k = 0 THEN ['reconciliation', 'adoration'] WHEN k = 1 THEN ['reconciliation', 'adoration', 'mass'] ELSE ['mass'] END) AS kind FROM p)
SELECT keyword, kind, max(p_size) AS weight FROM f GROUP BY 1, 2""",
    "parent_child_statistics": "SELECT n_name, count(c_custkey) AS n_children, count(DISTINCT c_mktsegment) AS n_segments FROM nation LEFT JOIN customer ON n_nationkey = c_nationkey GROUP BY n_name",
    "display_names": "SELECT s_suppkey, coalesce(n_name, 'Unknown (' || s_nationkey || ')') AS shown FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey AND n_nationkey % 5 <> 0",
    "grouped_by_status": "SELECT o_custkey, o_orderstatus, count(*) AS n, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1, 2",
    "coverage_ratios": f"""WITH {FACTS_SQL} SELECT round((SELECT count(*) FROM customer) / greatest((SELECT count(*) FROM nation), 1), 6) AS children_per_parent,
round(100.0 * (SELECT count(DISTINCT child_id) FROM facts) / greatest((SELECT count(*) FROM customer), 1), 6) AS coverage_percent""",
    "newest_facts": f"WITH {FACTS_SQL} SELECT fact_id, child_id, fact_type, created_at FROM facts WHERE {HAS_DATA_SQL} ORDER BY created_at DESC, fact_id DESC LIMIT 3",
    "export_summary": f"WITH {FACTS_SQL} SELECT count(*) AS n_rows, count(DISTINCT child_id) AS n_children, count(fact_value) AS n_values, count(DISTINCT fact_type) AS n_types, min(created_at) AS first_at, max(created_at) AS last_at FROM facts",
    "export_envelope": """SELECT c_nationkey, '{"count":' || count(*) || ',"rows":[' || string_agg('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}', ',' ORDER BY c_custkey) || ']}' AS document FROM customer GROUP BY 1""",
    "address_assembly": """SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Full ' || c_name ELSE concat_ws(', ', CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END, n_name, c_mktsegment) END AS address
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
}
