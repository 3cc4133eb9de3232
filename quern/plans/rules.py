"""Rule-based filters, scores and small rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import dom as D
from quern.functions import exprs as X
from quern.operators import relational as R
from quern.plans.base import FACTS_SQL, VISITS_SQL, facts, table, visits

SKIP_TERMS = ("menu", "login", "the and", "de la", "!!")
NAME_TERMS = ("ment", "tion", "heit", "the")
UI_TERMS = ("|", "###", "%%%")
# Services in frames, maps, and words of listings.
FRAME_SERVICES = ("stripe.com", "paypal.com", "square.com", "donate", "payment", "analytics", "google-analytics", "googletagmanager", "facebook.com", "twitter.com", "youtube.com", "vimeo.com", "recaptcha", "ads", "advertising")
FRAME_MAPS = ("maptive.com", "google.com/maps", "mapbox.com", "arcgis.com", "leaflet", "openstreetmap")
FRAME_WORDS = ("parish", "church", "directory", "locator", "finder")
# Weights of page complexity indicators.
COMPLEXITY = (("js", 2.0), ("images", 1.3), ("iframes", 1.5))
# strategies' first and longest seconds and their factor a retry.
STRATEGIES = {"lightning": (5.0, 15.0, 1.2), "fast": (10.0, 25.0, 1.3), "moderate": (20.0, 45.0, 1.4), "complex": (35.0, 75.0, 1.6), "patient": (60.0, 120.0, 1.8)}
# What makes pages worth keeping for longer or shorter.
KEPT_TERMS, MOVING_TERMS = ("schedule", "times", "mass", "confession", "adoration"), ("javascript", "ajax", "dynamic")
RELIABLE_HOSTS, MOVING_HOSTS = ("archatl.com", "wordpress.com", "squarespace.com"), ("wix.com", "weebly.com")


def _first_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("name"))


def skip_term_filter(spark: SparkSession, d: str) -> DataFrame:
    low = F.lower(F.trim("name"))
    return _first_lines(spark, d).where(~X.any_of(low, SKIP_TERMS) & (F.length(low) >= 3)).select("doc_id")


def name_validators(spark: SparkSession, d: str) -> DataFrame:
    """An indicator and no exclusion, an indicator and no menu term, and both."""
    low = F.lower("name")
    a = X.any_of(low, NAME_TERMS) & ~X.any_of(low, SKIP_TERMS)
    b = X.any_of(low, NAME_TERMS) & ~X.any_of(low, UI_TERMS)
    return _first_lines(spark, d).select("doc_id", a.alias("by_exclusion"), b.alias("by_menu"), (a & b).alias("both"))


def present_fields(spark: SparkSession, d: str) -> DataFrame:
    """Null and empty fields are left out; zeros and false stay."""
    k = F.col("c_custkey")
    fields = (("name", F.col("c_name")), ("city", F.when(k % 3 == 0, "").otherwise(F.col("c_mktsegment"))), ("flag", F.when(k % 2 == 0, "false")), ("zero", F.lit("0")))
    shown = F.filter(F.array(*[F.when(X.has_value(v), F.concat(F.lit(f"{n}="), v)) for n, v in fields]), lambda x: x.isNotNull())
    return table(spark, d, "customer").select("c_custkey", F.array_join(shown, ";").alias("fields"))


def api_endpoints(spark: SparkSession, d: str) -> DataFrame:
    """Bodies of 50 characters or more with at least three of the terms."""
    low = F.lower("html")
    n = X.hits(low, ("charset", "href", "script", "footer", "article", "table"))
    return table(spark, d, "pages").where((F.length("html") >= 50) & (n >= 3)).select("page_id", n.alias("n_terms"))


def embedded_frames(pages: DataFrame) -> DataFrame:
    """(page_id, pos, src, kind) of the frames that a page embeds: maps and listings; services are left out."""
    low = F.lower("src")
    p = D.with_nodes(pages.select("page_id", "html"))
    sources = F.transform(F.filter("nodes", lambda n: n["tag"] == "iframe"), lambda n: F.coalesce(D.attr(n, "src"), F.lit("")))
    kind = F.when(X.any_of(low, FRAME_MAPS), "mapping").when(X.any_of(low, FRAME_WORDS), "listing")
    return p.select("page_id", F.posexplode(sources).alias("pos", "src")).where(~X.any_of(low, FRAME_SERVICES)).withColumn("kind", kind).where("kind is not null")


def iframe_sources(spark: SparkSession, d: str) -> DataFrame:
    return embedded_frames(table(spark, d, "pages"))


def extraction_statistics(spark: SparkSession, d: str) -> DataFrame:
    f = facts(spark, d)
    return f.groupBy("method").agg(F.count("*").alias("attempted"), F.count_if(X.has_data(F.col("fact_value"))).alias("succeeded"), F.count_if(~X.has_data(F.col("fact_value"))).alias("failed"), F.count_if(F.col("score") >= 50).alias("confident"))


def best_page_per_type(spark: SparkSession, d: str) -> DataFrame:
    """The best fact of each child and type, the first of equals, from a score of 7."""
    best = facts(spark, d).where("score >= 7").groupBy("child_id", "fact_type").agg(F.max(F.struct("score", (-F.col("fact_id")).alias("before"))).alias("b"))
    return best.select("child_id", "fact_type", (-F.col("b.before")).alias("fact_id"), "b.score")


def weighted_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Weighted mean of the known indicators; 1.0 where none is."""
    h = F.lower("html")
    p = table(spark, d, "pages").select("page_id", *[X.occurrences(h, t).cast("double").alias(n) for n, t in (("js", "<script"), ("images", "<img"), ("iframes", "<iframe"))])
    value = sum((F.col(n) * w for n, w in COMPLEXITY), F.lit(0.0))
    weight = sum(w for _, w in COMPLEXITY)
    return p.select("page_id", F.round(F.coalesce(value / weight, F.lit(1.0)), 6).alias("complexity"))


def adaptive_timeout(spark: SparkSession, d: str) -> DataFrame:
    """A base by strategy, blended with the 95th percentile of the last 100 visits, then moved by retries, trend and success."""
    rn = F.row_number().over(Window.partitionBy("worker").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    v = visits(spark, d).withColumn("rn", rn).where("rn <= 100")
    g = v.groupBy("worker").agg(F.sort_array(F.collect_list("seconds")).alias("s"), F.sort_array(F.collect_list(F.when(F.col("seconds").isNotNull(), F.struct("rn", "seconds")))).alias("l"), F.avg(F.col("seconds").cast("decimal(18,6)")).cast("double").alias("m"), F.avg(F.col("ok").cast("double")).alias("r"))
    latest = F.slice("l.seconds", 1, 5)
    g = g.select("worker", F.size("s").alias("n"), X.exclusive_p95(F.col("s")).alias("p95"), (F.aggregate(latest, F.lit(0.0), lambda a, x: a + x) / 5).alias("recent"), "m", "r")
    m, r, n = F.col("m"), F.col("r"), F.col("n")
    strategy = F.when(n == 0, "moderate").when((m < 3) & (r > 0.9), "lightning").when(m < 8, "fast").when((m > 25) | (r < 0.6), "patient").when(m > 15, "complex").otherwise("moderate")
    g = g.withColumn("strategy", strategy)
    at = lambda i: F.coalesce(*[F.when(F.col("strategy") == name, row[i]) for name, row in STRATEGIES.items()])
    weight = F.least(n / 20.0, F.lit(0.7))
    t = F.when(n == 0, at(0)).otherwise(at(0) * (1 - weight) + F.col("p95") * 1.5 * weight) * F.pow(at(2), F.col("worker") % 3)
    t = t * F.when((n >= 5) & (F.col("recent") > m * 1.5), 1.3).when((n >= 5) & (F.col("recent") < m * 0.7), 0.9).otherwise(1.0) * F.when(r < 0.5, 1.4).when(r > 0.95, 0.9).otherwise(1.0)
    return g.select("worker", "strategy", F.round(F.greatest(F.lit(3.0), F.least(t, at(1))), 2).alias("timeout"))


def cache_ttl(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to keep a page: half an hour by what it says and whose it is."""
    h, u, host = F.lower("html"), F.col("url"), X.url_host(F.col("url"))
    content = F.when(h.contains("last-modified") | u.contains("static"), 3.0).when(X.any_of(h, MOVING_TERMS), 0.5).when(X.any_of(h, KEPT_TERMS), 2.0).otherwise(1.0)
    site = F.when(X.any_of(host, RELIABLE_HOSTS), 1.3).when(X.any_of(host, MOVING_HOSTS), 0.7).otherwise(1.0)
    return table(spark, d, "pages").select("page_id", F.round(1800.0 * content * site, 4).alias("ttl"))


def cache_statistics(spark: SparkSession, d: str) -> DataFrame:
    v = visits(spark, d)
    return v.groupBy("event_type").agg(F.count_if(F.col("event_id") % 3 != 0).alias("hits"), F.count_if(F.col("event_id") % 3 == 0).alias("misses"), F.round(100.0 * F.count_if(F.col("event_id") % 3 != 0) / F.greatest(F.count("*"), F.lit(1)), 4).alias("hit_rate"))


def lookup_times(spark: SparkSession, d: str) -> DataFrame:
    """The moving average of lookup times of each kind, newest last."""
    v = table(spark, d, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "value")
    return R.smoothed(v, "event_type", "at", "event_id", "value").withColumn("smoothed", F.round("smoothed", 6))


def detail_priority(spark: SparkSession, d: str) -> DataFrame:
    """Five less one for each missing field, one at least."""
    k = F.col("c_custkey")
    missing = sum(((k % m == 0).cast("int") for m in (2, 3, 5, 7)), F.lit(0))
    return table(spark, d, "customer").select("c_custkey", F.greatest(F.lit(1), 5 - missing).alias("priority"))


def link_score(spark: SparkSession, d: str) -> DataFrame:
    """Three a hit and one for a name, ten at most; the best link of each page from seven on."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    p = table(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))
    score = F.least(F.lit(10), 3 * X.hits(F.lower("href"), ("a", "e", "t", "n")) + F.col("href").rlike("[A-Z]").cast("int"))
    best = p.withColumn("score", score).where("score >= 7").groupBy("page_id").agg(F.max_by(F.struct("href", "score"), F.struct("score", -F.col("pos"))).alias("b"))
    return best.select("page_id", "b.href", "b.score")


def task_priority(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    return table(spark, d, "supplier").select("s_suppkey", F.round(5.0 - 0.01 * (rn - 1), 4).alias("priority"))


def progress(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") != "O").alias("processed"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return o.select("o_orderpriority", F.round(100.0 * F.col("processed") / F.greatest("total", F.lit(1)), 4).alias("progress"), F.round(100.0 * F.col("done") / F.greatest("processed", F.lit(1)), 4).alias("success"))


def extractor_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which kinds of work to skip, by thresholds joined on the kind."""
    limits = F.broadcast(spark.createDataFrame([("view", 0.3), ("click", 0.2), ("error", 0.1), ("signup", 0.5)], "kind string, most double"))
    g = visits(spark, d).groupBy("event_type").agg((F.count_if(F.col("status") != 200) / F.count("*")).alias("failing"))
    return g.join(limits, g["event_type"] == F.col("kind"), "left").select("event_type", F.round("failing", 6).alias("failing"), (F.col("failing") > F.coalesce("most", F.lit(0.25))).alias("skip"))


def field_aliases(spark: SparkSession, d: str) -> DataFrame:
    """The first alias that is present in JSON of changing shape."""
    k = F.col("event_id")
    doc = F.when(k % 3 == 0, F.concat(F.lit('{"name": "n'), k.cast("string"), F.lit('", "zip": 1}'))).when(k % 3 == 1, F.concat(F.lit('{"title": "t'), k.cast("string"), F.lit('"}'))).otherwise(F.concat(F.lit('noise {"label": "l'), k.cast("string"), F.lit('"} noise')))
    body = F.regexp_extract(doc, "(?s)\\{.*\\}", 0)
    name = F.coalesce(*[F.get_json_object(body, f"$.{a}") for a in ("name", "title", "label")])
    return table(spark, d, "events").select("event_id", name.alias("name"))


def directory_lines(spark: SparkSession, d: str) -> DataFrame:
    """Names and phones of directory text, each name once."""
    k = F.col("s_suppkey").cast("string")
    text = F.concat(F.lit("St. A"), k, F.lit(" 404-555-"), F.lpad(k, 4, "0"), F.lit("\nSt. B"), k, F.lit(" 404-556-"), F.lpad(k, 4, "0"), F.lit("\nSt. A"), k, F.lit(" 404-555-"), F.lpad(k, 4, "0"))
    rows = table(spark, d, "supplier").select("s_suppkey", text.alias("t")).select("s_suppkey", F.posexplode(F.regexp_extract_all("t", F.lit("(St\\. [A-Z][0-9]+ [0-9-]+)"), F.lit(1))).alias("pos", "line"))
    return rows.groupBy("s_suppkey", F.substring_index("line", " ", 2).alias("name")).agg(F.min_by(F.substring_index("line", " ", -1), "pos").alias("phone"))


def display_labels(spark: SparkSession, d: str) -> DataFrame:
    """Camel case as words, durations as minutes and seconds."""
    f = facts(spark, d).select("fact_id", F.trim(F.regexp_replace("fact_type", "([A-Z])", " $1")).alias("label"), "score")
    return f.select("fact_id", "label", F.when(F.col("score") >= 60, F.concat(F.floor(F.col("score") / 60).cast("string"), F.lit("m "), (F.col("score") % 60).cast("string"), F.lit("s"))).otherwise(F.concat(F.col("score").cast("string"), F.lit("s"))).alias("duration"))


def service_lines(spark: SparkSession, d: str) -> DataFrame:
    """The first five long lines with a day-like word."""
    lines = F.filter(F.split("text", "\n"), lambda x: (F.length(x) > 10) & F.lower(x).rlike("tion|ung|ment"))
    return table(spark, d, "documents").select("doc_id", F.size(lines).alias("n"), F.md5(F.encode(F.array_join(F.slice(lines, 1, 5), "; "), "UTF-8")).alias("digest"))


def relevant_section(spark: SparkSession, d: str) -> DataFrame:
    """The first paragraph below 2000 characters with two of the terms, cut at 1500."""
    found = F.filter(F.regexp_extract_all("html", F.lit("<p>([^<]*)</p>"), F.lit(1)), lambda x: (F.length(x) < 2000) & (X.hits(F.lower(x), ("the", "de", "tion", "en", "er")) >= 2))
    return table(spark, d, "pages").select("page_id", F.length(F.substring(F.try_element_at(found, F.lit(1)), 1, 1500)).alias("n_chars"))


def strategy_lookup(spark: SparkSession, d: str) -> DataFrame:
    """A page's kind and the strategy row joined to it."""
    rows = F.broadcast(spark.createDataFrame([("table", "rows", 0.9), ("list", "items", 0.8), ("plain", "text", 0.4)], "kind string, method string, confidence double"))
    h = F.lower("html")
    kind = F.when(h.contains("<table"), "table").when(h.contains("<ul"), "list").otherwise("plain")
    return table(spark, d, "pages").select("page_id", kind.alias("kind")).join(rows, "kind", "left")


def batch_statistics(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.floor(F.col("o_orderkey") / 1000).alias("batch"), "o_totalprice")
    g = o.groupBy("batch").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return g.agg(F.count("*").alias("batches"), F.sum("n").alias("records"), F.max("n").alias("largest"), F.round(F.max("top"), 2).alias("top"))


def profile_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Profiles by host, else by a platform found in the address."""
    host = F.regexp_replace(X.url_host(F.col("url")), "^www\\.", "")
    p = table(spark, d, "pages").select("page_id", host.alias("host"))
    known = p.where("page_id % 10 = 0").select(F.col("host").alias("_h")).distinct()
    return p.join(known, p["host"] == F.col("_h"), "left").select("page_id", F.when(F.col("_h").isNotNull(), "exact").when(F.col("host").startswith("blog."), "blog").when(F.col("host").startswith("m."), "mobile").otherwise("generic").alias("profile"))


QUERIES = {f.__name__: f for f in (skip_term_filter, name_validators, present_fields, api_endpoints, iframe_sources, extraction_statistics, best_page_per_type, weighted_complexity, adaptive_timeout, cache_ttl, cache_statistics, lookup_times, detail_priority, link_score, task_priority, progress, extractor_rules, field_aliases, directory_lines, display_labels, service_lines, relevant_section, strategy_lookup, batch_statistics, profile_lookup)}


def _any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def _hits(c: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{t}') AS INTEGER)" for t in terms) + ")"


def _occ(c: str, t: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, '{t}', ''))) / {len(t)} AS INTEGER)"


_LINES = "WITH n AS (SELECT doc_id, string_split(text, chr(10))[1] AS name FROM documents)"
_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_DATA = f"coalesce(fact_value, '') NOT IN ('', '{X.NOT_FOUND}')"

SQL = {
    "skip_term_filter": f"{_LINES} SELECT doc_id FROM n WHERE NOT {_any('lower(trim(name))', SKIP_TERMS)} AND length(trim(name)) >= 3",
    "name_validators": f"""{_LINES}, v AS (SELECT doc_id, {_any('lower(name)', NAME_TERMS)} AND NOT {_any('lower(name)', SKIP_TERMS)} AS by_exclusion, {_any('lower(name)', NAME_TERMS)} AND NOT {_any('lower(name)', UI_TERMS)} AS by_menu FROM n)
SELECT *, by_exclusion AND by_menu AS both FROM v""",
    "present_fields": "SELECT c_custkey, concat_ws(';', 'name=' || c_name, CASE WHEN c_custkey % 3 <> 0 THEN 'city=' || c_mktsegment END, CASE WHEN c_custkey % 2 = 0 THEN 'flag=false' END, 'zero=0') AS fields FROM customer",
    "api_endpoints": f"WITH p AS (SELECT page_id, html, {_hits('lower(html)', ('charset', 'href', 'script', 'footer', 'article', 'table'))} AS n_terms FROM pages) SELECT page_id, n_terms FROM p WHERE length(html) >= 50 AND n_terms >= 3",
    "iframe_sources": f"""WITH f AS (SELECT page_id, regexp_extract_all(html, '(?i)<iframe[^>]* src="([^"]*)"', 1) AS f FROM pages), s AS (SELECT page_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos, unnest(f) AS src FROM f),
k AS (SELECT *, CASE WHEN {_hits('lower(src)', FRAME_MAPS)} > 0 THEN 'mapping' WHEN {_hits('lower(src)', FRAME_WORDS)} > 0 THEN 'listing' END AS kind FROM s WHERE {_hits('lower(src)', FRAME_SERVICES)} = 0)
SELECT * FROM k WHERE kind IS NOT NULL""",
    "extraction_statistics": f"WITH {FACTS_SQL} SELECT method, count(*) AS attempted, count(*) FILTER ({_DATA}) AS succeeded, count(*) FILTER (NOT ({_DATA})) AS failed, count(*) FILTER (score >= 50) AS confident FROM facts GROUP BY method",
    "best_page_per_type": f"WITH {FACTS_SQL} SELECT child_id, fact_type, arg_max(fact_id, (score, -fact_id)) AS fact_id, max(score) AS score FROM facts WHERE score >= 7 GROUP BY 1, 2",
    "weighted_complexity": f"""WITH h AS (SELECT page_id, lower(html) AS h FROM pages), c AS (SELECT page_id, {_occ('h', '<script')} AS a, {_occ('h', '<img')} AS b, {_occ('h', '<iframe')} AS c FROM h),
w AS (SELECT *, a * 2.0 + b * 1.3 + c * 1.5 AS v FROM c)
SELECT page_id, round(coalesce(CAST(v AS DOUBLE) / 4.8::DOUBLE, 1.0), 6) AS complexity FROM w""",
    "adaptive_timeout": f"""WITH {VISITS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY ts DESC, event_id DESC) AS rn FROM visits),
g AS (SELECT worker, count(seconds) AS n, coalesce(list_sort(list(seconds) FILTER (seconds IS NOT NULL)), []) AS s, CAST(sum(CAST(seconds AS DECIMAL(18,6))) AS DOUBLE) / count(seconds) AS m, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS r FROM k WHERE rn <= 100 GROUP BY worker),
l AS (SELECT worker, sum(seconds) FILTER (i <= 5) / 5 AS recent FROM (SELECT worker, seconds, row_number() OVER (PARTITION BY worker ORDER BY rn) AS i FROM k WHERE rn <= 100 AND seconds IS NOT NULL) GROUP BY worker),
j AS (SELECT g.*, recent, greatest(1, least(CAST(floor(19 * (n + 1) / 20) AS INTEGER), n - 1)) AS j, CASE WHEN n = 0 THEN 'moderate' WHEN m < 3 AND r > 0.9 THEN 'lightning' WHEN m < 8 THEN 'fast' WHEN m > 25 OR r < 0.6 THEN 'patient' WHEN m > 15 THEN 'complex' ELSE 'moderate' END AS strategy FROM g LEFT JOIN l USING (worker)),
p AS (SELECT j.*, CASE WHEN n >= 5 THEN (s[j] * (20 - (19 * (n + 1) - j * 20)) + s[j + 1] * (19 * (n + 1) - j * 20)) / 20 WHEN n > 0 THEN list_sum(s) / n * 1.5::DOUBLE END AS p95, least(n / 20.0, 0.7::DOUBLE) AS w, {", ".join(f"CAST(CASE strategy " + " ".join(f"WHEN '{k}' THEN {v[i]}" for k, v in STRATEGIES.items()) + f" END AS DOUBLE) AS x{i}" for i in range(3))} FROM j)
SELECT worker, strategy, round(greatest(3.0, least(CASE WHEN n = 0 THEN x0 ELSE x0 * (1 - w) + p95 * 1.5::DOUBLE * w END * pow(x2, worker % 3) * CASE WHEN n >= 5 AND recent > m * 1.5::DOUBLE THEN 1.3 WHEN n >= 5 AND recent < m * 0.7::DOUBLE THEN 0.9 ELSE 1.0 END * CASE WHEN r < 0.5 THEN 1.4 WHEN r > 0.95 THEN 0.9 ELSE 1.0 END, x1)), 2) AS timeout FROM p""",
    "cache_ttl": f"""WITH p AS (SELECT page_id, url, lower(html) AS h, {_HOST} AS host FROM pages)
SELECT page_id, round(CAST(1800.0 * CASE WHEN contains(h, 'last-modified') OR contains(url, 'static') THEN 3.0 WHEN {_any('h', MOVING_TERMS)} THEN 0.5 WHEN {_any('h', KEPT_TERMS)} THEN 2.0 ELSE 1.0 END
* CASE WHEN {_any('host', RELIABLE_HOSTS)} THEN 1.3 WHEN {_any('host', MOVING_HOSTS)} THEN 0.7 ELSE 1.0 END AS DOUBLE), 4) AS ttl FROM p""",
    "lookup_times": """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn, row_number() OVER (PARTITION BY event_type ORDER BY value = 0, ts, event_id) AS first, ts, event_id FROM events),
f AS (SELECT event_type, arg_min((ts, event_id), first) AS start FROM e GROUP BY 1)
SELECT event_type, count(*) AS n, round(sum(CASE WHEN (ts, event_id) < start THEN 0 ELSE value * pow(0.9::DOUBLE, rn - 1) * CASE WHEN (ts, event_id) = start THEN 1 ELSE 0.1::DOUBLE END END), 6) AS smoothed FROM e JOIN f USING (event_type) GROUP BY 1""",
    "cache_statistics": f"WITH {VISITS_SQL} SELECT event_type, count(*) FILTER (event_id % 3 <> 0) AS hits, count(*) FILTER (event_id % 3 = 0) AS misses, round(100.0 * count(*) FILTER (event_id % 3 <> 0) / greatest(count(*), 1), 4) AS hit_rate FROM visits GROUP BY 1",
    "detail_priority": "SELECT c_custkey, greatest(1, 5 - (" + " + ".join(f"CAST(c_custkey % {m} = 0 AS INTEGER)" for m in (2, 3, 5, 7)) + ")) AS priority FROM customer",
    "link_score": f"""WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS f FROM pages), p AS (SELECT page_id, unnest(f) AS href, generate_subscripts(f, 1) AS pos FROM a),
s AS (SELECT *, least(10, 3 * {_hits('lower(href)', ('a', 'e', 't', 'n'))} + CAST(regexp_matches(href, '[A-Z]') AS INTEGER)) AS score FROM p)
SELECT page_id, href, score FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, pos) AS rn FROM s WHERE score >= 7) WHERE rn = 1""",
    "task_priority": "SELECT s_suppkey, round(CAST(5.0 - 0.01 * (row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1) AS DOUBLE), 4) AS priority FROM supplier",
    "progress": "WITH g AS (SELECT o_orderpriority, count(*) AS t, count(*) FILTER (o_orderstatus <> 'O') AS p, count(*) FILTER (o_orderstatus = 'F') AS d FROM orders GROUP BY 1) SELECT o_orderpriority, round(100.0 * p / greatest(t, 1), 4) AS progress, round(100.0 * d / greatest(p, 1), 4) AS success FROM g",
    "extractor_rules": f"""WITH {VISITS_SQL}, g AS (SELECT event_type, count(*) FILTER (status <> 200) / count(*) AS f FROM visits GROUP BY 1), l AS (SELECT * FROM (VALUES ('view', 0.3), ('click', 0.2), ('error', 0.1), ('signup', 0.5)) v(kind, most))
SELECT event_type, round(f, 6) AS failing, f > coalesce(most, 0.25) AS skip FROM g LEFT JOIN l ON event_type = kind""",
    "field_aliases": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'n' WHEN 1 THEN 't' ELSE 'l' END || event_id AS name FROM events",
    "directory_lines": "SELECT s_suppkey, 'St. A' || s_suppkey AS name, '404-555-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS phone FROM supplier UNION ALL SELECT s_suppkey, 'St. B' || s_suppkey, '404-556-' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') FROM supplier",
    "display_labels": f"WITH {FACTS_SQL} SELECT fact_id, trim(regexp_replace(fact_type, '([A-Z])', ' \\1', 'g')) AS label, CASE WHEN score >= 60 THEN (score // 60) || 'm ' || (score % 60) || 's' ELSE score || 's' END AS duration FROM facts",
    "service_lines": "WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: length(x) > 10 AND regexp_matches(lower(x), 'tion|ung|ment')) AS l FROM documents) SELECT doc_id, CAST(len(l) AS INTEGER) AS n, md5(coalesce(array_to_string(l[1:5], '; '), '')) AS digest FROM l",
    "relevant_section": f"WITH p AS (SELECT page_id, list_filter(regexp_extract_all(html, '<p>([^<]*)</p>', 1), lambda x: length(x) < 2000 AND {_hits('lower(x)', ('the', 'de', 'tion', 'en', 'er'))} >= 2) AS f FROM pages) SELECT page_id, CAST(length(substring(f[1], 1, 1500)) AS INTEGER) AS n_chars FROM p",
    "strategy_lookup": """WITH p AS (SELECT page_id, CASE WHEN contains(lower(html), '<table') THEN 'table' WHEN contains(lower(html), '<ul') THEN 'list' ELSE 'plain' END AS kind FROM pages)
SELECT kind, page_id, CASE kind WHEN 'table' THEN 'rows' WHEN 'list' THEN 'items' ELSE 'text' END AS method, CAST(CASE kind WHEN 'table' THEN 0.9 WHEN 'list' THEN 0.8 ELSE 0.4 END AS DOUBLE) AS confidence FROM p""",
    "batch_statistics": "WITH g AS (SELECT o_orderkey // 1000 AS batch, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY 1) SELECT count(*) AS batches, CAST(sum(n) AS BIGINT) AS records, max(n) AS largest, round(max(top), 2) AS top FROM g",
    "profile_lookup": f"""WITH p AS (SELECT page_id, regexp_replace({_HOST}, '^www\\.', '') AS host FROM pages)
SELECT page_id, CASE WHEN host IN (SELECT host FROM p WHERE page_id % 10 = 0) THEN 'exact' WHEN starts_with(host, 'blog.') THEN 'blog' WHEN starts_with(host, 'm.') THEN 'mobile' ELSE 'generic' END AS profile FROM p""",
}
