"""Queries on texts, pages, names and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.plans.base import VISITS_SQL, table, visits

#: Keyword weights that hit the invented texts of four languages.
QUALITY_TERMS = (("tion", 3), ("ment", 3), ("heit", 3), ("the ", 2), (" der ", 2), (" que ", 2), (" of ", 1), (" de ", 1), (" le ", 1))

# Error classes and their patterns, the first that matches counts.
ERROR_CLASSES = (
    ("network_timeout", ("timeout", "connection.*timed out", "read.*timeout", "socket.*timeout", "request.*timeout")),
    ("network_connection", ("connection.*refused", "connection.*reset", "network.*unreachable", "name.*not.*resolved", "no route to host")),
    ("http_client_error", ("404", "not found", "forbidden", "unauthorized", "bad request")),
    ("http_server_error", ("500", "502", "503", "504", "internal server error", "bad gateway", "service unavailable")),
    ("parsing_error", ("json.*decode", "xml.*parse", "html.*parse", "invalid.*syntax", "malformed.*data")),
    ("ai_service_error", ("ai.*error", "model.*error", "api.*quota", "rate.*limit", "service.*unavailable")),
    ("database_error", ("database.*error", "connection.*pool", "sql.*error", "table.*not.*exist", "constraint.*violation")),
    ("selenium_error", ("webdriver.*exception", "element.*not.*found", "session.*not.*created", "chrome.*not.*found", "browser.*crash")),
)
# Terms of severities, sought letter by letter, and classes that are not tried again.
SEVERITIES = (("critical", ("critical", "fatal", "database.*down")), ("high", ("500", "server.*error", "timeout")), ("medium", ("404", "not.*found", "parsing")))
NOT_AGAIN = ("http_client_error", "parsing_error")
# Phrases of pages that block, and what blocks.
BLOCK_PHRASES = (("attention required", "cloudflare"), ("checking your browser", "cloudflare"), ("access denied", "bot_detection"), ("prove you are human", "captcha"), ("blocked by security policy", "firewall"), ("ddos protection by", "ddos_protection"))
# How times are written.
TIME_PATTERNS = (r"\b(?:1[0-2]|[1-9]):(?:[0-5][0-9])\s*(?:AM|PM|am|pm)\b", r"\b(?:1[0-2]|[1-9])\s*(?:AM|PM|am|pm)\b", r"\b(?:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)\b")
# Evidence of a status.
STATUS_EVIDENCE = ((403, "HTTP 403 Forbidden status"), (429, "HTTP 429 Too Many Requests"), (503, "HTTP 503 Service Unavailable"))


def content_quality(spark: SparkSession, d: str) -> DataFrame:
    """Keyword hits weighted to a score and banded."""
    t = F.lower("text")
    total = sum((X.occurrences(t, k) * w for k, w in QUALITY_TERMS), F.lit(0))
    return table(spark, d, "documents").select("doc_id", total.alias("total"), X.band(total, ((10, "good"), (5, "fair"), (2, "poor"), (1, "irrelevant")), "error").alias("quality"))


PARISH = ("the", "ment", "tion", "heit", "customer")
EXCLUDE = ("ing", "ier", "ung", "office")
WEAK = ("of", "de", "er")


def _names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("name"))


def _validation(spark: SparkSession, d: str) -> DataFrame:
    """Signals for and against a name, the decision and its confidence."""
    low = F.lower(F.trim("name"))
    good = 2.0 * X.hits(low, PARISH) + 0.5 * X.hits(low, WEAK) + F.when(F.col("name").rlike("(?i)(^| )(saint|st|san|le) +[a-z]+"), 1.5).otherwise(0.0)
    bad = 2.5 * X.hits(low, EXCLUDE) + F.when(F.length(low) < 3, 1.0).otherwise(0.0) + F.when((F.upper("name") == F.col("name")) & (F.length("name") > 20), 0.5).otherwise(0.0) + F.when(low.isin("home", "contact", "about"), 2.0).otherwise(0.0)
    n = _names(spark, d).withColumn("good", good).withColumn("bad", bad)
    g, b = F.col("good"), F.col("bad")
    valid = F.when((b >= 3) & (g < 1), False).when((g >= 1.5) & (b < 1), True).when((b >= 3) & (g <= 4), False).when((g >= 0.5) & (b < 2), True).otherwise(g >= b)
    confidence = F.when(g + b == 0, 0.5).otherwise(X.clamp(F.abs(g - b) / (g + b + 1), 0.1, 0.95))
    return n.select("doc_id", "name", "good", "bad", valid.alias("is_valid"), F.round(confidence, 6).alias("confidence"))


def entity_validation(spark: SparkSession, d: str) -> DataFrame:
    return _validation(spark, d).drop("name")


def validation_stats(spark: SparkSession, d: str) -> DataFrame:
    v = _validation(spark, d)
    return v.groupBy("is_valid").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.7).alias("n_sure"), F.round(F.avg("good"), 6).alias("mean_good"))


def keyword_histogram(spark: SparkSession, d: str) -> DataFrame:
    """How many names each keyword occurs in."""
    words = F.filter(F.array(*[F.when(F.lower("name").contains(k), k) for k in (*PARISH, *EXCLUDE)]), lambda k: k.isNotNull())
    return _names(spark, d).select(F.explode(words).alias("keyword")).groupBy("keyword").agg(F.count("*").alias("n"))


def completeness_profile(spark: SparkSession, d: str) -> DataFrame:
    """Completeness counts, confidence bands and a quality score over customers with gaps."""
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.when(k % 3 != 0, F.col("c_mktsegment")).alias("city"), F.when(k % 4 == 0, "").otherwise("street").alias("address"), F.when(k % 5 != 0, "phone").alias("phone"), ((k % 10) / 10.0).alias("confidence"))
    has = lambda n: F.count_if(X.has_value(F.col(n)))
    g = c.agg(F.count("*").alias("n"), F.count_if(F.length("name") > 2).alias("names"), has("city").alias("cities"), has("address").alias("addresses"), has("phone").alias("phones"), F.count_if(F.col("confidence") >= 0.8).alias("high"), F.count_if((F.col("confidence") >= 0.5) & (F.col("confidence") < 0.8)).alias("medium"), F.count_if(F.col("confidence") < 0.5).alias("low"))
    basic = (F.col("names") + F.col("cities")) / (F.col("n") * 2) * 100
    more = (F.col("addresses") + F.col("phones")) / (F.col("n") * 2) * 100
    return g.withColumn("quality", F.round((basic + more) / 2, 4))


def contact_extract(spark: SparkSession, d: str) -> DataFrame:
    """First phone and email of each text, the phone formatted."""
    t = F.col("text")
    phone = X.first_match(t, X.PHONE)
    return table(spark, d, "documents").select("doc_id", phone.alias("phone"), X.first_match(t, X.EMAIL).alias("email"), X.format_phone(phone).alias("shown"))


def address_split(spark: SparkSession, d: str) -> DataFrame:
    """Distance, street, city, state and zip of listing lines."""
    k = F.col("c_custkey")
    line = F.concat(k.cast("string"), F.lit(" Main St, "), F.col("c_mktsegment"), F.lit(", NY "), F.lpad((k % 90000 + 10000).cast("string"), 5, "0"), F.when(k % 2 == 0, F.concat(F.lit(" ("), (k % 9).cast("string"), F.lit(".5 Miles)"))).otherwise(""))
    shape = "^(.*?), ([^,]+), ([A-Z]{2}) ([0-9]{5})"
    g = lambda i: F.regexp_extract("line", shape, i)
    return table(spark, d, "customer").select("c_custkey", line.alias("line")).select("c_custkey", g(1).alias("street"), g(2).alias("city"), g(3).alias("state"), g(4).alias("zip"), X.first_match(F.col("line"), "\\(([0-9.]+) Miles\\)", 1).alias("miles"))


def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    name = F.concat(F.when(k % 3 == 0, "St. Mary Catholic Church ").when(k % 3 == 1, "Our Lady of Fatima, Parish Church ").otherwise("Sts. Peter & Paul "), F.col("s_name"))
    address = F.concat(k.cast("string"), F.lit(" North Elm Street, Suite "), (k % 7).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", X.normalize_with(name, X.NAME_RULES).alias("name"), X.normalize_with(address, X.ADDRESS_RULES).alias("address"))


def _count(c: Column, *terms: str) -> Column:
    return sum((X.occurrences(c, t) for t in terms), F.lit(0))


def html_structure(spark: SparkSession, d: str) -> DataFrame:
    h = F.lower("html")
    p = table(spark, d, "pages").select("page_id", _count(h, "<table").alias("tables"), _count(h, "<ul", "<ol").alias("lists"), _count(h, "<a ").alias("links"), _count(h, "<img").alias("images"))
    kind = F.when(F.col("tables") > 3, "tabular_data").when(F.col("lists") > 5, "list_based").when(F.col("links") > 20, "navigation_heavy").otherwise("simple_content")
    return p.withColumn("kind", kind)


def html_complexity(spark: SparkSession, d: str) -> DataFrame:
    """Capped indicators and their weighted mean."""
    h = F.lower("html")
    p = table(spark, d, "pages").select(
        "page_id",
        F.least(_count(h, "<script", "javascript:") / 10, F.lit(3.0)).alias("js_heavy"),
        F.least(_count(h, "<img") / 20, F.lit(2.0)).alias("image_heavy"),
        F.least(_count(h, "<iframe") / 3, F.lit(2.0)).alias("iframes"),
        F.least(X.hits(h, ("ajax", "fetch(", "async")) / 3, F.lit(2.0)).alias("dynamic"),
    )
    return p.select("page_id", F.round((F.col("js_heavy") * 2.0 + F.col("image_heavy") * 1.3 + F.col("iframes") * 1.5 + F.col("dynamic") * 2.2) / 7.0, 6).alias("complexity"))


def html_text(spark: SparkSession, d: str) -> DataFrame:
    t = X.html_text(F.col("html"))
    return table(spark, d, "pages").select("page_id", F.length(t).alias("n_chars"), F.md5(F.encode(t, "UTF-8")).alias("digest"))


def embedded_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of each page in order, each target once, without anchors and scripts."""
    found = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    p = table(spark, d, "pages").select("page_id", F.posexplode(found).alias("pos", "href"))
    p = p.where(~F.col("href").startswith("#") & ~F.lower("href").rlike("^(javascript|mailto):") & (F.col("href") != ""))
    return p.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


def robots_rules(spark: SparkSession, d: str) -> DataFrame:
    """Directives of each host, once each, from a file of lines for each of its pages."""
    root = F.regexp_extract("url", "^([a-z]+://[^/?#]*)", 1)
    lines = F.split(F.concat(F.lit("User-agent: *\nDisallow: "), X.url_path(F.col("url")), F.lit("\n# note\nSitemap: "), root, F.lit("/sitemap.xml")), "\n")
    p = table(spark, d, "pages").select(X.url_host(F.col("url")).alias("host"), F.explode(lines).alias("line")).where(F.lower("line").rlike("^(sitemap|disallow):"))
    return p.select("host", F.lower(F.substring_index("line", ":", 1)).alias("directive"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value")).distinct()


def sitemap_urls(spark: SparkSession, d: str) -> DataFrame:
    """<loc> values of sitemaps built from the pages, without media."""
    xml = F.concat(F.lit("<urlset><url><loc>"), F.col("url"), F.lit("</loc></url><url><loc>"), F.col("url"), F.lit(".jpg</loc></url></urlset>"))
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all(xml, F.lit("<loc>([^<]*)</loc>"), F.lit(1))).alias("loc")).where(~F.col("loc").rlike("\\.(jpg|png|pdf)$"))


def blocking_detect(spark: SparkSession, d: str) -> DataFrame:
    """Blocking by status or body phrase, with evidence and a description."""
    h, k = F.lower("html"), F.col("page_id")
    status = F.when(k % 11 == 0, 403).when(k % 13 == 0, 429).when(k % 17 == 0, 503).otherwise(200)
    by_status = F.when(F.col("status") == 403, "403_forbidden").when(F.col("status") == 429, "rate_limited").when(F.col("status") == 503, "service_unavailable")
    by_body = F.coalesce(*[F.when(h.contains(p), kind) for p, kind in BLOCK_PHRASES])
    said = [F.when(F.col("status") == code, text) for code, text in STATUS_EVIDENCE] + [F.when(h.contains(p), f"Content pattern: {p}") for p, _ in BLOCK_PHRASES]
    evidence = F.array_join(F.array_compact(F.array(*said)), "; ")
    p = table(spark, d, "pages").withColumn("status", status)
    kind = F.coalesce(by_status, by_body)
    return p.select("page_id", "status", kind.isNotNull().alias("is_blocked"), kind.alias("kind"), evidence.alias("evidence"))


def _messages(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    said = F.when(e % 6 == 0, "Connection to host timed out").when(e % 6 == 1, "Connection refused by peer").when(e % 6 == 2, "HTTP 404: page not found").when(e % 6 == 3, "HTTP 503: Service Unavailable").when(e % 6 == 4, "Json could not decode").otherwise("Unknown: oops")
    return visits(spark, d).select("event_id", "event_type", said.alias("message"))


def error_classify(spark: SparkSession, d: str) -> DataFrame:
    m = F.lower("message")
    kind = X.first_class(m, ERROR_CLASSES, "unknown")
    severity = F.coalesce(*[F.when(X.any_of(m, terms), label) for label, terms in SEVERITIES], F.lit("low"))
    return _messages(spark, d).withColumn("kind", kind).select("event_id", "kind", severity.alias("severity"), (~F.col("kind").isin(*NOT_AGAIN)).alias("retryable"))


def error_statistics(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).withColumn("kind", X.first_class(F.lower("message"), ERROR_CLASSES, "unknown"))
    return m.groupBy("event_type", "kind").agg(F.count("*").alias("n"), F.count_if(F.col("event_id") % 3 == 0).alias("recovered"))


def error_prefixes(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d).groupBy(F.substring_index("message", ":", 1).alias("prefix")).agg(F.count("*").alias("n"))
    return m.orderBy(F.col("n").desc(), "prefix").limit(5)


def time_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Times of day, hours of the day and weekdays, by each pattern in turn: the first twenty and how many there are."""
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), F.lit(0)) for p in TIME_PATTERNS])
    return table(spark, d, "documents").select("doc_id", F.array_join(F.slice(found, 1, 20), ",").alias("times"), F.size(found).alias("n"))


def context_snippet(spark: SparkSession, d: str) -> DataFrame:
    """100 characters on either side of a keyword's first place."""
    at = F.locate("tion", F.lower("text"))
    return table(spark, d, "documents").where(at > 0).select("doc_id", F.substring("text", F.greatest(at - 100, F.lit(1)), F.lit(4) + 100 + F.least(at - 1, F.lit(100))).alias("snippet"))


def line_lookahead(spark: SparkSession, d: str) -> DataFrame:
    """The line after each first line, and the two after that, as one text."""
    lines = F.split("text", "\n")
    return table(spark, d, "documents").where(F.size(lines) > 1).select("doc_id", F.length(F.array_join(F.slice(lines, 2, 3), " ")).alias("n_chars"), F.size(lines).alias("n_lines"))


def statement_lint(spark: SparkSession, d: str) -> DataFrame:
    """Statements of SQL scripts, one script an order, and whether they destroy data."""
    k = F.col("o_orderkey").cast("string")
    second = F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("DROP TABLE t"), k)).otherwise(F.concat(F.lit("SELECT *\n  FROM t"), k))
    script = F.concat(F.lit("-- setup; of\nCREATE TABLE t"), k, F.lit(" (id int);\n"), second, F.lit("; UPDATE t SET p = '"), F.col("o_orderpriority"), F.lit("';"))
    bare = F.regexp_replace(script, "--[^\\n]*\\n", "")
    o = table(spark, d, "orders").select("o_orderkey", F.posexplode(F.split(bare, ";")).alias("pos", "statement")).select("o_orderkey", "pos", X.squeeze(F.col("statement")).alias("statement")).where("statement <> ''")
    return o.select("*", F.lower("statement").rlike("^(drop|truncate)").alias("destructive"))


def training_set(spark: SparkSession, d: str) -> DataFrame:
    """Labelled rows by ordered rules, with weights; unlabelled ones give negatives of low weight."""
    t, lab = table(spark, d, "documents"), table(spark, d, "labels")
    j = t.join(lab.select(F.col("doc_id").alias("_l"), "quality", "toxic"), F.col("doc_id") == F.col("_l"), "left")
    label = F.when(F.col("quality") == 1, 1).when(F.col("quality") == 0, 0).when(F.col("n_chars") < 300, 0)
    weight = F.when(F.col("toxic") == 1, 0.8).when(F.col("quality").isNotNull(), 1.0).otherwise(0.5)
    return j.select("doc_id", label.alias("label"), weight.alias("weight")).where("label is not null")


def precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """A length rule against the quality labels."""
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select((F.col("n_chars") > 500).alias("p"), (F.col("quality") == 1).alias("y"))
    g = j.agg(F.count_if(F.col("p") & F.col("y")).alias("tp"), F.count_if(F.col("p") & ~F.col("y")).alias("fp"), F.count_if(~F.col("p") & F.col("y")).alias("fn"))
    p, r = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1)), F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return g.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def cache_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.md5(F.encode(F.concat_ws("|", F.lit("page"), "url", F.col("page_id").cast("string")), "UTF-8")).alias("key"))


QUERIES = {f.__name__: f for f in (content_quality, entity_validation, validation_stats, keyword_histogram, completeness_profile, contact_extract, address_split, name_normalize, html_structure, html_complexity, html_text, embedded_links, robots_rules, sitemap_urls, blocking_detect, error_classify, error_statistics, error_prefixes, time_mentions, context_snippet, line_lookahead, statement_lint, training_set, precision_recall, cache_keys)}


def _occ(c: str, t: str) -> str:
    return f"CAST((length({c}) - length(replace({c}, '{t}', ''))) / {len(t)} AS INTEGER)"


def _occs(c: str, *terms: str) -> str:
    return "(" + " + ".join(_occ(c, t) for t in terms) + ")"


def _hits(c: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{t}') AS INTEGER)" for t in terms) + ")"


_TOTAL = " + ".join(f"{_occ('t', k)} * {w}" for k, w in QUALITY_TERMS)
_VALID = f"""n AS (SELECT doc_id, string_split(text, chr(10))[1] AS name FROM documents), l AS (SELECT *, lower(trim(name)) AS low FROM n),
g AS (SELECT *, CAST(2.0 * {_hits('low', PARISH)} + 0.5 * {_hits('low', WEAK)} + CASE WHEN regexp_matches(name, '(?i)(^| )(saint|st|san|le) +[a-z]+') THEN 1.5 ELSE 0 END AS DOUBLE) AS good,
 CAST(2.5 * {_hits('low', EXCLUDE)} + CASE WHEN length(low) < 3 THEN 1.0 ELSE 0 END + CASE WHEN upper(name) = name AND length(name) > 20 THEN 0.5 ELSE 0 END + CASE WHEN low IN ('home', 'contact', 'about') THEN 2.0 ELSE 0 END AS DOUBLE) AS bad FROM l),
v AS (SELECT doc_id, good, bad, CASE WHEN bad >= 3 AND good < 1 THEN false WHEN good >= 1.5 AND bad < 1 THEN true WHEN bad >= 3 AND good <= 4 THEN false WHEN good >= 0.5 AND bad < 2 THEN true ELSE good >= bad END AS is_valid,
 round(CASE WHEN good + bad = 0 THEN 0.5 ELSE greatest(least(abs(good - bad) / (good + bad + 1), 0.95), 0.1) END, 6) AS confidence FROM g)"""


def _rewrites(c: str, rules) -> str:
    for pattern, into in rules:
        c = f"regexp_replace({c}, '{pattern}', '{into}', 'g')"
    return f"trim(regexp_replace(regexp_replace({c}, '[^a-z0-9_ \\t]', '', 'g'), '[ \\t-\\r]+', ' ', 'g'))"


_CLASS = "CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{'|'.join(p)}') THEN '{k}'" for k, p in ERROR_CLASSES) + " ELSE 'unknown' END"
_MSG = f"""WITH {VISITS_SQL}, m AS (SELECT event_id, event_type, CASE event_id % 6 WHEN 0 THEN 'Connection to host timed out' WHEN 1 THEN 'Connection refused by peer' WHEN 2 THEN 'HTTP 404: page not found' WHEN 3 THEN 'HTTP 503: Service Unavailable' WHEN 4 THEN 'Json could not decode' ELSE 'Unknown: oops' END AS message FROM visits),
c AS (SELECT *, {_CLASS} AS kind FROM m)"""
_SEVERITY = " ".join(f"WHEN {_hits('lower(message)', t)} > 0 THEN '{k}'" for k, t in SEVERITIES)
_TEXT = "trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t-\\r]+', ' ', 'g'))"

SQL = {
    "content_quality": f"WITH d AS (SELECT doc_id, lower(text) AS t FROM documents), s AS (SELECT doc_id, {_TOTAL} AS total FROM d) SELECT doc_id, total, CASE WHEN total >= 10 THEN 'good' WHEN total >= 5 THEN 'fair' WHEN total >= 2 THEN 'poor' WHEN total >= 1 THEN 'irrelevant' ELSE 'error' END AS quality FROM s",
    "entity_validation": f"WITH {_VALID} SELECT * FROM v",
    "validation_stats": f"WITH {_VALID} SELECT is_valid, count(*) AS n, count(*) FILTER (confidence > 0.7) AS n_sure, round(avg(good), 6) AS mean_good FROM v GROUP BY is_valid",
    "keyword_histogram": "WITH n AS (SELECT lower(string_split(text, chr(10))[1]) AS name FROM documents), k AS (SELECT unnest([" + ", ".join(f"'{k}'" for k in (*PARISH, *EXCLUDE)) + "]) AS keyword) SELECT keyword, count(*) AS n FROM n JOIN k ON contains(name, keyword) GROUP BY keyword",
    "completeness_profile": """WITH g AS (SELECT count(*) AS n, count(*) FILTER (length(c_name) > 2) AS names, count(*) FILTER (c_custkey % 3 <> 0 AND c_mktsegment <> '') AS cities, count(*) FILTER (c_custkey % 4 <> 0) AS addresses, count(*) FILTER (c_custkey % 5 <> 0) AS phones,
count(*) FILTER (c_custkey % 10 >= 8) AS high, count(*) FILTER (c_custkey % 10 BETWEEN 5 AND 7) AS medium, count(*) FILTER (c_custkey % 10 < 5) AS low FROM customer)
SELECT *, round(((names + cities) / (n * 2) * 100 + (addresses + phones) / (n * 2) * 100) / 2, 4) AS quality FROM g""",
    "contact_extract": f"""WITH p AS (SELECT doc_id, nullif(regexp_extract(text, '{X.PHONE}'), '') AS phone, nullif(regexp_extract(text, '{X.EMAIL}'), '') AS email FROM documents), q AS (SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS dd FROM p)
SELECT doc_id, phone, email, CASE WHEN length(dd) = 10 THEN '(' || dd[1:3] || ') ' || dd[4:6] || '-' || dd[7:10] ELSE phone END AS shown FROM q""",
    "address_split": "SELECT c_custkey, c_custkey || ' Main St' AS street, c_mktsegment AS city, 'NY' AS state, lpad(CAST(c_custkey % 90000 + 10000 AS VARCHAR), 5, '0') AS zip, CASE WHEN c_custkey % 2 = 0 THEN (c_custkey % 9) || '.5' END AS miles FROM customer",
    "name_normalize": f"""WITH s AS (SELECT s_suppkey, lower(trim(CASE s_suppkey % 3 WHEN 0 THEN 'St. Mary Catholic Church ' WHEN 1 THEN 'Our Lady of Fatima, Parish Church ' ELSE 'Sts. Peter & Paul ' END || s_name)) AS n, lower(s_suppkey || ' North Elm Street, Suite ' || s_suppkey % 7) AS a FROM supplier)
SELECT s_suppkey, {_rewrites('n', X.NAME_RULES)} AS name, {_rewrites('a', X.ADDRESS_RULES)} AS address FROM s""",
    "html_structure": f"""WITH h AS (SELECT page_id, lower(html) AS h FROM pages), c AS (SELECT page_id, {_occs('h', '<table')} AS tables, {_occs('h', '<ul', '<ol')} AS lists, {_occs('h', '<a ')} AS links, {_occs('h', '<img')} AS images FROM h)
SELECT *, CASE WHEN tables > 3 THEN 'tabular_data' WHEN lists > 5 THEN 'list_based' WHEN links > 20 THEN 'navigation_heavy' ELSE 'simple_content' END AS kind FROM c""",
    "html_complexity": f"""WITH h AS (SELECT page_id, lower(html) AS h FROM pages), c AS (SELECT page_id, least({_occs('h', '<script', 'javascript:')} / 10, 3.0) AS a, least({_occs('h', '<img')} / 20, 2.0) AS b, least({_occs('h', '<iframe')} / 3, 2.0) AS c, least({_hits('h', ('ajax', 'fetch(', 'async'))} / 3, 2.0) AS e FROM h)
SELECT page_id, round((a * 2.0 + b * 1.3 + c * 1.5 + e * 2.2) / 7.0, 6) AS complexity FROM c""",
    "html_text": f"SELECT page_id, length({_TEXT}) AS n_chars, md5({_TEXT}) AS digest FROM pages",
    "embedded_links": """WITH a AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS f FROM pages), p AS (SELECT page_id, unnest(f) AS href, generate_subscripts(f, 1) - 1 AS pos FROM a)
SELECT page_id, href, CAST(min(pos) AS INTEGER) AS pos FROM p WHERE NOT starts_with(href, '#') AND NOT regexp_matches(lower(href), '^(javascript|mailto):') AND href <> '' GROUP BY 1, 2""",
    "robots_rules": """WITH p AS (SELECT regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) AS root, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages), h AS (SELECT *, lower(regexp_extract(root, '^[a-z]+://(.*)$', 1)) AS host FROM p)
SELECT DISTINCT host, 'disallow' AS directive, path AS value FROM h UNION ALL SELECT DISTINCT host, 'sitemap', root || '/sitemap.xml' FROM h""",
    "sitemap_urls": "WITH x AS (SELECT page_id, unnest(regexp_extract_all('<urlset><url><loc>' || url || '</loc></url><url><loc>' || url || '.jpg</loc></url></urlset>', '<loc>([^<]*)</loc>', 1)) AS loc FROM pages) SELECT * FROM x WHERE NOT regexp_matches(loc, '\\.(jpg|png|pdf)$')",
    "blocking_detect": f"""WITH p AS (SELECT page_id, CASE WHEN page_id % 11 = 0 THEN 403 WHEN page_id % 13 = 0 THEN 429 WHEN page_id % 17 = 0 THEN 503 ELSE 200 END AS status, lower(html) AS h FROM pages),
k AS (SELECT *, coalesce(CASE status WHEN 403 THEN '403_forbidden' WHEN 429 THEN 'rate_limited' WHEN 503 THEN 'service_unavailable' END, CASE {" ".join(f"WHEN contains(h, '{p}') THEN '{k}'" for p, k in BLOCK_PHRASES)} END) AS kind FROM p)
SELECT page_id, status, kind IS NOT NULL AS is_blocked, kind, concat_ws('; ', CASE status {" ".join(f"WHEN {c} THEN '{t}'" for c, t in STATUS_EVIDENCE)} END, {", ".join(f"CASE WHEN contains(h, '{p}') THEN 'Content pattern: {p}' END" for p, _ in BLOCK_PHRASES)}) AS evidence FROM k""",
    "error_classify": f"{_MSG} SELECT event_id, kind, CASE {_SEVERITY} ELSE 'low' END AS severity, kind NOT IN ('{NOT_AGAIN[0]}', '{NOT_AGAIN[1]}') AS retryable FROM c",
    "error_statistics": f"{_MSG} SELECT event_type, kind, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS recovered FROM c GROUP BY 1, 2",
    "error_prefixes": f"{_MSG} SELECT split_part(message, ':', 1) AS prefix, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, prefix LIMIT 5",
    "time_mentions": f"WITH t AS (SELECT doc_id, list_concat({', '.join(f"regexp_extract_all(text, '{p}')" for p in TIME_PATTERNS)}) AS f FROM documents) SELECT doc_id, array_to_string(f[1:20], ',') AS times, CAST(len(f) AS INTEGER) AS n FROM t",
    "context_snippet": "WITH t AS (SELECT doc_id, text, instr(lower(text), 'tion') AS at_ FROM documents) SELECT doc_id, substring(text, greatest(at_ - 100, 1), 104 + least(at_ - 1, 100)) AS snippet FROM t WHERE at_ > 0",
    "line_lookahead": "WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) SELECT doc_id, CAST(length(array_to_string(l[2:4], ' ')) AS INTEGER) AS n_chars, CAST(len(l) AS INTEGER) AS n_lines FROM t WHERE len(l) > 1",
    "statement_lint": """SELECT o_orderkey, 0 AS pos, 'CREATE TABLE t' || o_orderkey || ' (id int)' AS statement, false AS destructive FROM orders
UNION ALL SELECT o_orderkey, 1, CASE WHEN o_orderstatus = 'F' THEN 'DROP TABLE t' ELSE 'SELECT * FROM t' END || o_orderkey, o_orderstatus = 'F' FROM orders UNION ALL SELECT o_orderkey, 2, 'UPDATE t SET p = ' || chr(39) || o_orderpriority || chr(39), false FROM orders""",
    "training_set": """SELECT doc_id, label, weight FROM (SELECT doc_id, CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN 0 WHEN n_chars < 300 THEN 0 END AS label,
CAST(CASE WHEN toxic = 1 THEN 0.8 WHEN quality IS NOT NULL THEN 1.0 ELSE 0.5 END AS DOUBLE) AS weight FROM documents LEFT JOIN labels USING (doc_id)) WHERE label IS NOT NULL""",
    "precision_recall": """WITH j AS (SELECT n_chars > 500 AS p, quality = 1 AS y FROM documents JOIN labels USING (doc_id)),
g AS (SELECT count(*) FILTER (p AND y) AS tp, count(*) FILTER (p AND NOT y) AS fp, count(*) FILTER (NOT p AND y) AS fn FROM j),
r AS (SELECT *, tp / greatest(tp + fp, 1) AS pr, tp / greatest(tp + fn, 1) AS re FROM g)
SELECT tp, fp, fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0.0 END, 6) AS f1 FROM r""",
    "cache_keys": "SELECT page_id, md5('page|' || url || '|' || page_id) AS key FROM pages",
}
