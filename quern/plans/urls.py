"""Queries on the URLs of crawled pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.functions import urls as U
from quern.operators import relational as R
from quern.plans.base import table

T = U.UrlTerms()
WEIGHTS = (("en", 5), ("fr", 3), ("1", 2), ("index", 4))
NEGATIVE = ("de", "9")
BASE = "ththre.example.com"


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", "url")


def _confidence():
    return (F.col("page_id") % 10) / 10.0


def url_normalize(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select("page_id", X.normalize_url(F.col("url")).alias("normalized"), X.comparable_url(F.col("url")).alias("comparable"))


def url_suppression(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose normalised URL is not among the suppressed ones."""
    p = _pages(spark, d).withColumn("n", X.normalize_url(F.col("url")))
    gone = p.where("page_id % 7 = 0").select(F.col("n").alias("gone")).distinct()
    return R.without_rows(p, gone, "n", "gone").select("page_id", "url")


def url_features(spark: SparkSession, d: str) -> DataFrame:
    u, path, host = F.col("url"), F.lower(X.url_path(F.col("url"))), X.url_host(F.col("url"))
    flag = lambda c: c.cast("double")
    return _pages(spark, d).select(
        "page_id",
        flag(path.contains("en")).alias("has_en"),
        flag(path.contains("fr") | path.contains("de")).alias("has_other"),
        flag(U.path_depth(u)).alias("path_depth"),
        flag(F.length(path)).alias("path_length"),
        flag(path.contains("-")).alias("has_hyphen"),
        flag(path.contains("_")).alias("has_underscore"),
        flag(F.length(host)).alias("domain_length"),
        flag(F.size(F.split(host, "\\.")) > 2).alias("has_subdomain"),
        flag(path.endswith(".html")).alias("ends_with_html"),
        flag(X.any_of(path, ("donate", "news", "9"))).alias("has_negative"),
    )


def url_pattern_stats(spark: SparkSession, d: str) -> DataFrame:
    """Attempts and successes of each host and path shape."""
    p = table(spark, d, "pages").select(X.url_host(F.col("url")).alias("host"), X.url_pattern(X.url_path(F.col("url"))).alias("pattern"), (F.length("html") > 2000).alias("ok"), "page_id")
    return p.groupBy("host", "pattern").agg(F.count("*").alias("attempts"), F.count_if("ok").alias("successes"), F.max(F.when(F.col("ok"), F.col("page_id"))).alias("last_success"))


def host_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Each host's path shapes that have succeeded and those that never have; lists are as long as a host has shapes."""
    p = url_pattern_stats(spark, d).withColumn("good", F.col("successes") > 0)
    listed = lambda keep: F.array_join(F.sort_array(F.collect_list(F.when(keep, F.col("pattern")))), " ")
    return p.groupBy("host").agg(listed(F.col("good")).alias("succeeded"), listed(~F.col("good")).alias("failed"))


def url_relevance(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).where(U.relevant(F.col("url"), T) & ~F.col("url").rlike("(?i)\\.(jpg|png|gif|mp4)$") & ~F.col("url").rlike("[^/]+@[^/]+"))


def url_quality_topn(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best URLs by quality rank and score; skipped ones are out."""
    u, c = F.col("url"), _confidence()
    p = _pages(spark, d).withColumn("score", U.quality_score(u, c, T))
    p = p.withColumn("quality", U.quality_label(u, F.col("score"), T))
    p = p.withColumn("seconds", F.round(U.estimated_seconds(u, F.col("score"), F.col("quality"), c), 4))
    rank = F.when(F.col("quality") == "excellent", 4).when(F.col("quality") == "good", 3).when(F.col("quality") == "fair", 2).otherwise(1)
    return p.where("quality <> 'skip'").orderBy(rank.desc(), F.col("score").desc(), "page_id").limit(50).select("page_id", "quality", F.round(F.least("score", F.lit(100.0)), 4).alias("score"), "seconds")


def url_quality_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The same by the label's text, for parity: poor comes before good."""
    u, c = F.col("url"), _confidence()
    p = _pages(spark, d).withColumn("score", U.quality_score(u, c, T))
    p = p.withColumn("quality", U.quality_label(u, F.col("score"), T))
    return p.where("quality <> 'skip'").orderBy(F.col("quality").desc(), F.col("score").desc(), "page_id").limit(50).select("page_id", "quality")


def url_priority(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return _pages(spark, d).select("page_id", U.keyword_priority(u, WEIGHTS, NEGATIVE, BASE).alias("keyword_priority"), U.static_priority(u, T).alias("static_priority"))


def url_keyword_join(spark: SparkSession, d: str) -> DataFrame:
    """Weights of the keyword table's words in each path, by a broadcast of a table of four rows."""
    words = F.broadcast(spark.createDataFrame(list(WEIGHTS), "word string, weight int"))
    p = _pages(spark, d).withColumn("path", F.lower(X.url_path(F.col("url"))))
    return p.join(words, F.col("path").contains(F.col("word")), "left").groupBy("page_id").agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("weight"), F.count("word").alias("n_words"))


def candidate_urls(spark: SparkSession, d: str) -> DataFrame:
    """Scheme and path candidates of each host with their confidence, each URL once from its best source."""
    hosts = _pages(spark, d).select(X.url_host(F.col("url")).alias("host")).distinct()
    paths = F.array(*[F.struct(F.lit(p).alias("path"), F.lit(w).alias("boost")) for p, w in (("/schedule", 0.3), ("/times", 0.3), ("/about", 0.0))])
    made = hosts.withColumn("scheme", F.explode(F.array(F.lit("https://"), F.lit("http://")))).withColumn("p", F.explode(paths))
    made = made.select(F.concat("scheme", "host", "p.path").alias("url"), F.lit(1).alias("tier"), (0.5 + F.col("p.boost")).alias("confidence"))
    known = _pages(spark, d).select("url", F.lit(0).alias("tier"), F.lit(1.0).alias("confidence"))
    return known.unionByName(made).groupBy("url").agg(F.min(F.struct("tier", -F.col("confidence"))).alias("m")).select("url", F.col("m.tier").alias("tier"), (-F.col("m.col2")).alias("confidence"))


def url_total_score(spark: SparkSession, d: str) -> DataFrame:
    """Static priority plus the source's boost and quality's, best 25."""
    u, c = F.col("url"), _confidence()
    boost = F.when(F.col("page_id") % 4 == 0, 20.0 * c).when(F.col("page_id") % 4 == 1, 15.0).when(F.col("page_id") % 4 == 2, 5.0).otherwise(0.0)
    total = U.static_priority(u, T) + boost + F.when(F.col("page_id") % 6 == 0, 15.0).otherwise(0.0) + F.when(c > 0.5, 10.0).otherwise(0.0)
    return _pages(spark, d).select("page_id", F.round(total, 4).alias("total")).orderBy(F.col("total").desc(), "page_id").limit(25)


def host_strategy(spark: SparkSession, d: str) -> DataFrame:
    """Ordered host rules: the first that holds names the strategy, its limit and its timeouts."""
    host = X.url_host(F.col("url"))
    kind = F.when(host.startswith("m."), "mobile").when(host.startswith("blog."), "blog").when(host.endswith(".org"), "organisation").otherwise("default")
    base = F.when(F.col("kind") == "mobile", 15.0).when(F.col("kind") == "blog", 25.0).otherwise(30.0)
    steps = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.format_number(F.greatest(F.lit(1.0), F.least(F.col("base"), F.col("base") * (0.2 + 0.8 * i / 4 + 0.1 * F.length("kind") / 50))), 1)), "/")
    return _pages(spark, d).withColumn("kind", kind).withColumn("base", base).select("page_id", "kind", "base", steps.alias("timeouts"))


def optimal_workers(spark: SparkSession, d: str) -> DataFrame:
    p = _pages(spark, d).agg(F.count_distinct(X.url_host(F.col("url"))).alias("hosts"), F.count("*").alias("urls"))
    n = F.when(F.col("hosts") <= 2, 2).when(F.col("hosts") <= 5, 3).otherwise(F.least("hosts", F.lit(8))) + F.when(F.col("urls") > 50, 1).otherwise(0)
    return p.select("hosts", "urls", F.when(F.col("urls") == 0, 1).otherwise(F.least(n, F.lit(8))).alias("workers"))


def adaptive_threshold(spark: SparkSession, d: str) -> DataFrame:
    """A threshold of 15 with adjustments by URL and length, 3 at least."""
    p = table(spark, d, "pages")
    u, words = F.lower("url"), F.size(F.split(X.html_text(F.col("html")), " "))
    move = F.when(X.any_of(u, ("blog", "index")), -10).otherwise(0) + F.when(X.any_of(u, ("/en/", "schedule")), -7).otherwise(0) + F.when(u.contains("page"), -5).otherwise(0)
    move = move + F.when(words > 500, -5).when(words < 100, 3).otherwise(0) + F.when(u.contains("ref"), 10).otherwise(0)
    return p.select("page_id", F.greatest(F.lit(3), 15 + move).alias("threshold"))


QUERIES = {f.__name__: f for f in (url_normalize, url_suppression, url_features, url_pattern_stats, host_patterns, url_relevance, url_quality_topn, url_quality_by_label, url_priority, url_keyword_join, candidate_urls, url_total_score, host_strategy, optimal_workers, adaptive_threshold)}

_HOST = "lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_REST = "regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
_NORM = f"'https://' || regexp_replace(regexp_extract({_REST}, '^([^/?#]*)', 1), '^www\\.', '') || regexp_replace(regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1), '/+$', '') || regexp_extract({_REST}, '^[^?#]*(.*)$', 1)"
_CUT = "regexp_replace(lower(trim(url)), '/$', '')"
_COMP = f"regexp_replace(CASE WHEN regexp_matches({_CUT}, '^https?://') THEN {_CUT} ELSE 'https://' || {_CUT} END, '^http://', 'https://')"
_PATTERN = f"regexp_replace(lower(regexp_replace(regexp_replace({_PATH}, '/[0-9]+', '/NUM', 'g'), '[0-9]+', 'N', 'g')), '[a-f0-9]{{8,}}', 'ID', 'g')"


def _any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def _sum(c: str, terms) -> str:
    return "(" + " + ".join(f"CAST(contains({c}, '{t}') AS INTEGER)" for t in terms) + ")"


_DEPTH = f"len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))"
_STATIC = f"greatest(5.0 * {_sum('lower(url)', T.high)} + 3.0 * {_sum('lower(url)', T.medium)} + 1.0 * {_sum('lower(url)', T.general)} - 2.0 * {_sum('lower(url)', T.low)}, 0.0)"
_QUALITY = f"""q AS (SELECT page_id, url, page_id % 10 / 10.0 AS c, {_DEPTH} AS depth FROM pages),
s AS (SELECT *, CAST(25.0 * {_sum('lower(url)', T.high)} + 15.0 * {_sum('lower(url)', T.medium)} + 5.0 * {_sum('lower(url)', T.general)} + CASE WHEN c > 0.3 THEN c * 50.0 ELSE 0.0 END
  + CASE WHEN depth <= 2 THEN 10.0 WHEN depth > 5 THEN -10.0 ELSE 0.0 END - CASE WHEN contains(url, '?') THEN 5.0 ELSE 0.0 END AS DOUBLE) AS score FROM q),
l AS (SELECT *, CASE WHEN {_any(_HOST, T.blocked_hosts)} OR regexp_matches(lower({_PATH}), '\\.(pdf|docx?|zip)$') THEN 'skip' WHEN score >= 80 THEN 'excellent' WHEN score >= 60 THEN 'good' WHEN score >= 40 THEN 'fair' WHEN score >= 20 THEN 'poor' ELSE 'skip' END AS quality FROM s)"""

SQL = {
    "url_normalize": f"SELECT page_id, {_NORM} AS normalized, {_COMP} AS comparable FROM pages",
    "url_suppression": f"WITH p AS (SELECT page_id, url, {_NORM} AS n FROM pages) SELECT page_id, url FROM p WHERE n NOT IN (SELECT n FROM p WHERE page_id % 7 = 0)",
    "url_features": f"""WITH p AS (SELECT page_id, lower({_PATH}) AS path, {_HOST} AS host, {_DEPTH} AS depth FROM pages)
SELECT page_id, CAST(contains(path, 'en') AS DOUBLE) AS has_en, CAST(contains(path, 'fr') OR contains(path, 'de') AS DOUBLE) AS has_other, CAST(depth AS DOUBLE) AS path_depth, CAST(length(path) AS DOUBLE) AS path_length,
CAST(contains(path, '-') AS DOUBLE) AS has_hyphen, CAST(contains(path, '_') AS DOUBLE) AS has_underscore, CAST(length(host) AS DOUBLE) AS domain_length, CAST(len(string_split(host, '.')) > 2 AS DOUBLE) AS has_subdomain,
CAST(ends_with(path, '.html') AS DOUBLE) AS ends_with_html, CAST({_any('path', ('donate', 'news', '9'))} AS DOUBLE) AS has_negative FROM p""",
    "url_pattern_stats": f"SELECT {_HOST} AS host, {_PATTERN} AS pattern, count(*) AS attempts, count(*) FILTER (length(html) > 2000) AS successes, max(CASE WHEN length(html) > 2000 THEN page_id END) AS last_success FROM pages GROUP BY 1, 2",
    "host_patterns": f"WITH p AS (SELECT {_HOST} AS host, {_PATTERN} AS pattern, bool_or(length(html) > 2000) AS good FROM pages GROUP BY 1, 2) SELECT host, coalesce(string_agg(pattern, ' ' ORDER BY pattern) FILTER (good), '') AS succeeded, coalesce(string_agg(pattern, ' ' ORDER BY pattern) FILTER (NOT good), '') AS failed FROM p GROUP BY host",
    "url_relevance": f"""SELECT page_id, url FROM pages WHERE NOT {_any('lower(url)', T.exclude)} AND ({_any('lower(url)', T.include)} OR len(string_split(url, '/')) <= 5)
AND NOT regexp_matches(url, '(?i)\\.(jpg|png|gif|mp4)$') AND NOT regexp_matches(url, '[^/]+@[^/]+')""",
    "url_quality_topn": f"""WITH {_QUALITY} SELECT page_id, quality, round(least(score, 100.0), 4) AS score,
round(10.0::DOUBLE * CASE WHEN c > 0.3 THEN 0.8 ELSE 1.0 END * CASE WHEN depth > 5 THEN 1.3 ELSE 1.0 END * CASE WHEN contains(url, '?') THEN 1.2 ELSE 1.0 END * CASE quality WHEN 'excellent' THEN 0.7 WHEN 'good' THEN 0.8 WHEN 'poor' THEN 1.5 ELSE 1.0 END, 4) AS seconds
FROM l WHERE quality <> 'skip' ORDER BY CASE quality WHEN 'excellent' THEN 4 WHEN 'good' THEN 3 WHEN 'fair' THEN 2 ELSE 1 END DESC, l.score DESC, page_id LIMIT 50""",
    "url_quality_by_label": f"WITH {_QUALITY} SELECT page_id, quality FROM l WHERE quality <> 'skip' ORDER BY quality DESC, score DESC, page_id LIMIT 50",
    "url_priority": f"""WITH p AS (SELECT page_id, url, lower({_PATH}) AS path, replace({_HOST}, 'www.', '') AS host FROM pages)
SELECT page_id, {" + ".join(f"CASE WHEN contains(path, '{k}') THEN {w} ELSE 0 END" for k, w in WEIGHTS)} - 2 * {_sum('path', NEGATIVE)} + CASE WHEN len(string_split(path, '/')) > 2 THEN 1 ELSE 0 END + CASE WHEN host = '{BASE}' THEN 10 ELSE 0 END AS keyword_priority,
CAST({_STATIC} AS DOUBLE) AS static_priority FROM p""",
    "url_keyword_join": f"""WITH w AS (SELECT * FROM (VALUES {", ".join(f"('{k}', {v})" for k, v in WEIGHTS)}) v(word, weight)), p AS (SELECT page_id, lower({_PATH}) AS path FROM pages)
SELECT page_id, CAST(coalesce(sum(weight), 0) AS BIGINT) AS weight, count(word) AS n_words FROM p LEFT JOIN w ON contains(path, word) GROUP BY page_id""",
    "candidate_urls": f"""WITH h AS (SELECT DISTINCT {_HOST} AS host FROM pages), m AS (SELECT s.scheme || host || p.path AS url, 1 AS tier, CAST(0.5 + p.boost AS DOUBLE) AS confidence
FROM h, (VALUES ('https://'), ('http://')) s(scheme), (VALUES ('/schedule', 0.3), ('/times', 0.3), ('/about', 0.0)) p(path, boost) UNION ALL SELECT url, 0, 1.0 FROM pages)
SELECT url, tier, confidence FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY tier, confidence DESC) AS rn FROM m) WHERE rn = 1""",
    "url_total_score": f"""WITH p AS (SELECT page_id, url, page_id % 10 / 10.0 AS c FROM pages)
SELECT page_id, round(CAST({_STATIC} + CASE page_id % 4 WHEN 0 THEN 20.0 * c WHEN 1 THEN 15.0 WHEN 2 THEN 5.0 ELSE 0.0 END + CASE WHEN page_id % 6 = 0 THEN 15.0 ELSE 0.0 END + CASE WHEN c > 0.5 THEN 10.0 ELSE 0.0 END AS DOUBLE), 4) AS total
FROM p ORDER BY total DESC, page_id LIMIT 25""",
    "host_strategy": f"""WITH k AS (SELECT page_id, CASE WHEN starts_with({_HOST}, 'm.') THEN 'mobile' WHEN starts_with({_HOST}, 'blog.') THEN 'blog' WHEN ends_with({_HOST}, '.org') THEN 'organisation' ELSE 'default' END AS kind FROM pages),
b AS (SELECT *, CAST(CASE kind WHEN 'mobile' THEN 15.0 WHEN 'blog' THEN 25.0 ELSE 30.0 END AS DOUBLE) AS base FROM k)
SELECT page_id, kind, base, list_aggregate(list_transform([0, 1, 2, 3], lambda i: printf('%.1f', greatest(1.0, least(base, base * (0.2::DOUBLE + 0.8::DOUBLE * i / 4 + 0.1::DOUBLE * length(kind) / 50))))), 'string_agg', '/') AS timeouts FROM b""",
    "optimal_workers": f"WITH p AS (SELECT count(DISTINCT {_HOST}) AS hosts, count(*) AS urls FROM pages) SELECT hosts, urls, CASE WHEN urls = 0 THEN 1 ELSE least(CASE WHEN hosts <= 2 THEN 2 WHEN hosts <= 5 THEN 3 ELSE least(hosts, 8) END + CASE WHEN urls > 50 THEN 1 ELSE 0 END, 8) END AS workers FROM p",
    "adaptive_threshold": f"""WITH p AS (SELECT page_id, lower(url) AS u, len(string_split(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \\t-\\r]+', ' ', 'g')), ' ')) AS words FROM pages)
SELECT page_id, greatest(3, 15 + CASE WHEN {_any('u', ('blog', 'index'))} THEN -10 ELSE 0 END + CASE WHEN {_any('u', ('/en/', 'schedule'))} THEN -7 ELSE 0 END + CASE WHEN contains(u, 'page') THEN -5 ELSE 0 END
+ CASE WHEN words > 500 THEN -5 WHEN words < 100 THEN 3 ELSE 0 END + CASE WHEN contains(u, 'ref') THEN 10 ELSE 0 END) AS threshold FROM p""",
}
