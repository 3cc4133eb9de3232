"""Rows and links from pages' HTML, and small rules on names, delays and times.

A page's items stay in arrays of its row until they are rows of the result, so
only results that count a target once are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.functions import urls as U
from quern.plans import rules, text, urls
from quern.plans.base import VISITS_SQL, table, visits

# What names a link to a directory, in its text and in its path.
LINK_KEYWORDS = ("churches", "directory of parishes", "parishes", "parishfinder", "parish finder", "find a parish", "locations", "our parishes", "parish listings", "find a church", "church directory", "faith communities", "find mass times", "our churches", "search parishes", "parish map", "mass schedule", "sacraments", "worship")
LINK_PATHS = ("parishes", "directory", "locations", "churches", "parish-finder", "findachurch", "parishsearch", "parishdirectory", "find-a-church", "church-directory", "parish-listings", "parish-map", "mass-times", "sacraments", "search", "worship", "finder")
# Terms of links in menus and footers.
NAV_TERMS = ("schedule", "confession", "reconciliation", "adoration", "sacrament", "mass", "worship", "prayer", "spiritual", "devotion", "penance", "blessed", "eucharistic", "holy", "service", "liturgy", "ministry")
#: Terms of the invented pages, which only the registered queries add to the fixed ones.
OWN_TERMS = ("tion", "ment", "heit")
# Rewrites of names for accuracy checks, in their order.
NAME_REPLACES = (("saint", "st"), ("st.", "st"), (" catholic church", ""), (" catholic parish", ""), (" church", ""), (" parish", ""), (" the ", " "), ("  ", " "), ("'", ""))
# First delays by error, what a page says of a PDF directory.
DELAYS = (("NoSuchElementException", 0.5), ("TimeoutException", 2.0), ("TimeoutError", 2.0), ("WebDriverException", 1.0), ("SessionNotCreatedException", 5.0))
PDF_TERMS = ("parish directory.pdf", "parish list.pdf", "church directory.pdf", "parish guide.pdf", ".pdf", "download parish directory", "parish directory download")
# Descriptions of the kinds of blocking.
BLOCKED = (("403_forbidden", "actively blocking automated access (403 Forbidden)"), ("rate_limited", "rate limiting requests (429 Too Many Requests)"), ("cloudflare_protection", "using Cloudflare bot protection"), ("captcha", "requiring CAPTCHA verification"))

ITEM, ANCHOR = '(?s)<li[^>]*>.*?</li>', '(?s)<a [^>]*href="[^"]*"[^>]*>.*?</a>'
HREF, MENU = 'href="([^"]*)"', "(?s)<(?:nav|footer)[ >].*?</(?:nav|footer)>"


def _found(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _href(item: Column) -> Column:
    return X.unescape(F.regexp_extract(item, HREF, 1))


def _shown(item: Column) -> Column:
    return X.unescape(X.html_text(item))


def html_list_rows(spark: SparkSession, d: str) -> DataFrame:
    """A row for each list item of a page: its place, name and resolved link."""
    p = table(spark, d, "pages").select("page_id", "url", F.posexplode(_found(F.col("html"), ITEM)).alias("pos", "item"))
    return p.select("page_id", "pos", _shown(F.col("item")).alias("name"), U.url_join(F.col("url"), _href(F.col("item"))).alias("href"))


def _links(pages: DataFrame, source: Column) -> DataFrame:
    """Pages with `links`: (href, text) of each anchor, resolved, without in-page, script and mail links."""
    anchors = F.filter(_found(source, ANCHOR), lambda a: (_href(a) != "") & ~F.lower(_href(a)).rlike("^(#|javascript:|mailto:)"))
    links = F.transform(anchors, lambda a: F.struct(U.url_join(F.col("url"), _href(a)).alias("href"), _shown(a).alias("text")))
    return pages.select("page_id", "url", F.filter(links, lambda x: x["href"].startswith("http")).alias("links"))


def directory_links(pages: DataFrame, keywords: tuple[str, ...] = LINK_KEYWORDS, paths: tuple[str, ...] = LINK_PATHS) -> DataFrame:
    """Links whose text or path names a directory, each target once, with its first place among them."""
    wanted = lambda x: X.any_of(F.lower(x["text"]), keywords) | X.any_of(F.lower(X.url_path(x["href"])), paths)
    p = _links(pages, F.col("html")).select("page_id", F.posexplode(F.filter("links", wanted)).alias("pos", "x"))
    return p.groupBy("page_id", "x.href").agg(F.min("pos").alias("pos"), F.min_by("x.text", "pos").alias("text"))


def candidate_links(spark: SparkSession, d: str) -> DataFrame:
    return directory_links(table(spark, d, "pages"), (*LINK_KEYWORDS, *OWN_TERMS))


def menu_links(pages: DataFrame, terms: tuple[str, ...] = NAV_TERMS) -> DataFrame:
    """The first twenty links of menus and footers with a term in their text or target."""
    menus = F.array_join(_found(F.col("html"), MENU), " ")
    wanted = lambda x: X.any_of(F.lower(x["text"]), terms) | X.any_of(F.lower(x["href"]), terms)
    p = _links(pages, menus).select("page_id", F.filter("links", wanted).alias("links"))
    return p.select("page_id", F.posexplode(F.slice(F.array_distinct("links.href"), 1, 20)).alias("pos", "href"))


def nav_links(spark: SparkSession, d: str) -> DataFrame:
    return menu_links(table(spark, d, "pages"), (*NAV_TERMS, *OWN_TERMS))


def link_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The best thirty targets of each host that are not pages yet, by priority: the next step of a best-first crawl."""
    pages = table(spark, d, "pages")
    seen = pages.select(F.col("url").alias("seen"))
    links = _links(pages, F.col("html")).select(F.explode("links.href").alias("url")).distinct()
    new = links.join(seen, links["url"] == seen["seen"], "left_anti").select("url", X.url_host(F.col("url")).alias("host"), U.static_priority(F.col("url"), urls.T).alias("priority"))
    rn = F.row_number().over(Window.partitionBy("host").orderBy(F.col("priority").desc(), "url"))
    return new.withColumn("rank", rn).where("rank <= 30")


def name_variants(spark: SparkSession, d: str) -> DataFrame:
    """First lines by the two shorter name normalizers: ordered replaces, and three words less."""
    low = F.trim(F.lower("name"))
    replaced = low
    for old, new in NAME_REPLACES:
        replaced = F.replace(replaced, F.lit(old), F.lit(new))
    fewer = X.squeeze(F.regexp_replace(low, r"\b(catholic|church|parish)\b", ""))
    n = table(spark, d, "documents").select("doc_id", F.element_at(F.split("text", "\n"), 1).alias("name"))
    return n.select("doc_id", F.trim(replaced).alias("replaced"), fewer.alias("fewer"))


def backoff_delays(spark: SparkSession, d: str) -> DataFrame:
    """Seconds to wait after a failed visit: a first delay by error, half as much again each time, up to a tenth of jitter, ten at most."""
    e = F.col("event_id")
    error = F.when(F.col("status") == 404, "NoSuchElementException").when(F.col("status") == 500, "TimeoutException").when(~F.col("ok"), "WebDriverException").otherwise("other")
    first = F.coalesce(*[F.when(F.col("error") == k, v) for k, v in DELAYS], F.lit(1.0))
    v = visits(spark, d).select("event_id", error.alias("error"))
    delay = first * F.pow(F.lit(1.5), (e % 6).cast("double")) * (1 + 0.1 * (e % 100) / 100)
    return v.select("event_id", "error", (F.floor(F.least(delay, F.lit(10.0)) * 1000000 + 0.5) / 1000000).alias("delay"))


def iso_timestamps(spark: SparkSession, d: str) -> DataFrame:
    """Seconds of times written as ISO 8601 with a trailing Z."""
    shown = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    at = F.to_timestamp(F.regexp_replace(F.col("shown"), "Z$", "+00:00"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    return table(spark, d, "events").select("event_id", shown.alias("shown")).select("event_id", F.unix_seconds(at).alias("seconds"))


def blocking_description(spark: SparkSession, d: str) -> DataFrame:
    """What is known of each page's blocking, as a sentence."""
    said = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in BLOCKED], F.concat(F.lit("blocking access ("), F.col("kind"), F.lit(")")), F.lit("accessible to automated requests"))
    return text.blocking_detect(spark, d).select("page_id", F.concat(F.lit("Website "), said).alias("description"))


def profile_stats(spark: SparkSession, d: str) -> DataFrame:
    """How many pages each profile serves, and whether it was made for a host."""
    return rules.profile_lookup(spark, d).groupBy("profile").agg(F.count("*").alias("n")).withColumn("own", F.col("profile") == "exact")


def pdf_confidence(spark: SparkSession, d: str) -> DataFrame:
    """0.7 for a PDF's address and 0.1 for each phrase of the page, 1 at most."""
    c = F.when(F.lower("url").contains(".pdf"), 0.7).otherwise(0.0) + 0.1 * X.hits(F.lower("html"), PDF_TERMS)
    return table(spark, d, "pages").select("page_id", F.round(F.least(c, F.lit(1.0)), 4).alias("confidence"))


def worker_log(spark: SparkSession, d: str, worker: str = "7") -> DataFrame:
    """A worker's events; `aggregate` means all workers'."""
    v = visits(spark, d)
    return (v if worker == "aggregate" else v.where(F.col("worker") == int(worker))).select("event_id", "worker", "event_type")


QUERIES = {f.__name__: f for f in (html_list_rows, candidate_links, nav_links, link_frontier, name_variants, backoff_delays, iso_timestamps, blocking_description, profile_stats, pdf_confidence, worker_log)}


def _any(c: str, terms) -> str:
    return "(" + " OR ".join(f"contains({c}, '{t}')" for t in terms) + ")"


def _plain(c: str) -> str:
    for entity, letter in X.ENTITIES:
        c = f"replace({c}, '{entity}', '{letter.replace(chr(39), chr(39) * 2)}')"
    return c


def _items(source: str, pattern: str) -> str:
    """Items of pages with place, resolved link and text; all relative links of the tables are rooted."""
    return f"""f AS (SELECT page_id, url, regexp_extract_all({source}, '{pattern}', 0) AS f FROM pages), i AS (SELECT page_id, url, unnest(f) AS item, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS place FROM f),
l AS (SELECT page_id, place, {_plain(f"regexp_extract(item, '{HREF}', 1)")} AS ref, {_plain("trim(regexp_replace(regexp_replace(item, '<[^>]*>', ' ', 'g'), '[ \\t-\\r]+', ' ', 'g'))")} AS text, url FROM i),
r AS (SELECT page_id, place, text, ref, CASE WHEN starts_with(ref, '/') THEN regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || ref WHEN ref = '' THEN url ELSE ref END AS href FROM l)"""


_KEPT = "ref <> '' AND NOT regexp_matches(lower(ref), '^(#|javascript:|mailto:)') AND starts_with(href, 'http')"
_PATH = "lower(regexp_extract(href, '^[a-z]+://[^/?#]*([^?#]*)', 1))"
_ERROR = "CASE WHEN status = 404 THEN 'NoSuchElementException' WHEN status = 500 THEN 'TimeoutException' WHEN NOT ok THEN 'WebDriverException' ELSE 'other' END"
_REPLACED = "low"
for _old, _new in NAME_REPLACES:
    _REPLACED = f"replace({_REPLACED}, '{_old.replace(chr(39), chr(39) * 2)}', '{_new}')"

SQL = {
    "html_list_rows": f"WITH {_items('html', ITEM)} SELECT page_id, place AS pos, text AS name, href FROM r",
    "candidate_links": f"""WITH {_items('html', ANCHOR)}, k AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS pos FROM r WHERE {_KEPT} AND ({_any('lower(text)', (*LINK_KEYWORDS, *OWN_TERMS))} OR {_any(_PATH, LINK_PATHS)}))
SELECT page_id, href, CAST(min(pos) AS INTEGER) AS pos, arg_min(text, pos) AS text FROM k GROUP BY 1, 2""",
    "nav_links": f"""WITH {_items(f"array_to_string(regexp_extract_all(html, '{MENU}', 0), ' ')", ANCHOR)}, k AS (SELECT * FROM r WHERE {_KEPT} AND ({_any('lower(text)', (*NAV_TERMS, *OWN_TERMS))} OR {_any('lower(href)', (*NAV_TERMS, *OWN_TERMS))})),
u AS (SELECT page_id, href, min(place) AS place FROM k GROUP BY 1, 2), n AS (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY place) - 1 AS INTEGER) AS pos, href FROM u) SELECT * FROM n WHERE pos < 20""",
    "link_frontier": f"""WITH {_items('html', ANCHOR)}, u AS (SELECT DISTINCT href AS url FROM r WHERE {_KEPT} AND href NOT IN (SELECT url FROM pages)), s AS (SELECT url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host, CAST({urls._STATIC} AS DOUBLE) AS priority FROM u)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY host ORDER BY priority DESC, url) AS INTEGER) AS rank FROM s) WHERE rank <= 30""",
    "name_variants": f"""WITH n AS (SELECT doc_id, trim(lower(string_split(text, chr(10))[1])) AS low FROM documents)
SELECT doc_id, trim({_REPLACED}) AS replaced, trim(regexp_replace(regexp_replace(low, '\\b(catholic|church|parish)\\b', '', 'g'), '[ \\t-\\r]+', ' ', 'g')) AS fewer FROM n""",
    "backoff_delays": f"""WITH {VISITS_SQL}, e AS (SELECT event_id, {_ERROR} AS error FROM visits)
SELECT event_id, error, floor(least(CAST(CASE error {" ".join(f"WHEN '{k}' THEN {v}" for k, v in DELAYS)} ELSE 1.0 END AS DOUBLE) * pow(1.5::DOUBLE, event_id % 6) * (1 + 0.1::DOUBLE * (event_id % 100) / 100), 10.0::DOUBLE) * 1000000 + 0.5) / 1000000 AS delay FROM e""",
    "iso_timestamps": "SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS seconds FROM events",
    "blocking_description": f"""WITH b AS ({text.SQL["blocking_detect"]}) SELECT page_id, 'Website ' || CASE {" ".join(f"WHEN kind = '{k}' THEN '{v}'" for k, v in BLOCKED)} WHEN kind IS NOT NULL THEN 'blocking access (' || kind || ')' ELSE 'accessible to automated requests' END AS description FROM b""",
    "profile_stats": f"WITH p AS ({rules.SQL['profile_lookup']}) SELECT profile, count(*) AS n, profile = 'exact' AS own FROM p GROUP BY profile",
    "pdf_confidence": "SELECT page_id, round(CAST(least(CASE WHEN contains(lower(url), '.pdf') THEN 0.7 ELSE 0.0 END + 0.1 * (" + " + ".join(f"CAST(contains(lower(html), '{t}') AS INTEGER)" for t in PDF_TERMS) + "), 1.0) AS DOUBLE), 4) AS confidence FROM pages",
    "worker_log": "SELECT event_id, user_id AS worker, event_type FROM events WHERE user_id = 7",
}
