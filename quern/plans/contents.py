"""What pages and texts hold: fitting extractors, named elements, embedded rows, snippets.

Every result depends on one row of its table, so nothing here is shuffled but
the lines of an order, of which an order has few.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import exprs as X
from quern.plans.base import FACTS_SQL, facts, table
from quern.plans.links import ITEM, OWN_TERMS

# Extractors and their seconds, in the order in which they are tried.
EXTRACTORS = {"NavigationExtractor": 5, "PDFDirectoryExtractor": 3, "IframeExtractor": 8, "ParishFinderExtractor": 12, "EnhancedDiocesesCardExtractor": 15, "TableExtractor": 8, "ImprovedInteractiveMapExtractor": 15, "ImprovedGenericExtractor": 20, "EnhancedAIFallbackExtractor": 30}
LAST_RESORTS = ("ImprovedGenericExtractor", "EnhancedAIFallbackExtractor")
# What pages with maps, finders, menus and cards hold, sought letter by letter.
MAP_TERMS = ("leaflet", "mapbox", "google.maps", "arcgis", "openlayers", "esri", "leaflet-", "mapbox-", "gm-", "esri-", "map-container", "map-wrapper", "parish-locator")
FINDER_TERMS = ("parish-finder", "find.*parish", "parish.*locator", "parish.*search")
MENU_TERMS = ("<nav", "menu", "dropdown", "hover.*parish")
CARD_TERMS = ("card-", "col-lg.*location", "parish.*card", "church.*card")
SCRIPT_TERMS, LOADING_TERMS = ("angular", "react", "vue"), ("ajax", "xhr", "fetch(")
# Terms of map controls, of names, of addresses.
CONTROL_TERMS = ("enable", "select", "tool", "directions", "zoom", "drag", "grouping", "search", "filter", "legend", "don't group", "location", "name", "type", "address", "city", "state", "zip code", "phone number", "deanery", "website", "latitude", "longitude", "apply to", "distance radius", "drive time polygon", "individual location")
NAMED_TERMS = ("saint", "st.", "st ", "holy", "blessed", "our lady", "cathedral", "church", "parish", "chapel", "shrine")
STREET_TERMS = ("st ", "ave", "rd ", "blvd", "street", "avenue")
# Names of lists in scripts and in responses.
SCRIPT_LISTS = ("parishes", "locations", "markers", "churches")
RESPONSE_LISTS = ("parishes", "churches", "locations", "data", "results")
# Terms of schedules.
SCHEDULE_TERMS = ("mass", "schedule", "confession", "reconciliation", "adoration", "eucharistic", "holy hour", "sacrament", "liturgy", "service", "sunday", "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "daily", "weekly", "am", "pm", "time", "hour")
HOURS_TERMS = ("schedule", "hours", "am", "pm", "confessionals", "by appointment")
# How names in one line begin, and what tells such a line.
NAME_STARTS = ("St\\. [A-Z]", "Saint [A-Z]", "Our Lady", "Holy [A-Z]", "Sacred [A-Z]", "Blessed [A-Z]", "Christ [A-Z]")
NAME_MARKS = ("St.", "Saint", "Holy", "Our Lady", "Sacred", "Blessed", "Christ")
#: Starts and marks of the invented texts, beside the fixed ones.
OWN_STARTS, OWN_MARKS = ("The [a-z]", "Le [a-z]", "Der [a-z]", "La [a-z]"), ("The ", "Le ", "Der ", "La ")

ELEMENT = "(?s)<li[^>]*>.*?</li>|<p[^>]*>.*?</p>"
PARAGRAPH = "(?s)<p>.*?</p>"
TAG = '<([a-z][a-z0-9]*(?: [a-z-]+="[^"]*")?)'
HOURS = "(?i)([0-9]+)\\s*hours?\\s*per\\s*(week|month)"


def _all(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def _either(terms: tuple[str, ...]) -> str:
    return "|".join(t.replace(".", "[.]") for t in terms)


def _seen(h: Column) -> dict[str, Column]:
    """What tells from a lower-cased page that an extractor suits it."""
    return {
        "IframeExtractor": h.rlike("<iframe[^>]*>"), "ParishFinderExtractor": X.any_of(h, FINDER_TERMS), "EnhancedDiocesesCardExtractor": X.any_of(h, CARD_TERMS), "TableExtractor": h.rlike("(?s)<table[^>]*>.*parish.*</table>"),
        "PDFDirectoryExtractor": h.rlike("href=[\"'][^\"']*\\.pdf[\"']"), "NavigationExtractor": X.any_of(h, MENU_TERMS), "ImprovedInteractiveMapExtractor": X.any_of(h, MAP_TERMS),
    }


def _analysed(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """(keys, suits, skips, complexity) of lower-cased pages."""
    h = F.col(html)
    seen = _seen(h)
    suits = F.array_compact(F.array(*[F.when(c, n) for n, c in seen.items()], *[F.lit(n) for n in LAST_RESORTS]))
    skips = F.array_compact(F.array(*[F.when(~seen[n], n) for n in ("ImprovedInteractiveMapExtractor", "PDFDirectoryExtractor", "IframeExtractor")]))
    points = F.when(X.any_of(h, SCRIPT_TERMS), 3).otherwise(0) + F.when(X.any_of(h, LOADING_TERMS), 2).otherwise(0) + F.when(seen["ParishFinderExtractor"], 2).otherwise(0) + F.when(seen["IframeExtractor"], 2).otherwise(0) + F.when(F.length(h) > 500000, 1).otherwise(0)
    return pages.select(*keys, suits.alias("suits"), skips.alias("skips"), X.band(points, ((5, "high"), (2, "medium")), "low").alias("complexity"))


def extractor_order(h: Column) -> Column:
    """Extractors in the order in which a lower-cased page suggests to try them: those that suit, then the rest but those to leave out."""
    seen = _seen(h)
    suits = F.array_compact(F.array(*[F.when(c, n) for n, c in seen.items()], *[F.lit(n) for n in LAST_RESORTS]))
    rest = F.array_compact(F.array(*[F.lit(n) if n not in ("ImprovedInteractiveMapExtractor", "PDFDirectoryExtractor", "IframeExtractor") else F.when(seen[n], n) for n in EXTRACTORS]))
    return F.concat(suits, F.array_except(rest, suits))


def page_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Extractors that suit a page, those to leave out, its complexity, and the order to try with seconds for each."""
    p = _analysed(table(spark, d, "pages").select("page_id", F.lower("html").alias("h")), "h", "page_id")
    rest = F.array_except(F.array_except(F.array(*[F.lit(n) for n in EXTRACTORS]), "suits"), "skips")
    base = F.create_map(*[F.lit(x) for pair in EXTRACTORS.items() for x in pair])

    def timed(name: Column) -> Column:
        s = F.element_at(base, name)
        seconds = F.when(F.col("complexity") == "high", F.floor(s * 3 / 2)).when(F.col("complexity") == "low", F.greatest(F.lit(3), F.floor(s * 7 / 10))).otherwise(s)
        return F.concat(name, F.lit(":"), seconds.cast("string"))

    order = F.transform(F.concat("suits", rest), timed)
    return p.select("page_id", F.array_join("suits", ",").alias("suitable"), F.array_join("skips", ",").alias("skipped"), "complexity", F.array_join(order, ",").alias("sequence"))


def element_rows(spark: SparkSession, d: str) -> DataFrame:
    """Named elements of a page: by attribute, heading or first line; map controls and short unlikely names left out."""
    # Each explode ends an expression, so that none is repeated for each of its uses.
    plain = lambda i: F.trim(X.unescape(F.regexp_replace(i, "<[^>]*>", "")))
    items = F.transform(_all(F.col("html"), ELEMENT), lambda i: F.struct(i.alias("item"), plain(i).alias("plain")))
    e = table(spark, d, "pages").select("page_id", F.posexplode(items).alias("pos", "e")).select("page_id", "pos", "e.item", "e.plain")
    attribute = lambda a: F.nullif(X.unescape(F.regexp_extract("item", f'^<[^>]* {a}="([^"]*)"', 1)), F.lit(""))
    heading = F.nullif(F.trim(X.unescape(F.regexp_extract("item", "(?s)<(?:h[1-4]|strong)[^>]*>([^<]*)<", 1))), F.lit(""))
    name = F.coalesce(attribute("data-name"), attribute("data-title"), attribute("title"), heading, F.when((F.length("plain") > 2) & (F.length("plain") < 200), F.trim(F.substring_index("plain", "\n", 1))))
    lines = F.filter(F.transform(F.split("plain", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    address = F.coalesce(attribute("data-address"), attribute("title"), F.try_element_at(F.filter(F.slice(lines, 2, 3), lambda x: X.any_of(F.lower(x), STREET_TERMS)), F.lit(1)))
    fits = lambda x: (F.length(x["name"]) >= 3) & ~F.lower(x["name"]).rlike(_either(CONTROL_TERMS)) & (F.lower(x["name"]).rlike(_either(NAMED_TERMS)) | (F.length(x["name"]) >= 15))
    kept = F.filter(F.array(F.struct(name.alias("name"), address.alias("address"))), fits)
    return e.select("page_id", "pos", F.inline(kept))


def script_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a list inside a script, under the first name whose list parses; here the script of a page's list items."""
    names = F.transform(_all(F.col("html"), ITEM), lambda i: F.struct(X.unescape(X.html_text(i)).alias("name")))
    script = F.concat(F.lit("var x = 0; var "), F.element_at(F.array(*[F.lit(n) for n in SCRIPT_LISTS]), (F.col("page_id") % 4 + 1).cast("int")), F.lit(" = "), F.to_json(names), F.lit(";"))
    p = table(spark, d, "pages").select("page_id", script.alias("script"))
    parsed = F.coalesce(*[F.from_json(X.first_match(F.col("script"), f"(?s){n}\\s*[:=]\\s*(\\[.*?\\])", 1), "array<struct<name: string>>") for n in SCRIPT_LISTS])
    return p.select("page_id", F.posexplode(parsed).alias("pos", "x")).select("page_id", "pos", "x.name")


def response_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of a JSON response: its own list or the first list under a known name; here orders' lines as responses."""
    k = F.col("l_orderkey")
    body = F.to_json(F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part")))))
    name = F.element_at(F.array(*[F.lit(n) for n in RESPONSE_LISTS]), (k % 5 + 1).cast("int"))
    o = table(spark, d, "lineitem").groupBy("l_orderkey").agg(body.alias("body"))
    o = o.select("l_orderkey", F.when(k % 6 == 5, F.col("body")).otherwise(F.concat(F.lit('{"status": "ok", "'), name, F.lit('": '), F.col("body"), F.lit("}"))).alias("said"))
    under = [F.get_json_object("said", f"$.{n}") for n in RESPONSE_LISTS]
    found = F.coalesce(*[F.when(c.startswith("["), c) for c in under], F.when(F.col("said").startswith("["), F.col("said")))
    return o.select("l_orderkey", F.explode(F.from_json(found, "array<struct<line: int, part: long>>")).alias("x")).select("l_orderkey", "x.line", "x.part")


def time_snippets(pages: DataFrame, keyword: str) -> DataFrame:
    """The best of the paragraphs that name a keyword, each with the five after it: longest, words of schedules count for 100; hours a week or month where it says so."""
    texts = F.transform(_all(F.col("html"), PARAGRAPH), lambda x: X.unescape(X.html_text(x)))
    p = pages.select("page_id", texts.alias("t"))
    joined = F.transform("t", lambda x, i: F.struct(F.lower(x).contains(keyword).alias("named"), F.trim(F.array_join(F.slice("t", i + 1, 6), "\n")).alias("text"), i.alias("at")))
    rated = F.transform(F.filter(joined, lambda x: x["named"]), lambda x: F.struct((F.length(x["text"]) + F.when(X.any_of(F.lower(x["text"]), HOURS_TERMS), 100).otherwise(0)).alias("score"), (-x["at"]).alias("before"), x["text"].alias("text")))
    best = p.select("page_id", F.array_max(rated)["text"].alias("best"))
    said = F.concat(F.regexp_extract("best", HOURS, 1), F.lit(" hours per "), F.lower(F.regexp_extract("best", HOURS, 2)))
    return best.select("page_id", F.coalesce(F.when(F.col("best").rlike(HOURS), said), F.col("best"), F.lit(X.NOT_FOUND)).alias("snippet"))


def time_snippet(spark: SparkSession, d: str, keyword: str = OWN_TERMS[0]) -> DataFrame:
    return time_snippets(table(spark, d, "pages"), keyword)


def relevant_prefix(text: Column, most: int, terms: tuple[str, ...] = SCHEDULE_TERMS) -> Column:
    """Texts over so many characters cut to words: all up to 70 % of it, then on while each word has a term, up to it.

    Shorter texts are trimmed only; null stays null.
    """
    words = F.split(X.squeeze(text), " ")

    def step(a: Column, w: Column) -> Column:
        takes = a["open"] & ((a["size"] < most * 0.7) | ((a["size"] < most) & X.any_of(F.lower(w), terms)))
        return F.struct((a["size"] + F.when(takes, F.length(w) + 1).otherwise(0)).alias("size"), (a["n"] + takes.cast("int")).alias("n"), takes.alias("open"))

    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("n"), F.lit(True).alias("open"))
    kept = F.array_join(F.slice(words, 1, F.aggregate(words, start, step)["n"]), " ")
    cut = F.when(F.length(kept) > most, F.concat(F.substring(kept, 1, most), F.lit("..."))).otherwise(kept)
    return F.when(F.length(text) > most, cut).otherwise(F.trim(text))


def relevant_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts of at most 32000 characters, with more of what is relevant."""
    t = relevant_prefix(F.col("text"), 32000)
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n_chars"), F.md5(F.encode("t", "UTF-8")).alias("digest"))


def name_split(spark: SparkSession, d: str) -> DataFrame:
    """Names of lines that hold several, cut before each start of the first kind that occurs past the line's begin."""
    marks = sum((X.occurrences(F.col("line"), m) for m in (*NAME_MARKS, *OWN_MARKS)), F.lit(0))
    n = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("row", "line")).where((F.length("line") > 100) & (marks > 2))

    def parts(start: str) -> Column:
        # Starts get a mark before them, which splits like an empty match.
        return F.split(F.regexp_replace("line", f"({start})", "\u0001$1"), "\u0001")

    kept = [F.filter(F.transform(parts(s), lambda x: F.trim(x)), lambda x: F.length(x) > 5) for s in (*NAME_STARTS, *OWN_STARTS)]
    names = F.coalesce(*[F.when(F.size(parts(s)) > 1, k) for s, k in zip((*NAME_STARTS, *OWN_STARTS), kept, strict=True)], F.array("line"))
    whole = n.withColumn("names", names).withColumn("names", F.when(F.size("names") == 0, F.array("line")).otherwise(F.col("names")))
    return whole.select("doc_id", "row", F.posexplode("names").alias("pos", "name"))


def selector_groups(spark: SparkSession, d: str) -> DataFrame:
    """Selectors of a page's elements by complexity, the first five, five and three."""
    def selector(tag: Column) -> Column:
        name, kind = F.regexp_extract(tag, "^[a-z0-9]+", 0), F.regexp_extract(tag, ' ([a-z-]+)="', 1)
        value = F.regexp_extract(tag, '="([^"]*)"', 1)
        return F.when(kind == "class", F.concat(F.lit("."), value)).when(kind == "id", F.concat(F.lit("#"), value)).when(kind != "", F.concat(name, F.lit("["), kind, F.lit("]"))).otherwise(name)

    p = table(spark, d, "pages").select("page_id", F.array_distinct(F.transform(_all(F.col("html"), TAG, 1), selector)).alias("s"))
    simple = lambda x: x.startswith(".") & ~x.contains(" ")
    medium = lambda x: x.startswith("#") | (x.contains("[") & x.contains("]")) | (x.startswith(".") & x.contains(" "))
    first = lambda keep, n: F.array_join(F.slice(F.filter("s", keep), 1, n), ",")
    return p.select("page_id", first(simple, 5).alias("simple"), first(lambda x: medium(x) & ~simple(x), 5).alias("medium"), first(lambda x: ~simple(x) & ~medium(x), 3).alias("complex"))


def fact_by_id(spark: SparkSession, d: str, fact_id: int = 7) -> DataFrame:
    """One fact by its id; the scan gets the id as a pushed filter."""
    return facts(spark, d).where(F.col("fact_id") == fact_id)


QUERIES = {f.__name__: f for f in (page_analysis, element_rows, script_rows, response_rows, time_snippet, relevant_text, name_split, selector_groups, fact_by_id)}


def _any(c: str, terms) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(c, t.replace("'", "''")) for t in terms) + ")"


def _plain(c: str) -> str:
    for entity, letter in X.ENTITIES:
        c = f"replace({c}, '{entity}', '{letter.replace(chr(39), chr(39) * 2)}')"
    return c


_SEEN_SQL = {
    "IframeExtractor": "regexp_matches(h, '<iframe[^>]*>')", "ParishFinderExtractor": _any("h", FINDER_TERMS), "EnhancedDiocesesCardExtractor": _any("h", CARD_TERMS), "TableExtractor": "regexp_matches(h, '(?s)<table[^>]*>.*parish.*</table>')",
    "PDFDirectoryExtractor": "regexp_matches(h, 'href=[\"''][^\"'']*\\.pdf[\"'']')", "NavigationExtractor": _any("h", MENU_TERMS), "ImprovedInteractiveMapExtractor": _any("h", MAP_TERMS),
}
_SECONDS = "CASE x " + " ".join(f"WHEN '{n}' THEN {s}" for n, s in EXTRACTORS.items()) + " END"
_SHOWN = "trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \\t-\\r]+', ' ', 'g'))"


def _attribute(a: str) -> str:
    return "nullif({}, '')".format(_plain(f"regexp_extract(item, '^<[^>]* {a}=\"([^\"]*)\"', 1)"))


def _split_at(start: str) -> str:
    return f"string_split(regexp_replace(line, '({start})', chr(1) || '\\1', 'g'), chr(1))"


_NAMES = "CASE " + " ".join(f"WHEN len({_split_at(s)}) > 1 THEN list_filter(list_transform({_split_at(s)}, lambda x: trim(x)), lambda x: length(x) > 5)" for s in (*NAME_STARTS, *OWN_STARTS)) + " ELSE [line] END"
_MARKS = " + ".join(f"(length(line) - length(replace(line, '{m}', ''))) // {len(m)}" for m in (*NAME_MARKS, *OWN_MARKS))

SQL = {
    "page_analysis": f"""WITH p AS (SELECT page_id, lower(html) AS h FROM pages),
s AS (SELECT page_id, list_filter([{", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _SEEN_SQL.items())}, {", ".join(f"'{n}'" for n in LAST_RESORTS)}], lambda x: x IS NOT NULL) AS suits,
list_filter([{", ".join(f"CASE WHEN NOT {_SEEN_SQL[n]} THEN '{n}' END" for n in ("ImprovedInteractiveMapExtractor", "PDFDirectoryExtractor", "IframeExtractor"))}], lambda x: x IS NOT NULL) AS skips,
CASE WHEN {_any("h", SCRIPT_TERMS)} THEN 3 ELSE 0 END + CASE WHEN {_any("h", LOADING_TERMS)} THEN 2 ELSE 0 END + CASE WHEN {_SEEN_SQL["ParishFinderExtractor"]} THEN 2 ELSE 0 END + CASE WHEN {_SEEN_SQL["IframeExtractor"]} THEN 2 ELSE 0 END + CASE WHEN length(h) > 500000 THEN 1 ELSE 0 END AS points FROM p),
c AS (SELECT *, CASE WHEN points >= 5 THEN 'high' WHEN points >= 2 THEN 'medium' ELSE 'low' END AS complexity, list_concat(suits, list_filter([{", ".join(f"'{n}'" for n in EXTRACTORS)}], lambda x: NOT list_contains(suits, x) AND NOT list_contains(skips, x))) AS o FROM s)
SELECT page_id, array_to_string(suits, ',') AS suitable, array_to_string(skips, ',') AS skipped, complexity,
array_to_string(list_transform(o, lambda x: x || ':' || CASE complexity WHEN 'high' THEN {_SECONDS} * 3 // 2 WHEN 'low' THEN greatest(3, {_SECONDS} * 7 // 10) ELSE {_SECONDS} END), ',') AS sequence FROM c""",
    "element_rows": f"""WITH f AS (SELECT page_id, regexp_extract_all(html, '{ELEMENT}', 0) AS f FROM pages), i AS (SELECT page_id, unnest(f) AS item, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos FROM f),
t AS (SELECT *, trim({_plain("regexp_replace(item, '<[^>]*>', '', 'g')")}) AS plain FROM i),
n AS (SELECT page_id, pos, coalesce({_attribute("data-name")}, {_attribute("data-title")}, {_attribute("title")}, nullif(trim({_plain("regexp_extract(item, '(?s)<(?:h[1-4]|strong)[^>]*>([^<]*)<', 1)")}), ''), CASE WHEN length(plain) > 2 AND length(plain) < 200 THEN trim(string_split(plain, chr(10))[1]) END) AS name,
coalesce({_attribute("data-address")}, {_attribute("title")}, list_filter(list_filter(list_transform(string_split(plain, chr(10)), lambda x: trim(x)), lambda x: x <> '')[2:4], lambda x: {_any("lower(x)", STREET_TERMS)})[1]) AS address FROM t)
SELECT * FROM n WHERE length(name) >= 3 AND NOT {_any("lower(name)", CONTROL_TERMS)} AND ({_any("lower(name)", NAMED_TERMS)} OR length(name) >= 15)""",
    "script_rows": f"""WITH f AS (SELECT page_id, regexp_extract_all(html, '{ITEM}', 0) AS f FROM pages), i AS (SELECT page_id, unnest(f) AS item, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS pos FROM f)
SELECT page_id, pos, {_plain(_SHOWN.format("item"))} AS name FROM i""",
    "response_rows": "SELECT l_orderkey, l_linenumber AS line, l_partkey AS part FROM lineitem",
    "time_snippet": f"""WITH f AS (SELECT page_id, list_transform(regexp_extract_all(html, '{PARAGRAPH}', 0), lambda x: {_plain(_SHOWN.format("x"))}) AS t FROM pages),
i AS (SELECT page_id, t, unnest(range(1, len(t) + 1)) AS place FROM f), j AS (SELECT page_id, place, trim(array_to_string(t[place : place + 5], chr(10))) AS text FROM i WHERE contains(lower(t[place]), '{OWN_TERMS[0]}')),
b AS (SELECT page_id, arg_max(text, (length(text) + CASE WHEN {_any("lower(text)", HOURS_TERMS)} THEN 100 ELSE 0 END, -place)) AS best FROM j GROUP BY page_id)
SELECT page_id, coalesce(CASE WHEN regexp_matches(best, '{HOURS}') THEN regexp_extract(best, '{HOURS}', 1) || ' hours per ' || lower(regexp_extract(best, '{HOURS}', 2)) END, best, '{X.NOT_FOUND}') AS snippet FROM pages LEFT JOIN b USING (page_id)""",
    "relevant_text": f"""WITH d AS (SELECT doc_id, text, string_split(trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')), ' ') AS w FROM documents), l AS (SELECT doc_id, w FROM d WHERE length(text) > 32000),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM l), s AS (SELECT *, coalesce(sum(length(word) + 1) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size FROM u),
e AS (SELECT doc_id, min(i) AS stop FROM s WHERE NOT (size < 22400 OR (size < 32000 AND {_any("lower(word)", SCHEDULE_TERMS)})) GROUP BY doc_id),
k AS (SELECT doc_id, text, array_to_string(w[1 : coalesce(stop - 1, len(w))], ' ') AS kept FROM d LEFT JOIN e USING (doc_id)),
c AS (SELECT doc_id, CASE WHEN length(text) <= 32000 THEN trim(text) WHEN length(kept) > 32000 THEN substring(kept, 1, 32000) || '...' ELSE kept END AS t FROM k)
SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM c""",
    "name_split": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS row FROM documents),
n AS (SELECT doc_id, row, line, {_NAMES} AS names FROM l WHERE length(line) > 100 AND {_MARKS} > 2), w AS (SELECT doc_id, row, CASE WHEN len(names) = 0 THEN [line] ELSE names END AS names FROM n)
SELECT doc_id, CAST(row AS INTEGER) AS row, CAST(generate_subscripts(names, 1) - 1 AS INTEGER) AS pos, unnest(names) AS name FROM w""",
    "selector_groups": f"""WITH f AS (SELECT page_id, regexp_extract_all(html, '{TAG}', 1) AS f FROM pages), t AS (SELECT page_id, unnest(f) AS tag, generate_subscripts(f, 1) AS pos FROM f),
k AS (SELECT *, regexp_extract(tag, '^[a-z0-9]+') AS name, regexp_extract(tag, ' ([a-z-]+)="', 1) AS kind, regexp_extract(tag, '="([^"]*)"', 1) AS value FROM t),
s AS (SELECT page_id, CASE WHEN kind = 'class' THEN '.' || value WHEN kind = 'id' THEN '#' || value WHEN kind <> '' THEN name || '[' || kind || ']' ELSE name END AS s, min(pos) AS pos FROM k GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN starts_with(s, '.') AND NOT contains(s, ' ') THEN 0 WHEN starts_with(s, '#') OR (contains(s, '[') AND contains(s, ']')) OR starts_with(s, '.') THEN 1 ELSE 2 END AS g FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY page_id, g ORDER BY pos) AS rn FROM g), j AS (SELECT page_id, g, string_agg(s, ',' ORDER BY pos) AS s FROM r WHERE rn <= CASE g WHEN 2 THEN 3 ELSE 5 END GROUP BY 1, 2)
SELECT page_id, coalesce(max(s) FILTER (g = 0), '') AS simple, coalesce(max(s) FILTER (g = 1), '') AS medium, coalesce(max(s) FILTER (g = 2), '') AS complex FROM j GROUP BY page_id""",
    "fact_by_id": f"WITH {FACTS_SQL} SELECT * FROM facts WHERE fact_id = 7",
}
