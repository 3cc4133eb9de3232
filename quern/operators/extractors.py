"""Rows of listings in pages: extractors over nodes, chosen by method and tried in a page's order.

Each extractor is a column expression from a page's nodes and its address to an
array of rows (ROW).  The chain evaluates them lazily in one pass over a page: the
first that gives rows wins and is named in each of them.  Terms and selectors
are parameters with the published values as defaults.

Null and empty pages give no rows.  Fetching other pages, moving maps and reading
PDFs are not part of this.
"""

from __future__ import annotations

import html
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import dom as D
from quern.functions import exprs as X
from quern.functions.urls import url_join

ROW = "struct<name: string, street_address: string, city: string, state: string, zip_code: string, full_address: string, phone: string, website: string, latitude: double, longitude: double, miles: double, confidence: double, method: string>"
ROWS = f"array<{ROW}>"

# Street suffixes of addresses at the end of a name, and of addresses in details and cells.
NAME_SUFFIXES = "street|st|avenue|ave|road|rd|drive|dr|way|lane|ln|boulevard|blvd|court|ct|plaza|pl|terrace|ter|circle|cir|parkway|pkwy|highway|hwy|route|rte|blvd"
DETAIL_SUFFIXES = "Street|St|Avenue|Ave|Road|Rd|Drive|Dr|Way|Lane|Ln|Boulevard|Blvd|Court|Ct|Plaza|Pl|Terrace|Ter|Circle|Cir|Parkway|Pkwy|Highway|Hwy|Route|Rte"
CELL_STREET = "(?i)\\d+.*(?:street|st|avenue|ave|road|rd|drive|dr)"
ADDRESS = rf"(?i)(\d+\s+[\w\s.\-]+(?:{NAME_SUFFIXES})\.?,?\s*.*?\s*\w{{2}}\s*\d{{5}}(?:-\d{{4}})?)$"
CITY_STATE_ZIP = r"([A-Za-z\s.]+),\s*([A-Za-z]{2})\s*(\d{5}(?:-\d{4})?)$"
ZIP = r"(\d{5}(?:-\d{4})?)$"
MILES = r"(?i)\((\d+\.?\d*)\s*Miles\)"
PHONE = r"\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}"
DETAIL_PHONES = (r"(?i)Phone:\s*(\(?(?:\d{3})\)?\s*[-.\s]?\d{3}[-.\s]?\d{4})", r"(?i)P:\s*(\(?(?:\d{3})\)?\s*[-.\s]?\d{3}[-.\s]?\d{4})", r"\b(\d{3}[-.\s]?\d{3}[-.\s]?\d{4})\b")
DETAIL_ADDRESS = rf"(?i)(\d+\s+[A-Za-z0-9\s.\-]+(?:{DETAIL_SUFFIXES})\.?,?)\s*([A-Za-z\s]+),\s*([A-Z]{{2}})\s*(\d{{5}}(?:-\d{{4}})?)"
# What names of cards, finders and generic elements must not or must hold.
CARD_SKIPS = ("no parish registration", "contact", "chancery", "pastoral center", "tv mass", "directory", "finder", "diocese", "bishop", "office")
FINDER_SKIPS = ("finder", "directory", "map", "search", "filter")
GENERIC_NAMES = ("parish", "church", "st.", "saint", "our lady", "holy", "cathedral")
NAMED = ("saint", "st.", "st ", "holy", "blessed", "our lady", "cathedral", "church", "parish", "chapel", "shrine", "basilica", "sacred", "immaculate", "mother", "christ")
CONTROLS = ("type", "apply", "select", "open", "load", "hide", "disable", "enable", "boundary", "group", "column", "tool", "drag", "zoom", "search", "filter", "legend", "menu", "navigation")
TABLE_WORDS = ("parish", "church", "name", "address")
SOCIAL = ("facebook", "twitter", "instagram")
LATITUDES, LONGITUDES = ("data-lat", "data-latitude", "lat", "latitude"), ("data-lng", "data-longitude", "data-lon", "lng", "longitude", "lon")
# Lists in scripts by name, then by what their items hold; fields that hold a name.
SCRIPT_WORDS = ("parish", "church", "location", "marker", "lat", "popup")
SCRIPT_LISTS = (*[rf"(?s){n}\s*[:=]\s*(\[.*?\])" for n in ("parishes", "locations", "markers", "churches")], r'(?s)(\[.*?\{.*?"type"\s*:\s*"point".*?\}.*?\])', r'(?s)(\[.*?\{.*?"lat"\s*:\s*[\d.-]+.*?\}.*?\])', r'(?s)(\[.*?\{.*?"popup"\s*:\s*\{.*?\}.*?\])')
NAME_FIELDS = ("name", "parishName", "churchName", "parish_name", "church_name", "label", "text", "Name")

_t, _c, _a = D.tag, D.has_class, D.attr_has
#: Published selectors, most telling first; each is tried on the whole page.
FINDER_ITEMS: tuple[D.Test, ...] = (D.both(_t("li"), _c("location"), _c("parishes")), _a("class", "site"), D.both(_t("li"), D.has_attr("data-latitude")), _c("parish-item"), D.both(_a("class", "parish"), _a("class", "location")), _a("class", "parish"))
GENERIC_ITEMS: tuple[D.Test, ...] = (_a("class", "parish"), _a("class", "church"), _a("class", "location"), _t("article"), _c("entry"), _a("id", "parish"))
#: Lists and cards of menu pages as (outer, inner); outer None stands for the page.
LISTED: tuple[tuple[D.Test | None, D.Test], ...] = (
    (_c("parish-list"), _t("li")), (_c("church-list"), _t("li")), (D.both(_t("ul"), _c("parishes")), _t("li")), (D.both(_t("ul"), _c("churches")), _t("li")), (_c("directory-list"), _c("item")), (_c("parish-directory"), _c("entry")),
    (None, D.both(_t("article"), _c("post"))), (None, D.both(_t("article"), _a("class", "post"))), (None, _c("entry-title")), (None, _c("post-title")), (None, _c("entry-header")),
    (_c("content-area"), _t("article")), (_c("main-content"), _c("post")), (_c("site-content"), _t("article")), (_c("primary-content"), _c("entry")), (_t("main"), _t("article")), (_t("section"), _t("article")), (_c("content"), _t("article")),
    (None, _c("parish-card")), (None, _c("church-card")), (None, _c("location-card")), (None, D.both(_a("class", "parish"), _a("class", "card"))), (None, D.both(_a("class", "church"), _a("class", "card"))),
)
ITEM_NAMES: tuple[D.Test, ...] = (_t("h1"), _t("h2"), _t("h3"), _t("h4"), _c("name"), _c("title"), _c("parish-name"), _t("strong"), _c("entry-title"), _c("post-title"), D.both(_t("a"), _a("href", "parish")), D.both(_t("a"), _a("href", "church")), D.both(_t("a"), _a("title", "parish")), D.both(_t("a"), _a("title", "church")))


@dataclass(frozen=True)
class ListingTerms:
    """What an extractor accepts: selectors of items, and words of names."""

    finder_items: Sequence[D.Test] = FINDER_ITEMS
    finder_names: Sequence[D.Test] = (_c("name"), _c("parish-name"), _t("h3"), _t("h4"), _c("title"), _t("span"))
    generic_items: Sequence[D.Test] = GENERIC_ITEMS
    generic_names: Sequence[str] = GENERIC_NAMES
    generic_headings: Sequence[str] = ("h1", "h2", "h3", "h4", "h5")
    #: Whether a generic element without a heading is named by its first line, and whether addresses and distances are cut off names.
    generic_lines: bool = True
    generic_split: bool = True
    listed: Sequence[tuple[D.Test | None, D.Test]] = LISTED
    named: Sequence[str] = NAMED
    controls: Sequence[str] = CONTROLS
    table_words: Sequence[str] = TABLE_WORDS
    card: D.Test = field(default=D.both(_t("div"), lambda n: F.coalesce(D.attr(n, "class") == "col-lg location", F.lit(False))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def first_of(options: Sequence[Column]) -> Column:
    """The first array that is not empty, or null."""
    return F.try_element_at(F.filter(F.array(*options), lambda x: F.size(x) > 0), F.lit(1))


def first_rows(options: Sequence[Column], one: Callable[[Column], Column]) -> Column:
    """The rows of the first array of items that gives any."""
    return F.aggregate(F.array(*options), F.expr(f"cast(array() as {ROWS})"), lambda found, items: F.when(F.size(found) > 0, found).otherwise(_kept(F.transform(items, one))))


def _present(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def split_name(raw: Column) -> Column:
    """Name, address parts and distance of a listing's line, as a struct."""
    miles = X.first_match(raw, MILES, 1).cast("double")
    plain = F.trim(F.regexp_replace(raw, MILES, ""))

    def parts(p: Column) -> Column:
        full = F.coalesce(F.trim(F.regexp_extract(p, ADDRESS, 1)), F.lit(""))
        place = F.regexp_extract(full, CITY_STATE_ZIP, 0)
        zip_code = F.regexp_extract(full, ZIP, 1)
        name = F.when(full != "", F.trim(F.replace(p, full, F.lit("")))).otherwise(p)
        street = F.when(place != "", F.replace(full, place, F.lit(""))).when(zip_code != "", F.replace(full, zip_code, F.lit(""))).otherwise(full)
        part = lambda k: _present(F.regexp_extract(full, CITY_STATE_ZIP, k))
        return F.struct(
            X.squeeze(F.regexp_replace(name, ",\\s*$", "")).alias("name"),
            _present(F.regexp_replace(F.trim(street), ",+\\s*$", "")).alias("street"),
            part(1).alias("city"), part(2).alias("state"), F.coalesce(part(3), _present(zip_code)).alias("zip"), _present(full).alias("full"), miles.alias("miles"),
        )

    return let(F.coalesce(plain, F.lit("")), parts)


def whole_name(raw: Column) -> Column:
    """The struct of `split_name` for a line that is all name."""
    null = lambda kind: F.lit(None).cast(kind)
    return F.struct(X.squeeze(F.regexp_replace(F.trim(raw), ",\\s*$", "")).alias("name"), *[null("string").alias(n) for n in ("street", "city", "state", "zip", "full")], null("double").alias("miles"))


def _row(method: str, confidence: float, name: Column, s: Column, **more: Column) -> Column:
    """A row of a split name; more replaces its fields."""
    null = F.lit(None)
    has = {"street_address": s["street"], "city": s["city"], "state": s["state"], "zip_code": s["zip"], "full_address": s["full"], "miles": s["miles"]} | more
    names = ("street_address", "city", "state", "zip_code", "full_address", "phone", "website", "latitude", "longitude", "miles")
    return F.struct(name.alias("name"), *[has.get(n, null).alias(n) for n in names], F.lit(confidence).alias("confidence"), F.lit(method).alias("method")).cast(ROW)


def _kept(rows: Column) -> Column:
    return F.filter(rows, lambda r: r.isNotNull())


def _first_text(nodes: Column, tests: Sequence[D.Test]) -> Column:
    """Text of the first element by the first test that has one."""
    return F.coalesce(*[D.text_of(D.first(nodes, t)) for t in tests])


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def card_rows(nodes: Column, base: Column, terms: ListingTerms = ListingTerms()) -> Column:
    """Cards with a linked title; the city is the second line of the card's body, the site the card's link."""

    def one(card: Column) -> Column:
        return let(D.first(D.inside(card), D.both(_t("a"), _c("card"))), lambda link: let(X.squeeze(D.text_of(D.first(link, D.both(_t("h4"), _c("card-title"))))), lambda raw: let(split_name(raw), lambda s: made(link, raw, s))))

    def made(link: Column, raw: Column, s: Column) -> Column:
        second = F.try_element_at(_lines(D.text_of(D.first(link, D.both(_t("div"), _c("card-body"))))), F.lit(2))
        href = D.attr(D.own(link), "href")
        site = let(href, lambda h: F.when(h.startswith("/"), url_join(base, h)).otherwise(h))
        town = F.coalesce(s["city"], F.when(~second.startswith("Learn More"), X.squeeze(second)))

        def placed(t: Column) -> Column:
            halves = F.split(t, ", ")
            cut = s["state"].isNull() & (F.size(halves) == 2)
            return _row("diocese_card_extraction", 0.9, s["name"], s, city=F.when(cut, F.trim(halves[0])).otherwise(t), state=F.when(cut, F.trim(F.try_element_at(halves, F.lit(2)))).otherwise(s["state"]), website=site)

        return F.when((F.length(raw) >= 3) & ~X.any_of(F.lower(s["name"]), CARD_SKIPS), let(town, placed))

    return _kept(F.transform(D.subtrees(nodes, terms.card), one))


def finder_rows(nodes: Column, base: Column, terms: ListingTerms = ListingTerms()) -> Column:
    """Items of a finder by the first selector that has any: name, coordinates, and details of its hidden part."""
    bound = D.both(_t("span"), _a("data-bind", "title"))

    def number(item: Column, names: Sequence[str]) -> Column:
        return F.coalesce(*[F.expr("cast(null as double)"), *[D.attr(D.own(item), n).try_cast("double") for n in names]])

    def one(item: Column) -> Column:
        name = F.coalesce(_present(X.squeeze(D.text_of(D.first(item, bound)))), X.squeeze(_first_text(D.inside(item), terms.finder_names)))
        details = D.first(item, D.both(_t("div"), _c("mapLocationDetail")))
        return let(split_name(F.coalesce(name, F.lit(""))), lambda s: let(details, lambda d: let(F.coalesce(D.text_of(d), F.lit("")), lambda said: made(item, s, d, said))))

    def made(item: Column, s: Column, d: Column, said: Column) -> Column:
        digits = X.phone_digits(F.coalesce(*[X.first_match(said, p, 1) for p in DETAIL_PHONES]))
        phone = F.when(F.length(digits) == 10, X.format_phone(digits))
        href = F.trim(D.attr(D.own(D.first(d, _t("a"))), "href"))
        part = lambda k: _present(X.squeeze(F.regexp_extract(said, DETAIL_ADDRESS, k)))
        street = _present(F.regexp_replace(part(1), ",\\s*$", ""))
        full = F.when(street.isNotNull(), F.concat_ws(" ", street, F.concat(part(2), F.lit(","), F.lit(" "), part(3)), part(4)))
        row = _row(
            "parish_finder_extraction", 0.85, s["name"], s, street_address=F.coalesce(street, s["street"]), city=F.coalesce(part(2), s["city"]), state=F.coalesce(part(3), s["state"]), zip_code=F.coalesce(part(4), s["zip"]), full_address=F.coalesce(full, s["full"]),
            phone=phone, website=F.when(href.startswith("http") | href.startswith("www"), href), latitude=number(item, LATITUDES), longitude=number(item, LONGITUDES),
        )
        return F.when((F.length(s["name"]) >= 3) & ~X.any_of(F.lower(s["name"]), FINDER_SKIPS), row)

    items = first_of([D.subtrees(nodes, t) for t in terms.finder_items])
    return _kept(F.transform(items, one))


def table_rows(nodes: Column, base: Column, terms: ListingTerms = ListingTerms()) -> Column:
    """Rows of tables that speak of such listings, their first row left out; cells told apart by what they hold.

    A cell that spans rows counts in each of them, so a name given once names all its rows.
    """

    def one(cells: Column) -> Column:
        return let(split_name(X.squeeze(D.text_of(F.try_element_at(cells, F.lit(1))))), lambda s: let(F.transform(F.slice(cells, 2, F.greatest(F.size(cells) - 1, F.lit(0))), seen), lambda rest: made(s, rest)))

    def seen(cell: Column) -> Column:
        href = D.attr(D.own(D.first(cell, _t("a"))), "href")
        return let(D.text_of(cell), lambda x: F.struct(x.alias("text"), X.first_match(x, PHONE).alias("phone"), x.rlike(CELL_STREET).alias("street"), F.when(href.startswith("http"), href).alias("site")))

    def last(rest: Column, keep: Callable[[Column], Column], value: Callable[[Column], Column]) -> Column:
        return F.try_element_at(F.transform(F.filter(rest, keep), value), F.lit(-1))

    def made(s: Column, rest: Column) -> Column:
        short = lambda x: x["site"].isNull() & (F.length(F.trim(x["text"])) < 30) & (F.length(F.trim(x["text"])) > 2) & ~x["text"].rlike("\\d")
        phone = last(rest, lambda x: x["phone"].isNotNull(), lambda x: x["phone"])
        street = last(rest, lambda x: x["phone"].isNull() & x["street"], lambda x: X.squeeze(x["text"]))
        row = _row("table_extraction", 0.85, s["name"], s, street_address=F.coalesce(street, s["street"]), city=F.coalesce(last(rest, short, lambda x: X.squeeze(x["text"])), s["city"]), phone=phone, website=last(rest, lambda x: x["site"].isNotNull(), lambda x: x["site"]))
        return F.when(F.length(s["name"]) >= 3, row)

    tables = F.filter(D.subtrees(nodes, _t("table")), lambda t: X.any_of(F.lower(D.text_of(t)), terms.table_words))
    rows = F.flatten(F.transform(tables, lambda t: let(D.grid_rows(t), lambda g: F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))))))
    return _kept(F.transform(F.filter(rows, lambda r: F.size(r) > 0), one))


def generic_rows(nodes: Column, base: Column, terms: ListingTerms = ListingTerms()) -> Column:
    """Elements by the first selector that gives rows: heading or first line, phone, first link to another site."""

    def one(item: Column) -> Column:
        headings = [F.when(F.length(h) > 2, h) for h in (X.squeeze(D.text_of(D.first(D.inside(item), _t(tag)))) for tag in terms.generic_headings)]
        lines = lambda said: [F.try_element_at(_lines(said), F.lit(1))] if terms.generic_lines else []
        named = split_name if terms.generic_split else whole_name
        return let(D.text_of(item), lambda said: let(named(F.coalesce(*headings, *lines(said), F.lit(""))), lambda s: made(item, said, s)))

    def made(item: Column, said: Column, s: Column) -> Column:
        links = F.transform(F.filter(item, lambda n: n["tag"] == "a"), lambda n: D.attr(n, "href"))
        site = F.try_element_at(F.filter(links, lambda h: h.startswith("http") & ~X.any_of(F.lower(h), SOCIAL)), F.lit(1))
        row = _row("improved_generic_extraction", 0.4, s["name"], s, phone=X.first_match(said, PHONE), website=site)
        return F.when((F.length(s["name"]) >= 3) & X.any_of(F.lower(s["name"]), terms.generic_names), row)

    return first_rows([D.subtrees(nodes, t) for t in terms.generic_items], one)


def listed_rows(nodes: Column, base: Column, terms: ListingTerms = ListingTerms()) -> Column:
    """Items of lists and cards of a directory page, by the first selector that gives rows."""

    def one(item: Column) -> Column:
        return let(D.text_of(item), lambda said: let(F.trim(F.coalesce(_first_text(D.inside(item), ITEM_NAMES), F.try_element_at(F.split(F.trim(said), "\n"), F.lit(1)))), lambda name: let(split_name(X.squeeze(said)), lambda s: made(name, s))))

    def made(name: Column, s: Column) -> Column:
        low = F.lower(name)
        row = _row("navigation_element_extraction", 0.5, X.squeeze(name), s, full_address=F.lit(None), miles=F.lit(None))
        return F.when((F.length(name) >= 3) & X.any_of(low, terms.named) & ~X.any_of(low, terms.controls), row)

    return first_rows([D.subtrees(nodes, inner) if outer is None else D.under(nodes, outer, inner) for outer, inner in terms.listed], one)


def map_rows(nodes: Column, base: Column, terms: ListingTerms = ListingTerms()) -> Column:
    """Items of JSON lists in scripts, by the first pattern that gives rows: named, typed, with coordinates or pop-ups.

    Lists end at their first closing bracket, as published.
    """

    def one(item: Column) -> Column:
        get = lambda k: _present(F.get_json_object(item, f"$.{k}"))
        popup = F.get_json_object(item, "$.popup.value")
        name = F.coalesce(_present(X.squeeze(X.unescape(F.regexp_extract(popup, "(?is)<(?:a|h[1-4])(?:\\s[^>]*)?>([^<]*)</", 1)))), _present(X.squeeze(X.unescape(F.regexp_replace(get("title"), "<[^>]*>", "")))), *[get(k) for k in NAME_FIELDS])
        return let(split_name(F.coalesce(name, F.lit(""))), lambda s: F.when((F.length(s["name"]) >= 3) & ~X.any_of(F.lower(s["name"]), FINDER_SKIPS), _row(
            "interactive_map_extraction", 0.8, s["name"], s, city=F.coalesce(s["city"], get("city"), get("location"), get("City")), phone=get("phone"), website=F.coalesce(get("website"), get("url")),
            latitude=F.coalesce(get("lat"), get("latitude")).try_cast("double"), longitude=F.coalesce(get("lng"), get("lon"), get("longitude")).try_cast("double"))))

    def items(pattern: str) -> Column:
        def of(script: Column) -> Column:
            lists = F.transform(F.regexp_extract_all(script, F.lit(pattern), F.lit(1)), lambda j: F.from_json(j, "array<string>"))
            return F.filter(F.flatten(F.filter(lists, lambda x: x.isNotNull())), lambda i: i.startswith("{"))

        return F.flatten(F.transform(scripts, of))

    scripts = F.transform(F.filter(nodes, lambda n: (n["tag"] == "#raw") & X.any_of(F.lower(n["text"]), SCRIPT_WORDS)), lambda n: n["text"])
    return first_rows([items(p) for p in SCRIPT_LISTS], one)


#: Extractors by the names that page analysis gives, and by method.
BY_NAME = {"EnhancedDiocesesCardExtractor": card_rows, "ParishFinderExtractor": finder_rows, "TableExtractor": table_rows, "ImprovedInteractiveMapExtractor": map_rows, "NavigationExtractor": listed_rows, "ImprovedGenericExtractor": generic_rows}
# Methods of detected patterns and their extractors; others are generic.
BY_METHOD = {"diocese_card_extraction_with_details": "EnhancedDiocesesCardExtractor", "parish_finder_extraction": "ParishFinderExtractor", "table_extraction": "TableExtractor", "interactive_map_extraction": "ImprovedInteractiveMapExtractor", "navigation_extraction": "NavigationExtractor", "generic_extraction": "ImprovedGenericExtractor", "squarespace_extraction": "ImprovedGenericExtractor"}


def by_method(method: Column, nodes: Column, base: Column, terms: ListingTerms = ListingTerms()) -> Column:
    """The rows of the extractor that a page's method names; unknown methods get the generic one.  Only that one runs."""
    out = generic_rows(nodes, base, terms)
    for m, name in BY_METHOD.items():
        if name != "ImprovedGenericExtractor":
            out = F.when(method == m, BY_NAME[name](nodes, base, terms)).otherwise(out)
    return out


def chain(order: Column, nodes: Column, base: Column, terms: ListingTerms = ListingTerms()) -> Column:
    """(source, rows) of the first extractor of a page's order that gives rows; names without an extractor are passed over."""
    none = F.struct(F.lit(None).cast("string").alias("source"), F.expr(f"cast(array() as {ROWS})").alias("rows"))

    def step(found: Column, name: Column) -> Column:
        rows = F.expr(f"cast(array() as {ROWS})")
        for n, extract in BY_NAME.items():
            rows = F.when(name == n, extract(nodes, base, terms)).otherwise(rows)
        return F.when(F.size(found["rows"]) > 0, found).otherwise(let(rows, lambda r: F.struct(F.when(F.size(r) > 0, name).alias("source"), r.alias("rows"))))

    return F.aggregate(order, none, step)


def extracted(pages: DataFrame, order: Column, keys: Sequence[str] = ("page_id",), url_col: str = "url", html_col: str = "html", terms: ListingTerms = ListingTerms(), unescape: Callable[[str], str] = html.unescape) -> DataFrame:
    """(keys, source, pos, row fields): each page read once, by the first extractor of its order that gives rows."""
    read = D.with_nodes(pages.select(*keys, F.col(url_col).alias("_url"), order.alias("_order"), F.col(html_col).alias("_html")), "_html", "_nodes", unescape=unescape)
    got = read.select(*keys, chain(F.col("_order"), F.col("_nodes"), F.col("_url"), terms).alias("_got"))
    return got.select(*keys, F.col("_got.source").alias("source"), F.posexplode("_got.rows").alias("pos", "_row")).select(*keys, "source", "pos", "_row.*")
