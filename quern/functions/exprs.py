"""Column functions of the library: predicates, cleaners, parsers, scores.

Each takes and returns Columns, stays inside code generation and has no state.
Word lists are parameters with plain defaults.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what stands in a fact for "nothing was found".
NOT_FOUND = "Information not found"


def has_value(c: Column) -> Column:
    """Neither null nor empty."""
    return F.coalesce(c, F.lit("")) != ""


def has_data(c: Column) -> Column:
    """A usable fact value: not missing and not the sentinel."""
    return ~F.coalesce(c, F.lit("")).isin("", NOT_FOUND)


def contains_ci(c: Column, needle: str | None) -> Column:
    """Case-insensitive containment without wildcards; no needle accepts all."""
    return F.lit(True) if not needle else F.coalesce(F.lower(c).contains(needle.lower()), F.lit(False))


def tri_state(c: Column, wanted: str | None) -> Column:
    """'true' and 'false' filter, anything else accepts all."""
    text = (wanted or "").lower()
    return c if text == "true" else ~c if text == "false" else F.lit(True)


def any_of(c: Column, terms: Sequence[str]) -> Column:
    """Some term occurs."""
    out = F.lit(False)
    for t in terms:
        out = out | c.contains(t)
    return out


def hits(c: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur."""
    return sum((c.contains(t).cast("int") for t in terms), F.lit(0))


def occurrences(c: Column, term: str) -> Column:
    """Non-overlapping occurrences of a term."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)).cast("int")


def squeeze(c: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, "[ \\t-\\r]+", " "))


def normalize_url(url: Column) -> Column:
    """https, no leading www., no slash at the path's end; query and fragment stay."""
    rest = F.regexp_replace(url, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_extract(rest, "^([^/?#]*)", 1), "^www\\.", "")
    path = F.regexp_replace(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), "/+$", "")
    tail = F.regexp_extract(rest, "^[^?#]*(.*)$", 1)
    return F.concat(F.lit("https://"), host, path, tail)


def comparable_url(url: Column) -> Column:
    """Trimmed, lower case, one slash less at the end, https."""
    u = F.regexp_replace(F.lower(F.trim(url)), "/$", "")
    u = F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))
    return F.regexp_replace(u, "^http://", "https://")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, "^[a-z]+://([^/?#]*)", 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, "^[a-z]+://[^/?#]*([^?#]*)", 1)


def url_pattern(path: Column) -> Column:
    """A path's shape: numbered segments, digits and long hexadecimal ids are generalised."""
    p = F.regexp_replace(path, "/[0-9]+", "/NUM")
    p = F.lower(F.regexp_replace(p, "[0-9]+", "N"))
    return F.regexp_replace(p, "[a-f0-9]{8,}", "ID")


def rewrite(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Regular-expression rewrites, one after the other."""
    for pattern, into in rules:
        c = F.regexp_replace(c, pattern, into)
    return c


# Rewrites of names and addresses, in their order.
NAME_RULES = (
    (r"\bst\.?\s+", "saint "),
    (r"\bsts\.?\s+", "saints "),
    (r"\bblessed\s+virgin\s+mary\b", "bvm"),
    (r"\bour\s+lady\s+of\b", "ol of"),
    (r"\bimmaculate\s+heart\s+of\s+mary\b", "ihm"),
    (r"\bsacred\s+heart\s+of\s+jesus\b", "shj"),
    (r"\bcatholic\s+church\b", "church"),
    (r"\bparish\s+church\b", "church"),
    (r"\bchurch\s+of\b", ""),
    (r"\s+", " "),
)
ADDRESS_RULES = (
    (r"\bstreet\b", "st"),
    (r"\bavenue\b", "ave"),
    (r"\bdriver\b", "dr"),
    (r"\broad\b", "rd"),
    (r"\bboulevard\b", "blvd"),
    (r"\blane\b", "ln"),
    (r"\bcourt\b", "ct"),
    (r"\bcircle\b", "cir"),
    (r"\bplace\b", "pl"),
    (r"\bapartment\b", "apt"),
    (r"\bsuite\b", "ste"),
    (r"\bnorth\b", "n"),
    (r"\bsouth\b", "s"),
    (r"\beast\b", "e"),
    (r"\bwest\b", "w"),
)


def normalize_with(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Lower case, rules, no punctuation, single spaces (ASCII letters, digits and _ count as word characters)."""
    out = F.regexp_replace(rewrite(F.lower(F.trim(F.coalesce(c, F.lit("")))), rules), "[^a-z0-9_ \\t]", "")
    return squeeze(out)


def phone_digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def phones_match(a: Column, b: Column) -> Column:
    x, y = phone_digits(a), phone_digits(b)
    return (x == y) & (F.length(x) >= 10)


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """First match, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


PHONE = r"\(?[0-9]{3}\)?[-. ]?[0-9]{3}[-. ]?[0-9]{4}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def format_phone(c: Column) -> Column:
    """(ddd) ddd-dddd where there are ten digits, else unchanged."""
    d = phone_digits(c)
    return F.when(F.length(d) == 10, F.concat(F.lit("("), F.substring(d, 1, 3), F.lit(") "), F.substring(d, 4, 3), F.lit("-"), F.substring(d, 7, 4))).otherwise(c)


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def band(c: Column, cuts: Sequence[tuple[float, str]], last: str) -> Column:
    """The label of the first cut that the value reaches."""
    out = None
    for at, label in cuts:
        out = F.when(c >= at, label) if out is None else out.when(c >= at, label)
    return out.otherwise(last)


def first_class(c: Column, classes: Sequence[tuple[str, Sequence[str]]], last: str) -> Column:
    """The first class one of whose patterns matches."""
    out = None
    for label, patterns in classes:
        hit = c.rlike("|".join(patterns))
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def exclusive_p95(values: Column) -> Column:
    """95th percentile of a sorted array by the exclusive method; 1.5 means below five values."""
    m = F.size(values)
    j = F.greatest(F.lit(1), F.least(F.floor(19 * (m + 1) / 20).cast("int"), m - 1))
    d = 19 * (m + 1) - j * 20
    high = (F.element_at(values, j) * (20 - d) + F.element_at(values, j + 1) * d) / 20
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / m
    return F.when(m >= 5, high).when(m > 0, mean * 1.5)


# Entities and their letters; the ampersand comes last.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """Common entities as their letters."""
    for entity, letter in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(letter))
    return c


def unescape_text(text: str) -> str:
    """`unescape` for a text in Python: only references that end in a semicolon count."""
    for entity, letter in ENTITIES:
        text = text.replace(entity, letter)
    return text


def html_text(html: Column) -> Column:
    """Text of a page: scripts, styles and tags become spaces, white space is squeezed."""
    bare = F.regexp_replace(html, "(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return squeeze(F.regexp_replace(bare, "<[^>]*>", " "))
