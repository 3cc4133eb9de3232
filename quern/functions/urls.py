"""URL filters, features, priorities and qualities as Column functions with term lists as parameters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import exprs as X


@dataclass(frozen=True)
class UrlTerms:
    """Term lists; the defaults hit crawled pages of several languages."""

    exclude: tuple[str, ...] = ("/admin/", "/login/", ".pdf", ".jpg", "mailto:", "#")
    include: tuple[str, ...] = ("/en/", "schedule", "blog")
    high: tuple[str, ...] = ("/en/", "index")
    medium: tuple[str, ...] = ("blog", "page")
    general: tuple[str, ...] = ("example", ".org")
    low: tuple[str, ...] = ("/fr/", "ref")
    blocked_hosts: tuple[str, ...] = ("facebook.com", "m.")


def relevant(url: Column, terms: UrlTerms, max_parts: int = 5) -> Column:
    """Not excluded, and included by a term or not too deep."""
    u = F.lower(url)
    return ~X.any_of(u, terms.exclude) & (X.any_of(u, terms.include) | (F.size(F.split(url, "/")) <= max_parts))


def keyword_priority(url: Column, weights: Sequence[tuple[str, int]], negative: Sequence[str], base_host: str | None = None) -> Column:
    """Weights of the keywords in the path, less 2 a negative one, 1 for depth, 10 for the own host."""
    path, host = F.lower(X.url_path(url)), F.regexp_replace(X.url_host(url), "www\\.", "")
    score = sum((F.when(path.contains(k), w).otherwise(0) for k, w in weights), F.lit(0))
    score = score - 2 * X.hits(path, negative)
    score = score + (F.size(F.split(path, "/")) > 2).cast("int")
    return score + F.when(host == base_host, 10).otherwise(0) if base_host else score


def static_priority(url: Column, terms: UrlTerms) -> Column:
    u = F.lower(url)
    return F.greatest(5.0 * X.hits(u, terms.high) + 3.0 * X.hits(u, terms.medium) + 1.0 * X.hits(u, terms.general) - 2.0 * X.hits(u, terms.low), F.lit(0.0))


def url_join(base: Column, ref: Column) -> Column:
    """A link of a page as an absolute URL: other schemes, hosts, rooted and relative paths, queries, fragments, dot segments."""
    root = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    own, tail = F.regexp_extract(ref, "^([^?#]*)", 1), F.regexp_extract(ref, "^[^?#]*(.*)$", 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^(.*/)", 1))
    parts = F.split(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)), "/")
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1)))).otherwise(F.concat(a, F.array(s))))
    last = F.element_at(parts, -1)
    merged = F.concat(F.array_join(kept, "/"), F.when(last.isin(".", ".."), "/").otherwise(""))
    same = F.concat(root, path, F.when(tail.startswith("#"), F.regexp_extract(base, "^[^?#]*(\\?[^#]*)", 1)).otherwise(""), tail)
    out = F.when(ref == "", base).when(ref.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), ref)
    out = out.when(ref.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), ref))
    return out.when(own == "", same).otherwise(F.concat(root, merged, tail))


def path_depth(url: Column) -> Column:
    return F.size(F.filter(F.split(X.url_path(url), "/"), lambda p: p != ""))


def quality_score(url: Column, confidence: Column, terms: UrlTerms) -> Column:
    """25, 15 and 5 a term, half the confidence in percent over 0.3, shallow +10, deep -10, query -5."""
    u, depth = F.lower(url), path_depth(url)
    score = 25.0 * X.hits(u, terms.high) + 15.0 * X.hits(u, terms.medium) + 5.0 * X.hits(u, terms.general)
    score = score + F.when(confidence > 0.3, confidence * 50.0).otherwise(0.0)
    score = score + F.when(depth <= 2, 10.0).when(depth > 5, -10.0).otherwise(0.0)
    return score - F.when(url.contains("?"), 5.0).otherwise(0.0)


def quality_label(url: Column, score: Column, terms: UrlTerms) -> Column:
    bad = X.any_of(X.url_host(url), terms.blocked_hosts) | F.lower(X.url_path(url)).rlike("\\.(pdf|docx?|zip)$")
    return F.when(bad, "skip").otherwise(X.band(score, ((80.0, "excellent"), (60.0, "good"), (40.0, "fair"), (20.0, "poor")), "skip"))


def estimated_seconds(url: Column, score: Column, label: Column, confidence: Column) -> Column:
    t = F.lit(10.0) * F.when(confidence > 0.3, 0.8).otherwise(1.0) * F.when(path_depth(url) > 5, 1.3).otherwise(1.0) * F.when(url.contains("?"), 1.2).otherwise(1.0)
    return t * F.when(label == "excellent", 0.7).when(label == "good", 0.8).when(label == "poor", 1.5).when(label == "skip", 0.0).otherwise(1.0)
