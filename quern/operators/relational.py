"""Relational operators: listings, pages, pivots, comparisons, upserts, prioritised picks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nulls_as_largest(c: Column, descending: bool = False) -> Column:
    """Nulls last ascending and first descending."""
    return c.desc_nulls_first() if descending else c.asc_nulls_last()


def page(df: DataFrame, order: Sequence[Column], number: int, size: int) -> DataFrame:
    """One page of an ordered listing; pages count from 1.  The order must end in a unique key."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def sort_key(df: DataFrame, wanted: str, allowed: dict[str, str], unique: str, descending: bool = False) -> list[Column]:
    """The order for a sort key from outside: only allowed keys count, and the unique key breaks ties."""
    column = allowed.get(wanted)
    return [*([nulls_as_largest(F.col(column), descending)] if column else []), F.col(unique).asc()]


def with_rows(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other, df[left] == other[right], "left_semi")


def without_rows(df: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    return df.join(other, df[left] == other[right], "left_anti")


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the largest order columns of each key, by an aggregation that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return best.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*df.columns)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of new replace those of old with the same key; of equal keys in new the latest counts."""
    fresh = latest_by(new, keys, order)
    return old.join(fresh, list(keys), "left_anti").unionByName(fresh.select(*old.columns))


def partial_upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], given: Sequence[str]) -> DataFrame:
    """As upsert, but new only has some columns and its nulls keep old values."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    both = o.join(n, on, "full_outer")
    return both.select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in given or c in keys else F.col(f"o.{c}").alias(c) for c in old.columns])


def resolve_by_two_keys(new: DataFrame, old: DataFrame, first: Sequence[str], second: Sequence[str], id_col: str) -> DataFrame:
    """Each new row's existing id by the first key, else by the second, else null; and what would happen."""
    a = old.groupBy(*first).agg(F.min(id_col).alias("_by_first"))
    b = old.groupBy(*second).agg(F.min(id_col).alias("_by_second"))
    found = new.join(a, list(first), "left").join(b, list(second), "left")
    hit = F.coalesce("_by_first", "_by_second")
    return found.withColumn("existing_id", hit).withColumn("outcome", F.when(hit.isNull(), "added").otherwise("updated")).drop("_by_first", "_by_second")


def compare(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison: match, mismatch, only_left, only_right."""
    a, b = left.select(key, F.col(value).alias("left_value")), right.select(F.col(key).alias("_k"), F.col(value).alias("right_value"))
    both = a.join(b, F.col(key) == F.col("_k"), "full_outer")
    kind = F.when(F.col("_k").isNull(), "only_left").when(F.col(key).isNull(), "only_right").when(F.col("left_value").eqNullSafe(F.col("right_value")), "match").otherwise("mismatch")
    return both.select(F.coalesce(key, "_k").alias(key), "left_value", "right_value", kind.alias("outcome"))


def daily_cumulative(df: DataFrame, stamp: Column) -> DataFrame:
    """(day, n, total): counts of each day from first to last, days without rows included.

    The rows are counted by day before anything else, so the running total only
    sees one row a day.
    """
    days = df.where(stamp.isNotNull()).groupBy(F.to_date(stamp).alias("day")).agg(F.count("*").alias("n"))
    span = days.agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    full = span.join(days, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("n"))
    return full.withColumn("total", F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def smoothed(df: DataFrame, key: str, at: str, tie: str, value: str, alpha: float = 0.1, width: int = 86_400_000_000) -> DataFrame:
    """(key, n, smoothed): the moving average that gives each new value the weight alpha, in the order of at and tie.

    The first value that is not 0 is taken whole, as is the rule where an average of
    0 means none yet (values are 0 or more).  A value is a map x -> (1 - alpha) x +
    alpha v, and such maps combine: rows are folded inside slices of `width` of a
    key's time, each slice to a factor and a sum, and slices in order to the result,
    so no key is sorted whole.  Null keys, times and values are left out; keys
    with zeros only give 0.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(at).isNotNull() & F.col(value).isNotNull()).select(F.col(key).alias("k"), F.struct(F.col(at).alias("at"), F.col(tie).alias("tie")).alias("o"), F.floor(F.col(at) / width).alias("slice"), F.col(value).cast("double").alias("v"))
    first = rows.groupBy("k").agg(F.min(F.when(F.col("v") != 0, F.col("o"))).alias("first"), F.count("*").alias("n"))
    used = rows.join(first, "k").where(F.col("o") >= F.col("first"))
    after = F.row_number().over(Window.partitionBy("k", "slice").orderBy(F.col("o").desc())) - 1
    part = F.col("v") * F.pow(F.lit(1 - alpha), after) * F.when(F.col("o") == F.col("first"), 1.0).otherwise(alpha)
    folded = used.select("k", "slice", part.alias("part")).groupBy("k", "slice").agg(F.sum("part").alias("sum"), F.count("*").alias("m"))
    later = F.coalesce(F.sum("m").over(Window.partitionBy("k").orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = folded.select("k", (F.col("sum") * F.pow(F.lit(1 - alpha), later)).alias("part")).groupBy("k").agg(F.sum("part").alias("smoothed"))
    return first.join(sums, "k", "left").select(F.col("k").alias(key), "n", F.coalesce("smoothed", F.lit(0.0)).alias("smoothed"))
