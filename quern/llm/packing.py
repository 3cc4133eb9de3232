"""Packing by optimal length buckets.

The lengths of all documents become one global histogram; dynamic programming
over it chooses the bucket borders with the least padding; documents padded to
their bucket's border then form batches of a token budget inside each bucket.

The histogram has a row for each distinct length, so borders are optimal for all
documents.  Its size is bounded by the text: k distinct lengths need at least
k (k - 1) / 2 words, so 10^13 words give at most 4.5 million, and the programme takes
a few vectorised passes over them for each bucket (its costs are such that best
cuts move only upwards, so each half of the lengths searches its own range).  Batches form
within chunks of a bucket, dealt by a hash of the id, as many as the bucket's own
rows need at `chunk` rows each, so a length that a third of all documents share is
spread like any other; each chunk may end in one unfilled batch.

Edge cases: null text has no tokens; documents without tokens go to the smallest
bucket; a document over the budget is a batch by itself; equal rows stand side by
side; null ids sort first; empty tables give empty results; extra columns are not
read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.scratch import stored


@dataclass(frozen=True)
class PackRule:
    buckets: int = 16
    budget: int = 16384
    chunk: int = 4096


def word_count(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text: the default measure of its length."""
    parts = F.size(F.split(text, "[ \\t-\\r]+"))
    ends = text.rlike("^[ \\t-\\r]").cast("int") + text.rlike("[ \\t-\\r]\\z").cast("int")
    return F.when(text.isNull() | (text == ""), 0).otherwise(parts - ends).cast("long")


def _cuts(before: np.ndarray, lengths: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least of before[i] + lengths[j] * (total[j + 1] - total[i]) over i <= j, and its smallest i.

    The smallest best i never falls as j grows, so the middle of a range of js
    splits the is for both halves; all ranges of one depth are taken together.
    """
    m = len(lengths)
    cost, choice = np.empty(m, np.int64), np.empty(m, np.int64)
    ranges = np.array([[0, m - 1, 0, m - 1]], np.int64)
    while len(ranges):
        lo, hi, first, last = ranges.T
        mid = (lo + hi) // 2
        size = np.minimum(last, mid) - first + 1
        start = np.cumsum(size) - size
        i = np.arange(int(size.sum())) + np.repeat(first - start, size)
        j = np.repeat(mid, size)
        value = before[i] + lengths[j] * (total[j + 1] - total[i])
        least = np.minimum.reduceat(value, start)
        at = np.flatnonzero(value == np.repeat(least, size))
        of = np.repeat(np.arange(len(mid)), size)[at]
        best = i[at[np.concatenate(([True], of[1:] != of[:-1]))]]
        cost[mid], choice[mid] = least, best
        halves = np.concatenate((np.stack((lo, mid - 1, first, best), 1), np.stack((mid + 1, hi, best, last), 1)))
        ranges = halves[halves[:, 0] <= halves[:, 1]]
    return cost, choice


def best_borders(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """Borders of at most so many buckets that minimise the total padded length; ascending, the last is the largest length."""
    m = len(lengths)
    if m == 0:
        return []
    total = np.concatenate(([0], np.cumsum(counts)))
    cost = lengths * total[1:]
    back = []
    for _ in range(1, min(buckets, m)):
        # The last bucket holds lengths i to j; i = 0 leaves the earlier buckets empty.
        cost, choice = _cuts(np.concatenate(([0], cost[:-1])), lengths, total)
        back.append(choice)
    out, j = [], m - 1
    for choice in reversed(back):
        if j < 0:
            break
        out.append(int(lengths[j]))
        j = int(choice[j]) - 1
    if j >= 0:
        out.append(int(lengths[j]))
    return sorted(out)


def pack(docs: DataFrame, rule: PackRule = PackRule(), tokens: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, bucket, chunk, batch, slot, padding): every document's place.

    bucket is the border that the document is padded to; (bucket, chunk, batch)
    names a batch, slot its row there.
    """
    n = word_count(F.col(text_col)) if tokens is None else tokens.cast("long")
    sized = stored(docs.select(F.col(id_col), F.coalesce(n, F.lit(0)).cast("long").alias("n_tokens")), "sizes")
    # Documents without tokens are counted as of one token: they get a border as well.
    found = sized.groupBy(F.greatest("n_tokens", F.lit(1).cast("long")).alias("length")).agg(F.count("*").alias("n")).orderBy("length").toArrow()
    lengths, counts = (found.column(c).to_numpy().astype(np.int64) for c in ("length", "n"))
    borders = best_borders(lengths, counts, rule.buckets)
    rows = np.bincount(np.searchsorted(borders, lengths), counts) if borders else []
    bucket, chunks = F.lit(None).cast("long"), F.lit(1).cast("long")
    for b, held in reversed(list(zip(borders, rows, strict=True))):
        fits = F.col("n_tokens") <= b
        bucket, chunks = F.when(fits, F.lit(b).cast("long")).otherwise(bucket), F.when(fits, F.lit(max(1, -(-int(held) // rule.chunk))).cast("long")).otherwise(chunks)
    placed = sized.withColumn("bucket", bucket).withColumn("chunk", F.pmod(F.xxhash64(F.col(id_col), "n_tokens"), chunks))
    room = F.greatest(F.lit(1), F.floor(F.lit(rule.budget) / F.col("bucket")))
    nth = F.row_number().over(Window.partitionBy("bucket", "chunk").orderBy(F.col(id_col).asc_nulls_first(), "n_tokens")) - 1
    return placed.withColumn("_nth", nth).select(id_col, "n_tokens", "bucket", "chunk", F.floor(F.col("_nth") / room).alias("batch"), (F.col("_nth") % room).cast("long").alias("slot"), (F.col("bucket") - F.col("n_tokens")).alias("padding"))
