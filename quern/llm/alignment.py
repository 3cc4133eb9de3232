"""Alignment of two tokenizers: groups of ids that end at the same byte, and links between them.

The ids of both tokenizers become cumulative byte ends.  Dictionaries from end to
index are intersected; the sorted common ends cut both id lists into groups, and
each group's overlapping tokens are its links.

A text falls into units at single spaces between other characters, where both
tokenizers always cut: the first one's pattern gives such a space to the word
that follows, and no piece of the second has a space after another character
(checked when the vocabulary is loaded; otherwise a text is one unit).  A unit
is encoded and aligned once, together with other new ones, and looked up afterwards,
in tables bounded by `MOST_UNITS`.

The number of documents of an id pair is counted over the whole corpus.  The most
frequent pairs, at most `HOT_PAIRS`, are broadcast; all others meet their counts
in a join, so neither the table nor a frequent pair has to fit anywhere.

Edge cases: null and empty texts and texts that either tokenizer does not give
back byte for byte have no tokens (zeros, an empty groups_sha256) and count for no
pair; repeated rows and ids are documents of their own; special tokens' strings are
plain text; very long words are encoded without being kept; empty tables give empty
results; only id and text are read.
"""

from __future__ import annotations

import gc
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb
from quern.llm.scratch import stored

MOST_UNITS = 300_000
MOST_KEPT_CHARS = 200
HOT_PAIRS = 1 << 18
COUNTED = 2_000_000
#: Both tokenizers cut before a space between other characters (Python's white space includes Unicode's).
CUT = re.compile(r"(?<=[^ ])(?= \S)")
#: Texts without such a place are cut at every space.
UNEVEN = re.compile(r" (?:\s|\Z)")


def _byte_of() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable Latin-1 stands for itself, others follow 255."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def common_ends(a: list[int], b: list[int], first_a: int = 0, first_b: int = 0) -> tuple[list[int], list[int]]:
    """Indices, counted from first_a and first_b, into both ascending lists of the values that they share."""
    in_a, in_b = dict(zip(a, range(first_a, first_a + len(a)), strict=True)), dict(zip(b, range(first_b, first_b + len(b)), strict=True))
    both = sorted(in_a.keys() & in_b.keys())
    return list(map(in_a.__getitem__, both)), list(map(in_b.__getitem__, both))


def slice_links(ends_a: np.ndarray, ends_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the overlapping tokens of each group, group by group.

    Inside a group no end but the last is shared, so every end of either side
    begins a new overlap: a group of p and q tokens has p + q - 1 links.
    """
    inner_a, inner_b = np.ones(len(ends_a), bool), np.ones(len(ends_b), bool)
    inner_b[cuts_b] = False  # A shared end counts once.
    ends = np.sort(np.concatenate((ends_a[inner_a], ends_b[inner_b])))
    return np.searchsorted(ends_a, ends), np.searchsorted(ends_b, ends)


class Lists:
    """Lists of numbers of units, one after another, as they are learnt."""

    def __init__(self) -> None:
        self.counts, self.flat = np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def add(self, counts: np.ndarray, flat: np.ndarray) -> None:
        self.counts, self.flat = np.concatenate((self.counts, counts)), np.concatenate((self.flat, flat))

    def keep(self, at: np.ndarray) -> None:
        self.flat, self.counts = self.of(at)

    def cut(self, units: int) -> None:
        self.counts = self.counts[:units]
        self.flat = self.flat[: int(self.counts.sum())]

    def of(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of the units at these places, in order, and how long each is."""
        starts = np.cumsum(self.counts) - self.counts
        counts = self.counts[at]
        ends = np.cumsum(counts)
        return self.flat[np.arange(int(counts.sum())) + np.repeat(starts[at] - (ends - counts), counts)], counts


class Pair:
    """The two tokenizers, the bytes of their tokens, and the units met so far."""

    def __init__(self, first: str, second: bytes) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(first)
        self.first.encode_special_tokens = True
        byte = _byte_of()
        vocab = self.first.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.bytes_a[i] = bytes(byte[c] for c in t) if all(c in byte for c in t) else t.encode()
        self.second = sentencepiece.SentencePieceProcessor(model_proto=second)
        pieces = [self.second.id_to_piece(i) for i in range(self.second.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.second.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sizes = [np.array([len(t) for t in table], np.int64) for table in (self.bytes_a, self.bytes_b)]
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)
        # Ids as they stand in the groups' text: inside a side, and at its end.
        self.said = [f"{i}{end}" for table, last in ((self.bytes_a, "|"), (self.bytes_b, ";")) for i in range(len(table)) for end in (",", last)]
        self.at: dict[str, int] = {}
        self.links, self.groups = Lists(), []
        #: Tokens of both and groups of each unit, -1 groups where a tokenizer does not give it back.
        self.numbers, self.used = np.zeros((0, 3), np.int64), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keeps the better half of the units by use, of those met more than once."""
        often = np.argsort(-self.used, kind="stable")[: MOST_UNITS // 2]
        keep = np.sort(often[self.used[often] > 1])
        units, places = list(self.at), keep.tolist()
        self.at = {units[i]: k for k, i in enumerate(places)}
        self.groups = [self.groups[i] for i in places]
        self.links.keep(keep)
        self.numbers, self.used = self.numbers[keep], self.used[keep]

    def units(self, text: str) -> list[str]:
        """The units of space and text, each without the space that it begins with."""
        if not text or not self.cuttable:
            return [text] if text else []
        return [u[1:] for u in CUT.split(" " + text)] if UNEVEN.search(" " + text) else text.split(" ")

    def _learn(self, new: list[str]) -> None:
        for k in range(0, len(new), 8192):
            some = new[k : k + 8192]
            whole = [" " + u for u in some]
            a = [x.ids for x in self.first.encode_batch_fast(whole, add_special_tokens=False)]
            b = self.second.encode(some, num_threads=1)
            raw = [u.encode("utf-8", "surrogatepass") for u in whole]
            back = self._back(a, self.bytes_a, raw) & self._back(b, self.bytes_b, raw)
            self.at.update(zip(some, range(len(self.groups), len(self.groups) + len(some)), strict=True))
            self._align([x if ok else [] for x, ok in zip(a, back.tolist(), strict=True)], [x if ok else [] for x, ok in zip(b, back.tolist(), strict=True)], back)

    def _align(self, a: list[list[int]], b: list[list[int]], back: np.ndarray) -> None:
        """Appends the groups and links of units, whose bytes lie one after another."""
        n = len(a)
        count_a, count_b = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
        ids_a, ids_b = (np.fromiter(chain.from_iterable(x), np.int64, int(c.sum())) for x, c in ((a, count_a), (b, count_b)))
        unit = np.repeat(np.arange(n), count_a)
        ends_a, ends_b = np.cumsum(self.sizes[0][ids_a]), np.cumsum(self.sizes[1][ids_b])
        cuts_a, cuts_b = (np.array(c, np.int64) for c in common_ends(ends_a.tolist(), ends_b.tolist()))
        i, j = slice_links(ends_a, ends_b, cuts_a, cuts_b)
        cut = np.bincount(unit[cuts_a], minlength=n)
        self.groups += self._say(ids_a, ids_b, cuts_a, cuts_b, np.cumsum(count_a + count_b))
        self.links.add(np.bincount(unit[i], minlength=n), (ids_a[i] << 16 | ids_b[j]).astype(np.uint32))
        self.numbers = np.concatenate((self.numbers, np.stack((count_a, count_b, np.where(back, cut, -1)), 1)))
        self.used = np.concatenate((self.used, np.zeros(n, np.int64)))

    @staticmethod
    def _back(ids: list[list[int]], table: list[bytes], raw: list[bytes]) -> np.ndarray:
        """Whether the tokens give back each unit's bytes: all at once, and one by one only where some do not."""
        spelt = list(map(table.__getitem__, chain.from_iterable(ids)))
        ends = np.cumsum([len(x) for x in ids])
        sizes = np.concatenate(([0], np.cumsum([len(t) for t in spelt])))[np.concatenate(([0], ends))]
        if b"".join(spelt) == b"".join(raw) and (np.diff(sizes) == [len(x) for x in raw]).all():
            return np.ones(len(ids), bool)
        return np.array([b"".join([table[i] for i in x]) == u for x, u in zip(ids, raw, strict=True)], bool)

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """(tokens of both, groups, links) and the groups' text of each text; the links of all as (row, pair), row by row.

        Nothing here refers to itself, so the collector has nothing to find in its many small lists.
        """
        gc.disable()
        try:
            return self._documents(texts)
        finally:
            gc.enable()

    def _documents(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        n = len(texts)
        cut = [self.units(t or "") for t in texts]
        if len(self.groups) > MOST_UNITS:
            self._forget()
        seen = self.at
        new = {u: None for row in cut for u in row if u not in seen}
        # Long units come last and go again, so they are never kept.
        self._learn([u for u in new if len(u) <= MOST_KEPT_CHARS])
        kept, long = len(self.groups), [u for u in new if len(u) > MOST_KEPT_CHARS]
        self._learn(long)
        sizes = np.array([len(row) for row in cut], np.int64)
        places = list(map(seen.__getitem__, chain.from_iterable(cut)))
        at, of = np.array(places, np.int64), np.repeat(np.arange(n), sizes)
        self.used += np.bincount(at, minlength=len(self.used))
        lost = np.zeros(n, bool)
        lost[of[self.numbers[at, 2] < 0]] = True
        ends = np.cumsum(sizes).tolist()
        said = ["" if gone else ";".join(map(self.groups.__getitem__, places[lo:hi])) for gone, lo, hi in zip(lost.tolist(), [0, *ends[:-1]], ends, strict=True)]
        keep = ~lost[of]
        at, of = at[keep], of[keep]
        pairs, counts = self.links.of(at)
        numbers = np.stack([np.bincount(of, w, n).astype(np.int64) for w in (*self.numbers[at].T, counts)], 1)
        for u in long:
            del seen[u]
        del self.groups[kept:]
        self.links.cut(kept)
        self.numbers, self.used = self.numbers[:kept], self.used[:kept]
        return numbers, said, np.repeat(of, counts), pairs

    def _say(self, ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, ends: np.ndarray) -> list[str]:
        """Each unit's groups, up to its end in tokens of both: a group's first ids, then its second ones."""
        codes = np.empty(len(ids_a) + len(ids_b), np.int64)
        for side, ids, cuts, others, shift in ((0, ids_a, cuts_a, cuts_b, 1), (1, ids_b, cuts_b, cuts_a, 0)):
            last = np.zeros(len(ids), np.int64)
            last[cuts] = 1
            group = np.cumsum(last) - last
            # Of the other side all earlier groups stand before; before second ids also their own group's first ones.
            before = np.concatenate(([0], others + 1))[group + 1 - shift]
            codes[np.arange(len(ids)) + before] = 2 * (ids + side * len(self.bytes_a)) + last
        said, ends = list(map(self.said.__getitem__, codes.tolist())), ends.tolist()
        return ["".join(said[lo:hi])[:-1] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


_LOADED: dict[str, Pair] = {}


def _loaded(first: str, second: bytes) -> Pair:
    """One per worker process and pair of vocabularies."""
    key = hashlib.md5(first.encode() + second).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Pair(first, second)
    return _LOADED[key]


def read_files(first: str, second: str) -> tuple[str, bytes]:
    with open(first, encoding="utf-8") as f, open(second, "rb") as g:
        return f.read(), g.read()


def _distinct(rows: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, pair and number of times of each row's distinct pairs, row by row."""
    key, times = np.unique(rows.astype(np.uint64) << np.uint64(32) | pairs, return_counts=True)
    return (key >> np.uint64(32)).astype(np.int64), (key & np.uint64(0xFFFFFFFF)).astype(np.int64), times


def aligned(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times): every text's distinct id pairs a << 16 | b, in 32 bits."""
    sent = docs.sparkSession.sparkContext.broadcast(read_files(first, second))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = _loaded(*sent.value)
        for b in batches:
            for lo, hi, _, _ in tb.slices(b.column(1)):
                numbers, groups, rows, pairs = both.documents(b.column(1).slice(lo, hi - lo).to_pylist())
                row, pair, times = _distinct(rows, pairs)
                cut = np.searchsorted(row, np.arange(hi - lo + 1)).astype(np.int32)
                as_list = [pa.ListArray.from_arrays(pa.array(cut), pa.array(x)) for x in (pair.astype(np.uint32).view(np.int32), times.astype(np.int32))]
                sha = pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups], pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(numbers[:, k]) for k in range(4)), sha, *as_list], names=["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    got = tb.in_batches(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<int>, times array<int>")
    return got.select(F.monotonically_increasing_id().alias("row"), "*")


def pair_counts(found: DataFrame) -> DataFrame:
    """(pair, n, best): documents that hold each pair, and whether no pair of its first id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def counted() -> pa.RecordBatch:
            pair, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair.view(np.uint32).astype(np.int64)), pa.array(n)], names=["pair", "n"])

        for b in batches:
            # A row's pairs are distinct already.
            held.append(b.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > COUNTED:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    n = tb.in_batches(found.select("pairs"), run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    n = n.withColumn("a", F.shiftright("pair", 16))
    most = n.groupBy("a").agg(F.max("n").alias("most"))
    return n.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def figures(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    found = stored(aligned(docs, first, second, id_col, text_col), "aligned")
    counts = stored(pair_counts(found), "pair-counts")
    hot = counts.orderBy(F.col("n").desc(), "pair").limit(HOT_PAIRS).toArrow().sort_by("pair")
    sent = docs.sparkSession.sparkContext.broadcast(tuple(hot.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, best = sent.value
        for b in batches:
            flat, times = b.column(1).flatten().to_numpy().view(np.uint32).astype(np.int64), b.column(2).flatten().to_numpy().astype(np.int64)
            of = np.repeat(np.arange(b.num_rows), np.diff(b.column(1).offsets.to_numpy()))
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                hit = known[at] == flat
                t, a = times[hit], at[hit]
                sums = [np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)]
                np.add.at(sums[0], of[hit], t * best[a])
                np.add.at(sums[1], of[hit], t * n[a])
                yield pa.RecordBatch.from_arrays([b.column(0), pa.nulls(b.num_rows, pa.int64()), pa.array(sums[0]), pa.array(sums[1])], names=["row", "pair", "n_best", "count_sum"])
                flat, times, of = flat[~hit], times[~hit], of[~hit]
            if len(flat):
                # Other pairs: times for their join in n_best.
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), pa.array(flat), pa.array(times), pa.nulls(len(flat), pa.int64())], names=["row", "pair", "n_best", "count_sum"])

    split = tb.in_batches(found.select("row", "pairs", "times"), run, "row long, pair long, n_best long, count_sum long")
    known = split.where("pair is null").select("row", "n_best", "count_sum")
    rest = split.where("pair is not null").join(counts, "pair").select("row", F.when(F.col("best"), F.col("n_best")).otherwise(0).alias("n_best"), (F.col("n_best") * F.col("n")).alias("count_sum"))
    shown = ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    own = found.select("row", *shown)
    sums = known.unionByName(rest).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    total = own.join(sums, "row", "left")
    return total.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")
