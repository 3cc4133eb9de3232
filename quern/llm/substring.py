"""Substring deduplication by seed and extend.

Seeds are winnowed anchors: of the `seed`-word hashes inside a window of `window`
words the smallest is the window's anchor, so equal windows have equal anchors at
the same place.  Documents are joined on their anchors: every occurrence of an
anchor meets its first one, the leader, and gets the words around it.  The match
is extended both ways, word by word, and matches of at least `window` words are
repeats of earlier text.

An occurrence may differ from its leader and yet repeat a third document.  Windows
that stay unconfirmed are therefore seeds of a second round, each as a whole: they
are joined on the hash of the window with its first occurrence, and the words
compared again.  What both rounds confirm is every word with an earlier start;
touching and overlapping matches merge into maximal repeats.

Every occurrence meets one leader and never all others, so a passage in a third of
all documents costs a row for each of them.  Leaders are found by aggregations that
combine before the shuffle; in the joins a leader's side has one row a key, and
adaptive execution splits the other.  Words travel in pieces of BLOCK words with
enough on either side, each to a document once.  Texts are shuffled once,
compressed, and that exchange is reused.

Words are compared by 64-bit hashes, one by one.  "Earlier" is a smaller doc_id, or
an earlier start in the same document.

Edge cases: null text has no words; null ids come before all others, in order of a
hash of the text; equal rows are one document (both keep or lose the same words),
and different texts under one id are ordered by a hash of the text; documents below
`window` words lose nothing; empty tables give empty results; extra columns pass
through `cut` untouched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb
from quern.llm.scratch import parts_for, stored

#: Null ids become the least ids, by a hash of the text.
_NO_ID, _NULLS = -(1 << 63), 1 << 40
#: A place is a hash of the text, which tells apart different texts under one id, and PLACE_BITS of a word's number.
PLACE_BITS = 40
#: Leaders' words travel in pieces of so many bits of words.
BLOCK_BITS = 7


@dataclass(frozen=True)
class Repeats:
    """window: words of a repeat at least; seed: words of an anchor's hash."""

    window: int = 20
    seed: int = 6


def _sliding_argmin(g: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost minimum of each run of `width` values."""
    low, at, span = g, np.arange(len(g)), 1
    while span < width:
        step = min(span, width - span)
        n = len(low) - step
        left = low[:n] <= low[step:]
        at = np.where(left, at[:n], at[step:])
        low = np.where(left, low[:n], low[step:])
        span += step
    return at


def anchors(words: np.ndarray, rows: np.ndarray, rule: Repeats) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows inside a row, each one's anchor place, and all seed hashes."""
    if len(words) < rule.window:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    grams = tb.windows(words, rule.seed)
    place = _sliding_argmin(grams, rule.window - rule.seed + 1)
    starts = np.flatnonzero(tb.inside_rows(rows, rule.window))
    return starts, place[starts], grams


def _packed(docs: DataFrame) -> DataFrame:
    """The second column's texts, compressed one by one for the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                data = memoryview(np.ascontiguousarray(buf))
                part = b.slice(lo, hi - lo)
                yield part.set_column(1, "text", pa.array([press.compress(data[s:e]) for s, e in zip(offs[:-1], offs[1:], strict=True)], pa.binary()))

    # Where d is known not to be null, all joins on it read one and the same exchange.
    fields = [f"`{f.name}` {('long not null', 'binary')[k] if k < 2 else f.dataType.simpleString()}" for k, f in enumerate(docs.schema)]
    return tb.in_batches(docs, run, ", ".join(fields))


def _opened(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches of some rows with their texts decompressed."""
    press = zstandard.ZstdDecompressor()
    for whole in batches:
        for lo in range(0, whole.num_rows, rows):
            b = whole.slice(lo, rows)
            yield b.set_column(1, "text", pa.array([press.decompress(x) for x in b.column(1).to_pylist()], pa.large_binary()))


class Slice:
    """Rows lo to hi of a batch: bytes, words, and where each row's words begin."""

    def __init__(self, lo: int, hi: int, buf: np.ndarray, offs: np.ndarray) -> None:
        self.lo, self.hi, self.n, self.buf, self.offs = lo, hi, hi - lo, buf, offs
        self.starts, self.ends, self.rows = tb.word_spans(buf, offs)
        self.first = np.searchsorted(self.rows, np.arange(self.n + 1))
        self.text = (tb.hash_spans(buf, offs[:-1], offs[1:]) >> np.uint64(49)).astype(np.int64) << PLACE_BITS

    @cached_property
    def words(self) -> np.ndarray:
        return tb.hash_spans(self.buf, self.starts, self.ends)

    def place(self, at: np.ndarray) -> np.ndarray:
        """The places of words, by their numbers in the slice."""
        return self.text[self.rows[at]] + at - self.first[self.rows[at]]


def _slices(texts: pa.Array) -> Iterator[Slice]:
    return (Slice(*x) for x in tb.slices(texts))


def _flat(column: pa.Array, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Values and row numbers of a list column's rows lo to hi."""
    part = column.slice(lo, hi - lo)
    size = part.value_lengths().fill_null(0).to_numpy()
    return part.flatten().to_numpy(), np.repeat(np.arange(hi - lo), size)


def _fields(column: pa.Array, lo: int, hi: int) -> tuple[list, np.ndarray]:
    """Fields and row numbers of the structs in a list column's rows lo to hi; binary ones as lists of bytes."""
    part = column.slice(lo, hi - lo)
    size = part.value_lengths().fill_null(0).to_numpy()
    return [x.to_pylist() if pa.types.is_binary(x.type) else x.to_numpy() for x in part.flatten().flatten()], np.repeat(np.arange(hi - lo), size)


def _dealt(pairs: DataFrame, name: str) -> DataFrame:
    """(d, name): a document's (at, d0, at0), each once."""
    return pairs.groupBy("d").agg(F.collect_set(F.struct("at", "d0", "at0")).alias(name))


def _mixed(values: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Values told apart by row."""
    return tb.mix(values.astype(np.uint64) * np.uint64(3) + rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _found(keys: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the asked are among the keys, and the key's place for these."""
    order = np.argsort(keys, kind="stable")
    if not len(keys):
        return np.zeros(len(asked), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys[order], asked), len(keys) - 1)
    hit = keys[order][at] == asked
    return hit, order[at[hit]]


def _occurrences(keys: np.ndarray, at: np.ndarray, of: Slice, ids: pa.Array, names: list[str]) -> pa.RecordBatch:
    """(key, d, at, n): each key of a document once, at its first place, with how often it occurs."""
    row = of.rows[at]
    _, one, times = np.unique(_mixed(keys, row), return_index=True, return_counts=True)
    row, at = row[one], at[one]
    return pa.RecordBatch.from_arrays([pa.array(tb.signed(keys[one])), pa.array(ids.to_numpy()[row]), pa.array(of.place(at)), pa.array(times)], names=names)


def _anchor_rows(docs: DataFrame, rule: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for of in _slices(b.column(1)):
                starts, place, grams = anchors(of.words, of.rows, rule)
                if len(starts):
                    at = np.unique(place)
                    yield _occurrences(grams[at], at, of, b.column(0).slice(of.lo, of.n), ["h", "d", "at", "n"])

    return tb.in_batches(docs, run, "h long not null, d long not null, at long not null, n long not null")


def _led(occurrences: DataFrame) -> DataFrame:
    """(d, at, d0, at0): occurrences of keys (h, d, at, n) that occur again, with the key's first one."""
    first = occurrences.groupBy("h").agg(F.sum("n").alias("all"), F.min(F.struct("d", "at")).alias("m")).where("all > 1")
    # A key of its own gives the join exchanges of its own, whose large partitions can be split.
    own = F.col("h").bitwiseXOR(F.lit(-1)).alias("g")
    first = first.select(own, F.col("m.d").alias("d0"), F.col("m.at").alias("at0"))
    met = occurrences.select(own, "d", "at", "n").join(first.hint("merge"), "g")
    return met.where("n > 1 or d <> d0 or at <> at0").select("d", "at", "d0", "at0")


def _pieces(texts: DataFrame, seeds: DataFrame, name: str, rule: Repeats) -> DataFrame:
    """(d, name): for each document with seeds, the pieces (d0, s, words) of the leaders' texts."""
    column = seeds.columns[1]
    asked = seeds.select("d", F.explode(F.array_distinct(F.transform(column, lambda x: F.struct(x["d0"].alias("d0"), F.shiftright(x["at0"], BLOCK_BITS).alias("s"))))).alias("p")).select("d", "p.d0", "p.s")
    wanted = asked.groupBy("d0").agg(F.collect_set("s").alias("wanted")).withColumnRenamed("d0", "d")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for b in _opened(batches):
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                of = Slice(lo, hi, buf, offs)
                segment, row = _flat(b.column(b.num_columns - 1), lo, hi)
                mine = (segment >> (PLACE_BITS - BLOCK_BITS)) == (of.text[row] >> PLACE_BITS)
                segment, row = segment[mine], row[mine]
                at = ((segment << BLOCK_BITS) - of.text[row]).clip(0)
                first, last = of.first[row], of.first[row + 1]
                begin, end = np.maximum(first + at - (rule.window - rule.seed), first), np.minimum(first + at + (1 << BLOCK_BITS) + rule.window, last)
                some = np.flatnonzero(begin < end)
                data = memoryview(np.ascontiguousarray(buf))
                ids = b.column(0).slice(lo, hi - lo).to_numpy()
                words = [press.compress(data[of.starts[i] : of.ends[j - 1]]) for i, j in zip(begin[some], end[some], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row[some]]), pa.array(segment[some]), pa.array(words, pa.binary())], names=["d0", "s", "words"])

    own = F.xxhash64("d0", "s").alias("g")
    # Equal rows give equal pieces, of which one goes on.
    cut = tb.in_batches(texts.join(wanted, "d"), run, "d0 long not null, s long not null, words binary").groupBy("d0", "s").agg(F.min("words").alias("words"))
    sent = asked.select("d", "d0", "s", own).join(cut.select("d0", "s", own, "words").hint("merge"), ["g", "d0", "s"])
    return sent.groupBy("d").agg(F.collect_list(F.struct("d0", "s", "words")).alias(name))


class _Leaders:
    """The seeds of a slice's documents and the leaders' words that came with them."""

    def __init__(self, of: Slice, seeds: pa.Array, pieces: pa.Array, rule: Repeats) -> None:
        self.of, self.rule = of, rule
        (self.at, self.d0, self.at0), self.row = _fields(seeds, of.lo, of.hi)
        mine = (self.at >> PLACE_BITS) == (of.text[self.row] >> PLACE_BITS)
        self.at, self.d0, self.at0, self.row = self.at[mine], self.d0[mine], self.at0[mine], self.row[mine]
        (d0, s, words), row = _fields(pieces, of.lo, of.hi)
        press = zstandard.ZstdDecompressor()
        texts = [press.decompress(x) for x in words]
        buf = np.frombuffer(b"".join(texts), np.uint8)
        starts, ends, piece = tb.word_spans(buf, np.concatenate(([0], np.cumsum([len(x) for x in texts], dtype=np.int64))))
        self.words = tb.hash_spans(buf, starts, ends)
        self.cut = np.searchsorted(piece, np.arange(len(texts) + 1))
        # The place in the leader's document of a piece's first word.
        low = (s << BLOCK_BITS) & ((1 << PLACE_BITS) - 1)
        self.base = (s << BLOCK_BITS) - low + np.maximum(low - (rule.window - rule.seed), 0) if len(s) else s
        self.piece_keys = _mixed(s ^ tb.signed(tb.mix(d0.astype(np.uint64))), row) if len(s) else np.zeros(0, np.uint64)

    def meet(self, keys: np.ndarray, at: np.ndarray, own: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of places `at` with `keys`: those that have an earlier leader, its piece, the place's counterpart there; and whether each has one.

        own are the keys of all places of the slice, by which seeds are told.
        """
        seed = _mixed(own[self.of.first[self.row] + (self.at - self.of.text[self.row])], self.row)
        hit, k = _found(seed, _mixed(keys, self.of.rows[at]))
        row = self.of.rows[at[hit]]
        later = (self.d0[k] != ids[row]) | (self.at0[k] != self.of.place(at[hit]))
        led = np.zeros(len(at), bool)
        led[np.flatnonzero(hit)[later]] = True
        k, row = k[later], row[later]
        ask = (self.at0[k] >> BLOCK_BITS) ^ tb.signed(tb.mix(self.d0[k].astype(np.uint64)))
        there, piece = _found(self.piece_keys, _mixed(ask, row))
        return at[led][there], piece, self.at0[k][there] - self.base[piece] + self.cut[piece], led

    def equal(self, at: np.ndarray, piece: np.ndarray, other: np.ndarray, before: int, after: int) -> np.ndarray:
        """Which of the words from `before` to `after` around each place are those around its counterpart."""
        out = np.zeros((len(at), before + after), bool)
        first, last = self.of.first[self.of.rows[at]], self.of.first[self.of.rows[at] + 1]
        low, high = self.cut[piece], self.cut[piece + 1]
        for col, step in enumerate(range(-before, after)):
            x, y = at + step, other + step
            inside = np.flatnonzero((x >= first) & (x < last) & (y >= low) & (y < high))
            out[inside, col] = self.of.words[x[inside]] == self.words[y[inside]]
        return out


def _extended(of: Slice, ids: np.ndarray, seeds: pa.Array, pieces: pa.Array, rule: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the starts of repeats that the anchors' leaders confirm; starts of windows with a leader that they do not."""
    starts, place, grams = anchors(of.words, of.rows, rule)
    flags = np.zeros(len(of.words), bool)
    if not len(starts):
        return flags, starts
    leaders, side = _Leaders(of, seeds, pieces, rule), rule.window - rule.seed
    every = np.unique(place)
    at, piece, other, led = leaders.meet(grams[every], every, grams, ids)
    same = leaders.equal(at, piece, other, side, rule.window)
    left = np.minimum.accumulate(same[:, :side][:, ::-1], axis=1).sum(1)
    right = np.minimum.accumulate(same[:, side + rule.seed :], axis=1).sum(1)
    whole = same[:, side : side + rule.seed].all(1) & (left + right >= side)
    begin, number = (at - left)[whole], (left + right - side + 1)[whole]
    delta = np.zeros(len(flags) + 1, np.int64)
    np.add.at(delta, begin, 1)
    np.add.at(delta, begin + number, -1)
    flags = np.cumsum(delta[:-1]) > 0
    return flags, starts[led[np.searchsorted(every, place)] & ~flags[starts]]


def _unsettled_rows(found: DataFrame, rule: Repeats) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _opened(batches):
            for of in _slices(b.column(1)):
                ids = b.column(0).slice(of.lo, of.n)
                _, open_ = _extended(of, ids.to_numpy(), b.column(b.num_columns - 2), b.column(b.num_columns - 1), rule)
                if len(open_):
                    yield _occurrences(tb.windows(of.words, rule.window)[open_], open_, of, ids, ["h", "d", "at", "n"])

    return tb.in_batches(found, run, "h long not null, d long not null, at long not null, n long not null")


def marked(docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text", others: tuple[str, ...] = ()) -> DataFrame:
    """(d, text, others..., seeds, pieces, seeds2, pieces2): each compressed text with what its document needs to find its repeats.

    seeds: anchors with their leaders; pieces: the leaders' words; both again for
    the windows that the first round leaves open.
    """
    null = F.lit(_NO_ID) + F.xxhash64(text_col).bitwiseAND(F.lit(_NULLS - 1))
    own = F.coalesce(F.col(id_col).cast("long"), null)
    texts = _packed(docs.select(own.alias("d"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(others)))).repartition(parts_for(docs), "d")
    seeds = _dealt(stored(_led(_anchor_rows(docs.select(own.alias("d"), F.col(text_col).alias("text")), rule)), "seeds"), "seeds")
    pieces = _pieces(texts, seeds, "pieces", rule)
    seeds2 = _dealt(_led(_unsettled_rows(texts.join(seeds, "d").join(pieces, "d"), rule)), "seeds2")
    pieces2 = _pieces(texts, seeds2, "pieces2", rule)
    return texts.join(seeds, "d", "left").join(pieces, "d", "left").join(seeds2, "d", "left").join(pieces2, "d", "left")


def removals(b: pa.RecordBatch, rule: Repeats) -> Iterator[tuple[Slice, np.ndarray]]:
    """Slices of a batch of `marked` rows, with the flags of the words to remove."""
    at = b.num_columns - 4
    for of in _slices(b.column(1)):
        ids = b.column(0).slice(of.lo, of.n).to_numpy()
        flags, open_ = _extended(of, ids, b.column(at), b.column(at + 1), rule)
        if len(open_):
            leaders = _Leaders(of, b.column(at + 2), b.column(at + 3), rule)
            windows = tb.windows(of.words, rule.window)
            begin, piece, other, _ = leaders.meet(windows[open_], open_, windows, ids)
            flags[begin[leaders.equal(begin, piece, other, 0, rule.window).all(1)]] = True
        yield of, tb.covered(len(of.words), np.flatnonzero(flags), rule.window)


def _joined(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep: np.ndarray, first: np.ndarray) -> list[bytes]:
    """The kept words of each row, joined by one space."""
    lens = np.where(keep, ends - starts + 1, 0)
    total = np.concatenate(([0], np.cumsum(lens)))
    kept = np.flatnonzero(keep)
    part = lens[kept]
    at = np.arange(int(part.sum())) - np.repeat(total[:-1][kept], part)
    src = at + np.repeat(starts[kept], part)
    out = buf[np.minimum(src, len(buf) - 1)] if len(buf) else np.zeros(0, np.uint8)
    out = np.where(at == np.repeat(part - 1, part), np.uint8(32), out).astype(np.uint8).tobytes()
    cut = total[first]
    return [out[a : max(a, z - 1)] for a, z in zip(cut[:-1], cut[1:], strict=True)]


def digests(docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _opened(batches):
            for of, gone in removals(b, rule):
                ids = b.column(0).slice(of.lo, of.n).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, mask=ids < _NO_ID + _NULLS),
                        pa.array(np.bincount(of.rows, minlength=of.n)),
                        pa.array(np.bincount(of.rows[gone], minlength=of.n)),
                        pa.array([hashlib.sha256(x).hexdigest() for x in _joined(of.buf, of.starts, of.ends, ~gone, of.first)]),
                    ],
                    names=[id_col, "n_words", "n_removed", "kept_sha256"],
                )

    return tb.in_batches(marked(docs, rule, id_col, text_col), run, f"{id_col} long, n_words long, n_removed long, kept_sha256 string")


def maximal_repeats(docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, first_word, n_words, text): the maximal runs of words to remove."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _opened(batches):
            for of, gone in removals(b, rule):
                begin, end = tb.runs(gone, of.first)
                row = of.rows[begin]
                ids = b.column(0).slice(of.lo, of.n).to_numpy()[row]
                data = of.buf.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids < _NO_ID + _NULLS), pa.array(begin - of.first[row]), pa.array(end - begin), pa.array([data[of.starts[i] : of.ends[j - 1]].decode() for i, j in zip(begin, end, strict=True)], pa.string())], names=[id_col, "first_word", "n_words", "text"])

    return tb.in_batches(marked(docs, rule, id_col, text_col), run, f"{id_col} long, first_word long, n_words long, text string")


def cut(docs: DataFrame, rule: Repeats = Repeats(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, without the repeats: each run of removed words goes with the space after it."""
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    names = [id_col if c == "d" else text_col if c == "text" else others[int(c[1:])] for c in ("d", "text", *(f"_{i}" for i in range(len(others))))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _opened(batches):
            for of, gone in removals(b, rule):
                begin, end = tb.runs(gone, of.first)
                texts = [x.decode() for x in b.column(1).slice(of.lo, of.n).to_pylist()]
                data, rows, first, starts, ends, offs = of.buf.tobytes(), of.rows, of.first, of.starts, of.ends, of.offs
                for row in np.unique(rows[begin]):
                    a, z = np.searchsorted(rows[begin], (row, row + 1))
                    pieces, at = [], offs[row]
                    for i, j in zip(begin[a:z], end[a:z], strict=True):
                        pieces.append(data[at : starts[i]])
                        at = starts[j] if j < first[row + 1] else ends[j - 1]
                    pieces.append(data[at : offs[row + 1]])
                    texts[row] = b"".join(pieces).decode()
                ids = b.column(0).slice(of.lo, of.n).to_numpy()
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids < _NO_ID + _NULLS), pa.array(texts, pa.string()), *(b.column(2 + i).slice(of.lo, of.n) for i in range(len(others)))], names=names)

    done = marked(docs, rule, id_col, text_col, others)
    shape = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString() if n != id_col else 'long'}" for n in names)
    return tb.in_batches(done, run, shape).select(*docs.columns)
