"""Jaccard join of word n-gram sets by parity sketches.

A document's set of n-grams is XOR-hashed into a sketch of bits: each n-gram
flips one bit, so two sketches differ in at most as many bits as the sets differ
in n-grams.  Sets of similarity t and sizes a and b differ in at most
(a + b)(1 - t)/(1 + t) n-grams; with sizes cut into bands, all pairs of one band
level have one bound d.  The sketch is cut into d + 1 + q pieces, of which at
least q + 1 must be equal (pigeonhole).  As equal pieces hold the same n-grams,
each document may leave out its poorest pieces as long as these are at most q;
that keeps out pieces without any but common n-grams, which many unrelated texts
share, and loses no pair.

Sets that share a piece are chained, a row per set and piece and never a row per
pair; the connected groups so found hold every pair that can link.  Inside a group all pairs are compared in bounded
blocks: first by whole-sketch Hamming distances against d, which splits the group
up, then by exact set intersections for pairs not yet connected.  What comes out of a block is a
spanning forest of true links, which suffices for the components.

Exact copies of a set collapse to one before any comparison.  Sets are compared
by 64-bit n-gram hashes.

Edge cases: null and empty texts have an empty set, link with nothing and are
their own component; a text with fewer words than n is one n-gram; equal ids with
different texts are nodes of one document (their links add up); null ids form
links like others but give no component_id unless linked to a non-null one;
empty tables give empty results; only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb
from quern.llm.components import components
from quern.llm.scratch import parts_for, stored

SKETCH_BYTES = 1 << 20
BLOCK_ROWS = 1024
BATCH_ROWS = 256
BLOCK_BYTES = 8 << 20
COMMON_KEPT = 1 << 18
SETS_MET = 1 << 19


@dataclass(frozen=True)
class JaccardRule:
    """Two sets link when percent * union <= 100 * intersection; percent is 50 to 100."""

    ngram: int = 5
    percent: int = 80
    spare: float = 0.25

    def __post_init__(self) -> None:
        if not 50 <= self.percent <= 100:
            raise ValueError("percent must be from 50 to 100")

    def most_apart(self, total: int) -> int:
        """Largest symmetric difference of linked sets whose sizes add up to total."""
        return total * (100 - self.percent) // (100 + self.percent)


@lru_cache(4)
def bands(rule: JaccardRule) -> np.ndarray:
    """Lower borders of the size bands: linked sets lie in one band or two neighbours."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, -(-out[-1] * 100 // rule.percent)))
    return np.array(out, np.int64)


@lru_cache(4)
def pieces(rule: JaccardRule) -> tuple[np.ndarray, np.ndarray]:
    """For each level the number of pieces and how many of them may be left out."""
    top = np.append(bands(rule)[1:], 1 << 41) - 1
    need = np.array([rule.most_apart(2 * int(t)) + 1 for t in top], np.int64)
    spare = np.ceil(need * rule.spare).astype(np.int64)
    spare[need == 1] = 0
    return need + spare, spare


def ngrams(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes, ascending in each row, and their rows."""
    buf = tb.LOWER[buf]
    starts, ends, rows = tb.word_spans(buf, offs)
    words = tb.hash_spans(buf, starts, ends)
    count = np.bincount(rows, minlength=len(offs) - 1)
    grams = tb.windows(words, n)
    ok = tb.inside_rows(rows, n)
    grams, of = grams[ok], rows[: len(ok)][ok]
    # Short texts: the whole sequence is one n-gram, told apart by its length.
    few = np.flatnonzero((count > 0) & (count < n))
    if len(few):
        first = np.searchsorted(rows, few)
        short = np.zeros(len(few), np.uint64)
        for k in range(1, n):
            at = count[few] == k
            if at.any():
                short[at] = tb.windows(words, k)[first[at]]
        grams, of = np.concatenate((grams, short)), np.concatenate((of, few))
    order = np.argsort(grams)
    grams, of = grams[order], of[order]
    order = np.argsort(of.astype(np.uint16) if len(offs) < 65536 else of, kind="stable")
    grams, of = grams[order], of[order]
    new = np.ones(len(grams), bool)
    new[1:] = (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])
    return grams[new], of[new]


def _sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n, np.uint64)
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        out[rows[first]] = np.add.reduceat(values, first)
    return out


def set_ids(grams: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and 64-bit id of each row's set."""
    size = np.bincount(rows, minlength=n)
    return size, tb.signed(tb.mix(_sums(tb.mix(grams), rows, n) ^ tb.mix(size.astype(np.uint64))))


def piece_keys(grams: np.ndarray, rows: np.ndarray, size: np.ndarray, rule: JaccardRule, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, row) of the pieces that each set is joined on, at its own level and the next."""
    border = bands(rule)
    number, spare = pieces(rule)
    band = np.searchsorted(border, size, "right") - 1
    out: list[tuple[np.ndarray, np.ndarray]] = []
    has = size > 0
    # One hash bit of 2**32 in a piece, as a random word: their XOR is the piece's parity sketch.
    bit = tb.mix((grams & np.uint64(0xFFFFFFFF)) + np.uint64(0x51ED27))
    high = grams >> np.uint64(32)
    # A piece's worth is its number of n-grams that are not common ones.
    worth = np.ones(len(grams))
    if common is not None and len(common):
        worth[common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams] = 0
    for up in (0, 1):
        level = np.where(has, band + up, 0)
        m = np.where(has, number[level], 0)
        base = np.concatenate(([0], np.cumsum(m)))
        cell = ((high * m[rows].astype(np.uint64)) >> np.uint64(32)).astype(np.int64) + base[rows]
        total = int(base[-1])
        count = np.bincount(cell, minlength=total)
        rare = np.bincount(cell, worth, total).astype(np.int64)
        value = np.zeros(total, np.uint64)
        if len(cell):
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            value[cell[first]] = np.bitwise_xor.reduceat(bit, first)
        row = np.repeat(np.arange(len(size)), m)
        # The poorest pieces are left out while all of such a worth fit into the spare ones.
        least = np.zeros(len(size), np.int64)
        gone = np.zeros(len(size), np.int64)
        open_ = has.copy()
        for c in range(12):
            gone = gone + np.bincount(row[rare == c], minlength=len(size))
            open_ &= gone <= spare[level]
            if not open_.any():
                break
            least[open_] = c + 1
        keep = rare >= least[row]
        piece = np.arange(total) - base[row]
        key = tb.mix(value ^ tb.mix((level[row] * (1 << 40) + piece * 64 + np.minimum(count, 63)).astype(np.uint64)))
        out.append((key[keep], row[keep]))
    return np.concatenate([k for k, _ in out]), np.concatenate([r for _, r in out])


def _sketches(grams: np.ndarray, rows: np.ndarray, n: int) -> list[bytes]:
    """Whole-set parity sketches, of the first power of two bits that is no less than the set's size, 1024 at least."""
    size = np.bincount(rows, minlength=n)
    width = np.maximum(1024, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    base = np.concatenate(([0], np.cumsum(width)))
    place = base[rows] + (tb.mix(grams).view(np.int64) & (width[rows] - 1))
    odd = np.packbits((np.bincount(place, minlength=int(base[-1])) & 1).astype(np.uint8)).tobytes()
    return [odd[x // 8 : y // 8] for x, y in zip(base[:-1], base[1:], strict=True)]


def _by_width(rows: list[tuple]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and sketches of the rows of each sketch width, in 64-bit words."""
    places: dict[int, list[int]] = {}
    for i, x in enumerate(rows):
        places.setdefault(len(x[2]) // 8, []).append(i)
    return {w: (np.array(at), np.frombuffer(b"".join(rows[i][2] for i in at), np.uint64).reshape(-1, w)) for w, at in places.items()}


def _near(left: list[tuple], right: list[tuple], rule: JaccardRule) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(place in left, place in right, distance) of the pairs that the sketches do not rule out, in blocks.

    A sketch of twice the width folds onto a narrower one; sets whose widths are
    further apart differ too much in size to link.
    """
    a_n, b_n = (np.array([x[1] for x in rows], np.int64) for rows in (left, right))
    b_by = _by_width(right)
    for wa, (a_at, a) in _by_width(left).items():
        for wb, (b_at, b) in b_by.items():
            if max(wa, wb) > 2 * min(wa, wb):
                continue
            w = min(wa, wb)
            x, y = (m if m.shape[1] == w else m[:, :w] ^ m[:, w:] for m in (a, b))
            step = max(1, (1 << 22) // max(1, len(y) * w))
            for lo in range(0, len(x), step):
                apart = np.bitwise_count(x[lo : lo + step, None, :] ^ y[None, :, :]).sum(2, dtype=np.int64)
                both = a_n[a_at[lo : lo + step], None] + b_n[b_at][None, :]
                i, j = np.nonzero(apart * (100 + rule.percent) <= both * (100 - rule.percent))
                yield a_at[lo + i], b_at[j], apart[i, j]


def _sets(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """(id, n, sid, sketch, t1, t2) of every row of (id, text, t1, t2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                grams, rows = ngrams(buf, offs, rule.ngram)
                size, sid = set_ids(grams, rows, hi - lo)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(size), pa.array(sid), pa.array(_sketches(grams, rows, hi - lo), pa.binary()), b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo)], names=["id", "n", "sid", "sketch", "t1", "t2"])

    return tb.in_batches(docs, run, f"id {docs.schema[0].dataType.simpleString()}, n long, sid long, sketch binary, t1 long, t2 long")


def _common(docs: DataFrame, rule: JaccardRule, n_docs: int) -> np.ndarray:
    """The n-grams of boilerplate and much-copied passages, ascending: at most COMMON_KEPT of them.

    Each task counts all its n-grams and passes on those found in three or more
    of its documents.  The table only says which pieces are worth joining on;
    results are the same with any table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def found() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tb.signed(g[n >= 3])), pa.array(n[n >= 3])], names=["g", "n"])

        for b in batches:
            for _, _, buf, offs in tb.slices(b.column(1)):
                held.append(ngrams(buf, offs, rule.ngram)[0])
                size += len(held[-1])
                if size > 2_000_000:
                    yield found()
                    held, size = [], 0
        if size:
            yield found()

    counted = tb.in_batches(docs, run, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= max(8, n_docs // 4000))
    rows = counted.orderBy(F.col("n").desc(), "g").limit(COMMON_KEPT).select("g").toArrow()
    return np.sort(rows.column("g").to_numpy().view(np.uint64)) if rows.num_rows else np.zeros(0, np.uint64)


def _keys(docs: DataFrame, rule: JaccardRule, common: np.ndarray | None = None) -> DataFrame:
    """(key, sid) of every piece joined on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[int] = set()
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                grams, rows = ngrams(buf, offs, rule.ngram)
                size, sid = set_ids(grams, rows, hi - lo)
                # Copies give one set of rows a task, as far as it remembers the sets it has met.
                if len(met) > SETS_MET:
                    met.clear()
                _, one = np.unique(sid, return_index=True)
                one = np.array([i for i in one.tolist() if int(sid[i]) not in met], np.int64)
                met.update(sid[one].tolist())
                lone = np.zeros(hi - lo, bool)
                lone[one] = True
                pick = lone[rows]
                key, row = piece_keys(grams[pick], rows[pick], np.where(lone, size, 0), rule, common)
                yield pa.RecordBatch.from_arrays([pa.array(tb.signed(key)), pa.array(sid[row])], names=["key", "sid"])

    return tb.in_batches(docs, run, "key long, sid long")


def _chains(keys: DataFrame, parts: int) -> DataFrame:
    """(u, v): each set of a piece linked to the one before it, in order of set ids.

    A piece's rows are two numbers each and pass as a sorted stream, so even one
    that very many sets share takes no memory; a set has many pieces, so one
    piece holds a small share of all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key0, sid0 = None, None
        for b in batches:
            key, sid = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(key):
                continue
            same = (key[1:] == key[:-1]) & (sid[1:] != sid[:-1])
            u, v = sid[:-1][same], sid[1:][same]
            if key0 == key[0] and sid0 != sid[0]:
                u, v = np.append(u, sid0), np.append(v, sid[0])
            key0, sid0 = key[-1], sid[-1]
            pairs = np.unique(np.stack((u, v), 1), axis=0) if len(u) else np.zeros((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return tb.in_batches(keys.repartition(parts, "key").sortWithinPartitions("key", "sid"), run, "u long, v long").distinct()


def _members(docs: DataFrame, rule: JaccardRule) -> DataFrame:
    """(comp, blocks, sid, n, sketch, grams) of rows of (t1, text, want, comp, blocks) whose set is the wanted one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                grams, rows = ngrams(buf, offs, rule.ngram)
                size, sid = set_ids(grams, rows, hi - lo)
                sketch = _sketches(grams, rows, hi - lo)
                cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                ok = np.flatnonzero(sid == b.column(2).slice(lo, hi - lo).to_numpy())
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(3).slice(lo, hi - lo).take(pa.array(ok)),
                        b.column(4).slice(lo, hi - lo).take(pa.array(ok)),
                        pa.array(sid[ok]),
                        pa.array(size[ok]),
                        pa.array([sketch[i] for i in ok], pa.binary()),
                        pa.array([grams[cut[i] : cut[i + 1]].tobytes() for i in ok], pa.binary()),
                    ],
                    names=["comp", "blocks", "sid", "n", "sketch", "grams"],
                )

    return tb.in_batches(docs, run, "comp long, blocks int, sid long, n long, sketch binary, grams binary")


def _forest(left: list[tuple], right: list[tuple] | None, rule: JaccardRule) -> list[tuple[int, int]]:
    """True links that connect what is linked, inside `left` or between the two lists.

    Without n-grams in the rows: what the sketches do not rule out.
    """
    other = left if right is None else right
    lead = list(range(len(left) + (0 if right is None else len(right))))
    shift = 0 if right is None else len(left)

    def root(i: int) -> int:
        while lead[i] != i:
            lead[i] = lead[lead[i]]
            i = lead[i]
        return i

    exact = len(left[0]) > 3
    sets: dict[int, np.ndarray] = {}

    def grams(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = np.frombuffer((left[i] if i < len(left) else other[i - shift])[3], np.uint64)
        return sets[i]

    out = []
    for i, j, apart in _near(left, other, rule):
        if right is None:
            later = j > i
            i, j, apart = i[later], j[later], apart[later]
        order = np.argsort(apart, kind="stable")
        for p, q in zip(i[order].tolist(), (j[order] + shift).tolist(), strict=True):
            u, v = root(p), root(q)
            if u == v:
                continue
            if exact:
                x, y = grams(p), grams(q)
                common = len(np.intersect1d(x, y, assume_unique=True))
            if not exact or 100 * common >= rule.percent * (len(x) + len(y) - common):
                lead[u] = v
                out.append((left[p][0], (other[q - shift] if right is not None else left[q])[0]))
    return out


def links(members: DataFrame, rule: JaccardRule, parts: int) -> DataFrame:
    """(u, v): a spanning forest of the links among members of each comp, found in pairs of blocks.

    members are (comp, blocks, sid, n, sketch) and, for an exact check, grams.
    """
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    mate = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mate")
    dealt = members.withColumn("own", own).select("*", mate).select("comp", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"), (F.col("own") > F.col("mate")).alias("second"), *members.columns[2:])
    dealt = dealt.repartition(parts, "comp", "i", "j").sortWithinPartitions("comp", "i", "j", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right, seen = None, [], [], set()

        def done() -> pa.RecordBatch | None:
            if len(left) + len(right) < 2:
                return None
            inner = now[1] == now[2]
            if not inner and (not left or not right):
                return None
            found = _forest(left, None if inner else right, rule)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"]) if found else None

        for b in batches:
            parts = (b.slice(at, BATCH_ROWS) for at in range(0, b.num_rows, BATCH_ROWS))
            for comp, i, j, second, *rest in chain.from_iterable(zip(*(c.to_pylist() for c in p.columns), strict=True) for p in parts):
                if (comp, i, j) != now:
                    if now is not None and (got := done()) is not None:
                        yield got
                    now, left, right, seen = (comp, i, j), [], [], set()
                if (second, rest[0]) not in seen:  # repeated rows
                    seen.add((second, rest[0]))
                    (right if second else left).append(tuple(rest))
        if now is not None and (got := done()) is not None:
            yield got

    return tb.in_batches(dealt, run, "u long, v long")


def _in_blocks(members: DataFrame, blocks: Column) -> DataFrame:
    """Each member with the number of blocks of its comp."""
    return members.join(members.groupBy("comp").agg(blocks.cast("int").alias("blocks")), "comp")


def _tags(id_col: str, text_col: str) -> list[Column]:
    """t1 and t2: 128 bits of a row's id and text."""
    i, t = F.col(id_col), F.col(text_col)
    return [F.xxhash64(F.lit(1), i, t).alias("t1"), F.xxhash64(F.lit(2), t, i).alias("t2")]


def _labelled(docs: DataFrame, rule: JaccardRule, id_col: str, text_col: str) -> DataFrame:
    """(id, n, t1, t2, component_id) of every row."""
    parts = parts_for(docs)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # A row is found again by 128 bits of its id and text, as ids may repeat or be null.
    tagged = texts.select("id", "text", *_tags("id", "text"))
    sets = stored(_sets(tagged, rule), "sets")
    common = _common(texts, rule, sets.count())
    one = sets.where("n > 0").groupBy("sid").agg(F.min(F.struct("t1", "t2")).alias("t"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    near = components(_chains(_keys(texts, rule, common), parts)).toDF("sid", "comp")
    # Groups that share pieces fall apart where whole sketches rule the links out, before any set is shipped.
    asked = _in_blocks(stored(near.join(one, "sid"), "near"), F.ceil(F.sum(F.length("sketch") + 64) / SKETCH_BYTES))
    near = components(links(asked.select("comp", "blocks", "sid", "n", "sketch"), rule, parts)).toDF("sid", "comp")
    wanted = _in_blocks(stored(near.join(one.drop("sketch"), "sid"), "wanted"), F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum(F.col("n") * 8 + 160) / BLOCK_BYTES)))
    wanted = stored(wanted.select("t.t1", "t.t2", F.col("sid").alias("want"), "comp", "blocks"), "asked")
    # What is wanted grows with the corpus, so the plan is a merge join at every size.
    members = _members(tagged.select("t1", "t2", "text").join(wanted.hint("merge"), ["t1", "t2"]).select("t1", "text", "want", "comp", "blocks"), rule)
    found = components(links(members, rule, parts))
    # Nodes of the final graph are sets; each set's smallest document stands for it.
    label = sets.where("n > 0").groupBy("sid").agg(F.min("id").alias("id"), F.count("*").alias("rows")).join(found.select(F.col("id").alias("sid"), "component"), "sid", "left").where("rows > 1 or component is not null").withColumn("component", F.coalesce("component", "sid"))
    least = label.groupBy("component").agg(F.min("id").alias("component_id"))
    by_set = label.select("sid", "component").join(least, "component").select("sid", "component_id", F.lit(True).alias("found"))
    # A set that very many rows share: a merge join's large partitions are split.
    component = F.when((F.col("n") > 0) & F.col("found"), F.col("component_id")).otherwise(F.col("id"))
    return sets.join(by_set.hint("merge"), "sid", "left").select("id", "n", "t1", "t2", component.alias("component_id"))


def linked_components(docs: DataFrame, rule: JaccardRule = JaccardRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every document."""
    return _labelled(docs, rule, id_col, text_col).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, rule: JaccardRule = JaccardRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, of which each component keeps its smallest id, and repeated rows one.

    Null ids go where they are linked to a document with an id, and stay otherwise.
    """
    found = stored(_labelled(docs, rule, id_col, text_col), "labelled")
    key = ["t1", "t2"]
    gone = stored(found.where(~F.col("component_id").eqNullSafe(F.col("id"))).select(*key).distinct(), "gone")
    again = stored(found.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key), "again")
    # A row travels as one struct, so no column of it can clash with what is added.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_tags(id_col, text_col)).join(gone, key, "left_anti")
    single = rows.join(again, key, "left_anti")
    several = rows.join(again, key, "left_semi").dropDuplicates(key)
    return single.unionByName(several).select("row.*")
