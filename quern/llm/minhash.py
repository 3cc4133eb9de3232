"""MinHash near-duplicates: many universal hash minima, banding, verification, components.

Each distinct set of word n-grams gets ``BANDS * ROWS`` minima under multiply-add
hashes, each band's minima a key, and the minima's low bytes a signature.  Two
sets of similarity t share a band with probability 1 - (1 - t^ROWS)^BANDS (all
but 1.6e-9 at 0.8).

The sets of a band are linked to its smallest one (a star, a row per set and
band), which finds nearly all; sets that the star leaves in different groups are
compared with each other in blocks, except those of the band's largest group among
themselves.  Signatures rule out what agrees in fewer than `least_equal` minima
(about seven standard deviations below the threshold's mean).  What stays is
confirmed on the full sets in the same two steps: the star's links first, then
all sets of one group that are not linked yet.  Links become components by
alternating large-star and small-star rounds.

So a group of copies costs a row per copy and band, and only sets that are near
each other without being linked are compared in pairs of blocks of at most
``BLOCK_ROWS`` sets or ``BLOCK_BYTES``.

Edge cases: null and empty texts have an empty set, link with nothing and are their
own component; a text with fewer words than n is one n-gram; exact copies of a set
collapse first (by 128 bits); rows with equal ids and different texts are linked
each on its own; null ids form links like others but give no component_id unless
linked to a non-null one; empty tables give empty results;
only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb
from quern.llm.components import components
from quern.llm.parity_join import ngrams, set_ids
from quern.llm.scratch import parts_for, stored

ROWS = 5
BANDS = 51
MINIMA = ROWS * BANDS
BLOCK_ROWS = 512
BLOCK_BYTES = 8 << 20
HASH_CHUNK = 1 << 15

_rng = np.random.Generator(np.random.PCG64(31))
_A = _rng.integers(0, 1 << 31, MINIMA, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _rng.integers(0, 1 << 32, MINIMA, dtype=np.uint32)
_BAND = _rng.integers(1, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class NearRule:
    """Two sets link when percent * union <= 100 * intersection; percent is 70 or more."""

    ngram: int = 5
    percent: int = 80

    def __post_init__(self) -> None:
        if not 70 <= self.percent <= 100:
            raise ValueError("percent must be from 70 to 100")

    @property
    def least_equal(self) -> int:
        """Equal minima of linked sets, seven standard deviations below their mean."""
        t = self.percent / 100
        return int(MINIMA * t - 7 * (MINIMA * t * (1 - t)) ** 0.5)


def minima(grams: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """(n, MINIMA) uint32 minima of each row's n-grams; rows without any are all ones."""
    out = np.full((n, MINIMA), 0xFFFFFFFF, np.uint32)
    x = (grams >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(x), HASH_CHUNK):
        part, of = x[lo : lo + HASH_CHUNK], rows[lo : lo + HASH_CHUNK]
        first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        at = of[first]
        for k in range(MINIMA):
            got = np.minimum.reduceat(part * _A[k] + _B[k], first)
            out[at, k] = np.minimum(out[at, k], got)
    return out


def band_keys(low: np.ndarray) -> np.ndarray:
    """(n, BANDS) keys: each band's minima and its number, hashed."""
    groups = low.reshape(len(low), BANDS, ROWS).astype(np.uint64)
    return tb.signed(tb.mix(tb.mix((tb.mix(groups + np.uint64(1)) * _BAND[None]).sum(2, dtype=np.uint64)) + np.arange(BANDS, dtype=np.uint64)[None]))


def _sets(docs: DataFrame, rule: NearRule) -> DataFrame:
    """(id, n, h1, h2, sig, keys, t1, t2) of every row of (id, text, t1, t2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                grams, rows = ngrams(buf, offs, rule.ngram)
                n, h1 = set_ids(grams, rows, hi - lo)
                _, h2 = set_ids(tb.mix(grams + np.uint64(77)), rows, hi - lo)
                # Copies inside a slice are hashed once.
                _, one, back = np.unique(h1, return_index=True, return_inverse=True)
                renumber = np.full(hi - lo, -1)
                renumber[one] = np.arange(len(one))
                pick = renumber[rows] >= 0
                of = renumber[rows[pick]]
                order = np.argsort(of, kind="stable")
                low = minima(grams[pick][order], of[order], len(one))
                keys = band_keys(low)[back]
                sig = (low & 0xFF).astype(np.uint8)[back]
                as_list = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n), pa.array(h1), pa.array(h2), pa.array([s.tobytes() for s in sig], pa.binary()), as_list, b.column(2).slice(lo, hi - lo), b.column(3).slice(lo, hi - lo)], names=["id", "n", "h1", "h2", "sig", "keys", "t1", "t2"])

    return tb.in_batches(docs, run, f"id {docs.schema[0].dataType.simpleString()}, n long, h1 long, h2 long, sig binary, keys array<long>, t1 long, t2 long")


def _linked(x: bytes, y: bytes, rule: NearRule) -> bool:
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    if 100 * min(len(a), len(b)) < rule.percent * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= rule.percent * (len(a) + len(b) - common)


def checked(pairs: DataFrame, sets: DataFrame, what: str, rule: NearRule) -> DataFrame:
    """The (u, v) of pairs that are near by `what`: the signatures, or the full sets (grams)."""
    side = sets.select("sid", "n", what)
    met = pairs.join(side.toDF("u", "n_u", "of_u"), "u").join(side.toDF("v", "n_v", "of_v"), "v")
    met = met.where((100 * F.least("n_u", "n_v") >= rule.percent * F.greatest("n_u", "n_v"))).select("u", "v", "of_u", "of_v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                x, y = part.column(2).to_pylist(), part.column(3).to_pylist()
                if what == "sig":
                    same = np.frombuffer(b"".join(x), np.uint8).reshape(-1, MINIMA) == np.frombuffer(b"".join(y), np.uint8).reshape(-1, MINIMA)
                    ok = same.sum(1) >= rule.least_equal
                else:
                    ok = np.array([_linked(p, q, rule) for p, q in zip(x, y, strict=True)], bool)
                if ok.any():
                    at = pa.array(np.flatnonzero(ok))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at)], names=["u", "v"])

    return tb.in_batches(met, run, "u long, v long")


def _block_links(left: list[tuple], right: list[tuple] | None, rule: NearRule) -> list[tuple[int, int]]:
    """Links that join up rows (comp, sid, n, sig[, grams]) of different comps, inside left or between both lists."""
    rows = left if right is None else left + right
    comps: dict[int, int] = {}
    lead: list[int] = []
    for x in rows:
        if x[0] not in comps:
            comps[x[0]] = len(lead)
            lead.append(comps[x[0]])
    of = np.array([comps[x[0]] for x in rows])
    sig = np.frombuffer(b"".join([x[3] for x in rows]), np.uint8).reshape(-1, MINIMA)
    size = np.array([x[2] for x in rows], np.int64)
    exact, out = len(rows[0]) > 4, []
    for i in range(len(left)):
        start = i + 1 if right is None else len(left)
        while True:
            # Groups that joined up are one number, so a row meets only others.
            rest = start + np.flatnonzero(of[start:] != of[i])
            rest = rest[100 * np.minimum(size[rest], size[i]) >= rule.percent * np.maximum(size[rest], size[i])]
            joined = False
            for lo in range(0, len(rest), 64):
                some = rest[lo : lo + 64]
                near = some[(sig[some] == sig[i]).sum(1) >= rule.least_equal]
                for j in near.tolist():
                    if of[j] != of[i] and (not exact or _linked(rows[i][4], rows[j][4], rule)):
                        out.append((rows[i][1], rows[j][1]))
                        of[of == of[j]] = of[i]
                        joined = True
                if joined:
                    start = int(some[-1]) + 1
                    break
            if not joined:
                break
    return out


def across(rows: DataFrame, rule: NearRule, weight, parts: int) -> DataFrame:
    """(u, v): links that join up sets of one key and different comps, from (key, comp, sid, n, sig[, grams]).

    A key's rows are cut into blocks, those of its largest comp apart from the
    rest; each pair of blocks that holds different comps is compared by one task.
    """
    held = rows.groupBy("key", "comp").agg(F.count("*").alias("c"), F.sum(weight).alias("w"))
    per_key = held.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("comps"), F.sum("c").alias("all"), F.max(F.struct("c", "comp"))["c"].alias("most"), F.sum("w").alias("bytes"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK_ROWS), F.ceil(F.col("bytes") * n / F.col("all") / BLOCK_BYTES)).cast("int")
    per_key = per_key.where("comps > 1").select("key", "main", blocks(F.col("most")).alias("b_main"), blocks(F.col("all") - F.col("most")).alias("b_rest"))
    named = rows.join(per_key, "key")
    is_main = F.col("comp") == F.col("main")
    own = F.when(is_main, F.pmod(F.xxhash64("sid"), F.col("b_main"))).otherwise(F.col("b_main") + F.pmod(F.xxhash64("sid"), F.col("b_rest"))).cast("int")
    named = named.withColumn("own", own)
    # The largest comp's blocks meet the others only.
    mates = F.sequence(F.when(is_main, F.col("b_main")).otherwise(F.lit(0)), F.col("b_main") + F.col("b_rest") - 1)
    dealt = named.select("*", F.explode(mates).alias("mate"))
    shown = ["comp", "sid", "n", "sig", *[c for c in rows.columns if c == "grams"]]
    dealt = dealt.select("key", F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"), (F.col("own") > F.col("mate")).alias("second"), *shown)
    dealt = dealt.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "second")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left, right = None, [], []

        def done() -> pa.RecordBatch | None:
            if not left or (now[1] != now[2] and not right):
                return None
            found = _block_links(left, None if now[1] == now[2] else right, rule)
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.int64()), pa.array([v for _, v in found], pa.int64())], names=["u", "v"]) if found else None

        for b in batches:
            for k in range(0, b.num_rows, 256):
                for key, i, j, second, *row in zip(*(c.to_pylist() for c in b.slice(k, 256).columns), strict=True):
                    if (key, i, j) != now:
                        if now is not None and (got := done()) is not None:
                            yield got
                        now, left, right = (key, i, j), [], []
                    (right if second else left).append(tuple(row))
        if now is not None and (got := done()) is not None:
            yield got

    return tb.in_batches(dealt, run, "u long, v long").distinct()


def _with_comp(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows with the component of their sid, or itself."""
    return rows.join(found.select(F.col("id").alias("sid"), "component"), "sid", "left").withColumn("comp", F.coalesce("component", "sid")).drop("component")


def _grams(texts: DataFrame, wanted: DataFrame, rule: NearRule) -> DataFrame:
    """(sid, comp, n, sig, grams) of the wanted sets, from their representatives' texts."""
    # What is wanted grows with the corpus: a merge join at every size, after which repeated rows lie together.
    met = texts.join(wanted.hint("merge"), ["t1", "t2"]).dropDuplicates(["t1", "t2"]).select("text", "sid", "comp", "n", "sig")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(0)):
                grams, rows = ngrams(buf, offs, rule.ngram)
                cut = np.searchsorted(rows, np.arange(hi - lo + 1))
                held = pa.array([grams[cut[i] : cut[i + 1]].tobytes() for i in range(hi - lo)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(b.column(k).slice(lo, hi - lo) for k in range(1, 5)), held], names=["sid", "comp", "n", "sig", "grams"])

    return tb.in_batches(met, run, "sid long, comp long, n long, sig binary, grams binary")


def near_components(docs: DataFrame, rule: NearRule = NearRule(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row."""
    parts = parts_for(docs)
    # A row is found again by 128 bits of its id and text, as ids may repeat or be null.
    i, t = F.col(id_col), F.col(text_col)
    texts = docs.select(i.alias("id"), t.alias("text"), F.xxhash64(F.lit(1), i, t).alias("t1"), F.xxhash64(F.lit(2), t, i).alias("t2"))
    rows = stored(_sets(texts, rule), "minima")
    one = rows.where("n > 0").groupBy("h1", "h2").agg(F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("keys").alias("keys"), F.min(F.struct("t1", "t2")).alias("t"))
    sets = stored(one.select(F.monotonically_increasing_id().alias("sid"), "*"), "sets")
    # Stars: each band's sets meet the smallest.
    keyed = sets.select("sid", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("sid").alias("lead"), F.count("*").alias("m")).where("m > 1")
    bands = stored(keyed.join(shared, "key").select("key", "sid", "lead", "m"), "bands")
    star = stored(checked(bands.where("sid <> lead").select(F.col("lead").alias("u"), F.col("sid").alias("v")).distinct(), sets, "sig", rule), "star")
    grouped = _with_comp(bands.where("m > 2 and sid <> lead").select("key", "sid"), components(star))
    open_ = grouped.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    loose = stored(grouped.join(open_, "key", "left_semi").join(sets.select("sid", "n", "sig"), "sid").select("key", "comp", "sid", "n", "sig"), "loose")
    likely = stored(star.unionByName(across(loose, rule, F.lit(MINIMA + 32), parts)).distinct(), "likely")
    # Confirmed on full sets: the links found, then what lies in one group and is not linked yet.
    near = components(likely)
    wanted = sets.select("sid", "n", "sig", "t.t1", "t.t2").join(near.toDF("sid", "comp"), "sid")
    full = stored(_grams(texts.select("t1", "t2", "text"), wanted, rule), "full")
    sure = stored(checked(likely, full, "grams", rule), "sure")
    parted = _with_comp(full.withColumnRenamed("comp", "key"), components(sure)).select("key", "comp", "sid", "n", "sig", "grams")
    found = components(sure.unionByName(across(parted, rule, F.length("grams") + MINIMA + 64, parts)))
    named = sets.select("h1", "h2", "sid").join(found.toDF("sid", "comp"), "sid")
    of_rows = rows.where("n > 0").groupBy("h1", "h2").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
    return _labels(rows, of_rows, named, id_col)


def _labels(rows: DataFrame, of_sets: DataFrame, named: DataFrame, id_col: str) -> DataFrame:
    """The smallest id of each row's component; sets that only one row has and nothing links keep their own."""
    label = of_sets.join(named.drop("sid"), ["h1", "h2"], "left").where("rows > 1 or comp is not null")
    least = label.where("comp is not null").groupBy("comp").agg(F.min("id").alias("least"))
    label = label.join(least, "comp", "left").select("h1", "h2", F.when(F.col("comp").isNull(), F.col("id")).otherwise(F.col("least")).alias("least"), F.lit(True).alias("found"))
    by_set = rows.where("n > 0").select("id", "n", "h1", "h2").join(label.hint("merge"), ["h1", "h2"], "left").select("id", "n", F.when(F.col("found"), F.col("least")).otherwise(F.col("id")).alias("component_id"))
    out = by_set.unionByName(rows.where("n = 0").select("id", "n", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
