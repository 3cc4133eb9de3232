"""Document fingerprints by randomised edit embedding.

All texts share one random walk: at step j the walk stands on a character and,
by a random bit for (step, character), stays or moves on.  The characters it
stands on are the embedding.  Texts at a small edit distance fall into step
again soon after each edit, so the edit distance becomes a Hamming distance.

A fingerprint samples the embedding at SLOTS steps, drawn consistently: the
step of a slot is the last record of a random sequence within the walk's
length, so it is uniform over the walk and mostly the same for texts of nearly
equal length.  Two fingerprints' likeness is the share of equal slots, corrected
for chance.  Near copies are texts whose likeness on any of WALKS independent
walks reaches a cut.  Candidates share a band of sampled slots of a walk; all
distinct texts of a band are compared, in blocks of about BLOCK_ROWS.

Edge cases: null text reads as empty and has the all-zero fingerprint; equal
texts have equal fingerprints, and two empty texts are alike (1.0); equal ids
stand in the order of their texts' first HEAD bytes, then of a hash; equal rows
are each other's neighbours; an empty table gives an empty result.  Only id and text are read, so extra columns
cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb
from quern.llm.components import components
from quern.llm.scratch import parts_for, stored

SLOTS = 128
BANDS, BAND_SLOTS = 16, 8
WALKS = 3
BLOCK_ROWS = 1024
HEAD = 32
PERIOD = 4096
BLOCK_CHARS = 6 << 20
#: Without an edited form beside each text, a block may hold nearly twice as much.
PLAIN_CHARS = 10 << 20
_STEPS = 128

_rng = np.random.Generator(np.random.PCG64(99))
_MOVE = _rng.integers(0, 2, (PERIOD, 256), dtype=np.uint8)


def _records() -> np.ndarray:
    """For each slot the steps at which a new minimum of its sequence appears."""
    rows = []
    for _ in range(SLOTS):
        at, row = 1, []
        while at < 1 << 40:
            row.append(at)
            at = int(at / max(_rng.random(), 1e-12)) + 1
        rows.append(row)
    most = max(map(len, rows))
    return np.array([r + [1 << 62] * (most - len(r)) for r in rows], np.int64)


_RECORDS = _records()
#: The bits of each walk; the first walk's are those of the fingerprint column.
_MOVES = np.stack([_MOVE, *(np.random.Generator(np.random.PCG64(99 + k)).integers(0, 2, (PERIOD, 256), dtype=np.uint8) for k in range(1, WALKS))])


def fingerprints(texts: list[np.ndarray], move: np.ndarray = _MOVE) -> np.ndarray:
    """uint8 slots of each text, given as code points, a walk's beside the next's; 0 only where a text has no character.

    `move` holds the bits of one walk, or of several in its first dimension.  All
    walks of all texts take each step together: a step costs little more for
    several walks than for one where few long texts are left.
    """
    moves = move.reshape(-1, PERIOD, 256)
    walks = len(moves)
    out = np.zeros((len(texts), walks * SLOTS), np.uint8)
    lens = np.array([len(t) for t in texts], np.int64)
    order = np.argsort(-lens, kind="stable")
    order = order[lens[order] > 0]
    if not len(order):
        return out
    flat = np.concatenate([texts[i] for i in order])
    code = (((flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint16)
    size = lens[order]
    base = np.concatenate(([0], np.cumsum(size)[:-1]))
    # The steps to sample, by row and slot, in order of the step.
    length = 2 * size
    pick = np.empty((len(order), SLOTS), np.int64)
    for s in range(SLOTS):
        pick[:, s] = _RECORDS[s][np.searchsorted(_RECORDS[s], length, "right") - 1]
    by_step = np.argsort(pick, axis=None, kind="stable")
    steps = pick.ravel()[by_step]
    got = np.zeros((walks, len(order) * SLOTS), np.uint8)

    # A text's walks stand side by side, so those still under way are the first ones.
    at = np.repeat(base, walks)
    end = np.repeat(base + size - 1, walks)
    row_of_walk = np.tile(np.arange(walks, dtype=np.uint16) * np.uint16(256), len(order))
    table = np.ascontiguousarray(moves.transpose(1, 0, 2).reshape(PERIOD, walks * 256).astype(np.int64))
    log = np.empty((_STEPS, walks * len(order)), np.int64)
    here, by = np.empty(len(at), np.uint16), np.empty(len(at), np.int64)
    first = 0
    reach = -length  # ascending, as the rows' lengths descend
    for block in range(0, int(length[0]) + 1, _STEPS):
        active = walks * int(np.searchsorted(reach, -block, "right"))
        if not active:
            break
        pos, stop, shift, c, m = at[:active], end[:active], row_of_walk[:active], here[:active], by[:active]
        for j in range(_STEPS):
            log[j, :active] = pos
            code.take(pos, out=c, mode="clip")
            if walks > 1:
                np.add(c, shift, out=c)
            table[(block + j) % PERIOD].take(c, out=m, mode="clip")
            np.add(pos, m, out=pos)
            np.minimum(pos, stop, out=pos)
        upto = int(np.searchsorted(steps, block + _STEPS))
        cell = by_step[first:upto]
        for w in range(walks):
            got[w, cell] = (flat[log[steps[first:upto] - block, cell // SLOTS * walks + w]] % 251 + 1).astype(np.uint8)
        first = upto
    out[order] = got.reshape(walks, -1, SLOTS).transpose(1, 0, 2).reshape(len(order), -1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal slots beyond chance (one in twelve, about that of letters), 0 to 1."""
    same = (a == b).mean(1)
    return np.clip((same - 1 / 12) / (1 - 1 / 12), 0, 1)


def walks_likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The best likeness of any walk, of fingerprints with the walks side by side."""
    return np.max([likeness(a[:, k : k + SLOTS], b[:, k : k + SLOTS]) for k in range(0, b.shape[1], SLOTS)], 0)


def text_key(text: bytes) -> int:
    """64 bits by which equal texts meet."""
    return int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of (bucket, tail, id, head, text_key, packed): a bucket holds a range of ids and, as its tail, the first of the next.

    head is the text's first bytes, packed the whole text, compressed for the
    shuffle.  Borders are found from the ids alone, as the smallest id of each part of a
    range partitioning, so the driver sees one id per part.  Each row goes to
    its range's bucket, and the rows at a border also to the bucket before, so
    that neighbours meet and each text moves once.
    """
    parts = parts_for(docs)
    ids = docs.select(F.col(id_col).cast("long").alias("_id"))
    low = ids.repartitionByRange(4 * parts, F.col("_id").asc_nulls_first()).groupBy(F.spark_partition_id()).agg(F.min("_id").alias("low"), F.count_if(F.col("_id").isNull()).alias("nulls")).collect()
    borders = np.array(sorted({r["low"] for r in low if r["low"] is not None}), np.int64)
    if not any(r["nulls"] for r in low):
        borders = borders[1:]
        lowest = min((r["low"] for r in low if r["low"] is not None), default=None)
    else:
        lowest = None
    total = len(borders) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for lo, hi, buf, offs in tb.slices(whole.column(1)):
                data = memoryview(np.ascontiguousarray(buf))
                texts = [data[s:e] for s, e in zip(offs[:-1], offs[1:], strict=True)]
                yield from dealt(whole.column(0).slice(lo, hi - lo), pa.array([bytes(t[:HEAD]) for t in texts], pa.binary()), pa.array([text_key(t) for t in texts], pa.int64()), pa.array([press.compress(t) for t in texts], pa.binary()))

    def dealt(ids: pa.Array, *others: pa.Array) -> Iterator[pa.RecordBatch]:
        null = ids.is_null().to_numpy(zero_copy_only=False)
        key = ids.fill_null(0).to_numpy()
        bucket = np.where(null, 0, np.searchsorted(borders, key, "right"))
        lead = null if lowest is None else (key == lowest) & ~null
        lead = np.flatnonzero(lead | (np.isin(key, borders) & ~null))
        order = np.concatenate((np.arange(len(key)), lead))
        where = np.concatenate((bucket, (bucket[lead] - 1) % total))
        tail = np.arange(len(order)) >= len(key)
        yield pa.RecordBatch.from_arrays([pa.array(where, pa.int32()), pa.array(tail), *(c.take(pa.array(order)) for c in (ids, *others))], names=["bucket", "tail", "id", "head", "text_key", "packed"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return tb.in_batches(rows, run, "bucket int, tail boolean, id long, head binary, text_key long, packed binary").repartitionById(total, "bucket")


FIGURES = "text_key long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited form (see the query's contract), and their likenesses."""
    return _edited(docs, id_col, text_col).drop("text_key")


def edited_and_near(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """edited_fingerprints and each row's component_id of near copies."""
    return _with_component(_edited(docs, id_col, text_col), _component_of_key(plain_fingerprints(docs, id_col, text_col), least, id_col), id_col).drop("text_key")


def _edited(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = with_next(docs, id_col, text_col).sortWithinPartitions("bucket", "tail", F.col("id").asc_nulls_first(), "head", "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        held: tuple | None = None  # the last row so far: bucket, (id, text_key), text
        pairs: list[tuple] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal pairs, chars
            texts = [t for _, t, _ in pairs]
            nexts = [t for _, _, t in pairs]
            edited = []
            for t, after in zip(texts, nexts, strict=True):
                k = len(t) // 4
                edited.append(t[: len(t) - k] + after[:k])
            prints = fingerprints([_code_points(t) for t in [*texts, nexts[-1], *edited]])
            n = len(texts)
            own, change = prints[:n], prints[n + 1 :]
            # A pair's next text is mostly the following pair's own.
            after = prints[1 : n + 1].copy()
            other = [i for i in range(n - 1) if nexts[i] is not texts[i + 1]]
            if other:
                after[other] = fingerprints([_code_points(nexts[i]) for i in other])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([i[0] for i, _, _ in pairs], pa.int64()),
                    pa.array([i[1] for i, _, _ in pairs], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array([p.tobytes().hex() for p in own]),
                    pa.array([p.tobytes().hex() for p in change]),
                    pa.array(likeness(own, change)),
                    pa.array(likeness(own, after)),
                ],
                names=[id_col, *(f.split()[0] for f in FIGURES.split(", "))],
            )
            pairs, chars = [], 0
            return out

        for b in batches:
            for bucket, tail, key, code, packed in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4, 5)), strict=True):
                text = press.decompress(packed).decode()
                if held is not None and held[0] == bucket:
                    pairs.append((held[1], held[2], text))
                    chars += len(held[2])
                    if chars > BLOCK_CHARS:
                        yield flush()
                held = None if tail else (bucket, (key, code), text)
        if pairs:
            yield flush()

    return tb.in_batches(rows, run, f"{id_col} long, {FIGURES}")


def plain_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text_key, n_chars, fingerprint) of every text, the walks side by side, without a shuffle."""
    picked = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        chars = 0

        def flush() -> pa.RecordBatch:
            points = [_code_points(t) for t in texts]
            prints = fingerprints(points, _MOVES)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([text_key(t.encode()) for t in texts], pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([p.tobytes() for p in prints], pa.binary())], names=[id_col, "text_key", "n_chars", "fingerprint"])

        # A walk takes its steps for all texts of a block at once, so blocks reach over batches.
        for b in batches:
            kind = b.schema.field(0).type
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if texts and chars + len(text) > PLAIN_CHARS:
                    yield flush()
                    ids, texts, chars = [], [], 0
                ids.append(key)
                texts.append(text)
                chars += len(text)
        if texts:
            yield flush()

    return tb.in_batches(picked, run, f"{id_col} {picked.schema[0].dataType.simpleString()}, text_key long, n_chars long, fingerprint binary")


def _forest(prints: np.ndarray, left: int, least: float) -> list[tuple[int, int]]:
    """Links of a spanning forest of the alike rows: among all if left is 0, else of the first `left` with the rest.

    A pair is left uncompared only where both are connected already.
    """
    n = len(prints)
    group = np.arange(n)
    out = []
    for i in range(left or n - 1):
        others = np.arange(left or i + 1, n)
        others = others[group[others] != group[i]]
        hits = others[walks_likeness(prints[i : i + 1], prints[others]) >= least] if len(others) else others
        if len(hits):
            joined, at = np.unique(group[hits], return_index=True)
            out += [(i, int(k)) for k in hits[at]]
            group[np.isin(group, joined)] = group[i]
            if (group == group[0]).all():
                break
    return out


def _links(members: DataFrame, least: float, parts: int) -> DataFrame:
    """(u, v): links among the members (band, lo, hi, own, text_key, fingerprint) of each pair of blocks."""
    dealt = members.select("band", "lo", "hi", "own", "text_key", "fingerprint").repartition(parts, "band", "lo", "hi").sortWithinPartitions("band", "lo", "hi", "own", "text_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: tuple | None = None
        rows: list[tuple] = []
        out: list[tuple[int, int]] = []

        def close() -> None:
            if len(rows) > 1:
                left = sum(own == now[1] for own, _, _ in rows) if now[1] != now[2] else 0
                if now[1] == now[2] or 0 < left < len(rows):
                    prints = np.frombuffer(b"".join(p for _, _, p in rows), np.uint8).reshape(len(rows), -1)
                    out.extend((rows[i][1], rows[k][1]) for i, k in _forest(prints, left, least))

        def found() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([u for u, _ in out], pa.int64()), pa.array([v for _, v in out], pa.int64())], names=["u", "v"])

        for b in batches:
            for band, lo, hi, own, key, prints in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (band, lo, hi) != now:
                    close()
                    now, rows = (band, lo, hi), []
                rows.append((own, key, prints))
            if out:
                yield found()
                out = []
        close()
        if out:
            yield found()

    return tb.in_batches(dealt, run, "u long, v long").distinct()


def _component_of_key(prints: DataFrame, least: float, id_col: str) -> DataFrame:
    """(text_key, component_id): the smallest id of each distinct text's near copies."""
    some = prints.where("n_chars > 0").groupBy("text_key").agg(F.min("fingerprint").alias("fingerprint"), F.min(id_col).alias("low"))
    texts = stored(some, "prints")
    cut = np.random.Generator(np.random.PCG64(7)).permutation(SLOTS)
    bands = F.array(*[F.xxhash64(F.lit(w * BANDS + k), *[F.substring("fingerprint", w * SLOTS + int(s) + 1, 1) for s in cut[k * BAND_SLOTS : (k + 1) * BAND_SLOTS]]) for w in range(WALKS) for k in range(BANDS)])
    keyed = texts.select("text_key", F.explode(bands).alias("band"))
    shared = keyed.groupBy("band").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"), F.count("*").alias("n")).where("n > 1").drop("n")
    own = F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int")
    met = keyed.join(shared, "band").withColumn("own", own).withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = met.select("band", "text_key", "own", F.least("own", "mate").alias("lo"), F.greatest("own", "mate").alias("hi")).join(texts.select("text_key", "fingerprint"), "text_key")
    found = components(_links(members, least, parts_for(texts))).toDF("text_key", "component")
    label = texts.select("text_key", "low").join(found, "text_key", "left").withColumn("component", F.coalesce("component", "text_key"))
    return label.join(label.groupBy("component").agg(F.min("low").alias("component_id")), "component").select("text_key", "component_id")


def _with_component(rows: DataFrame, by_key: DataFrame, id_col: str) -> DataFrame:
    component = F.when(F.col("n_chars") > 0, F.coalesce("component_id", id_col)).otherwise(F.col(id_col))
    return rows.join(by_key, "text_key", "left").withColumn("component_id", component)


def near_copies(docs: DataFrame, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, component_id): near copies by bit-sampled bands, verified.

    Each band takes BAND_SLOTS sampled slots of one walk's fingerprint.  All
    distinct texts of a band are compared, in pairs of blocks, and joined where
    their likeness on any walk reaches `least`; rows of one text are one.
    component_id is the smallest id so reachable.  Empty texts stay alone; rows
    of null id link like others and get an id from a linked row only.
    """
    prints = stored(plain_fingerprints(docs, id_col, text_col), "rows")
    return _with_component(prints, _component_of_key(prints, least, id_col), id_col).select(id_col, "component_id")
