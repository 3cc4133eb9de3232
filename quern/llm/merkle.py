"""Merkle manifest of a table: a hash tree per source, one over the sources, and proofs.

Every row is a leaf.  In a tree, runs of ``FAN`` nodes become the hash of their
digests until one is left.  Builders each take an aligned block of ``FAN **
tier_levels`` consecutive nodes and append all nodes of their subtree to a log in the order of
completion, children before parents (postorder).  The places follow from the
sizes of the subtrees alone: before a node lie, on its level and below, all nodes
up to the end of its range, and above it those whose range ends before it begins.
So a proof's siblings are found in the log by `place`, without pointers.  The
blocks' roots are the next tier's nodes, built in the same way; tiers grow with
the logarithm of the rows, so what a task holds is one block, never a source.

Order: leaves ascend by id, then by their digest (equal ones are alike); null ids
and null sources come first.  The rows of a source are dealt by range over many
tasks, repeated ones too, and numbered by each task's offset.

Edge cases: null and empty values are told apart (``-`` and ``0:``); a lone leaf is
its tree's root and has no siblings there; an empty table gives an empty result;
columns that are not named as fields are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm import textbatch as tb
from quern.llm.scratch import parts_for, stored

FAN = 16
TIER_LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    """Hex sha256 of the fields, each with its byte count."""
    return F.sha2(F.concat(*[_field(v) for v in values]), 256)


def levels(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // FAN))
    return out


def place(level: int, i: int, n: int, top: int) -> int:
    """Postorder place of node i of a level in a tree of n leaves and levels 0 to top."""
    first, end = i * FAN**level, min((i + 1) * FAN**level, n)
    upto = sum(-(-end // FAN**k) for k in range(level + 1))
    return upto + sum(first // FAN**k for k in range(level + 1, top + 1)) - 1


def joined(digests: list[bytes]) -> bytes:
    """Hash of a run: sha256 of the digests as hex text."""
    return hashlib.sha256(b"".join([d.hex().encode() for d in digests])).digest()


def top_of(size: int, tier_levels: int) -> int:
    """The highest level that a block's builder makes: the tier's, or the tree's root."""
    return min(tier_levels, len(levels(size)) - 1)


def append_log(nodes: Iterator[bytes], count: int, top: int) -> list[bytes]:
    """All nodes of a block's subtree in order of completion."""
    log: list[bytes] = []
    open_: list[list[bytes]] = [[] for _ in range(top + 1)]

    def close(level: int) -> None:
        node = joined(open_[level - 1])
        open_[level - 1] = []
        log.append(node)
        open_[level].append(node)

    for i, node in enumerate(nodes, 1):
        log.append(node)
        open_[0].append(node)
        for level in range(1, top + 1):
            if i % FAN**level == 0 or i == count:
                close(level)
    return log


def siblings(log: list[bytes], i: int, count: int, top: int) -> list[tuple[list[bytes], list[bytes]]]:
    """For each level below top the digests before and after node i's ancestor in its run."""
    out = []
    for level in range(top):
        at = i // FAN**level
        first = at // FAN * FAN
        end = min(first + FAN, -(-count // FAN**level))
        run = [log[place(level, k, count, top)] for k in range(first, end)]
        out.append((run[: at - first], run[at - first + 1 :]))
    return out


def fold(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a digest and the hex text of its siblings give."""
    for before, after in path:
        digest = hashlib.sha256(before + digest.hex().encode() + after).digest()
    return digest


def _hex(digests: list[bytes]) -> bytes:
    return b"".join(digests).hex().encode()


def numbered(rows: DataFrame, tree: str, order: list[str], parts: int) -> DataFrame:
    """Rows with `idx` and `size`: their place in the order within their tree, and the tree's number of rows.

    Rows are dealt by ranges of tree and order; each task counts its rows, and
    the sums of the counts before it are its offset.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, k = None, 0
        for b in batches:
            at = []
            for name in b.column(0).to_pylist():
                if (name,) != now:
                    now, k = (name,), 0
                at.append(k)
                k += 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int64())], names=[*b.schema.names, "k"])

    shown = [tree, *[c for c in rows.columns if c != tree]]
    dealt = rows.select(*shown).repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    shape = T.StructType([*dealt.schema.fields, T.StructField("k", T.LongType())])
    kept = stored(tb.in_batches(dealt, run, shape).withColumn("part", F.spark_partition_id()), "ranges")
    counts = kept.groupBy(tree, "part").agg(F.count("*").alias("rows"))
    by_tree = Window.partitionBy(tree)
    before = F.sum("rows").over(by_tree.orderBy("part")) - F.col("rows")
    offsets = counts.select(F.col(tree).alias("t"), F.col("part").alias("p"), before.alias("before"), F.sum("rows").over(by_tree).alias("size"))
    met = kept.join(offsets, kept[tree].eqNullSafe(offsets["t"]) & (kept["part"] == offsets["p"]))
    return met.select(*shown, (F.col("k") + F.col("before")).alias("idx"), "size")


def built(nodes: DataFrame, payload: str, kind: str, parts: int, tier_levels: int) -> DataFrame:
    """One row per block of (tree, idx, size, digest, payload): its log, its root and its nodes' payloads."""
    dealt = nodes.select("tree", F.expr(f"idx div {FAN**tier_levels}").alias("block"), "idx", "size", "digest", payload).repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, size, held, own = None, 0, [], []

        def done() -> list:
            log = append_log(iter(held), len(held), top_of(size, tier_levels))
            return [now[0], now[1], size, b"".join(log), log[-1], own]

        def out(rows: list[list]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa_kind)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["tree", "block", "size", "log", "root", "payload"])

        pa_kind, ready = None, []
        for b in batches:
            pa_kind = b.schema.field(5).type
            for tree, block, _, n, digest, more in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (tree, block) != now:
                    if now is not None:
                        ready.append(done())
                    now, size, held, own = (tree, block), n, [], []
                held.append(digest)
                own.append(more)
                if len(ready) == 64:
                    yield out(ready)
                    ready = []
        if now is not None:
            ready.append(done())
            yield out(ready)

    return tb.in_batches(dealt, run, f"tree string, block long, size long, log binary, root binary, payload array<{kind}>")


PATH = "array<struct<before:binary,after:binary>>"


def proven(blocks: DataFrame, above: DataFrame | None, what, shape: str, kinds: list[pa.DataType | None], tier_levels: int) -> DataFrame:
    """Rows that `what(tree, idx, size, payload, digest, path)` gives for each node of the blocks.

    above has (tree, block, path) of the blocks' roots; without it they are roots.
    """
    names = [c.split()[0] for c in shape.split(", ")]
    if above is None:
        met = blocks.withColumn("path", F.lit(None).cast(PATH))
    else:
        met = blocks.join(above.withColumnRenamed("tree", "t").withColumnRenamed("block", "b"), F.col("tree").eqNullSafe(F.col("t")) & (F.col("block") == F.col("b")), "left").drop("t", "b")
    met = met.select("tree", "block", "size", "log", "payload", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 16):
                rows = []
                for tree, block, size, log, payload, path in zip(*(c.to_pylist() for c in whole.slice(k, 16).columns), strict=True):
                    nodes = [log[i : i + 32] for i in range(0, len(log), 32)]
                    upper = [(p["before"], p["after"]) for p in path or []]
                    top, count = top_of(size, tier_levels), len(payload)
                    for i, more in enumerate(payload):
                        own = [(_hex(x), _hex(y)) for x, y in siblings(nodes, i, count, top)]
                        rows.append(what(tree, block * FAN**tier_levels + i, size, more, nodes[place(0, i, count, top)], own + upper))
                # A kind that is None is that of the payload's id.
                held = whole.schema.field(4).type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(c, t if t is not None else held.field("id").type) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return tb.in_batches(met, run, shape)


_PATH = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))


def _path_row(tree, idx, size, more, digest, path):
    return tree, idx, [{"before": x, "after": y} for x, y in path]


def _paths(tiers: list[DataFrame], above: DataFrame | None, tier_levels: int) -> DataFrame | None:
    """(tree, block, path) of the lowest tier's blocks, from the paths of the trees' roots."""
    for tier in reversed(tiers[1:]):
        found = proven(tier, above, _path_row, "tree string, block long, path " + PATH, [pa.string(), pa.int64(), _PATH], tier_levels)
        above = stored(found, "paths")
    return above


def forest(nodes: DataFrame, payload: str, kind: str, parts: int, tier_levels: int) -> list[DataFrame]:
    """The tiers of all trees, lowest first: blocks of nodes, then of the blocks' roots, until each tree has one.

    A tree that is done stays out of higher tiers.
    """
    block = FAN**tier_levels
    tiers = [stored(built(nodes, payload, kind, parts, tier_levels), "tier")]
    while True:
        last = tiers[-1]
        more = last.where(F.col("size") > block)
        if not more.take(1):
            return tiers
        up = more.select("tree", F.col("block").alias("idx"), F.ceil(F.col("size") / block).cast("long").alias("size"), F.col("root").alias("digest"), F.lit(0).alias("none"))
        tiers.append(stored(built(up, "none", "int", parts, tier_levels), "tier"))


def roots(tiers: list[DataFrame], tier_levels: int) -> DataFrame:
    """(tree, root) of every tree."""
    done = [t.where(F.col("size") <= FAN**tier_levels).select("tree", "root") for t in tiers]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def manifest(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", fields: tuple[str, ...] = FIELDS, text_col: str = "text", tier_levels: int = TIER_LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    Where 5 divides the id's crc32, the text is tampered with before the proof is tried.
    """
    parts = parts_for(docs)
    values = [F.col(c) for c in fields]
    bad = [F.translate(F.col(c), UPPER, LOWER) if c == text_col else F.col(c) for c in fields]
    tampered = F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0
    leaves = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("tree"), F.unhex(leaf_digest(values)).alias("digest"), F.when(tampered, F.unhex(leaf_digest(bad))).alias("tried"), F.monotonically_increasing_id().alias("row"))
    leaves = stored(leaves, "leaves")
    placed = numbered(leaves, "tree", ["id", "digest", "row"], parts)
    id_kind = docs.schema[id_col].dataType.simpleString()
    kind = f"struct<id:{id_kind},tried:binary>"
    tiers = forest(placed.withColumn("payload", F.struct("id", "tried")), "payload", kind, parts, tier_levels)
    # The tree over the sources: their subroots, in order of their names, as nodes of one tree.
    subroots = stored(roots(tiers, tier_levels).select(F.lit("").alias("all"), F.col("tree").alias("name"), F.col("root").alias("digest")), "subroots")
    placed = numbered(subroots, "all", ["name"], parts).withColumnRenamed("all", "tree")
    over = forest(placed, "name", "string", parts, tier_levels)
    root = stored(roots(over, tier_levels).select(F.col("root").alias("of_all")), "root")
    shape = "tree string, block long, path " + PATH
    tops = proven(over[0], _paths(over, None, tier_levels), lambda tree, idx, size, more, digest, path: (more, 0, [{"before": x, "after": y} for x, y in path]), shape, [pa.string(), pa.int64(), _PATH], tier_levels)
    tops = stored(tops, "tops")
    # A source's root is the only block of its last tier, which is where its path begins.
    above = tops
    for n in range(len(tiers) - 1, 0, -1):
        found = stored(proven(tiers[n], above, _path_row, "tree string, block long, path " + PATH, [pa.string(), pa.int64(), _PATH], tier_levels), "paths")
        done = tiers[n - 1].where(F.col("size") <= FAN**tier_levels).select(F.col("tree").alias("t"))
        above = found.unionByName(tops.join(done, F.col("tree").eqNullSafe(F.col("t")), "left_semi"))

    def tried(tree, idx, size, more, digest, path):
        proof = hashlib.sha256(b"".join([x + y for x, y in path])).hexdigest()
        subroot = fold(digest, path[: len(levels(size)) - 1]).hex()
        return more["id"], digest.hex(), subroot, proof, fold(more["tried"] or digest, path).hex()

    rows = proven(tiers[0], above, tried, f"id {id_kind}, leaf string, subroot string, proof_sha256 string, folded_root string", [None, *[pa.string()] * 4], tier_levels)
    out = rows.crossJoin(F.broadcast(root.select(F.lower(F.hex("of_all")).alias("root"))))
    return out.select(F.col("id").alias(id_col), "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
