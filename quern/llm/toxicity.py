"""Toxicity by multiple-instance learning.

Labels mark documents, not sentences.  A linear model scores each sentence, the
document's probability is the noisy-or of its sentences' (1 - product of
(1 - p)), and the weights are fitted to the document labels through that
noisy-or.  The same sentence scores then locate the offending sentences.

The fit uses a bounded, documented sample of labelled rows (`TrainingSample`),
drawn by a hash of doc_id from rows outside the held-out fold.  `spare` times as
many ids are drawn, so that others stand in for documents of more than
`max_words` words, which the fit leaves out.  Scoring covers every whole text in
one pass without a shuffle, with a weight table of fixed size in the tasks'
closure.

Edge cases: null and empty texts have no sentence and score 0; null labels are
not learnt from; a doc_id that repeats is learnt from once, by its smallest text;
without any usable label every score is 0; ties for the worst sentence go to the
first; equal texts get equal scores; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb
from quern.llm.scratch import stored

WORD_BITS = 20
STEM_BITS = 18
WEIGHTS = (1 << WORD_BITS) + (1 << STEM_BITS)

_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789'")] = True
_LETTER[128:] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass(frozen=True)
class TrainingSample:
    """Bounds of the fit: rows of each label, and words of a training document.

    Features of fewer than min_docs documents are left out, or of fewer than a
    tenth of the positive ones where these are few (two at least).
    """

    positives: int = 2000
    negatives: int = 4000
    spare: int = 2
    max_words: int = 5000
    stem: int = 4
    min_docs: int = 12
    rounds: int = 100
    rate: float = 0.3
    decay: float = 1e-4


def sentences(buf: np.ndarray, offs: np.ndarray, stem: int) -> tuple[np.ndarray, ...]:
    """Row, first feature, byte start and end of each sentence; the two features of each word."""
    buf = tb.LOWER[buf]
    starts, ends = tb.runs(_LETTER[buf], offs)
    rows = tb.rows_of(starts, offs)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none, none, none
    # A run of marks ("!!", "...") is emphasis and ends nothing; a line's end always does.
    mark = _STOP[buf]
    single = mark.copy()
    single[1:] &= ~mark[:-1]
    single[:-1] &= ~mark[1:]
    stops = np.cumsum(single | (buf == 10))[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (stops[1:] != stops[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    whole = (tb.hash_spans(buf, starts, ends) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    begin = tb.code_points(buf)
    places = np.append(np.flatnonzero(begin), np.full(stem, len(buf)))
    nth = np.cumsum(begin)[starts] - 1
    cut = np.minimum(ends, places[np.minimum(nth + stem, len(places) - 1)])
    stems = (tb.hash_spans(buf, starts, cut) >> np.uint64(64 - STEM_BITS)).astype(np.int64) + (1 << WORD_BITS)
    return rows[first], first, starts[first], ends[last], whole, stems


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    stem: int


def distinct(cell: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each feature once a sentence, so that repetition does not add up."""
    key = np.unique(cell.astype(np.int64) * WEIGHTS + feature)
    return key // WEIGHTS, key % WEIGHTS


def logits(model: Model, first: np.ndarray, whole: np.ndarray, stems: np.ndarray) -> np.ndarray:
    z = np.full(len(first), model.bias)
    if len(first) and len(model.weights) > 1:
        cell = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(whole))))
        for feature in (whole, stems):
            some = np.flatnonzero(model.weights[feature])
            at, what = distinct(cell[some], feature[some])
            z += np.bincount(at, model.weights[what], len(first))
    return z


def bags(docs: DataFrame, sample: TrainingSample) -> DataFrame:
    """(label, at, sizes, features): the sentences of each row of (label, at, text) as int32 arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels, places = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo, hi, buf, offs in tb.slices(b.column(2)):
                row, first, _, _, whole, stems = sentences(buf, offs, sample.stem)
                size = np.diff(np.append(first, len(whole)))
                cut = np.searchsorted(row, np.arange(hi - lo + 1))
                word = np.append(first, len(whole))[cut]
                pairs = np.stack((whole, stems), 1).astype(np.int32)
                keep = [i for i in range(hi - lo) if 0 < word[i + 1] - word[i] <= sample.max_words]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([labels[lo + i] for i in keep], pa.int32()),
                        pa.array([places[lo + i] for i in keep], pa.int64()),
                        pa.array([size[cut[i] : cut[i + 1]].astype(np.int32).tobytes() for i in keep], pa.binary()),
                        pa.array([pairs[word[i] : word[i + 1]].tobytes() for i in keep], pa.binary()),
                    ],
                    names=["label", "at", "sizes", "features"],
                )

    return tb.in_batches(docs, run, "label int, at long, sizes binary, features binary")


def draw(docs: DataFrame, labels: DataFrame, label: str, usable: Column, positives: int, negatives: int) -> DataFrame:
    """(label, at, text) of a bounded sample of labelled rows, the same on every run.

    Takes the rows with the smallest hash `at` of doc_id of each label, so only as
    many ids as the bound meet in one place and are broadcast.  Each id gives one
    row, whatever the number of its documents.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & usable).select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("_label"))
    known = known.groupBy("_id").agg(F.max("_label").alias("_label")).withColumn("_at", F.xxhash64("_id"))
    picked = None
    for value, most in ((1, positives), (0, negatives)):
        some = known.where(F.col("_label") == value).orderBy("_at", "_id").limit(most)
        picked = some if picked is None else picked.unionByName(some)
    rows = docs.select(F.col("doc_id").alias("_doc"), F.col("text").alias("_text")).join(F.broadcast(picked), F.col("_doc") == F.col("_id"))
    return rows.groupBy("_id", "_label", "_at").agg(F.min("_text").alias("_text")).select(F.col("_label").alias("label"), F.col("_at").alias("at"), F.col("_text").alias("text"))


def gradient(w: np.ndarray, bias: float, cell: np.ndarray, feature: np.ndarray, doc: np.ndarray, y: np.ndarray, decay: float) -> np.ndarray:
    """Gradient by weights and bias of the mean loss of documents under a noisy-or of their sentences, plus the decay.

    cell and feature are the sentence and the feature of each one that occurs, doc
    the document of each sentence, y which documents are positive.  A document is
    positive unless none of its sentences is: -log of that is the sum of
    log(1 + exp(z)).
    """
    z = bias + np.bincount(cell, w[feature], len(doc))
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    heat = np.bincount(doc, np.logaddexp(0, z), len(y))
    pull = np.where(y, -1 / np.expm1(np.clip(heat, 1e-6, 50)), 1.0)
    g = pull[doc] * p
    return np.append(np.bincount(feature, g[cell], len(w)) / len(y) + decay * w, g.sum() / len(y))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, sample: TrainingSample = TrainingSample()) -> Model:
    """Fits on the sample; `usable` says which rows of labels may be learnt from."""
    # Of the spare rows only as many as the bound reach the driver.
    bag = stored(bags(draw(docs, labels, "toxic", usable, sample.spare * sample.positives, sample.spare * sample.negatives), sample), "bags")
    first, rest = (bag.where(F.col("label") == label).orderBy("at").limit(most) for label, most in ((1, sample.positives), (0, sample.negatives)))
    rows = first.unionByName(rest).toArrow().combine_chunks()
    none = Model(np.zeros(1, np.float32), -30.0, sample.stem)
    if rows.num_rows == 0:
        return none
    order = np.lexsort((np.array([hash_bytes(x) for x in rows.column("features").to_pylist()]),))
    rows = rows.take(pa.array(order))
    y = rows.column("label").to_numpy().astype(bool)
    if not y.any():
        return none
    sizes = [np.frombuffer(x, np.int32) for x in rows.column("sizes").to_pylist()]
    pairs = np.concatenate([np.frombuffer(x, np.int32) for x in rows.column("features").to_pylist()]).reshape(-1, 2)
    doc = np.repeat(np.arange(len(sizes)), [len(x) for x in sizes])
    size = np.concatenate(sizes)
    sentence = np.repeat(np.arange(len(size)), size)
    del rows
    # Features of a few documents teach nothing about others.
    of_doc = doc[sentence]
    spread = np.zeros(WEIGHTS, np.int64)
    for c in (0, 1):
        seen = np.unique(pairs[:, c].astype(np.int64) * len(sizes) + of_doc)
        spread += np.bincount(seen // len(sizes), minlength=WEIGHTS)
        del seen
    common = np.flatnonzero(spread >= min(sample.min_docs, max(2, int(y.sum()) // 10)))
    renamed = np.full(WEIGHTS, -1, np.int32)
    renamed[common] = np.arange(len(common), dtype=np.int32)
    cells, features = [], []
    for c in (0, 1):
        code = renamed[pairs[:, c]]
        some = np.flatnonzero(code >= 0)
        at, what = distinct(sentence[some], code[some])
        cells.append(at.astype(np.int32))
        features.append(what.astype(np.int32))
    cell, feature = np.concatenate(cells), np.concatenate(features)
    del cells, features, pairs, sentence, of_doc

    w, bias = np.zeros(len(common)), -4.0
    m, v = np.zeros(len(common) + 1), np.zeros(len(common) + 1)
    for step in range(1, sample.rounds + 1):
        grad = gradient(w, bias, cell, feature, doc, y, sample.decay)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = sample.rate * (1 - (step - 1) / sample.rounds) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
        w -= move[:-1]
        bias -= float(move[-1])
    weights = np.zeros(WEIGHTS, np.float32)
    weights[common] = w
    return Model(weights, bias, sample.stem)


def hash_bytes(x: bytes) -> int:
    return int(np.bitwise_xor.reduce(tb.mix(np.frombuffer(x, np.int32).astype(np.uint64))) >> np.uint64(1)) if x else 0


FIGURES = "score double, n_sentences long, n_offending long, worst_start long, worst_chars long, worst_score double"


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """One row per document: noisy-or score, sentences over the threshold, and the worst one's place in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                n = hi - lo
                row, first, start, end, whole, stems = sentences(buf, offs, model.stem)
                z = logits(model, first, whole, stems)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                score = -np.expm1(-np.bincount(row, np.logaddexp(0, z), n))
                best = np.lexsort((np.arange(len(row)), -p, row))
                lead = best[np.searchsorted(row[best], np.arange(n)).clip(0, max(0, len(row) - 1))] if len(row) else np.zeros(0, np.int64)
                has = np.bincount(row, minlength=n) > 0
                chars = np.concatenate(([0], np.cumsum(tb.code_points(buf))))
                pick = lambda x: pa.array(x, mask=~has) if len(row) else pa.nulls(n)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, n),
                        pa.array(score),
                        pa.array(np.bincount(row, minlength=n)),
                        pa.array(np.bincount(row, p >= threshold, n).astype(np.int64)),
                        pick(chars[start[lead]] - chars[offs[:-1]] if len(row) else None).cast(pa.int64()),
                        pick(chars[end[lead]] - chars[start[lead]] if len(row) else None).cast(pa.int64()),
                        pick(p[lead] if len(row) else None).cast(pa.float64()),
                    ],
                    names=[b.schema.names[0], *(f.split()[0] for f in FIGURES.split(", "))],
                )

    picked = docs.select(F.col(id_col), F.col(text_col))
    return tb.in_batches(picked, run, f"{id_col} {picked.schema[0].dataType.simpleString()}, {FIGURES}")


def offending(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, start, chars, score, sentence) of every sentence at or over the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                row, first, start, end, whole, stems = sentences(buf, offs, model.stem)
                if not len(row) or len(model.weights) == 1:
                    continue
                z = logits(model, first, whole, stems)
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                hot = np.flatnonzero(p >= threshold)
                chars = np.concatenate(([0], np.cumsum(tb.code_points(buf))))
                data = buf.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(lo, hi - lo).take(pa.array(row[hot])),
                        pa.array(chars[start[hot]] - chars[offs[row[hot]]]),
                        pa.array(chars[end[hot]] - chars[start[hot]]),
                        pa.array(p[hot]),
                        pa.array([data[start[i] : end[i]].decode() for i in hot], pa.string()),
                    ],
                    names=[b.schema.names[0], "start", "chars", "score", "sentence"],
                )

    picked = docs.select(F.col(id_col), F.col(text_col))
    return tb.in_batches(picked, run, f"{id_col} {picked.schema[0].dataType.simpleString()}, start long, chars long, score double, sentence string")
