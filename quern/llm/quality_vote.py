"""Quality classifier: similarity-weighted votes of the nearest labelled vectors.

Texts become hashed term vectors (character-shape trigrams, word lengths,
repetition marks, frequent words), weighted by the training sample's inverse
document frequencies and projected on its leading singular vectors.  The
labelled latent vectors, a bounded number of fixed width, go to the tasks; each
document's cosines with all of them are computed exactly in matrix blocks, and
its nearest neighbours vote with their similarity as weight.

The fit uses a bounded, documented sample of labelled rows
(`VoteSettings.per_label`), drawn by a hash of doc_id outside the held-out fold.
Scoring covers every whole text in one pass without a shuffle.

Edge cases: null and empty texts have a zero vector, so no neighbour, and get
the mean label of such texts in the sample, or 0 if it has none; null labels are
not learnt from; without labels every score is 0.5; cosines are rounded to
five decimals, and all that tie with the last neighbour vote too; a doc_id that
repeats is learnt from once, by its smallest text; empty tables give empty
results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb
from quern.llm.toxicity import draw

SHAPES, TERMS, MARKS = 2048, 2048, 32
WIDTH = SHAPES + TERMS + MARKS

_CLASS = np.arange(256, dtype=np.uint64)
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[48:58] = 48
_CLASS[128:] = 97
#: A slice has at most so many rows and bytes, as each row has a dense vector.
_ROWS, _BYTES = 256, 1 << 19


@dataclass(frozen=True)
class VoteSettings:
    per_label: int = 1500
    rank: int = 64
    neighbours: int = 15
    sharpness: float = 4.0


def term_matrix(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Square roots of relative term frequencies, one dense float32 row per document."""
    n = len(offs) - 1
    out = np.zeros((n, WIDTH), np.float32)
    if not len(buf):
        return out
    shape = _CLASS[buf]
    if len(buf) > 2:
        key = shape[:-2] * np.uint64(65536) + shape[1:-1] * np.uint64(256) + shape[2:]
        place = (tb.mix(key) >> np.uint64(64 - 11)).astype(np.int64)
        row = tb.rows_of(np.arange(len(place)), offs)
        ok = row == tb.rows_of(np.arange(2, len(buf)), offs)
        out[:, :SHAPES] = np.bincount((row * SHAPES + place)[ok], minlength=n * SHAPES).reshape(n, SHAPES)
    starts, ends, rows = tb.word_spans(buf, offs)
    if len(starts):
        words = tb.hash_spans(tb.LOWER[buf], starts, ends)
        term = (words >> np.uint64(64 - 11)).astype(np.int64)
        out[:, SHAPES : SHAPES + TERMS] = np.bincount(rows * TERMS + term, minlength=n * TERMS).reshape(n, TERMS)
        marks = np.zeros((n, MARKS), np.float32)
        marks += np.bincount(rows * MARKS + np.minimum(ends - starts, 15), minlength=n * MARKS).reshape(n, MARKS)
        for back in (1, 2, 3):
            same = np.flatnonzero((words[back:] == words[:-back]) & (rows[back:] == rows[:-back])) + back
            marks[:, 15 + back] = np.bincount(rows[same], minlength=n)
        out[:, SHAPES + TERMS :] = marks
    for a, z, weight in ((0, SHAPES, 1.0), (SHAPES, SHAPES + TERMS, 0.5), (SHAPES + TERMS, WIDTH, 1.0)):
        part = out[:, a:z]
        total = part.sum(1, keepdims=True)
        np.divide(part, np.maximum(total, 1), out=part)
        np.sqrt(part, out=part)
        part *= weight
    return out


def _vectors(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(2), _BYTES, _ROWS):
                rows = term_matrix(buf, offs).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([r.tobytes() for r in rows], pa.binary())], names=["label", "terms"])

    return tb.in_batches(docs, run, "label int, terms binary")


@dataclass(frozen=True)
class VoteModel:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    weights: np.ndarray
    blank: float
    settings: VoteSettings

    def latent(self, terms: np.ndarray) -> np.ndarray:
        low = (terms * self.idf) @ self.axes
        return low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)

    def score(self, terms: np.ndarray) -> np.ndarray:
        spoken = terms.any(1)
        out = np.where(spoken, 0.5, self.blank)
        n = len(self.labels)
        k = min(self.settings.neighbours, n)
        for at in range(0, len(terms) if n else 0, _ROWS):
            block = at + np.flatnonzero(spoken[at : at + _ROWS])
            near = np.round(self.latent(terms[block]) @ self.vectors.T, 5)
            last = np.partition(near, n - k, axis=1)[:, n - k]
            row, col = np.nonzero(near >= last[:, None])
            pull = np.exp(self.settings.sharpness * 8 * (near[row, col].astype(np.float64) - 1)) * self.weights[col]
            out[block] = np.bincount(row, pull * self.labels[col], len(block)) / np.maximum(np.bincount(row, pull, len(block)), 1e-300)
        return np.clip(out, 0, 1)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, settings: VoteSettings = VoteSettings()) -> VoteModel:
    """`usable` says which rows of labels may be learnt from."""
    rows = _vectors(draw(docs, labels, "quality", usable, settings.per_label, settings.per_label)).toArrow()
    y = rows.column("label").to_numpy().astype(np.float64)
    empty = VoteModel(np.ones(WIDTH, np.float32), np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0), 0.5, settings)
    if not len(y):
        return empty
    x = np.frombuffer(b"".join(rows.column("terms").to_pylist()), np.float16).reshape(len(y), WIDTH).astype(np.float32)
    order = np.array(sorted(range(len(y)), key=lambda i: (y[i], x[i].tobytes())))
    x, y = x[order], y[order]
    spoken = x.any(1)
    blank = float(y[~spoken].mean()) if not spoken.all() else 0.0
    x, y = x[spoken], y[spoken]
    if not len(y):
        return replace(empty, blank=blank)
    idf = np.log1p(len(y) / (1 + (x > 0).sum(0))).astype(np.float32)
    # Randomised range finder with power steps, then an exact small SVD.
    a = x * idf
    rank = min(settings.rank, *a.shape)
    basis = np.random.Generator(np.random.PCG64(5)).standard_normal((a.shape[1], min(rank + 16, *a.shape))).astype(np.float32)
    for _ in range(4):
        basis, _ = np.linalg.qr(a.T @ (a @ basis))
    _, _, vt = np.linalg.svd(a @ basis, full_matrices=False)
    axes = (basis @ vt.T)[:, :rank].astype(np.float32)
    low = a @ axes
    vectors = (low / np.maximum(np.linalg.norm(low, axis=1, keepdims=True), 1e-12)).astype(np.float32)
    return VoteModel(idf, axes, vectors, y, np.ones(len(y)), blank, settings)


def scores(docs: DataFrame, model: VoteModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): the weighted share of the neighbours labelled 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1), _BYTES, _ROWS):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(model.score(term_matrix(buf, offs)))], names=[b.schema.names[0], "score"])

    picked = docs.select(F.col(id_col), F.col(text_col))
    return tb.in_batches(picked, run, f"{id_col} {picked.schema[0].dataType.simpleString()}, score double")


def keep_good(docs: DataFrame, model: VoteModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents scored at or over the threshold, all columns."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(at), _BYTES, _ROWS):
                good = np.flatnonzero(model.score(term_matrix(buf, offs)) >= threshold)
                yield b.slice(lo, hi - lo).take(pa.array(good))

    return tb.in_batches(docs, run, docs.schema)
