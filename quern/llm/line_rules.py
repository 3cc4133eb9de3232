"""Line-first quality rules.

Every line is judged by itself (punctuation, navigation, boilerplate); failing
lines are removed, and a document that loses too much of its text is rejected.
Document-wide base rules (too few words, too much internal repetition) come on
top.  One pass over the text, no shuffle: each row is independent.

Edge cases: null text counts as no text; a document without words fails the
base rule; lines without words are neither judged nor counted; equal rows get
equal verdicts; an empty table gives an empty result.  Extra columns of the
input pass through `clean` untouched and cannot clash, as rows are handled by
position.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb

# Phrases of lines that belong to a site and not to its text.
BOILERPLATE = (
    "all rights reserved",
    "click here",
    "cookie policy",
    "licensed under",
    "privacy policy",
    "sign up for our newsletter",
    "subscribe to our",
    "terms of service",
    "terms of use",
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds; shares are of words.

    noise_per_word: a line fails the punctuation rule with more than this many
    ASCII punctuation characters a word, plus four.  menu_share: a line fails
    the navigation rule if at least menu_words and this share of its words are
    bare separators.  max_lost: a document is rejected if lines with more than
    this share of its words went.
    """

    noise_per_word: float = 0.6
    menu_words: int = 2
    menu_share: float = 0.25
    max_lost: float = 0.4
    boilerplate: tuple[str, ...] = BOILERPLATE
    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(rb"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~""")] = True
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[list(b"|>/")] = True


def _find(haystack: bytes, needle: bytes) -> list[int]:
    found, at = [], haystack.find(needle)
    while at >= 0:
        found.append(at)
        at = haystack.find(needle, at + 1)
    return found


def judge(buf: np.ndarray, offs: np.ndarray, rules: LineRules) -> dict[str, np.ndarray]:
    """Figures and verdict of each row of a slice, and the spans of its lines."""
    n = len(offs) - 1
    starts, ends, rows = tb.word_spans(buf, offs)
    words = tb.hash_spans(buf, starts, ends)
    n_words = tb.per_row(rows, n)
    total = np.concatenate(([0], np.cumsum(tb.code_points(buf))))
    word_chars = tb.per_row(rows, n, (total[ends] - total[starts]).astype(float)).astype(np.int64)
    n_symbols = tb.count_between(_SYMBOL[buf], offs[:-1], offs[1:])

    # Windows of words found twice in one document: equal keys after sorting.
    keys = tb.windows(words, rules.window)
    ok = tb.inside_rows(rows, rules.window)
    keys = tb.mix(keys ^ tb.mix(rows[: len(keys)].astype(np.uint64) + np.uint64(1)))
    ordered = np.sort(keys[ok])
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if len(twice):
        at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
        again = np.flatnonzero(ok & (twice[at] == keys))
    else:
        again = np.zeros(0, np.int64)
    n_repeat = tb.per_row(rows[tb.covered(len(rows), again, rules.window)], n)

    # Lines: rows split at \n; only lines with a word are judged.
    cut = np.flatnonzero(buf == 10)
    row_cut = tb.rows_of(cut, offs) if len(cut) else np.zeros(0, np.int64)
    line_start = np.concatenate((offs[:-1], cut + 1))
    line_row = np.concatenate((np.arange(n), row_cut))
    # Rows in order of their bytes; an empty row begins where the next one does.
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    last = np.concatenate((line_row[1:] != line_row[:-1], [True])) if len(line_row) else np.zeros(0, bool)
    line_end = np.where(last, offs[line_row + 1], np.concatenate((line_start[1:] - 1, [0])) if len(line_row) else line_start)
    first_word = np.searchsorted(starts, line_start)
    end_word = np.searchsorted(starts, line_end)
    line_words = end_word - first_word
    spoken = line_words > 0

    hashed = tb.hash_spans(buf, line_start, line_end)
    key = tb.mix(hashed ^ tb.mix(line_row.astype(np.uint64) + np.uint64(7)))
    at = np.flatnonzero(spoken)
    _, first = np.unique(key[at], return_index=True)
    repeated = np.ones(len(at), bool)
    repeated[first] = False
    n_dup = tb.per_row(line_row[at[repeated]], n)

    noise = tb.count_between(_PUNCT[buf], line_start, line_end)
    noisy = noise > rules.noise_per_word * line_words + 4
    bare = (ends - starts == 1) & _SEPARATOR[buf[starts]] if len(starts) else np.zeros(0, bool)
    menus = tb.count_between(bare, first_word, end_word)
    menu = (menus >= rules.menu_words) & (menus >= rules.menu_share * line_words)
    site = np.zeros(len(line_row), bool)
    lowered = tb.LOWER[buf].tobytes()
    for phrase in rules.boilerplate:
        if hits := _find(lowered, phrase.encode()):
            hits = np.array(hits)
            line = np.searchsorted(line_start, hits, "right") - 1
            site[line[hits + len(phrase.encode()) <= line_end[line]]] = True
    failed = spoken & (noisy | menu | site)
    lost = tb.per_row(line_row, n, np.where(failed, line_words, 0).astype(float)).astype(np.int64)
    base_failed = (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)
    return {
        "n_words": n_words,
        "word_chars": word_chars,
        "n_symbols": n_symbols,
        "n_dup_lines": n_dup,
        "n_repeat_words": n_repeat,
        "base_failed": base_failed,
        "kept": ~base_failed & (lost <= rules.max_lost * n_words),
        "n_lines": tb.per_row(line_row, n, spoken),
        "n_failed_lines": tb.per_row(line_row, n, failed),
        "n_lost_words": lost,
        "line_row": line_row,
        "line_start": line_start,
        "line_end": line_end,
        "line_failed": failed,
    }


FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, n_lines long, n_failed_lines long, n_lost_words long"
_ARROW = {"long": pa.int64(), "boolean": pa.bool_()}
_FIELDS = [(f.split()[0], _ARROW[f.split()[1]]) for f in FIGURES.split(", ")]


def figures(docs: DataFrame, rules: LineRules = LineRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, the figures and the verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(1)):
                got = judge(buf, offs, rules)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(got[k], t) for k, t in _FIELDS)], names=[b.schema.names[0], *(k for k, _ in _FIELDS)])

    picked = docs.select(F.col(id_col), F.col(text_col))
    return tb.in_batches(picked, run, f"{id_col} {picked.schema[0].dataType.simpleString()}, {FIGURES}")


def clean(docs: DataFrame, rules: LineRules = LineRules(), text_col: str = "text") -> DataFrame:
    """The kept documents, all columns, their failing lines removed from the text."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, buf, offs in tb.slices(b.column(at)):
                got = judge(buf, offs, rules)
                part, kept = b.slice(lo, hi - lo), np.flatnonzero(got["kept"])
                touched = np.unique(got["line_row"][got["line_failed"]])
                texts = part.column(at)
                if len(touched):
                    values = texts.to_pylist()
                    data = buf.tobytes()
                    bounds = np.searchsorted(got["line_row"], np.stack((touched, touched + 1)))
                    for row, a, z in zip(touched, *bounds, strict=True):
                        values[row] = b"\n".join(data[s:e] for s, e, f in zip(got["line_start"][a:z], got["line_end"][a:z], got["line_failed"][a:z], strict=True) if not f).decode()
                    texts = pa.array(values, texts.type)
                columns = list(part.columns)
                columns[at] = texts
                yield pa.RecordBatch.from_arrays([c.take(pa.array(kept)) for c in columns], names=part.schema.names)

    return tb.in_batches(docs, run, docs.schema)
