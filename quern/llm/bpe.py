"""Byte-pair encoding and decoding by speculate and verify.

For every word a greedy longest match over the vocabulary proposes tokens.  The
proposal is the true encoding exactly if each adjacent pair of tokens is
compatible, that is, encoding the two tokens' characters gives those two tokens
again (and each token encodes to itself).  Pairs are tested together, as sorted
arrays of pair codes against the codes known so far; only words with an
incompatible pair go through the exact merges.

Words are the unit: a table of words, bounded in number and letters, keeps their
tokens in each Python worker, and texts are gathered from it by index.  No
shuffle; memory follows a slice of whole rows.

The vocabulary file is read on the driver from a path parameter and its JSON
text, of fixed size, goes to the tasks.

Edge cases: null and empty texts have no token and decode to the empty string;
characters outside the vocabulary are dropped, as there is no unknown token; the
special tokens' strings in a text give their own ids; equal texts get equal
results; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm import textbatch as tb

# The vocabulary file's split pattern, its white space spelt out.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_PARTS = "'s|'t|'re|'ve|'m|'ll|'d"
_ANY = regex.compile(_PARTS + r"|[\p{L}]+|[\p{N}]|[^" + _WHITE + r"\p{L}\p{N}]+")
# The same where every character is ASCII or a common Latin letter.
_LETTERS = "a-zA-Zß-öø-ÿÀ-ÖØ-Þœ"
_LATIN = re.compile(_PARTS + "|[" + _LETTERS + "]+|[0-9]|[^\\t-\\r 0-9" + _LETTERS + "]+")
_PLAIN = re.compile("[\\x00-\\x7f" + _LETTERS + "]*")

WORDS_KEPT, LETTERS_KEPT = 300_000, 16_000_000
#: Words from so many symbols are merged over a heap, in time n log n.
LONG_WORD = 64
#: Pair codes kept: nine bytes each.
PAIRS_KEPT = 1 << 19


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stands for itself, the rest follow from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        out[b] = chr(b) if b in own else chr(more)
        more += b not in own
    return out


class _Words(dict):
    """Words by number; a word met for the first time gets the next number and waits in `new`."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordBpe:
    """A vocabulary with word ends; ids of words by speculation, of texts by gathering."""

    def __init__(self, spec: str, kept: int = WORDS_KEPT) -> None:
        data = json.loads(spec)
        model = data["model"]
        self.vocab: dict[str, int] = dict(model["vocab"])
        self.end: str = model["end_of_word_suffix"] or ""
        pairs = [m if isinstance(m, list) else m.split(" ", 1) for m in model["merges"]]
        self.rank = {(self.vocab[a], self.vocab[b]): rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.vocab[a + b] for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.split_special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.token = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.letters = byte_letters()
        # The longest token that begins with each pair of letters.
        self.longest: dict[str, int] = {}
        for t in self.vocab:
            bare = t.removesuffix(self.end) if t != self.end else t
            self.longest[bare[:2]] = max(self.longest.get(bare[:2], 1), len(bare))
        self.size = max(self.token) + 1
        # Pair codes met, ascending, and whether each is compatible.
        self.pairs = np.zeros(0, np.int64)
        self.fit = np.zeros(0, bool)
        self.own: dict[int, bool] = {}
        self.kept = kept
        self._clear()

    def _clear(self) -> None:
        """An empty table of words, or the better half by use of a full one."""
        old = getattr(self, "index", {})
        keep = []
        if old:
            often = np.argsort(-self.used, kind="stable")[: self.kept // 2]
            names = list(old)
            keep = [(names[i], self.flat[self.starts[i] : self.starts[i] + self.counts[i]].tolist()) for i in np.sort(often[self.used[often] > 1]) if names[i] not in self.special and len(names[i]) < LONG_WORD]
        self.index = _Words()
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)
        self.used = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)
        self.letters_kept = 0
        self.decoded: list[bytes] = []
        kept = [*((t, [i]) for t, i in self.special.items()), *keep]
        for w, _ in kept:
            self.index[w] = len(self.index)
        self._append([w for w, _ in kept], [x for _, x in kept])

    def _symbols(self, text: str, end: bool) -> list[int]:
        units = list(text)
        if end and units:
            units[-1] += self.end
        return [self.vocab[u] for u in units if u in self.vocab]

    def merged(self, ids: list[int]) -> list[int]:
        """The exact encoding: the pair of lowest rank merges first, the leftmost of equals."""
        get, none = self.rank.get, len(self.made)
        if len(ids) >= LONG_WORD:
            return self._merged_long(ids)
        ranks = [get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            low = min(ranks)
            if low == none:
                break
            k = ranks.index(low)
            ids[k : k + 2] = [self.made[low]]
            del ranks[k]
            if k:
                ranks[k - 1] = get((ids[k - 1], ids[k]), none)
            if k < len(ranks):
                ranks[k] = get((ids[k], ids[k + 1]), none)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """`merged` over a heap of pairs and a linked list of symbols."""
        get, n = self.rank.get, len(ids)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(rank, k) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if (rank := get(p)) is not None]
        heapify(heap)
        while heap:
            rank, k = heappop(heap)
            mate = after[k]
            # What an earlier merge has changed was pushed again.
            if ids[k] < 0 or mate < 0 or get((ids[k], ids[mate])) != rank:
                continue
            ids[k], ids[mate] = self.made[rank], -1
            after[k] = after[mate]
            if after[k] >= 0:
                before[after[k]] = k
                if (rank := get((ids[k], ids[after[k]]))) is not None:
                    heappush(heap, (rank, k))
            if before[k] >= 0 and (rank := get((ids[before[k]], ids[k]))) is not None:
                heappush(heap, (rank, before[k]))
        return [x for x in ids if x >= 0]

    def exact(self, word: str) -> list[int]:
        return self.merged(self._symbols("".join(self.letters[b] for b in word.encode()), True))

    def _spelt(self, token: int) -> list[int]:
        text = self.token[token]
        end = text.endswith(self.end) and text != self.end
        return self._symbols(text.removesuffix(self.end) if end else text, end)

    def proposal(self, word: str) -> list[int] | None:
        """Greedy longest match; None where some character has no token."""
        text = word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()])
        vocab, longest, out, at, n = self.vocab, self.longest, [], 0, len(text)
        while at < n:
            most = longest.get(text[at : at + 2], 1)
            if n - at <= most:
                got = vocab.get(text[at:] + self.end)
                if got is not None:
                    out.append(got)
                    break
            for stop in range(min(n - 1, at + most), at, -1):
                got = vocab.get(text[at:stop])
                if got is not None:
                    out.append(got)
                    at = stop
                    break
            else:
                return None
        return out

    def _fits(self, code: int) -> bool:
        a, b = divmod(code, self.size)
        return self.merged(self._spelt(a) + self._spelt(b)) == [a, b]

    def _compatible(self, codes: np.ndarray) -> np.ndarray:
        """Which ascending pair codes are compatible; each is decided once while the table of pairs lasts."""
        at = np.minimum(np.searchsorted(self.pairs, codes), max(0, len(self.pairs) - 1))
        new = codes[self.pairs[at] != codes] if len(self.pairs) else codes
        if len(new):
            if len(self.pairs) + len(new) > PAIRS_KEPT:
                self.pairs, self.fit, new = self.pairs[:0], self.fit[:0], codes
            fits = np.array([self._fits(int(c)) for c in new], bool)
            place = np.searchsorted(self.pairs, new)
            self.pairs, self.fit = np.insert(self.pairs, place, new), np.insert(self.fit, place, fits)
        return self.fit[np.searchsorted(self.pairs, codes)]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """Proposals for all, one test of all adjacent pairs, exact merges for those that fail."""
        ids = [self.proposal(w) for w in words]
        for i, tokens in enumerate(ids):
            if tokens is not None and len(tokens) == 1:
                t = tokens[0]
                if t not in self.own:
                    self.own[t] = self.merged(self._spelt(t)) == [t]
                if not self.own[t]:
                    ids[i] = None
        flat = np.array([t for x in ids if x for t in x], np.int64)
        of = np.repeat(np.arange(len(ids)), [len(x) if x else 0 for x in ids])
        if len(flat) > 1:
            pair = np.flatnonzero(of[1:] == of[:-1])
            code = flat[pair] * self.size + flat[pair + 1]
            every, back = np.unique(code, return_inverse=True)
            wrong = of[pair[~self._compatible(every)[back]]]
            for i in np.unique(wrong):
                ids[i] = None
        return [self.exact(w) if x is None else x for w, x in zip(words, ids, strict=True)]

    def _append(self, words: list[str], ids: list[list[int]]) -> None:
        counts = np.array([len(x) for x in ids], np.int64)
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(counts) - counts))
        self.counts = np.concatenate((self.counts, counts))
        self.used = np.concatenate((self.used, np.zeros(len(ids), np.int64)))
        self.flat = np.concatenate((self.flat, np.array([t for x in ids for t in x], np.uint32)))
        self.letters_kept += sum(map(len, words))
        self.decoded += [" ".join([self.token[t] for t in x]).encode() for x in ids]

    def words(self, text: str) -> list[str]:
        if self.split_special and any(s in text for s in self.special):
            parts = self.split_special.split(text)
            if len(parts) > 1:
                return [w for p in parts for w in ([p] if p in self.special else self._plain_words(p))]
        return self._plain_words(text)

    @staticmethod
    def _plain_words(text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _LATIN.findall(text.lower())
        text = unicodedata.normalize("NFC", text)
        # Letter by letter: the context rule of str.lower for a final sigma does not apply.
        return _ANY.findall(text.replace("Σ", "σ").lower())

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        """Token ids and decoded UTF-8 of each text."""
        if len(self.index) > self.kept or self.letters_kept > LETTERS_KEPT:
            self._clear()
        split = [self.words(t) for t in texts]
        sizes = np.array([len(x) for x in split], np.int64)
        at = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        if self.index.new:
            words, self.index.new = self.index.new, []
            self._append(words, self.encode_words(words))
        self.used += np.bincount(at, minlength=len(self.used))
        counts = self.counts[at]
        ends = np.cumsum(counts)
        place = np.arange(int(counts.sum())) + np.repeat(self.starts[at] - (ends - counts), counts)
        ids = self.flat[place]
        # A word of no token leaves no gap in the decoded text.
        decoded = self.decoded
        pieces = [decoded[i] for i in at.tolist()]
        word = np.concatenate(([0], np.cumsum(sizes)))
        token = np.concatenate(([0], ends))[word]
        for k in range(len(texts)):
            part = pieces[word[k] : word[k + 1]]
            if not counts[word[k] : word[k + 1]].all():
                part = [p for p in part if p]
            yield ids[token[k] : token[k + 1]], b" ".join(part)

    def decode(self, ids: np.ndarray) -> str:
        """Tokens joined by spaces: the vocabulary file names no decoder."""
        return " ".join([self.token[int(i)] for i in ids])


_LOADED: dict[str, WordBpe] = {}


def _loaded(spec: str) -> WordBpe:
    """One per worker process and vocabulary."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = WordBpe(spec)
    return _LOADED[key]


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def _run(docs: DataFrame, spec: str, id_col: str, text_col: str, what, shape: str, names: list[str], kinds: list[pa.DataType]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(spec)
    picked = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(sent.value)
        for b in batches:
            for lo, hi, _, _ in tb.slices(b.column(1)):
                rows = [what(ids, text) for ids, text in bpe.encode(b.column(1).slice(lo, hi - lo).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=[id_col, *names])

    return tb.in_batches(picked, run, f"{id_col} {picked.schema[0].dataType.simpleString()}, {shape}")


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every text."""

    def what(ids: np.ndarray, text: bytes) -> tuple:
        return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()

    return _run(docs, read_spec(vocabulary), id_col, text_col, what, "n_tokens long, ids_sha256 string, decoded_sha256 string", ["n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.string(), pa.string()])


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded) of every text."""
    return _run(docs, read_spec(vocabulary), id_col, text_col, lambda ids, text: (ids.tolist(), text.decode()), "ids array<int>, decoded string", ["ids", "decoded"], [pa.list_(pa.int32()), pa.string()])
