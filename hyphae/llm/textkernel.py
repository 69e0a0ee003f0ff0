"""Vectorised text primitives shared by the training-data operators.

A chunk of texts is laid end to end as one array of code points, so that word
boundaries, word hashes and n-gram hashes of thousands of documents come out of
a handful of numpy passes instead of a Python loop per document.

"Word" is a maximal run of letters and digits of the text in form NFKC, without
the five invisible characters below, in lower case.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Zero-width space, non-joiner, joiner, byte order mark, soft hyphen.
INVISIBLE = dict.fromkeys((0x200B, 0x200C, 0x200D, 0xFEFF, 0x00AD))
_INVISIBLE = [chr(c) for c in INVISIBLE]

#: Characters laid end to end at once; a longer single text is one chunk of its own.
CHUNK_CHARS = 600_000

CODE_POINTS = 0x110000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def word_chars() -> np.ndarray:
    """For every code point: is it a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(CODE_POINTS)), bool, CODE_POINTS)


@lru_cache(maxsize=1)
def char_values() -> np.ndarray:
    return mix64(np.arange(1, CODE_POINTS + 1, dtype=_U) * _U(_BASE))


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for base in (_BASE, _INVERSE):
            a = np.full(size, base, _U)
            a[0] = 1
            out.append(np.multiply.accumulate(a))
        if size > 8 * CHUNK_CHARS:  # one giant text must not pin its tables
            return out[0][:n], out[1][:n]
        _powers[:] = out
    return _powers[0][:n], _powers[1][:n]


def normalise(text: str | None) -> str:
    """NFKC, invisible characters removed, lower case; null gives the empty text."""
    if text is None:
        return ""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFKC", text)
    for c in _INVISIBLE:  # five searches take a hundredth of the time of translate(), which looks up every character
        text = text.replace(c, "")
    return text.lower()


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters together; every text whole."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t) + 1
        if i > lo and size + n > most:
            yield lo, i
            lo, size = i, 0
        size += n
    if lo < len(texts):
        yield lo, len(texts)


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each followed by a line feed, and where each text begins."""
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)), out=at[1:])
    return codes, at


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of codes[start:end], from one running polynomial sum."""
    up, down = powers(len(codes) + 1)
    total = np.zeros(len(codes) + 1, _U)
    np.cumsum(char_values()[codes] * up[: len(codes)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U))


@dataclass
class Words:
    """Words of a chunk of texts: hashes in text order, and how many each text has."""

    hashes: np.ndarray
    counts: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def words(normalised: list[str]) -> Words:
    codes, at = lay_out(normalised)
    flag = np.zeros(len(codes) + 1, np.int8)
    flag[1:] = word_chars()[codes]
    step = np.diff(flag)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)  # a chunk ends with a line feed
    return Words(span_hashes(codes, starts, ends), np.diff(np.searchsorted(starts, at)), starts, ends)


def ngram_hashes(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words inside one text, with the text of each, in order."""
    size = len(w.hashes) - n + 1
    if size <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    doc = w.doc
    inside = doc[:size] == doc[n - 1 :]
    h = np.zeros(size, _U)
    for k in range(n):
        h = h * _U(_BASE) + w.hashes[k : k + size]
    return mix64(h[inside]), doc[:size][inside]


def distinct_ngrams(w: Words, n: int, bits: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of each text as hashes of `bits` bits: (hash, text), sorted by text, then hash."""
    h, doc = ngram_hashes(w, n)
    key = np.sort((doc.astype(_U) << _U(bits)) | (h >> _U(64 - bits)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key & _U((1 << bits) - 1), (key >> _U(bits)).astype(np.int64)
