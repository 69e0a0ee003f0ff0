"""Evaluation passages inside a training corpus.

Document and items are cut into windows of `window` words, which are compared
by weighted similarity of their two-word shingles, a shingle weighing more the
fewer item windows hold it. Candidates are found without loss: windows of
similarity t have at least t of the weight of either in common. So a document
window counts only if t of its weight is known to the items, and it shares one
of the rarest shingles of the item window, those that together exceed 1 - t of
its weight. A SimHash can't do that: windows of 12 words that share 10 of 11
shingles differ in about 8 of 64 bits.

Equal windows, and windows within an explicit `radius`, are found by a 64-bit
SimHash: fingerprints within `radius` bits agree exactly in at least one of
radius + 1 blocks, so looking each block up finds all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyphae.llm.textkernel import Words, chunks, mix64, normalise, words

FINGERPRINT = 64
#: Characters of item text that one index holds on average; more items are taken in blocks.
BLOCK_CHARS = 20_000_000
#: Buckets of the count of shingles over all items: a fixed size, whatever the items.
COUNT_BITS = 20
#: Pairs of windows that are looked at together, so that repeated words on both sides don't fill the memory.
PAIRS_AT_ONCE = 500_000
_U = np.uint64


def shingles(w: Words) -> np.ndarray:
    """Hash of each word with the next one, by position of the first."""
    return mix64(w.hashes[:-1] * _U(0x9E3779B97F4A7C15) + w.hashes[1:]) if len(w.hashes) > 1 else np.zeros(0, _U)


def windows(w: Words, size: int) -> np.ndarray:
    """Positions where a run of `size` words lies inside one text."""
    n = len(w.hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    doc = w.doc
    return np.flatnonzero(doc[:n] == doc[size - 1 :])


def simhashes(pairs: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the size - 1 shingles from each position, by differences of running sums.

    The sums wrap around in eight bits; a difference of at most 126 votes doesn't.
    """
    if not len(at):
        return np.zeros(0, _U)
    votes = np.unpackbits(pairs.view(np.uint8).reshape(-1, 8), axis=1).view(np.int8) * np.int8(2) - np.int8(1)
    total = np.zeros((len(pairs) + 1, FINGERPRINT), np.int8)
    np.cumsum(votes, axis=0, dtype=np.int8, out=total[1:])
    span = size - 1
    won = (total[span:] - total[:-span])[at] > 0
    return np.packbits(won, axis=1).view(_U).ravel()


def bucket(shingle: np.ndarray) -> np.ndarray:
    return (shingle >> _U(64 - COUNT_BITS)).astype(np.int64)


def count_windows(texts: list[str], window: int) -> np.ndarray:
    """How many item windows hold a shingle, by bucket; the last value is the number of windows."""
    w = words([normalise(t) for t in texts])
    p, at = shingles(w), windows(w, window)
    held = np.sort(p[at[:, None] + np.arange(window - 1)], axis=1) if len(at) else np.zeros((0, window - 1), _U)
    first = np.ones(held.shape, bool)
    first[:, 1:] = held[:, 1:] != held[:, :-1]
    return np.append(np.bincount(bucket(held[first]), minlength=1 << COUNT_BITS), len(at))


def expand(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start, start + 1, … for n places of each."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def pieces(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of which each holds about PAIRS_AT_ONCE of the n in all, a row at least; empty ones are left out."""
    total = np.cumsum(n)
    lo, done = 0, 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(total, done + PAIRS_AT_ONCE, "right")))
        if total[hi - 1] > done:
            yield lo, hi
        lo, done = hi, total[hi - 1]


@dataclass
class ItemIndex:
    """Item windows, sorted once for each block of the fingerprint."""

    window: int
    radius: int
    item: np.ndarray  # item of each window
    words: np.ndarray  # (windows, window) word hashes
    pairs: np.ndarray  # (windows, window - 1) shingle hashes
    prints: np.ndarray
    known: np.ndarray  # distinct shingles of these items, sorted
    counts: np.ndarray  # windows of all items, in this index or not, by bucket of their shingles; how many there are

    @staticmethod
    def build(item_ids: list, texts: list[str], window: int, radius: int, counts: np.ndarray | None = None) -> ItemIndex:
        w = words([normalise(t) for t in texts])
        p, at = shingles(w), windows(w, window)
        spread = at[:, None] + np.arange(window)
        pairs = p[spread[:, :-1]] if len(at) else np.zeros((0, window - 1), _U)
        known = np.unique(pairs)
        counts = count_windows(texts, window) if counts is None else counts
        return ItemIndex(window, radius, w.doc[at], w.hashes[spread] if len(at) else np.zeros((0, window), _U), pairs, simhashes(p, at, window), known, counts)

    def __post_init__(self) -> None:
        cut = [FINGERPRINT * k // (self.radius + 1) for k in range(self.radius + 2)]
        self.blocks = []
        for lo, hi in zip(cut, cut[1:]):
            part = (self.prints >> _U(lo)) & _U((1 << (hi - lo)) - 1)
            order = np.argsort(part, kind="stable")
            present = np.zeros(1 << 22, bool)
            present[part & _U((1 << 22) - 1)] = True
            self.blocks.append((lo, hi, part[order], order, present))

    def candidates(self, prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (fingerprint, item window) within the radius, each once, in pieces of about PAIRS_AT_ONCE; a fingerprint is in one piece."""
        spans = []
        for lo, hi, part, order, present in self.blocks:
            own = (prints >> _U(lo)) & _U((1 << (hi - lo)) - 1)
            a = b = np.zeros(len(prints), np.int64)
            at = np.flatnonzero(present[own & _U((1 << 22) - 1)])
            a, b = a.copy(), b.copy()
            a[at], b[at] = np.searchsorted(part, own[at], "left"), np.searchsorted(part, own[at], "right")
            spans.append((order, a, b - a))
        for lo, hi in pieces(sum(n for *_, n in spans)):
            found = []
            for order, a, n in spans:
                d = np.repeat(np.arange(lo, hi), n[lo:hi])
                i = order[expand(a[lo:hi], n[lo:hi])]
                near = np.bitwise_count(prints[d] ^ self.prints[i]) <= self.radius
                found.append(d[near] * len(self.prints) + i[near])
            key = np.unique(np.concatenate(found))
            yield key // len(self.prints), key % len(self.prints)

    def weigh(self, shingle: np.ndarray) -> np.ndarray:
        """Weight of a shingle: more, the fewer windows of all items hold it. The same in every index."""
        return np.log1p(max(1, int(self.counts[-1])) / np.maximum(1, self.counts[bucket(shingle)]))

    def rarest(self, t: float) -> tuple[np.ndarray, np.ndarray]:
        """(shingle, item window), sorted: the shingles of each window of which any window of similarity t shares one."""
        p = np.sort(self.pairs, axis=1)
        w = self.weigh(p)
        w[:, 1:][p[:, 1:] == p[:, :-1]] = 0
        by = np.argsort(-w, axis=1, kind="stable")
        p, w = np.take_along_axis(p, by, 1), np.take_along_axis(w, by, 1)
        left = np.cumsum(w[:, ::-1], axis=1)[:, ::-1]
        i, k = np.nonzero((left >= t * (1 - 1e-9) * left[:, :1]) & (w > 0))
        shingle = p[i, k]
        by = np.argsort(shingle, kind="stable")
        return shingle[by], i[by]

    def sharing(self, p: np.ndarray, at: np.ndarray, t: float, rarest: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All (window of `at`, item window) that may have similarity t, each once, in pieces of about PAIRS_AT_ONCE; a window is in one piece."""
        if not len(self.known) or not len(at):
            return
        span = self.window - 1
        k = np.minimum(np.searchsorted(self.known, p), len(self.known) - 1)
        is_known = self.known[k] == p
        weight = self.weigh(p)
        total = np.concatenate(([0], np.cumsum(np.where(is_known, weight, 0))))
        strange = np.concatenate(([0], np.cumsum(np.where(is_known, 0, weight))))
        known, unknown = total[at + span] - total[at], strange[at + span] - strange[at]
        # windows that repeat an unknown shingle have less unknown weight than counted, so they stay
        odd = np.flatnonzero(~is_known)
        by = odd[np.argsort(p[odd], kind="stable")]
        near = (p[by[1:]] == p[by[:-1]]) & (by[1:] - by[:-1] < span)
        last = np.full(len(p) + 1, -1)
        last[by[1:][near]] = by[:-1][near]
        repeats = np.zeros(len(at), bool)
        if near.any():
            for x in range(span):
                repeats |= last[at + x] >= at
        d = np.flatnonzero((known > 0) & (repeats | (known >= t * (1 - 1e-9) * (known + unknown) - 1e-9)))
        for lo in range(0, len(d), 5_000):
            own = d[lo : lo + 5_000]
            shingle = p[at[own][:, None] + np.arange(span)]
            a, n = np.searchsorted(rarest[0], shingle, "left"), np.searchsorted(rarest[0], shingle, "right")
            n -= a
            for x, y in pieces(n.sum(1)):
                i = rarest[1][expand(a[x:y].ravel(), n[x:y].ravel())]
                key = np.unique(np.repeat(np.repeat(own[x:y], span), n[x:y].ravel()) * len(self.prints) + i)
                yield key // len(self.prints), key % len(self.prints)

    def similarity(self, own: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Weight of common shingles over weight of all, window against window."""
        out = np.zeros(len(own))
        for lo in range(0, len(own), 20_000):
            a, b = np.sort(own[lo : lo + 20_000], axis=1), np.sort(self.pairs[item[lo : lo + 20_000]], axis=1)
            first_a = np.concatenate((np.ones((len(a), 1), bool), a[:, 1:] != a[:, :-1]), axis=1)
            first_b = np.concatenate((np.ones((len(b), 1), bool), b[:, 1:] != b[:, :-1]), axis=1)
            wa, wb = self.weigh(a) * first_a, self.weigh(b) * first_b
            common = (wa * (a[:, :, None] == b[:, None, :]).any(2)).sum(1)
            out[lo : lo + 20_000] = common / (wa.sum(1) + wb.sum(1) - common)
        return out


def find_leaks(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = 12, radius: int | None = None, min_similarity: float = 0.8, exact: bool = False, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc, item, windows, similarity): documents that hold passages of evaluation items.

    A row for each document and item with at least one pair of windows of
    `window` words whose weighted shingle similarity is at least
    `min_similarity`; all such pairs are found, unless a `radius` leaves only
    those whose fingerprints differ in at most so many bits. `windows` counts
    the document's windows that match, `similarity` is the best. With `exact` a
    pair counts only if all its words agree, in order. Null and empty texts and
    texts shorter than a window hold nothing; repeated rows count once (counts
    are those of one of them); other columns are ignored.

    The corpus is scanned once per block of items and shuffles only matches.
    The item index travels to the tasks; a block holds about `block_chars`
    characters of items (or one item), so what travels doesn't grow with the
    items either. Shingles are counted once over all items, in 2**COUNT_BITS
    buckets, so weights and results are the same however the items are cut.
    """
    if not 2 <= window <= 127 or radius is not None and not 0 <= radius <= 15:
        raise ValueError("window must be 2 to 127 words, radius 0 to 15 bits")
    own = items.select(F.col(item_id_col).alias("item"), F.col(item_text_col).alias("text")).where("item is not null and text is not null").distinct()
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    counts = _counts(own, window)
    doc_type, item_type = docs.schema[id_col].dataType, items.schema[item_id_col].dataType
    schema = T.StructType([T.StructField(id_col, doc_type), T.StructField(item_id_col, item_type), T.StructField("windows", T.LongType()), T.StructField("similarity", T.DoubleType())])
    corpus = docs.select(F.col(id_col), F.col(text_col).alias("__text")).where(f"`{id_col}` is not null and __text is not null")
    out = None
    for k in range(blocks):
        rows = own.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect() if blocks > 1 else own.collect()
        rows.sort(key=lambda r: (str(r["item"]), r["text"]))
        ids = [r["item"] for r in rows]
        index = ItemIndex.build(ids, [r["text"] for r in rows], window, 2 if radius is None else radius, counts)
        part = corpus.mapInArrow(_scan(index, ids, schema, min_similarity, exact, radius is None and not exact), schema)
        out = part if out is None else out.unionByName(part)
    return out.groupBy(id_col, item_id_col).agg(F.max("windows").alias("windows"), F.max("similarity").alias("similarity"))


def _counts(items: DataFrame, window: int) -> np.ndarray:
    """Windows of all items by bucket of their shingles: at most 2**COUNT_BITS + 1 rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << COUNT_BITS) + 1, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                total += count_windows(texts[lo:hi], window)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["b", "n"])

    found = items.select("text").mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((1 << COUNT_BITS) + 1, np.int64)
    counts[found.column("b").to_numpy()] = found.column("n").to_numpy()
    return counts


def _scan(index: ItemIndex, ids: list, schema: T.StructType, min_similarity: float, exact: bool, lossless: bool):
    if lossless and min_similarity <= 0:
        raise ValueError("min_similarity must be above 0 unless a radius is given")
    rarest = index.rarest(min_similarity) if lossless and len(index.prints) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        for batch in batches:
            if not len(index.prints):
                continue
            texts, names = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo, hi in chunks(texts):
                w = words([normalise(t) for t in texts[lo:hi]])
                p, at = shingles(w), windows(w, index.window)
                if not len(at):
                    continue
                found = index.sharing(p, at, min_similarity, rarest) if lossless else index.candidates(simhashes(p, at, index.window))
                parts = []
                for d, i in found:
                    if exact:
                        same = (w.hashes[at[d][:, None] + np.arange(index.window)] == index.words[i]).all(1)
                        d, i = d[same], i[same]
                    s = index.similarity(p[at[d][:, None] + np.arange(index.window - 1)], i)
                    d, i, s = d[s >= min_similarity], i[s >= min_similarity], s[s >= min_similarity]
                    if len(d):
                        pair = w.doc[at[d]] * len(ids) + index.item[i]
                        one, inverse = np.unique(pair, return_inverse=True)
                        best = np.zeros(len(one))
                        np.maximum.at(best, inverse, s)
                        # a window of the document is in one piece, so pieces add up
                        parts.append((one, np.bincount(np.unique(np.stack((inverse, d)), axis=1)[0], minlength=len(one)), best))
                if not parts:
                    continue
                each, inverse = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
                hits = np.bincount(inverse, weights=np.concatenate([x[1] for x in parts]), minlength=len(each))
                best = np.zeros(len(each))
                np.maximum.at(best, inverse, np.concatenate([x[2] for x in parts]))
                yield pa.RecordBatch.from_arrays([pa.array([names[lo + x] for x in (each // len(ids)).tolist()], arrow.field(0).type), pa.array([ids[x] for x in (each % len(ids)).tolist()], arrow.field(1).type), pa.array(hits.astype(np.int64)), pa.array(best)], schema=arrow)

    return run
