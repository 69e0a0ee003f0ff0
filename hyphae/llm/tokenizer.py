"""Byte-level BPE encoding of a corpus with a public rank table.

Pre-tokens are cut by array operations on character classes; every pre-token
that a worker hasn't met is merged on a segment tree: leaf i holds the rank of
the pair that begins at byte i, an inner node the smaller of its children, with
the position in the low bits, so that the root is the leftmost pair of minimum
rank. A merge changes three leaves (the pair before, the merged one, the one
used up) and their paths to the root. Many short pre-tokens are merged side by
side, one tree a row; long ones one at a time.

Empty and null texts give an empty list of ids; a blank text is encoded as any
other. Texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hyphae.llm.textkernel import CODE_POINTS, chunks, lay_out, span_hashes

#: Where the public vocabulary files lie, unless a caller names another folder.
TOKENIZER_DIR = "/opt/tokenizers"

#: Code points with the Unicode property White_Space.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

OTHER, LETTER, NUMBER, SPACE, BREAK = range(5)
POSITION_BITS = 32
NO_PAIR = np.iinfo(np.int64).max
#: Slots of a worker's table of known pre-tokens; it starts anew when half full.
SLOTS = 1 << 21
#: Bytes up to which equal-sized pre-tokens share one matrix of trees.
SIDE_BY_SIDE = 256


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(i))[0], OTHER) for i in range(CODE_POINTS)), np.int8, CODE_POINTS)
    table[WHITE_SPACE] = SPACE
    return table


def pretoken_starts(codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokens of texts laid end to end.

    The cut is that of the byte-level pattern: an optional space with a run of
    letters, of numbers or of other signs; English contractions; and of white
    space all but a last sign that the next run takes or stands alone.
    """
    cls = char_classes()[codes]
    cls[at[1:] - 1] = BREAK
    first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
    # two breaks in a row (empty texts) form one run, which holds no token
    kind, end = cls[first], np.append(first[1:], len(cls))
    start = np.zeros(len(cls) + 1, bool)
    start[first[kind != BREAK]] = True
    start[first[kind == BREAK]] = True  # ends the token before
    following = np.append(kind[1:], BREAK)
    held = (kind == SPACE) & (following != BREAK)
    last = end[held] - 1
    start[last] = True
    takes = codes[last] == 32
    start[last[takes] + 1] = False
    # contractions: a lone apostrophe that no space was put before, then letters
    size = end - first
    before = np.concatenate(([0], codes[:-1]))[first]
    quote = np.flatnonzero((kind == OTHER) & (size == 1) & (codes[first] == 39) & (following == LETTER) & ((before != 32) | np.isin(first, at)))
    if len(quote):
        run = quote + 1
        a = codes[first[run]]
        b = np.where(size[run] > 1, codes[np.minimum(first[run] + 1, len(codes) - 1)], 0)
        one = np.isin(a, [ord(c) for c in "sdmt"])
        two = ~one & (((a == ord("l")) & (b == ord("l"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("r")) & (b == ord("e"))))
        for which, length in ((one, 1), (two, 2)):
            p, n = first[run[which]], size[run[which]]
            start[p] = False
            start[p[n > length] + length] = True
    begins = np.flatnonzero(start[:-1])
    ends = np.append(begins[1:], len(cls))
    real = cls[begins] != BREAK
    return begins[real], ends[real]


class RankTable:
    """Ranks of a byte-level vocabulary and the pairs that merge into them."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs: dict[int, int] = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank
        self._keys = np.sort(np.fromiter(self.pairs, np.int64, len(self.pairs)))
        self._found = np.array([self.pairs[k] for k in self._keys.tolist()], np.int64)

    def pair_keys(self, left: np.ndarray, right: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Rank of each pair with its position in the low bits; NO_PAIR where the pair doesn't merge."""
        key = left << 32 | right
        i = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[i] == key, self._found[i] << POSITION_BITS | position, NO_PAIR)

    def merge_one(self, token: bytes) -> list[int]:
        """Ids of one pre-token, merged on one segment tree."""
        n = len(token)
        ids = self.byte_ids[list(token)].tolist()
        if n == 1:
            return ids
        width = 1 << (n - 1).bit_length()
        tree = [NO_PAIR] * (2 * width)
        pairs = self.pairs

        def pair(p: int, q: int) -> int:
            rank = pairs.get(ids[p] << 32 | ids[q])
            return NO_PAIR if rank is None else rank << POSITION_BITS | p

        for p in range(n - 1):
            tree[width + p] = pair(p, p + 1)
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def put(p: int, value: int) -> None:
            node = width + p
            tree[node] = value
            while node > 1:
                node >>= 1
                low = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == low:
                    break
                tree[node] = low

        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (best := tree[1]) != NO_PAIR:
            p = best & ((1 << POSITION_BITS) - 1)
            q = after[p]
            ids[p], after[p] = best >> POSITION_BITS, after[q]
            ids[q] = -1
            put(q, NO_PAIR)
            if after[p] < n:
                before[after[p]] = p
                put(p, pair(p, after[p]))
            else:
                put(p, NO_PAIR)
            if before[p] >= 0:
                put(before[p], pair(before[p], p))
        return [i for i in ids if i >= 0]

    def merge_many(self, tokens: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens of at most SIDE_BY_SIDE bytes, one tree a row."""
        width = 1 << max(0, max(map(len, tokens)) - 1).bit_length()
        rows, length = len(tokens), np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in tokens), np.uint8).reshape(rows, width)
        ids = np.where(np.arange(width) < length[:, None], self.byte_ids[raw], -1)
        if width > 1:
            tree = np.full((rows, 2 * width), NO_PAIR, np.int64)
            places = np.broadcast_to(np.arange(width - 1), (rows, width - 1))
            tree[:, width : 2 * width - 1] = np.where(ids[:, 1:] >= 0, self.pair_keys(ids[:, :-1], np.maximum(ids[:, 1:], 0), places), NO_PAIR)
            level = width
            while level > 1:
                level >>= 1
                tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
            after = np.broadcast_to(np.arange(1, width + 1), (rows, width)).copy()
            before = np.broadcast_to(np.arange(-1, width - 1), (rows, width)).copy()
            row = np.flatnonzero(tree[:, 1] != NO_PAIR)
            while len(row):
                best = tree[row, 1]
                p = best & ((1 << POSITION_BITS) - 1)
                q = after[row, p]
                beyond = after[row, q]
                ids[row, p], ids[row, q] = best >> POSITION_BITS, -1
                after[row, p] = beyond
                more = beyond < length[row]
                before[row[more], beyond[more]] = p[more]
                self._put(tree, width, row, q, np.full(len(row), NO_PAIR))
                right = np.where(more, ids[row, np.minimum(beyond, width - 1)], 0)
                self._put(tree, width, row, p, np.where(more, self.pair_keys(ids[row, p], right, p), NO_PAIR))
                o = before[row, p]
                some = o >= 0
                if some.any():
                    r, o, p = row[some], o[some], p[some]
                    self._put(tree, width, r, o, self.pair_keys(ids[r, o], ids[r, p], o))
                row = row[tree[row, 1] != NO_PAIR]
        flat, kept = ids[ids >= 0].tolist(), (ids >= 0).sum(1).cumsum().tolist()
        return [flat[a:b] for a, b in zip([0, *kept[:-1]], kept)]

    @staticmethod
    def _put(tree: np.ndarray, width: int, row: np.ndarray, leaf: np.ndarray, value: np.ndarray) -> None:
        node = leaf + width
        tree[row, node] = value
        while node[0] > 1:
            node = node >> 1
            tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])

    def merge(self, tokens: list[bytes]) -> list[list[int]]:
        out: list[list[int]] = [[] for _ in tokens]
        classes: dict[int, list[int]] = {}
        for i, t in enumerate(tokens):
            classes.setdefault((len(t) - 1).bit_length() if len(t) <= SIDE_BY_SIDE else 99, []).append(i)
        for size, group in classes.items():
            if size == 99 or len(group) < 8:
                for i in group:
                    out[i] = self.merge_one(tokens[i])
            else:
                step = max(8, (1 << 20) >> size)
                for lo in range(0, len(group), step):
                    part = group[lo : lo + step]
                    for i, ids in zip(part, self.merge_many([tokens[i] for i in part])):
                        out[i] = ids
        return out


class Encoder:
    """Encodes chunks of texts; remembers pre-tokens in an open-addressing table of fixed size."""

    def __init__(self, ranks: RankTable):
        self.ranks = ranks
        self._forget()

    def _forget(self) -> None:
        self.keys, self.entry = np.zeros(SLOTS, np.uint64), np.full(SLOTS, -1, np.int32)
        self.offset, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Entry of each hash, or -1."""
        slot = (h >> np.uint64(43)).astype(np.int64)
        got = np.where(self.keys[slot] == h, self.entry[slot], -1)
        open_ = np.flatnonzero((self.keys[slot] != h) & (self.entry[slot] >= 0))
        at = slot[open_]
        while len(open_):
            at = (at + 1) & (SLOTS - 1)
            hit = self.keys[at] == h[open_]
            got[open_[hit]] = self.entry[at[hit]]
            on = ~hit & (self.entry[at] >= 0)
            open_, at = open_[on], at[on]
        return got

    def _learn(self, h: np.ndarray, tokens: list[bytes]) -> None:
        ids = self.ranks.merge(tokens)
        base = len(self.offset) - 1
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        self.offset = np.concatenate((self.offset, self.offset[-1] + np.cumsum(lengths)))
        self.flat = np.concatenate((self.flat, np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum()))))
        left, at = np.arange(len(h)), (h >> np.uint64(43)).astype(np.int64)
        while len(left):
            free = self.entry[at] < 0
            # of several that want one free slot the first gets it
            _, winner = np.unique(at[free], return_index=True)
            w = np.flatnonzero(free)[winner]
            self.keys[at[w]], self.entry[at[w]] = h[left[w]], base + left[w]
            stay = np.ones(len(left), bool)
            stay[w] = False
            left, at = left[stay], (at[stay] + 1) & (SLOTS - 1)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and the number of ids of each text."""
        codes, at = lay_out(texts)
        begins, ends = pretoken_starts(codes, at)
        h = span_hashes(codes, begins, ends)
        entry = self._find(h)
        offset, flat = self.offset, self.flat
        new = np.flatnonzero(entry < 0)
        if len(new):
            whole = "\n".join(texts) + "\n"
            spell = lambda at: [whole[begins[i] : ends[i]].encode("utf-8", "surrogatepass") for i in at.tolist()]
            fresh, first = np.unique(h[new], return_index=True)
            if len(fresh) > SLOTS // 8:  # one vast text: merged for itself, not remembered
                _, first, entry = np.unique(h, return_index=True, return_inverse=True)
                merged = self.ranks.merge(spell(first))
                offset = np.concatenate(([0], np.cumsum(np.fromiter(map(len, merged), np.int64, len(merged)))))
                flat = np.fromiter((i for x in merged for i in x), np.int32, int(offset[-1]))
            else:
                if len(self.offset) + len(fresh) > SLOTS // 2:
                    self._forget()
                    fresh, first = np.unique(h, return_index=True)
                    new = np.arange(len(h))
                self._learn(fresh, spell(new[first]))
                entry, offset, flat = self._find(h), self.offset, self.flat
        lengths = offset[entry + 1] - offset[entry]
        total = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(offset[entry] - total[:-1], lengths) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(begins, at)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(RankTable(path))


def encode_corpus(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k", tokenizer_dir: str = TOKENIZER_DIR) -> DataFrame:
    """(id, ids): the token ids of every row's text, without special tokens.

    One row out for every row in, repeated ids included. A null or an empty text
    gives an empty list. Other columns of `docs` are ignored, whatever their
    names. No shuffle: the whole operator is one narrow pass over the scan.
    """
    path = f"{tokenizer_dir}/{vocabulary}.tiktoken"
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for lo, hi in chunks(texts):
                ids, counts = enc.encode(texts[lo:hi])
                offsets = np.zeros(hi - lo + 1, np.int32)
                np.cumsum(counts, out=offsets[1:])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)
