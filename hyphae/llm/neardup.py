"""Near-duplicate documents: a lossless set-similarity join, vertically partitioned.

Every text is the set of its runs of `n` words. All n-grams stand in one global
order, rare ones first, that is cut into fragments; each fragment is joined by
itself and counts the partial overlap of every pair in it, and the counts are
summed per pair over the fragments.

What keeps this small:

* Texts of one n-gram set are one class from the start; classes are joined, and
  copies only meet again when the result is spelled out.
* The order comes from a sketch of n-gram counts over the whole corpus, of fixed
  size. Its errors cost time, never pairs: any order gives the same result.
* A pair of sizes a and b reaches the threshold only if it shares a gram at a
  position i of the first and j of the second with enough grams left after
  both, so gram i of a set of size a only meets sets of at most
  (a - i)(1 + t) / t - a grams. Within a gram's list, sorted by size, these are
  one run.
* Each set carries a parity bitmap of its grams. The bits in which two bitmaps
  differ are at most the grams in which the sets differ, which bounds the
  overlap from above before a pair leaves its fragment.

The summed overlaps make the candidates: grams that can't be the first common
ones of a pair aren't counted, so a sum is a lower bound. Candidates are then
checked exactly on their whole sets.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyphae.llm.textkernel import chunks, distinct_ngrams, mix64, normalise, words
from hyphae.session import cores, written

_U = np.uint64
GRAM_BITS = 40
#: The count sketch: buckets (fixed, so what is collected and sent out is too) and slices for summing it.
SKETCH_BITS, SLICES = 22, 64
#: The membership filter over candidate classes, of fixed size.
FILTER_BITS = 23
#: Postings that a fragment should hold, and pairs that are enumerated at once.
FRAGMENT_POSTINGS, PAIRS_AT_ONCE = 2_000_000, 2_000_000
#: Texts whose postings travel together.
TEXTS_TOGETHER = 4_000


def buckets(gram: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(gram) >> _U(64 - bits)).astype(np.int64)


def gram_sets(batch: pa.RecordBatch, n: int) -> Iterator[tuple[list, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of a batch (id, text): ids, size of each set, its signature, and all grams end to end."""
    names, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
    for lo, hi in chunks([t or "" for t in texts]):
        gram, doc = distinct_ngrams(words([normalise(t) for t in texts[lo:hi]]), n, GRAM_BITS)
        size = np.bincount(doc, minlength=hi - lo)
        ends = np.cumsum(size)
        total = np.concatenate((np.zeros(1, _U), np.cumsum(mix64(gram + _U(1)))))
        yield names[lo:hi], size, mix64(total[ends] - total[ends - size] + size.astype(_U)).view(np.int64), gram


def pack(gram: np.ndarray) -> bytes:
    return np.ascontiguousarray(gram.view(np.uint8).reshape(-1, 8)[:, : GRAM_BITS // 8].T).tobytes()


def unpack(body: bytes) -> np.ndarray:
    n = len(body) * 8 // GRAM_BITS
    out = np.zeros((n, 8), np.uint8)
    out[:, : GRAM_BITS // 8] = np.frombuffer(body, np.uint8).reshape(-1, n).T
    return out.view(_U).ravel()


def bitmap_class(size: np.ndarray) -> np.ndarray:
    """log2 of the 64-bit words in the bitmap of a set: about two bits a gram."""
    return np.clip(np.ceil(np.log2(np.maximum(size, 1) * 2 / 64)), 0, 8).astype(np.int64)


def bitmaps(gram: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parity bitmap of each set; sizes are powers of two, so that a larger one folds onto a smaller."""
    width = 64 << bitmap_class(size)
    base = np.concatenate(([0], np.cumsum(width)))
    bit = base[np.repeat(np.arange(len(size)), size)] + (mix64(gram ^ _U(0x5851F42D4C957F2D)) & (np.repeat(width, size) - 1).astype(_U)).astype(np.int64)
    odd = (np.bincount(bit, minlength=base[-1]) & 1).astype(np.uint8)
    raw = np.packbits(odd, bitorder="little").tobytes()
    return [raw[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist())]


class Join:
    """The threshold as a fraction p / q of the union."""

    def __init__(self, similarity: float):
        f = Fraction(similarity).limit_denominator(10_000)
        if not 0 < f <= 1:
            raise ValueError("similarity must be above 0 and at most 1")
        self.p, self.q = f.numerator, f.denominator

    def reach(self, size: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Largest partner that a gram at this position may be the first to meet."""
        return ((size - position) * (self.p + self.q)) // self.p - size

    def least(self, size: np.ndarray) -> np.ndarray:
        """Smallest partner of a set."""
        return -(-size * self.p // self.q)

    def enough(self, overlap: np.ndarray, together: np.ndarray) -> np.ndarray:
        return overlap * (self.p + self.q) >= self.p * together


#: Buckets that a task holds before it counts them, and tasks whose sketches are added first.
BUCKETS_HELD, TASKS_TOGETHER = 4_000_000, 64


def _first_task(n: int, id_type: pa.DataType):
    """Class of every text, and at the end the task's sketch in slices: one reading of the texts gives both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() // TASKS_TOGETHER
        count = np.zeros(1 << SKETCH_BITS, np.uint64)
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                count[:] += np.bincount(np.concatenate(held), minlength=1 << SKETCH_BITS).astype(np.uint64)
                held.clear()

        def rows(ids: list, sigs: np.ndarray, slices: list, bodies: list) -> pa.RecordBatch:
            a, b = len(ids), len(slices)
            return pa.RecordBatch.from_arrays([pa.array([*ids, *[None] * b], id_type), pa.array([*sigs.tolist(), *[None] * b], pa.int64()), pa.array([*[None] * a, *slices], pa.int32()), pa.array([*[None] * a, *[task] * b], pa.int32()), pa.array([*[None] * a, *bodies], pa.binary())], names=["id", "sig", "slice", "task", "body"])

        waiting = 0
        for batch in batches:
            for names, size, sig, gram in gram_sets(batch, n):
                held.append(buckets(gram, SKETCH_BITS).astype(np.int32))
                waiting += len(gram)
                if waiting >= BUCKETS_HELD:
                    add()
                    waiting = 0
                real = np.flatnonzero(size)
                yield rows([names[i] for i in real.tolist()], sig[real], [], [])
        add()
        if count.any():
            yield rows([], np.zeros(0, np.int64), list(range(SLICES)), [zlib.compress(x.tobytes(), 1) for x in np.split(count, SLICES)])

    return run


def _add_slices(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(b.as_py()), np.uint64) for b in t.column("body"))
    return pa.table({"slice": t.column("slice")[:1], "body": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})


def _level_slices(t: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(zlib.decompress(b.as_py()), np.uint64) for b in t.column("body"))
    level = np.minimum(255, 8 * np.log2(1 + total.astype(np.float64))).astype(np.uint8)
    return pa.table({"slice": t.column("slice")[:1], "body": pa.array([zlib.compress(level.tobytes(), 1)], pa.binary()), "grams": pa.array([int(total.sum())], pa.int64())})


def first_pass(corpus: DataFrame, n: int) -> tuple[DataFrame, np.ndarray, int, str]:
    """((id, sig), order, grams, folder): the class of every text of at least n words; for every bucket of grams the
    logarithm of its count over the whole corpus; the count of all grams; and the shared folder that holds the first.

    Sketches are added in two levels, so that what a task adds grows with the
    square root of the number of tasks.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = corpus.schema["id"].dataType
    out, path = written(corpus.mapInArrow(_first_task(n, to_arrow_type(kind)), f"id {kind.simpleString()}, sig long, slice int, task int, body binary"), "neardup-first")
    part = out.where("slice is not null").select("slice", "task", "body").groupBy("slice", "task").applyInArrow(_add_slices, "slice int, body binary")
    level = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint8)
    grams = 0
    for r in part.groupBy("slice").applyInArrow(_level_slices, "slice int, body binary, grams long").collect():
        level[r["slice"]] = np.frombuffer(zlib.decompress(bytes(r["body"])), np.uint8)
        grams += r["grams"]
    return out.where("slice is null").select("id", "sig").distinct(), level.ravel(), grams, path


def _postings_task(n: int, join: Join, order, fragments: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = order.value
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        texts = 0
        for batch in batches:
            for _, size, sig, gram in gram_sets(batch, n):
                held.append((size, sig, gram))
                texts += len(size)
                if texts >= TEXTS_TOGETHER:
                    yield from emit(held, level)
                    held, texts = [], 0
        if held:
            yield from emit(held, level)

    def emit(held: list, level: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, sig, gram = (np.concatenate([h[k] for h in held]) for k in range(3))
        # copies within these texts count once
        _, first = np.unique(sig, return_index=True)
        first = first[size[first] > 0]
        begin = np.cumsum(size) - size
        take = np.repeat(begin[first] - (np.cumsum(size[first]) - size[first]), size[first]) + np.arange(size[first].sum())
        size, sig, gram = size[first], sig[first], gram[take]
        if not len(size):
            return
        doc = np.repeat(np.arange(len(size)), size)
        rank = (level[buckets(gram, SKETCH_BITS)].astype(_U) << _U(GRAM_BITS)) | gram
        by = np.lexsort((rank, doc))
        rank = rank[by]
        position = np.arange(len(rank)) - np.repeat(np.cumsum(size) - size, size)
        reach = join.reach(size[doc], position)
        keep = reach >= join.least(size)[doc]
        maps = bitmaps(gram, size)
        rank, doc, reach = rank[keep], doc[keep], reach[keep]
        part = fragment_of(rank, fragments)
        by = np.lexsort((rank, part))
        rank, doc, reach, part = rank[by], doc[by], reach[by], part[by]
        cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out: dict[str, list] = {"fragment": [], "body": []}
        for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(part)]):
            here, local = np.unique(doc[a:b], return_inverse=True)
            gap = np.diff(rank[a:b], prepend=_U(0))
            parts = [np.array([len(here), b - a], np.int64).tobytes(), sig[here].tobytes(), size[here].astype(np.uint32).tobytes(), b"".join(maps[i] for i in here.tolist()), _planes(gap, 6), _planes(local.astype(_U), 2), _planes(reach[a:b].astype(_U), 4)]
            out["fragment"].append(int(part[a]))
            out["body"].append(zlib.compress(b"".join(parts), 1))
        yield pa.RecordBatch.from_arrays([pa.array(out["fragment"], pa.int32()), pa.array(out["body"], pa.binary())], names=["fragment", "body"])

    return run


def fragment_of(rank: np.ndarray, fragments: int) -> np.ndarray:
    """Fragment of each gram of the global order.

    Cuts run through every level of frequency at equal distances of the hash,
    so that fragments hold equal shares without knowing the levels' sizes.
    """
    return ((rank & _U((1 << GRAM_BITS) - 1)) * _U(fragments) >> _U(GRAM_BITS)).astype(np.int64)


def _planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian bytes of each significance together; high ones are nearly all zero."""
    return np.ascontiguousarray(x.astype(_U).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _from_planes(body: bytes, at: int, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(body, np.uint8, n * width, at).reshape(width, n).T
    return out.view(_U).ravel()


def _read_fragment(bodies: list[bytes]):
    """Grams, local texts and reach of all postings; signature, size and bitmap of each local text."""
    known: dict[int, int] = {}
    sizes: list[int] = []
    maps: list[list] = [[] for _ in range(9)]
    row: list[int] = []
    out: list[tuple] = []
    for packed in bodies:
        body = zlib.decompress(packed)
        docs, n = np.frombuffer(body, np.int64, 2).tolist()
        at = 16
        sig = np.frombuffer(body, np.int64, docs, at)
        at += 8 * docs
        size = np.frombuffer(body, np.uint32, docs, at).astype(np.int64)
        at += 4 * docs
        kind = bitmap_class(size)
        place = np.zeros(docs, np.int64)
        for i, (s, c) in enumerate(zip(sig.tolist(), kind.tolist())):
            k = known.get(s)
            if k is None:
                k = known[s] = len(sizes)
                sizes.append(int(size[i]))
                row.append(len(maps[c]))
                maps[c].append(body[at : at + (8 << c)])
            place[i] = k
            at += 8 << c
        gram = np.cumsum(_from_planes(body, at, n, 6))
        local = place[_from_planes(body, at + 6 * n, n, 2).astype(np.int64)]
        out.append((gram, local, _from_planes(body, at + 8 * n, n, 4).astype(np.int64)))
    gram, local, reach = (np.concatenate([o[k] for o in out]) for k in range(3))
    tables = [np.frombuffer(b"".join(m), _U).reshape(-1, 1 << c) if m else np.zeros((0, 1 << c), _U) for c, m in enumerate(maps)]
    return gram, local, reach, np.fromiter(known, np.int64, len(known)), np.array(sizes, np.int64), np.array(row, np.int64), tables


def _fragment_join(join: Join):
    def run(t: pa.Table) -> pa.Table:
        gram, doc, reach, sig, size, row, tables = _read_fragment([b.as_py() for b in t.column("body")])
        by = np.lexsort((doc, size[doc], gram))
        gram, doc, reach = gram[by], doc[by], reach[by]
        fresh = np.concatenate(([True], (gram[1:] != gram[:-1]) | (doc[1:] != doc[:-1])))
        gram, doc, reach = gram[fresh], doc[fresh], reach[fresh]
        number = np.cumsum(np.concatenate(([0], (gram[1:] != gram[:-1]).astype(np.int64))))
        span = int(size.max()) + 2
        key = number * span + size[doc]
        # partners of a posting: later in its gram's list, up to its reach
        count = np.maximum(0, np.searchsorted(key, number * span + np.minimum(reach, span - 1), "right") - np.arange(len(key)) - 1)
        total = np.cumsum(count)
        pairs, hits = np.zeros(0, np.int64), np.zeros(0, np.int64)
        lo = 0
        while lo < len(count):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            # one posting with a vast list is taken in pieces of its own
            for skip in range(0, max(1, int(count[lo])) if hi == lo + 1 else 1, PAIRS_AT_ONCE):
                c = count[lo:hi] if hi > lo + 1 else np.minimum(count[lo:hi] - skip, PAIRS_AT_ONCE)
                i = np.repeat(np.arange(lo, hi), c)
                j = i + 1 + skip + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                ok = (size[doc[i]] <= reach[j]) & (join.least(size[doc[j]]) <= size[doc[i]])
                a, b = doc[i[ok]], doc[j[ok]]
                p, h = np.unique(np.minimum(a, b) * len(sig) + np.maximum(a, b), return_counts=True)
                may = _may_pass(join, p // len(sig), p % len(sig), size, row, tables)
                p, h = p[may], h[may]
                pairs, where = np.unique(np.concatenate((pairs, p)), return_inverse=True)
                hits = np.bincount(where, weights=np.concatenate((hits, h)), minlength=len(pairs)).astype(np.int64)
            lo = hi
        x, y = sig[pairs // len(sig)], sig[pairs % len(sig)]
        return pa.table({"sig_a": pa.array(np.minimum(x, y)), "sig_b": pa.array(np.maximum(x, y)), "overlap": pa.array(hits)})

    return run


def _may_pass(join: Join, a: np.ndarray, b: np.ndarray, size: np.ndarray, row: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Could the pair reach the threshold, going by its bitmaps."""
    kind = bitmap_class(size)
    swap = kind[a] < kind[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    together = size[a] + size[b]
    ok = np.zeros(len(a), bool)
    combined = kind[a] * 16 + kind[b]
    for c in np.unique(combined).tolist():
        large, small = c // 16, c % 16
        at = np.flatnonzero(combined == c)
        for k in range(0, len(at), 200_000):
            i = at[k : k + 200_000]
            folded = np.bitwise_xor.reduce(tables[large][row[a[i]]].reshape(len(i), -1, 1 << small), axis=1)
            differ = np.bitwise_count(folded ^ tables[small][row[b[i]]]).sum(1, dtype=np.int64)
            ok[i] = join.enough((together[i] - differ) // 2, together[i])
    return ok


def _filter_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(1 << FILTER_BITS, bool)
    for batch in batches:
        for k in range(2):
            bits[buckets(batch.column(k).to_numpy().view(_U), FILTER_BITS)] = True
    if bits.any():
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([zlib.compress(np.packbits(x).tobytes(), 1) for x in np.split(bits, SLICES)], pa.binary())], names=["slice", "body"])


def _join_slices(t: pa.Table) -> pa.Table:
    got = np.bitwise_or.reduce([np.frombuffer(zlib.decompress(b.as_py()), np.uint8) for b in t.column("body")])
    return pa.table({"slice": t.column("slice")[:1], "body": pa.array([zlib.compress(got.tobytes(), 1)], pa.binary())})


def _sets_task(n: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        for batch in batches:
            for _, size, sig, gram in gram_sets(batch, n):
                ends = np.cumsum(size)
                _, first = np.unique(sig, return_index=True)
                first = first[(size[first] > 0) & bits[buckets(sig[first].view(_U), FILTER_BITS)]]
                yield pa.RecordBatch.from_arrays([pa.array(sig[first]), pa.array([pack(gram[ends[i] - size[i] : ends[i]]) for i in first.tolist()], pa.binary())], names=["sig", "body"])

    return run


def _check_task(join: Join):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(2), batch.column(3)
            keep, overlaps = [], []
            for i in range(batch.num_rows):
                x, y = unpack(a[i].as_py()), unpack(b[i].as_py())
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                if common * (join.p + join.q) >= join.p * (len(x) + len(y)):
                    keep.append(i)
                    overlaps.append(common / (len(x) + len(y) - common))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(overlaps, pa.float64())], names=["sig_a", "sig_b", "similarity"])

    return run


def class_links(corpus: DataFrame, n: int, similarity: float, level: np.ndarray, grams: int) -> DataFrame:
    """(sig_a, sig_b, similarity) for every two different n-gram sets that are similar enough."""
    spark = corpus.sparkSession
    join = Join(similarity)
    order = spark.sparkContext.broadcast(level)  # 2**SKETCH_BITS bytes, whatever the corpus
    fragments = max(2 * cores(spark), -(-grams // (2 * FRAGMENT_POSTINGS)))
    postings = corpus.mapInArrow(_postings_task(n, join, order, fragments), "fragment int, body binary")
    partial = postings.groupBy("fragment").applyInArrow(_fragment_join(join), "sig_a long, sig_b long, overlap long")
    candidates, _ = written(partial.groupBy("sig_a", "sig_b").agg(F.sum("overlap").alias("overlap")), "neardup-candidates")
    wanted = np.zeros((SLICES, (1 << FILTER_BITS) // SLICES), bool)
    for r in candidates.select("sig_a", "sig_b").mapInArrow(_filter_task, "slice int, body binary").groupBy("slice").applyInArrow(_join_slices, "slice int, body binary").collect():
        wanted[r["slice"]] = np.unpackbits(np.frombuffer(zlib.decompress(bytes(r["body"])), np.uint8)).astype(bool)
    sets = corpus.mapInArrow(_sets_task(n, spark.sparkContext.broadcast(wanted.ravel())), "sig long, body binary").groupBy("sig").agg(F.first("body").alias("body"))
    a, b = (sets.select(F.col("sig").alias(f"sig_{x}"), F.col("body").alias(f"body_{x}")) for x in "ab")
    return candidates.select("sig_a", "sig_b").join(a, "sig_a").join(b, "sig_b").select("sig_a", "sig_b", "body_a", "body_b").mapInArrow(_check_task(join), "sig_a long, sig_b long, similarity double")


def _corpus(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")


def _linked(corpus: DataFrame, n: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Members and links of all classes, each in the shared folder."""
    light, level, grams, _ = first_pass(corpus, n)
    links, _ = written(class_links(corpus, n, similarity, level, grams).select("sig_a", "sig_b"), "neardup-links")
    return light, links


def near_duplicate_pairs(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: every pair whose sets of n-word runs have at least this Jaccard similarity.

    Copies are pairs too, so a group of copies is spelled out in full; where
    groups may be large use `near_duplicate_classes`, which doesn't. Null texts
    and texts of fewer than n words take no part. Ids are expected to be unique:
    repeated rows of one id and text count once. Other columns are ignored.
    """
    corpus = _corpus(docs, id_col, text_col)
    light, links = _linked(corpus, n, similarity)
    a, b = (light.select(F.col("id").alias(f"doc_{x}"), F.col("sig").alias(f"sig_{x}")) for x in "ab")
    across = links.join(a, "sig_a").join(b, "sig_b").select(F.least("doc_a", "doc_b").alias("doc_a"), F.greatest("doc_a", "doc_b").alias("doc_b")).where("doc_a < doc_b")
    within = a.join(b, F.col("sig_a") == F.col("sig_b")).where("doc_a < doc_b").select("doc_a", "doc_b")
    return across.unionByName(within)


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(id, class_id, links, group_id): one row per document that takes part.

    class_id is the smallest id among texts of the same n-gram set, links the
    number of other classes that are similar enough, group_id the smallest id
    that can be reached over links.
    """
    from hyphae.operators.components import connected_components

    corpus = _corpus(docs, id_col, text_col)
    light, links = _linked(corpus, n, similarity)
    degree = links.select(F.explode(F.array("sig_a", "sig_b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("links"))
    classes = light.groupBy("sig").agg(F.min("id").alias("class_id"))
    root = connected_components(links.select(F.col("sig_a").alias("a"), F.col("sig_b").alias("b")))
    classes = classes.join(degree, "sig", "left").join(root.select(F.col("node").alias("sig"), "root"), "sig", "left").withColumn("root", F.coalesce("root", "sig"))
    groups = classes.groupBy("root").agg(F.min("class_id").alias("group_id"))
    return light.join(classes, "sig").join(groups, "root").select(F.col("id").alias(id_col), "class_id", F.coalesce("links", F.lit(0)).alias("links"), "group_id")
