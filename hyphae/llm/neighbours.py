"""Most similar vectors by counting collisions of hashes.

A vector's hash in each of TABLES tables is the signs of its products with a
few random planes. Two vectors that share at least `collisions` hashes are
candidates; they are met in the first table they share, where the hashes of all
tables travel along, so collisions are counted in place, and so does the vector
in one byte a value, which ranks the candidates of one bucket: a true neighbour
is among the best of every bucket that holds it, so only KEPT of a bucket go on,
and the best COMPARED of a vector are compared exactly. A vector whose
n-th neighbour is too far for the hashes to be trusted is compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyphae.session import written

TABLES, COLLISIONS = 32, 2
#: Candidates that a vector keeps of a bucket and that are compared exactly, pairs counted at once, vectors of a block that is compared with all.
KEPT, COMPARED, PAIRS_AT_ONCE, BLOCK = 10, 16, 500_000, 10_000
SEED = 20_250_101


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows; scaled by the largest value first, so that squares neither overflow nor vanish."""
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hash_task(dims: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.random.default_rng(SEED).standard_normal((dims, TABLES * bits))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                m = part.num_rows
                x = _matrix(part.column(1))
                sign = (x @ planes > 0).reshape(m, TABLES, bits)
                code = (sign * (1 << np.arange(bits))).sum(2).astype(np.uint16)
                key = (np.arange(TABLES, dtype=np.int64) << 16) | code
                top = np.abs(x).max(axis=1, keepdims=True)
                small = np.round(x / top * 127).astype(np.int8)
                codes = pa.array([c.tobytes() + t.tobytes() + r.tobytes() for c, t, r in zip(code, top.astype(np.float32), small)], pa.binary())
                again = pa.array(np.repeat(np.arange(m), TABLES))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), part.column(0).take(again), codes.take(again)], names=["key", "rep", "codes"])

    return run


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key: pairs within each key."""
    held: list[pa.RecordBatch] = []

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        key, rep = t.column(0).to_numpy(), t.column(1).combine_chunks()
        if not len(key):
            return
        body = np.frombuffer(b"".join(t.column(2).to_pylist()), np.uint8).reshape(len(key), -1)
        code = np.ascontiguousarray(body[:, : 2 * TABLES]).view(np.uint16)
        small = body[:, 2 * TABLES + 4 :].view(np.int8).astype(np.float32) * np.ascontiguousarray(body[:, 2 * TABLES : 2 * TABLES + 4]).view(np.float32) / np.float32(127)
        last = np.searchsorted(key, key, "right")
        later = last - np.arange(len(key)) - 1
        total = np.cumsum(later)
        lo = 0
        while lo < len(key):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS_AT_ONCE, "right")))
            c = later[lo:hi]
            i = np.repeat(np.arange(lo, hi), c)
            j = i + 1 + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            lo = hi
            if not len(i):
                continue
            same = code[i] == code[j]
            # a pair counts in the first table that it shares
            keep = np.flatnonzero((same.sum(1) >= COLLISIONS) & (same.argmax(1) == key[i] >> 16))
            i, j = i[keep], j[keep]
            like = np.einsum("ij,ij->i", small[i], small[j])
            i, j, like = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((like, like))
            by = np.lexsort((-like, i))
            i, j, like = i[by], j[by], like[by]
            best = np.arange(len(i)) - np.searchsorted(i, i, "left") < KEPT
            yield pa.RecordBatch.from_arrays([rep.take(pa.array(i[best])), rep.take(pa.array(j[best])), pa.array(like[best])], names=["a", "b", "like"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy()
        if held and key[-1] == held[-1].column(0)[-1].as_py():
            held.append(batch)
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        yield from pairs(pa.Table.from_batches([*held, batch.slice(0, cut)]))
        held = [batch.slice(cut)]
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _cosine_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            s = (_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.round(s, 6))], names=["a", "b", "similarity"])


def _scan_task(names: list, x: np.ndarray, n: int):
    """The n best of each batch for every vector of the block; equal similarities at the edge are all kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {name: k for k, name in enumerate(names)}
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                reps = part.column(0).to_pylist()
                s = np.round(x @ _matrix(part.column(1)).T, 6)
                for k, r in enumerate(reps):
                    if r in at:
                        s[at[r], k] = -9
                m = min(n, s.shape[1])
                edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                i, j = np.nonzero((s >= edge[:, None]) & (s > -9))
                yield pa.RecordBatch.from_arrays([pa.array([names[k] for k in i.tolist()]), pa.array([reps[k] for k in j.tolist()]), pa.array(s[i, j])], names=["a", "b", "similarity"])

    return run


def _best(pairs: DataFrame, n: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("a").orderBy(F.col("similarity").desc(), "b"))
    return pairs.withColumn("place", place).where(F.col("place") <= n).select("a", "b", "similarity", "place")


def trusted(bits: int, chance: float = 0.97) -> float:
    """Least cosine at which a pair shares COLLISIONS hashes with at least this chance."""
    from math import comb, cos, pi

    for k in range(1, 1_000):
        p = (1 - k / 2_000) ** bits
        if sum(comb(TABLES, c) * p**c * (1 - p) ** (TABLES - c) for c in range(COLLISIONS)) > 1 - chance:
            return cos((k - 1) / 2_000 * pi)
    return 0.0


def most_similar(vectors: DataFrame, *, id_col: str = "id", vector_col: str = "embedding", n: int = 5, dims: int = 64) -> DataFrame:
    """(id, neighbor_id, similarity, place): the n most similar other vectors of every sound vector.

    By cosine rounded to 6 decimals, ties by smaller id. A vector is sound if it
    isn't null, has `dims` values, none of them null, NaN or infinite, and isn't all zero; others
    take no part. Repeated rows count once. Equal vectors are one class that is
    hashed once, however many ids it has. A few neighbours may be missed.
    """
    spark = vectors.sparkSession
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = vectors.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding")).where((F.size(v) == dims) & ~odd & F.exists(v, lambda x: x != 0) & F.col("id").isNotNull())
    sound = sound.groupBy("id").agg(F.min("embedding").alias("embedding")).withColumn("embedding", F.transform("embedding", lambda x: x + F.lit(0.0)))
    same = Window.partitionBy("embedding")
    placed, _ = written(sound.withColumn("rep", F.min("id").over(same)).withColumn("number", F.row_number().over(same.orderBy("id"))), "neighbours-vectors")
    reps = placed.where("number = 1").select("rep", "embedding")
    first = placed.where(F.col("number") <= n + 1).select("rep", "id")
    count = reps.count()
    bits = int(np.clip(round(np.log2(max(2, count))) - 3, 6, 16))
    keyed = reps.mapInArrow(_hash_task(dims, bits), "key long, rep string, codes binary")
    met = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_count_task, "a string, b string, like float")
    few = met.withColumn("at", F.row_number().over(Window.partitionBy("a").orderBy(F.col("like").desc(), "b"))).where(F.col("at") <= COMPARED).select("a", "b")
    a, b = (reps.select(F.col("rep").alias(x), F.col("embedding").alias(f"v{x}")) for x in "ab")
    near = _best(few.join(b, "b").join(a, "a").select("a", "b", "va", "vb").mapInArrow(_cosine_task, "a string, b string, similarity double"), n)
    near, _ = written(near, "neighbours-near")
    settled = near.where((F.col("place") == min(n, max(1, count - 1))) & (F.col("similarity") >= trusted(bits))).select(F.col("a").alias("rep"))
    rest, _ = written(reps.join(settled, "rep", "left_anti"), "neighbours-rest")
    blocks = -(-rest.count() // BLOCK)
    pairs = near.join(rest.select(F.col("rep").alias("a")), "a", "left_anti").select("a", "b", "similarity")
    for k in range(blocks):
        own = rest.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == k).toArrow()
        if own.num_rows:
            found = reps.mapInArrow(_scan_task(own.column("rep").to_pylist(), _matrix(own.column("embedding").combine_chunks()), n), "a string, b string, similarity double")
            pairs = pairs.unionByName(_best(found, n).select("a", "b", "similarity"))
    # from classes back to ids: the class itself, then the first ids of the near ones
    reach = pairs.unionByName(reps.select(F.col("rep").alias("a"), F.col("rep").alias("b"), F.lit(1.0).alias("similarity")))
    ids = reach.join(first.select(F.col("rep").alias("b"), F.col("id").alias("neighbor_id")), "b").select(F.col("a").alias("rep"), "neighbor_id", "similarity")
    ids = ids.withColumn("at", F.row_number().over(Window.partitionBy("rep").orderBy(F.col("similarity").desc(), "neighbor_id"))).where(F.col("at") <= n + 1)
    out = placed.select("id", "rep").join(ids, "rep").where("id <> neighbor_id")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), "neighbor_id"))
    return out.withColumn("place", place).where(F.col("place") <= n).select(F.col("id").alias(id_col), "neighbor_id", "similarity", "place")
