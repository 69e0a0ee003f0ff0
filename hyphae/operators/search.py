"""Exact vector search: one query vector by native expressions, many by blocked products."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyphae.functions.metadata import matches
from hyphae.functions.vector import cosine, literal

#: Queries whose vectors are sent out together, and vectors they are multiplied with at once.
QUERIES_TOGETHER, VECTORS_TOGETHER = 2_000, 2_000


def top_k(vectors: DataFrame, query: list[float], k: int = 10, *, filters: dict[str, Any] | None = None, id_col: str = "id", vector_col: str = "embedding", metadata_col: str = "metadata") -> DataFrame:
    """(id, score, rank): the k vectors of highest cosine with the query, ties by smaller id.

    Scores are rounded to 9 decimals before they are compared. Filters count before scoring. A zero vector scores 0; null vectors and
    those of another length than the query take no part. Every task keeps k
    rows, so nothing but those is shuffled.
    """
    own = vectors.where(matches(F.col(metadata_col), filters)) if filters else vectors
    scored = own.select(F.col(f"`{id_col}`").alias("id"), F.round(cosine(F.col(f"`{vector_col}`"), literal(query)), 9).alias("score")).where("id is not null and score is not null and not isnan(score)")
    best = scored.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")))


def _scan(names: list, x: np.ndarray, order: np.ndarray | None, k: int):
    """The k best of each part for every query; equal scores at the edge are all kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, VECTORS_TOGETHER):
                part = batch.slice(lo, VECTORS_TOGETHER)
                y = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                size = np.sqrt((y * y).sum(1, keepdims=True))
                s = np.round(x @ (y / np.where(size == 0, 1.0, size)).T, 9)
                if order is not None:
                    s[part.column(2).to_numpy()[None, :] > order[:, None]] = -9
                m = min(k, s.shape[1])
                edge = np.partition(s, s.shape[1] - m, axis=1)[:, s.shape[1] - m]
                i, j = np.nonzero((s >= edge[:, None]) & (s > -9))
                yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in i.tolist()], batch.schema.field(0).type), part.column(0).take(pa.array(j)), pa.array(s[i, j])], names=["query_id", "id", "score"])

    return run


def top_k_each(vectors: DataFrame, queries: DataFrame, k: int, *, id_col: str = "id", vector_col: str = "embedding", order_col: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): for every query row its k vectors of highest cosine, itself included, ties by smaller id.

    With `order_col`, a query sees only vectors whose order is at most its own.
    Scores are rounded to 9 decimals before they are compared. Queries are
    taken in blocks of QUERIES_TOGETHER, each a scan of the vectors, so what is
    sent out has a fixed size; rows whose vector is null, holds a null or NaN or
    is of another length than most take no part. Exact, and quadratic in
    queries and vectors.
    """
    spark = vectors.sparkSession
    sound = lambda d: d.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"), *([F.col(f"`{order_col}`").cast("long").alias("o")] if order_col else [])).where("id is not null and v is not null and not exists(v, x -> x is null or isnan(x))")
    own, asked = sound(vectors).dropDuplicates(["id"]), sound(queries).dropDuplicates(["id"])
    kind = vectors.schema[id_col].dataType.simpleString()
    dims = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = f"query_id {kind}, id {kind}, score double"
    if dims is None:
        return spark.createDataFrame([], schema + ", rank int")
    own, asked = own.where(F.size("v") == dims["n"]), asked.where(F.size("v") == dims["n"])
    blocks = max(1, -(-asked.count() // QUERIES_TOGETHER))
    found = None
    for b in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).toArrow()
        if not block.num_rows:
            continue
        x = block.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(block.num_rows, -1)
        size = np.sqrt((x * x).sum(1, keepdims=True))
        part = own.mapInArrow(_scan(block.column("id").to_pylist(), x / np.where(size == 0, 1.0, size), block.column("o").to_numpy() if order_col else None, k), schema)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank int")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)
