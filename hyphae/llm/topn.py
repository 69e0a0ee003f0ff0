"""The first few rows of every group, by exact positions in one global order.

Rows are sorted into ranges of (group, value descending, id), so a group of any
size is spread over as many ranges as it fills. Within a range a row's place in
its group is counted as it comes; a range's count of the group that it ends
with is added to the places of the same group in the ranges after it. A prefix
sum over the ranges thus gives every row its exact position, and rows whose
position is at most n stay. No group is gathered anywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyphae.session import written


def _place_task(n: int):
    """The first n rows of every group of a range, with their places; last, the count of the group it ends with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen, kept = None, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            group = batch.column(1)
            fresh = np.ones(batch.num_rows, bool)
            fresh[1:] = pc.not_equal(group[1:], group[:-1]).to_numpy(zero_copy_only=False)
            before = seen if group[0].as_py() == last else 0
            start = np.maximum.accumulate(np.where(fresh, np.arange(batch.num_rows), 0))
            place = np.arange(batch.num_rows) - start + np.where(start == 0, before, 0) + 1
            last, seen, kept = group[-1].as_py(), int(place[-1]), batch.slice(batch.num_rows - 1)
            at = pa.array(np.flatnonzero(place <= n))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(at) for k in range(4)), pa.array(place[place <= n]), pa.array(np.zeros(len(at), np.int64))], names=["part", "g", "i", "v", "place", "count"])
        if kept is not None:
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(4)), pa.array([0]), pa.array([seen])], names=["part", "g", "i", "v", "place", "count"])

    return run


def top_of_group(rows: DataFrame, *, group_col: str = "source_id", id_col: str = "id", value_col: str = "confidence", n: int = 3, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(group, id, value, place): the n rows of highest value of every group, ties by smaller id.

    Rows whose group, id or value is null and values that are NaN or outside
    low to high take no part. Repeated rows of one group and id count once, with
    their highest value. Other columns are ignored. What is left of each range
    is written to the shared folder, so that counts and rows come from one and
    the same order; the counts are one row for each range.
    """
    group, key, value = F.col(f"`{group_col}`"), F.col(f"`{id_col}`"), F.col(f"`{value_col}`").cast("double")
    # adding 0.0 makes -0.0 and 0.0 one value; NaN is larger than any value here
    sound = rows.select(group.alias("g"), key.alias("i"), (value + F.lit(0.0)).alias("v")).where(F.col("g").isNotNull() & F.col("i").isNotNull() & F.col("v").between(low, high))
    once = sound.groupBy("g", "i").agg(F.max("v").alias("v"))
    order = [F.col("g"), F.col("v").desc(), F.col("i")]
    ranged = once.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "g", "i", "v")
    kinds = {c: once.schema[c].dataType.simpleString() for c in ("g", "i")}
    placed, _ = written(ranged.mapInArrow(_place_task(n), f"part int, g {kinds['g']}, i {kinds['i']}, v double, place long, count long"), "topn-places")
    # a range in the middle of a group holds nothing else, so its count is that of the group it ends with
    ends = placed.where("count > 0").select("part", "g", "count")
    before = Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    later = ends.select("g", "part", F.sum("count").over(before).alias("shift")).where("shift is not null")
    # a group may also end in a range that ends with another one: there all the ranges before count
    total = ends.groupBy("g").agg(F.max_by(F.struct("part", "count"), "part").alias("last"), F.sum("count").alias("all"))
    tail = total.select("g", F.col("last.part").alias("from"), "all")
    rest = placed.where("place > 0")
    shifted = rest.join(F.broadcast(later), ["g", "part"], "left").join(F.broadcast(tail), "g", "left")
    shift = F.coalesce(F.col("shift"), F.when(F.col("part") > F.col("from"), F.col("all")), F.lit(0))
    out = shifted.withColumn("place", (F.col("place") + shift).cast("int")).where(F.col("place") <= n)
    return out.select(F.col("g").alias(group_col), F.col("i").alias(id_col), F.col("v").alias(value_col), "place")
