"""Connected components by contracting neighbourhoods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyphae.session import drop_path, fresh_path


def connected_components(edges: DataFrame, *, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of every node's component.

    Alternates large-star and small-star steps, which take a number of rounds
    that grows with the logarithm of a component's size, not with its diameter.
    A node's smallest neighbour is found by aggregation, so a hub's neighbours
    are never gathered. Each round is written to the shared folder. Nulls and
    self-loops link nothing; nodes without an edge have no row.
    """
    spark = edges.sparkSession
    kind = edges.schema[a].dataType.simpleString()
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"`{a}` is not null and `{b}` is not null and u <> v").distinct()
    previous, last = "", None
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours of u move under the smallest of u and its neighbours
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        # small star: u and its smaller neighbours move under the smallest of them
        small = large.join(smallest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        path = fresh_path(spark, "components")
        small.write.parquet(path)
        now = spark.read.schema(f"u {kind}, v {kind}").parquet(path)
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if previous:
            drop_path(spark, previous)
        previous = path
        if mark == last:
            break
        last = mark
    else:
        raise RuntimeError("components did not settle")
    roots = now.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").union(roots.select("root", "root").distinct())
