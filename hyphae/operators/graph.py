"""Neighbours, breadth-first paths and subgraphs of a directed multigraph, followed in both directions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyphae.functions.text import label_key
from hyphae.session import drop_path, written


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each id: repeated rows keep the smallest label, type and properties."""
    rest = [c for c in nodes.columns if c != "id"]
    return nodes.where("id is not null").groupBy("id").agg(F.min(F.struct(*rest)).alias("r")).select("id", *[F.col(f"r.`{c}`").alias(c) for c in rest])


def of_types(types: list[str] | None) -> Column:
    """Edges of these types; all for None, none for an empty list."""
    return F.lit(True) if types is None else F.col("relation_type").isin(types) if types else F.lit(False)


def steps(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """(at, other, edge_id): every edge from both its ends; a self-loop once."""
    own = edges.where(of_types(types)).where("source_id is not null and target_id is not null").select("id", "source_id", "target_id").distinct()
    out = own.select(F.col("source_id").alias("at"), F.col("target_id").alias("other"), F.col("id").alias("edge_id"))
    back = own.where("source_id <> target_id").select(F.col("target_id").alias("at"), F.col("source_id").alias("other"), F.col("id").alias("edge_id"))
    return out.unionByName(back)


def neighbours(nodes: DataFrame, edges: DataFrame, *, starts: DataFrame | None = None, types: list[str] | None = None) -> DataFrame:
    """(at, other, edge_id): nodes one edge away, whichever way it points; missing nodes are left out.

    `starts` has the column id; without it all nodes are starts.
    """
    known = nodes.select("id").where("id is not null").distinct()
    begin = known if starts is None else known.join(starts.select("id").distinct(), "id", "left_semi")
    found = steps(edges, types).join(known.withColumnRenamed("id", "other"), "other", "left_semi")
    return found.join(begin.withColumnRenamed("id", "at"), "at", "left_semi").select("at", "other", "edge_id")


def reach(nodes: DataFrame, edges: DataFrame, starts: DataFrame, *, hops: int = 2, types: list[str] | None = None) -> DataFrame:
    """(start_id, id, hop, parent_id, edge_id, path): every node once that is at most `hops` edges from a start.

    Breadth first from all starts together; a start itself isn't reached, and a
    start that is no node reaches nothing. Of several ways to a node the one
    counts whose edge ids come first, so the tree is always the same. `path` is
    the edge ids from the start. Each hop is written to the shared folder, and
    the last folder holds the result.
    """
    known = nodes.select("id").where("id is not null").distinct()
    begin = known.join(starts.select("id").distinct(), "id", "left_semi")
    kind = edges.schema["id"].dataType.simpleString()
    seen = begin.select(F.col("id").alias("start_id"), "id", F.lit(0).alias("hop"), F.lit(None).cast(nodes.schema["id"].dataType).alias("parent_id"), F.lit(None).cast(kind).alias("edge_id"), F.array().cast(f"array<{kind}>").alias("path"))
    if hops <= 0:
        return seen.limit(0)
    move, at_step = written(steps(edges, types).join(known.withColumnRenamed("id", "other"), "other", "left_semi"), "reach-steps")
    path = ""
    for hop in range(1, hops + 1):
        front = seen.where(F.col("hop") == hop - 1).select("start_id", F.col("id").alias("at"), "path")
        found = front.join(move, "at").select("start_id", F.col("other").alias("id"), F.col("at").alias("parent_id"), "edge_id", F.concat("path", F.array("edge_id")).alias("path"))
        fresh = found.groupBy("start_id", "id").agg(F.min(F.struct("path", "parent_id", "edge_id")).alias("w")).join(seen.select("start_id", "id"), ["start_id", "id"], "left_anti")
        fresh = fresh.select("start_id", "id", F.lit(hop).alias("hop"), "w.parent_id", "w.edge_id", "w.path")
        seen, now = written(seen.unionByName(fresh), "reach")
        if path:
            drop_path(seen.sparkSession, path)
        path = now
        if seen.where(F.col("hop") == hop).isEmpty():
            break
    drop_path(seen.sparkSession, at_step)
    return seen.where("hop > 0")


def subgraph(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None, *, depth: int = 2, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what is at most `depth` edges from the starts, and the edges with both ends in it; all without starts."""
    own = unique_nodes(nodes)
    linked = edges.where(of_types(types)).dropDuplicates(["id"])
    if starts is None:
        return own, linked
    ids = reach(nodes, edges, starts, hops=depth, types=types).select("id").union(own.join(starts.select("id").distinct(), "id", "left_semi").select("id")).distinct()
    inside = linked.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    return own.join(ids, "id", "left_semi"), inside.select(*edges.columns)


def by_label(nodes: DataFrame, labels: DataFrame, *, node_type: str = "ENTITY") -> DataFrame:
    """(label, id): for every row of `labels` (label) the node of that label, case and outer blanks aside; the smallest id of several."""
    own = nodes.where(F.col("node_type") == node_type).groupBy(label_key(F.col("label")).alias("key")).agg(F.min("id").alias("id"))
    return labels.select("label", label_key(F.col("label")).alias("key")).distinct().join(own, "key").select("label", "id")


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) without the nodes of `gone` (id) and without every edge from or to them."""
    ids = gone.select("id").where("id is not null").distinct()
    left = edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left.select(*edges.columns)


def without_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without those of `gone` (source_id, target_id, relation_type); a null type there means every type."""
    typed = gone.where("relation_type is not null").select("source_id", "target_id", "relation_type").distinct()
    whole = gone.where("relation_type is null").select("source_id", "target_id").distinct()
    return edges.join(typed, ["source_id", "target_id", "relation_type"], "left_anti").join(whole, ["source_id", "target_id"], "left_anti").select(*edges.columns)


def as_entities(nodes: DataFrame) -> DataFrame:
    """(id, name, type, metadata) of the ENTITY nodes; the type is a property and CONCEPT by default."""
    from hyphae.functions.metadata import field

    return nodes.where("node_type = 'ENTITY'").select("id", F.col("label").alias("name"), F.coalesce(field(F.col("properties"), "entity_type", "string"), F.lit("CONCEPT")).alias("type"), F.col("properties").alias("metadata"))


def keyed(edges: DataFrame, seq: str) -> DataFrame:
    """One edge for each (source, target, type), the one of highest `seq`: what an update leaves of parallel edges."""
    last = Window.partitionBy("source_id", "target_id", "relation_type").orderBy(F.desc(seq), "id")
    return edges.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")
