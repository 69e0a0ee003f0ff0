"""Hybrid queries: vectors, then metadata, then the graph, as one DataFrame for each part of the result."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hyphae.functions.metadata import matches
from hyphae.operators.graph import as_entities, neighbours, reach, unique_nodes
from hyphae.operators.search import top_k
from hyphae.plans.language import Query, parse, plan_steps


@dataclass
class Result:
    """Frames of a query; those that weren't asked for are None. `scores` (id, score) is always there."""

    query: str
    documents: DataFrame | None
    entities: DataFrame | None
    relationships: DataFrame | None
    scores: DataFrame
    metadata: dict[str, Any] = field(default_factory=dict)


def sources(documents: DataFrame, vectors: DataFrame | None, q: Query, encode: Callable[[str], list[float]]) -> DataFrame:
    """(id, score, rank): twice as many candidates as wanted, by similarity or, without a text, in stored order with score 1.

    Filters come after this on purpose, so a filter that few documents pass
    leaves fewer than were asked for.
    """
    if q.semantic_query:
        return top_k(vectors, encode(q.semantic_query), 2 * q.top_k)
    first = documents.orderBy("seq", "id").limit(2 * q.top_k)
    return first.select("id", F.lit(1.0).alias("score"), F.row_number().over(Window.orderBy("seq", "id")).alias("rank"))


def matched(documents: DataFrame, candidates: DataFrame, q: Query) -> DataFrame:
    """Documents of the candidates that pass the filters, the best `top_k` of them, with score and rank.

    A candidate without a document is dropped. Candidates are at most twice
    top_k rows, so they are the side that is sent to the documents.
    """
    found = documents.join(F.broadcast(candidates), "id").where(matches(F.col("metadata"), q.metadata_filters))
    return found.orderBy("rank").limit(q.top_k)


def expand(nodes: DataFrame, edges: DataFrame, hits: DataFrame, q: Query) -> tuple[DataFrame, DataFrame]:
    """(entities, relationships) around the hits: the tree of a traversal, or without one the direct neighbours."""
    types = q.allowed_relationship_types
    if q.traverse_hops > 0:
        found = reach(nodes, edges, hits, hops=q.traverse_hops, types=types)
        near, used = found.select("id"), found.select("edge_id")
        # a path begins with its document, which is a node too
        near = near.unionByName(found.select(F.col("start_id").alias("id")))
    else:
        found = neighbours(nodes, edges, starts=hits, types=types)
        near, used = found.select(F.col("other").alias("id")), found.select("edge_id")
    entities = as_entities(unique_nodes(nodes).join(near.distinct(), "id", "left_semi"))
    relationships = edges.join(used.distinct().withColumnRenamed("edge_id", "id"), "id", "left_semi").dropDuplicates(["id"])
    return entities, relationships


def execute(q: Query, documents: DataFrame, vectors: DataFrame | None, nodes: DataFrame, edges: DataFrame, encode: Callable[[str], list[float]]) -> Result:
    """Run a query.

    documents: id, text, metadata (JSON), seq; vectors: id, embedding; nodes:
    id, label, node_type, properties (JSON); edges: id, source_id, target_id,
    relation_type and whatever else.
    """
    hits = matched(documents, sources(documents, vectors, q, encode), q)
    wanted = set(q.return_fields)
    entities = relationships = None
    if wanted & {"entities", "relationships"}:
        entities, relationships = expand(nodes, edges, hits.select("id"), q)
    ranked = hits.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "rank"))).drop("rank")
    return Result(
        query=q.semantic_query or q.target,
        documents=ranked if "documents" in wanted else None,
        entities=entities if "entities" in wanted else None,
        relationships=relationships if "relationships" in wanted else None,
        scores=ranked.select("id", "score"),
        metadata={"plan_steps": plan_steps(q)},
    )


def query(text: str, documents: DataFrame, vectors: DataFrame | None, nodes: DataFrame, edges: DataFrame, encode: Callable[[str], list[float]], *, k: int = 10, filters: dict[str, Any] | None = None, strict: bool = False) -> Result:
    """Parse and run; `k` always counts, `filters` go over those of the text."""
    q = parse(text, strict=strict)
    q.top_k = k
    q.metadata_filters.update(filters or {})
    return execute(q, documents, vectors, nodes, edges, encode)


def semantic_search(text: str, documents: DataFrame, vectors: DataFrame, encode: Callable[[str], list[float]], *, k: int = 10) -> DataFrame:
    """(document_id, score, text, metadata, rank): a hit without a document stays, with empty text."""
    hits = top_k(vectors, encode(text), k)
    own = documents.select("id", "text", "metadata")
    return hits.join(own, "id", "left").select(F.col("id").alias("document_id"), "score", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("metadata", F.lit("{}")).alias("metadata"), "rank").orderBy("rank")
