"""The knowledge graph of a batch of documents, and what an update changes in it, as set operations.

Documents carry `seq`, the order in which they arrive: a document sees those
before it. Ids come from hashes of what they name, so a batch run again gives
the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyphae.functions import text as T
from hyphae.functions.vector import clamp, three_decimals
from hyphae.operators.search import top_k_each

MIN_CONFIDENCE, CANDIDATES = 0.6, 5


def entity_id(name: Column) -> Column:
    return F.concat(F.lit("ent-"), F.sha2(T.label_key(name), 256))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return F.concat(F.lit("rel-"), F.sha2(F.concat_ws("\x1f", source, target, kind), 256))


def document_nodes(docs: DataFrame) -> DataFrame:
    """(id, label, node_type, properties): the label is the first 40 characters, with dots if there are more."""
    label = F.concat(F.substring("text", 1, 40), F.when(F.length("text") > 40, "...").otherwise(""))
    return docs.select("id", label.alias("label"), F.lit("DOCUMENT").alias("node_type"), F.col("metadata").alias("properties"))


def document_entities(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, pos, name, type, entity): the entities of every text in order."""
    found = docs.select(F.col("id").alias("doc_id"), "seq", F.posexplode(T.entities(F.col("text"))).alias("pos", "e"))
    return found.select("doc_id", "seq", "pos", "e.name", "e.type", entity_id(F.col("e.name")).alias("entity"))


def entity_nodes(found: DataFrame) -> DataFrame:
    """(id, label, node_type, entity_type): one node for each label; the first mention gives its spelling and type."""
    first = found.groupBy("entity").agg(F.min(F.struct("seq", "doc_id", "pos", "name", "type")).alias("m"))
    return first.select(F.col("entity").alias("id"), F.col("m.name").alias("label"), F.lit("ENTITY").alias("node_type"), F.col("m.type").alias("entity_type"))


def _edges(frame: DataFrame, kind: str) -> DataFrame:
    typed = frame.withColumn("relation_type", F.lit(kind))
    return typed.select(edge_id(F.col("source_id"), F.col("target_id"), F.col("relation_type")).alias("id"), "source_id", "target_id", "relation_type", "confidence", "evidence_text")


def mention_edges(found: DataFrame) -> DataFrame:
    """One MENTIONS edge for each document and entity; the first spelling is the evidence."""
    once = found.groupBy("doc_id", "entity").agg(F.min(F.struct("pos", "name")).alias("m"))
    evidence = F.concat(F.lit("Document '"), F.col("doc_id"), F.lit("' explicitly mentions entity '"), F.col("m.name"), F.lit("'"))
    return _edges(once.select(F.col("doc_id").alias("source_id"), F.col("entity").alias("target_id"), F.lit(1.0).alias("confidence"), evidence.alias("evidence_text")), "MENTIONS")


def candidates(vectors: DataFrame, *, new: DataFrame | None = None, most: int = CANDIDATES) -> DataFrame:
    """(doc_id, other, score): for every new document the most similar ones that were there before it.

    `vectors` has id, seq and embedding. One more than `most` are looked up and
    the document itself is dropped from them.
    """
    asked = vectors if new is None else vectors.join(new.select("id").distinct(), "id", "left_semi")
    found = top_k_each(vectors, asked, most + 1, order_col="seq")
    return found.where("id <> query_id").select(F.col("query_id").alias("doc_id"), F.col("id").alias("other"), "score")


def similar_edges(found: DataFrame, *, least: float = MIN_CONFIDENCE) -> DataFrame:
    """SIMILAR_TO edges from the newer to the older document where the score is high enough."""
    evidence = F.concat(F.lit("Vector cosine similarity ("), three_decimals(F.col("score")), F.lit(") between doc '"), F.col("doc_id"), F.lit("' and doc '"), F.col("other"), F.lit("'"))
    return _edges(found.where(F.col("score") >= least).select(F.col("doc_id").alias("source_id"), F.col("other").alias("target_id"), clamp(F.col("score")).alias("confidence"), evidence.alias("evidence_text")), "SIMILAR_TO")


def cross_links(found: DataFrame, mentions: DataFrame) -> DataFrame:
    """MENTIONS edges from a candidate to the entities it shares with the new document, whatever the score; the best score counts."""
    own = mentions.select(F.col("source_id").alias("doc_id"), F.col("target_id").alias("entity")).distinct()
    shared = found.join(own, "doc_id").join(own.select(F.col("doc_id").alias("other"), "entity"), ["other", "entity"])
    best = shared.groupBy("other", "entity").agg(F.max("score").alias("score"))
    evidence = F.concat(F.lit("Entity resolved across vector similar doc '"), F.col("other"), F.lit("' (similarity="), three_decimals(F.col("score")), F.lit(")"))
    return _edges(best.select(F.col("other").alias("source_id"), F.col("entity").alias("target_id"), clamp(F.col("score")).alias("confidence"), evidence.alias("evidence_text")), "MENTIONS")


def cooccurrences(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence, place, source, target, evidence)"""
    return docs.select(F.col("id").alias("doc_id"), F.explode(T.cooccurrences(F.col("text"))).alias("c")).select("doc_id", "c.*")


def cooccurrence_edges(pairs: DataFrame, *, least: float = MIN_CONFIDENCE) -> DataFrame:
    """CO_OCCURS_WITH edges between the entities of a sentence; the first sentence is the evidence."""
    once = pairs.select(entity_id(F.col("source")).alias("source_id"), entity_id(F.col("target")).alias("target_id"), "doc_id", "sentence", "place", "evidence").groupBy("source_id", "target_id").agg(F.min(F.struct("doc_id", "sentence", "place", "evidence")).alias("m"))
    own = once.select("source_id", "target_id", F.lit(T.COOCCURRENCE_CONFIDENCE).alias("confidence"), F.col("m.evidence").alias("evidence_text"))
    return _edges(own.where(F.col("confidence") >= least), "CO_OCCURS_WITH")


def counters(docs: DataFrame, found: DataFrame, *, least: float = MIN_CONFIDENCE) -> DataFrame:
    """(id, entities_extracted, facts_extracted, relationships_created, candidate_docs_evaluated) of every document.

    `found` are its candidates. Relationships are counted as they are made, one
    for each extracted name, similar document and pair of names; cross links are
    counted by `cross_links`.
    """
    per = found.groupBy("doc_id").agg(F.count("*").alias("seen"), F.count_if(F.col("score") >= least).alias("near"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    text = F.coalesce(F.col("text"), F.lit(""))
    own = docs.select("id", size(T.entity_names(text)).alias("names"), size(T.facts(text)).alias("facts"), size(T.cooccurrences(text)).alias("pairs"))
    joined = own.join(per, own["id"] == per["doc_id"], "left")
    pairs = F.col("pairs") if T.COOCCURRENCE_CONFIDENCE >= least else F.lit(0)
    return joined.select("id", F.col("names").cast("long").alias("entities_extracted"), F.col("facts").cast("long").alias("facts_extracted"), (F.col("names") + F.coalesce("near", F.lit(0)) + pairs).cast("long").alias("relationships_created"), F.coalesce("seen", F.lit(0)).cast("long").alias("candidate_docs_evaluated"))


def around(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, source_id, target_id, relation_type): the different edges from or to each id of `ids`."""
    own = ids.select(F.col("id").alias("doc_id")).distinct()
    key = ["source_id", "target_id", "relation_type"]
    out = edges.join(own, edges["source_id"] == own["doc_id"]).select("doc_id", *key)
    return out.unionByName(edges.join(own, edges["target_id"] == own["doc_id"]).select("doc_id", *key)).distinct()


def reconcile(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, source_id, target_id, relation_type, change): created, updated or removed, for edges keyed by document.

    An edge of the old state that the new one lacks is removed, also if it
    points at the document; one of both is updated.
    """
    key = ["doc_id", "source_id", "target_id", "relation_type"]
    a, b = old.select(*key).distinct().withColumn("was", F.lit(True)), new.select(*key).distinct().withColumn("is", F.lit(True))
    change = F.when(F.col("was").isNull(), "created").when(F.col("is").isNull(), "removed").otherwise("updated")
    return a.join(b, key, "full").select(*key, change.alias("change"))


def reconcile_counts(changes: DataFrame) -> DataFrame:
    """(doc_id, created, updated, removed)"""
    return changes.groupBy("doc_id").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("created", "updated", "removed")])
