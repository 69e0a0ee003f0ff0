"""One store: documents, vectors and graph under a folder, with everything a user does to them."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyphae import export
from hyphae.functions import text as T
from hyphae.functions.embedding import encoder, hash_vectors
from hyphae.functions.metadata import merged
from hyphae.functions.models import analyse
from hyphae.operators import graph as G
from hyphae.operators import ingest as I
from hyphae.operators.search import top_k
from hyphae.plans import engine
from hyphae.session import prepare
from hyphae.sources.tables import DOCUMENTS, EDGES, NODES, VECTORS, Table

COUNTS = ("entities_extracted", "facts_extracted", "relationships_created", "relationships_updated", "relationships_removed", "candidate_docs_evaluated")


class Client:
    """Documents in, hybrid queries out. Every change writes new versions of the tables; a batch is one change."""

    def __init__(self, spark: SparkSession, folder: str, *, dim: int = 384, min_confidence: float = I.MIN_CONFIDENCE, candidates: int = I.CANDIDATES, encode: Callable[[str], list[float]] | None = None):
        self.spark, self.dim, self.least, self.most = prepare(spark), dim, min_confidence, candidates
        self.encode = encode or encoder("hash", dim=dim)
        self._own_model = encode is not None
        self.documents = Table(spark, f"{folder}/documents", DOCUMENTS)
        self.vectors = Table(spark, f"{folder}/vectors", VECTORS)
        self.nodes = Table(spark, f"{folder}/nodes", NODES)
        self.edges = Table(spark, f"{folder}/edges", EDGES)

    # documents

    @staticmethod
    def _checked(text: str | None) -> str:
        if text is None or not text.strip():
            raise ValueError("Document text cannot be empty")
        return text

    def create(self, text: str, metadata: dict[str, Any] | None = None, id: str | None = None) -> dict[str, Any]:
        """Store and analyse one document; its id and counts."""
        name = id or str(uuid.uuid4())
        frame = self.spark.createDataFrame([(name, self._checked(text), json.dumps(metadata or {}))], "id string, text string, metadata string")
        return self.ingest(frame).first().asDict()

    def get(self, id: str) -> dict[str, Any] | None:
        row = self.documents.get(id)
        return row and row | {"metadata": json.loads(row["metadata"] or "{}")}

    def list(self, limit: int = 100, offset: int = 0) -> list[dict[str, Any]]:
        return [r.asDict() | {"metadata": json.loads(r["metadata"] or "{}")} for r in self.documents.page(limit, offset).collect()]

    def count(self) -> int:
        return self.documents.count()

    def update(self, id: str, text: str | None = None, metadata: dict[str, Any] | None = None) -> dict[str, Any]:
        """New text and metadata over the old ones; the graph is reconciled. KeyError if there is no such document."""
        old = self.documents.get(id)
        if old is None:
            raise KeyError(id)
        frame = self.spark.createDataFrame([(id, old["text"] if text is None else text, merged(old["metadata"], metadata))], "id string, text string, metadata string")
        return self.update_all(frame).first().asDict()

    def delete(self, id: str) -> bool:
        """Delete a document with its vector, its node and the edges of that; entities stay."""
        gone = self.spark.createDataFrame([(id,)], "id string")
        found = self.documents.delete(gone)
        self.vectors.delete(gone)
        self._cut(gone)
        return bool(found)

    def _cut(self, gone: DataFrame) -> None:
        nodes, edges = G.without_nodes(self.nodes.frame(), self.edges.frame(), gone)
        self.edges.replace(edges)
        self.nodes.replace(nodes)

    # batches

    def _batch(self, docs: DataFrame) -> DataFrame:
        """The batch with time stamps and its place in the order of arrival, written so that every use sees the same."""
        last = self.documents.frame().agg(F.max("seq")).first()[0] or 0
        now = F.lit(datetime.now(UTC))
        known = self.documents.frame().select("id", F.col("seq").alias("old_seq"), F.col("created_at").alias("old_created"))
        metadata = F.col("metadata") if "metadata" in docs.columns else F.lit("{}")
        given = [F.col("seq").alias("given")] if "seq" in docs.columns else []
        fresh = docs.select("id", "text", *given, F.coalesce(metadata, F.lit("{}")).alias("metadata")).dropDuplicates(["id"]).join(known, "id", "left")
        # a place from the hash of the id needs no global sort; it keeps documents of a batch apart and in one order
        place = F.lit(last) + 1 + F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        place = F.coalesce("given", place) if given else place
        return fresh.select("id", "text", "metadata", F.coalesce("old_created", now).alias("created_at"), now.alias("updated_at"), F.coalesce("old_seq", place).alias("seq"))

    def _embedded(self, docs: DataFrame) -> DataFrame:
        if self._own_model:
            encode = F.udf(self.encode, "array<double>")
            return docs.select("id", encode("text").alias("embedding"))
        return hash_vectors(docs, dim=self.dim)

    def _store(self, docs: DataFrame, stamp: bool) -> None:
        self.documents.put(docs)
        vectors = self._embedded(docs).join(docs.select("id", "metadata", "seq", "updated_at"), "id")
        extra = F.to_json(F.struct(F.col("id").alias("doc_id"), *([F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("updated_at")] if stamp else [])))
        with_id = F.when(F.length("metadata") > 2, F.concat(F.expr("left(metadata, length(metadata) - 1)"), F.lit(","), F.expr("substring(x, 2)"))).otherwise(F.col("x"))
        self.vectors.put(vectors.withColumn("x", extra).select("id", "embedding", with_id.alias("metadata"), "seq"))

    def _analysed(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
        """Nodes, own edges of the documents, links of others, pairs of entities and candidates of a stored batch."""
        found = I.document_entities(docs)
        mentions = I.mention_edges(found)
        near = I.candidates(self.vectors.frame(), new=docs, most=self.most)
        entity_nodes = I.entity_nodes(found).join(self.nodes.frame().select("id"), "id", "left_anti")
        named = entity_nodes.select("id", "label", "node_type", F.to_json(F.struct("entity_type")).alias("properties"))
        nodes = I.document_nodes(docs).unionByName(named)
        old = self.edges.frame().where("relation_type = 'MENTIONS'").select(*mentions.columns)
        links = I.cross_links(near, mentions.unionByName(old))
        pairs = I.cooccurrence_edges(I.cooccurrences(docs), least=self.least)
        return nodes, mentions.unionByName(I.similar_edges(near, least=self.least)), links, pairs, near

    def _seq(self, frame: DataFrame, names: list[str], seq: int) -> DataFrame:
        return frame.select(*[F.col(n) if n in frame.columns else F.lit(None).alias(n) for n in names if n != "seq"], F.lit(seq).cast("long").alias("seq"))

    def _commit(self, nodes: DataFrame, edges: list[DataFrame]) -> None:
        """Write nodes and edges; of parallel edges the one of highest confidence stays."""
        last = (self.edges.frame().agg(F.max("seq")).first()[0] or 0) + 1
        self.nodes.put(self._seq(nodes, self.nodes.frame().columns, last))
        every = reduce(DataFrame.unionByName, [self._seq(e, self.edges.frame().columns, last) for e in edges])
        best = every.groupBy("id").agg(F.max_by(F.struct(*[c for c in every.columns if c != "id"]), F.struct("confidence", "evidence_text")).alias("r")).select("id", "r.*")
        self.edges.put(best.select(*self.edges.frame().columns))

    def ingest(self, docs: DataFrame) -> DataFrame:
        """Store a batch (id, text, metadata as JSON) and put it into the graph; one row of counts for each document."""
        from hyphae.session import written

        batch, _ = written(self._batch(docs), "ingest-batch")
        self._store(batch, stamp=False)
        nodes, own, links, pairs, near = self._analysed(batch)
        near, _ = written(near, "ingest-candidates")
        counted = I.counters(batch, near, least=self.least)
        self._commit(nodes, [own, links, pairs])
        return counted.select(F.col("id").alias("document_id"), *[F.col(c) if c in counted.columns else F.lit(0).cast("long").alias(c) for c in COUNTS])

    def update_all(self, docs: DataFrame) -> DataFrame:
        """Replace documents and reconcile their edges; counts for each. What the new text doesn't support is removed."""
        from hyphae.session import written

        batch, _ = written(self._batch(docs), "update-batch")
        before, _ = written(I.around(self.edges.frame(), batch), "update-before")
        self._store(batch, stamp=True)
        nodes, own, _, pairs, near = self._analysed(batch)
        near, _ = written(near, "update-candidates")
        mine = own.select(F.col("source_id").alias("doc_id"), "source_id", "target_id", "relation_type")
        inner = I.cooccurrences(batch).select("doc_id", I.entity_id(F.col("source")).alias("source_id"), I.entity_id(F.col("target")).alias("target_id"), F.lit("CO_OCCURS_WITH").alias("relation_type"))
        changes, _ = written(I.reconcile(before, mine.unionByName(inner)), "update-changes")
        removed = changes.where("change = 'removed'").select("source_id", "target_id", "relation_type")
        own, _ = written(own, "update-edges")
        pairs, _ = written(pairs, "update-pairs")
        nodes, _ = written(nodes, "update-nodes")
        self.edges.replace(G.without_edges(self.edges.frame(), removed))
        self._commit(nodes, [own, pairs])
        counted = I.counters(batch, near, least=self.least).drop("relationships_created")
        changed = I.reconcile_counts(changes)
        joined = counted.join(changed, counted["id"] == changed["doc_id"], "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(f"relationships_{c}")
        return joined.select(F.col("id").alias("document_id"), "entities_extracted", "facts_extracted", zero("created"), zero("updated"), zero("removed"), "candidate_docs_evaluated")

    # questions

    def search(self, text: str, k: int = 10) -> list[dict[str, Any]]:
        found = engine.semantic_search(text, self.documents.frame(), self.vectors.frame(), self.encode, k=k)
        return [r.asDict() | {"metadata": json.loads(r["metadata"])} for r in found.collect()]

    def search_vectors(self, query: list[float], k: int = 10, filters: dict[str, Any] | None = None) -> list[tuple[str, float]]:
        return [(r["id"], r["score"]) for r in top_k(self.vectors.frame(), query, k, filters=filters).orderBy("rank").collect()]

    def query(self, text: str, k: int = 10, filters: dict[str, Any] | None = None, strict: bool = False) -> engine.Result:
        return engine.query(text, self.documents.frame(), self.vectors.frame(), self.nodes.frame(), self.edges.frame(), self.encode, k=k, filters=filters, strict=strict)

    def analyse(self, text: str) -> dict[str, Any]:
        """Entities, concepts, facts and candidates of a text, without storing anything."""
        return analyse(self.spark.createDataFrame([("", text)], "id string, text string")).first().asDict(recursive=True)

    # graph

    def add_nodes(self, nodes: DataFrame) -> None:
        self.nodes.put(self._seq(nodes, self.nodes.frame().columns, 0))

    def add_edges(self, edges: DataFrame) -> None:
        """Edges by id; without an id, one from what they link."""
        named = edges.withColumn("id", F.coalesce(F.col("id") if "id" in edges.columns else F.lit(None), I.edge_id(F.col("source_id"), F.col("target_id"), F.col("relation_type"))))
        bad = named.where("confidence < 0 or confidence > 1 or isnan(confidence)").limit(1).count()
        if bad:
            raise ValueError("confidence must be between 0 and 1")
        self.edges.put(self._seq(named, self.edges.frame().columns, 0))

    def delete_node(self, id: str) -> bool:
        there = self.nodes.get(id) is not None
        if there:
            self._cut(self.spark.createDataFrame([(id,)], "id string"))
        return there

    def delete_edges(self, source: str, target: str, relation_type: str | None = None) -> bool:
        gone = self.spark.createDataFrame([(source, target, relation_type)], "source_id string, target_id string, relation_type string")
        before = self.edges.frame()
        n = before.count()
        left = G.without_edges(before, gone)
        if left.count() == n:
            return False
        self.edges.replace(left)
        return True

    def node_by_label(self, label: str, node_type: str = "ENTITY") -> dict[str, Any] | None:
        """The earliest node of a label, case and outer blanks aside."""
        row = self.nodes.frame().where((F.col("node_type") == node_type) & (T.label_key(F.col("label")) == T.label_key(F.lit(label)))).orderBy("seq", "id").first()
        return row and row.asDict()

    def add_entity(self, id: str, name: str, type: str = "CONCEPT", metadata: dict[str, Any] | None = None) -> None:
        self.add_nodes(self.spark.createDataFrame([(id, name, "ENTITY", json.dumps({**(metadata or {}), "entity_type": type}))], "id string, label string, node_type string, properties string"))

    def entity(self, id: str) -> dict[str, Any] | None:
        row = G.as_entities(self.nodes.frame().where(F.col("id") == id)).first()
        if row is None:
            return None
        own = json.loads(row["metadata"] or "{}")
        own.pop("entity_type", None)
        return row.asDict() | {"metadata": own}

    def neighbours(self, id: str, types: list[str] | None = None) -> list[dict[str, Any]]:
        start = self.spark.createDataFrame([(id,)], "id string")
        found = G.neighbours(self.nodes.frame(), self.edges.frame(), starts=start, types=types)
        return [r.asDict() for r in found.join(self.nodes.frame().withColumnRenamed("id", "other"), "other").orderBy("edge_id", "other").collect()]

    def traverse(self, id: str, hops: int = 2, types: list[str] | None = None) -> list[dict[str, Any]]:
        """A path to every node within reach, nearest first; none from a node that isn't there."""
        start = self.spark.createDataFrame([(id,)], "id string")
        return [r.asDict() for r in G.reach(self.nodes.frame(), self.edges.frame(), start, hops=hops, types=types).orderBy("hop", "path").collect()]

    def evidence(self, edge_id: str) -> dict[str, Any] | None:
        row = self.edges.get(edge_id)
        return row and {k: row[k] for k in ("id", "source_id", "target_id", "relation_type", "confidence", "evidence_text", "properties")}

    def subgraph(self, ids: list[str] | None = None, depth: int = 2) -> tuple[DataFrame, DataFrame]:
        starts = self.spark.createDataFrame([(i,) for i in ids], "id string") if ids else None
        return G.subgraph(self.nodes.frame(), self.edges.frame(), starts, depth=depth)

    def visualise(self, kind: str = "text", ids: list[str] | None = None, depth: int = 2, path: str | None = None) -> Any:
        """The graph, or what is around some nodes, as text, json, dot or html."""
        nodes, edges = self.subgraph(ids, depth)
        return export.as_html(nodes, edges, path) if kind == "html" else {"text": export.as_text, "json": export.as_json, "dot": export.as_dot}[kind](nodes, edges)
