"""Queries over whole tables for every operator outside the subpackage of training data, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyphae.functions import text as T
from hyphae.functions.embedding import hash_buckets, hash_vector, hash_vectors
from hyphae.functions.metadata import equals
from hyphae.functions.vector import three_decimals
from hyphae.operators import graph as G
from hyphae.operators import ingest as I
from hyphae.operators.changes import changed_per_run
from hyphae.operators.search import top_k, top_k_each
from hyphae.plans import engine
from hyphae.plans.language import parse
from hyphae.session import prepare
from hyphae.streaming.feed import latest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

QUESTION = "the vector store moved records near the harbour before the freeze"
FIND = f'FIND documents WHERE semantic_match("{QUESTION}") AND metadata.category = "technology" TRAVERSE 1 HOPS WITH RELATIONSHIPS ["MENTIONS", "SIMILAR_TO"] RETURN documents, entities, relationships'


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


# documents and metadata


@query("SELECT doc_id, id, lang, n_chars FROM documents WHERE id = (SELECT min(id) FROM documents)")
def doc_point_lookup(spark, folder):
    docs = table(spark, folder, "documents")
    return docs.where(F.col("id") == docs.agg(F.min("id")).first()[0]).select("doc_id", "id", "lang", "n_chars")


@query("SELECT doc_id, id, n_chars FROM documents ORDER BY doc_id LIMIT 100 OFFSET 100")
def doc_page(spark, folder):
    return table(spark, folder, "documents").select("doc_id", "id", "n_chars").orderBy("doc_id").offset(100).limit(100)


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(DISTINCT id) FROM vectors) AS vectors")
def doc_count(spark, folder):
    a = table(spark, folder, "documents").agg(F.count("*").alias("documents"))
    return a.join(table(spark, folder, "vectors").agg(F.countDistinct("id").alias("vectors")), F.lit(True))


@query("SELECT id, feed_id, metadata FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY updated_at DESC NULLS LAST, feed_id DESC) AS n FROM doc_feed WHERE id IS NOT NULL) WHERE n = 1")
def doc_upsert_latest(spark, folder):
    return latest(table(spark, folder, "doc_feed")).select("id", "feed_id", "metadata")


@query("SELECT id, coalesce(u.feed_id, -1) AS feed_id FROM documents LEFT JOIN (SELECT id, max(feed_id) AS feed_id FROM doc_feed GROUP BY id) u USING (id)")
def doc_update(spark, folder):
    new = table(spark, folder, "doc_feed").groupBy("id").agg(F.max("feed_id").alias("feed_id"))
    return table(spark, folder, "documents").select("id").join(new, "id", "left").select("id", F.coalesce("feed_id", F.lit(-1)).alias("feed_id"))


@query("SELECT doc_id, id FROM documents WHERE id NOT IN (SELECT id FROM doc_feed WHERE id IS NOT NULL)")
def doc_delete_anti(spark, folder):
    return table(spark, folder, "documents").join(table(spark, folder, "doc_feed").select("id"), "id", "left_anti").select("doc_id", "id")


@query("""SELECT doc_id, coalesce(json_type(metadata, '$.version') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AND try_cast(json_extract_string(metadata, '$.version') AS DOUBLE) = 2, false) AS is_two,
  coalesce(json_type(metadata, '$.version') = 'VARCHAR' AND json_extract_string(metadata, '$.version') = '2', false) AS is_text,
  coalesce(json_type(metadata, '$.author') = 'NULL', true) AS no_author FROM documents""")
def metadata_equality(spark, folder):
    m = F.col("metadata")
    return table(spark, folder, "documents").select("doc_id", equals(m, "version", 2).alias("is_two"), equals(m, "version", "2").alias("is_text"), equals(m, "author", None).alias("no_author"))


# embeddings and vectors

_WORDS = f"SELECT id, unnest(list_filter(regexp_split_to_array(lower(text), '{T.WHITE}+'), lambda w: w <> '')) AS w FROM {{0}}"
_SLOTS = "SELECT id, CAST(CAST('0x' || substr(sha256(w), 1, 8) AS BIGINT) % 384 AS INTEGER) AS slot, 1 - 2 * (CAST('0x' || substr(sha256(w), 9, 2) AS BIGINT) % 2) AS sign FROM ({0})"


def _weights(source: str) -> str:
    return f"SELECT id, slot, CAST(sum(sign) AS BIGINT) AS weight FROM ({_SLOTS.format(_WORDS.format(source))}) GROUP BY id, slot HAVING sum(sign) <> 0"


@query(_weights("documents"))
def hash_embed_buckets(spark, folder):
    return hash_buckets(table(spark, folder, "documents"))


@query(f"""WITH w AS ({_weights("documents")}), n AS (SELECT id, sqrt(sum(weight * weight)) AS norm FROM w GROUP BY id)
SELECT id, slot, round(weight / norm, 6) AS value FROM w JOIN n USING (id)
UNION ALL SELECT id, CAST(s AS INTEGER) AS slot, round(1 / sqrt(384), 6) AS value FROM documents, range(384) r(s) WHERE text <> '' AND id NOT IN (SELECT id FROM n)""")
def hash_embedding(spark, folder):
    made = hash_vectors(table(spark, folder, "documents")).select("id", F.posexplode("embedding").alias("slot", "v"))
    return made.where("v <> 0").select("id", "slot", F.round("v", 6).alias("value"))


_FIRST = "(SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings ORDER BY vec_id LIMIT 1)"
_SCORED = f"SELECT vec_id AS id, label, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), q), 9) AS score FROM embeddings, {_FIRST}"


def _first_vector(vectors: DataFrame) -> list[float]:
    return [float(x) for x in vectors.orderBy("vec_id").select("embedding").first()[0]]


@query(f"SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({_SCORED}) ORDER BY rank LIMIT 10")
def vector_topk(spark, folder):
    v = table(spark, folder, "embeddings")
    return top_k(v, _first_vector(v), 10, id_col="vec_id").select("id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM ({_SCORED}) WHERE label = 3 ORDER BY rank LIMIT 10")
def vector_topk_filtered(spark, folder):
    v = table(spark, folder, "embeddings")
    own = v.withColumn("metadata", F.to_json(F.struct("label")))
    return top_k(own, _first_vector(v), 10, filters={"label": 3}, id_col="vec_id").select("id", F.round("score", 6).alias("score"), "rank")


@query(f"SELECT id, round(score, 6) AS score FROM (SELECT * FROM ({_SCORED}) ORDER BY score DESC, id LIMIT 20) WHERE label = 3 ORDER BY score DESC, id LIMIT 10")
def overfetch_postfilter(spark, folder):
    v = table(spark, folder, "embeddings")
    wide = top_k(v, _first_vector(v), 20, id_col="vec_id")
    return wide.join(v.select(F.col("vec_id").alias("id"), "label"), "id").where("label = 3").orderBy("rank").limit(10).select("id", F.round("score", 6).alias("score"))


@query("""SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM
  (SELECT a.vec_id AS query_id, b.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)) WHERE rank <= 6""")
def knn_per_vector(spark, folder):
    v = table(spark, folder, "embeddings")
    return top_k_each(v, v.where("vec_id % 50 = 0"), 6, id_col="vec_id").select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_SOUND = "SELECT id, any_value(embedding) AS e, CAST(regexp_extract(id, '[0-9]+$') AS BIGINT) AS seq FROM vectors WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: isnan(x))) = 0 GROUP BY id"
_NEAR = f"""SELECT doc_id, other, score FROM (SELECT a.id AS doc_id, b.id AS other, round(coalesce(CASE WHEN list_sum(list_transform(a.e, lambda x: abs(x))) = 0 OR list_sum(list_transform(b.e, lambda x: abs(x))) = 0 THEN 0 ELSE list_cosine_similarity(a.e, b.e) END, 0), 9) AS score
  FROM sound a, sound b WHERE b.seq <= a.seq QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY score DESC, b.id) <= 6) WHERE doc_id <> other"""


def _ordered_vectors(spark, folder) -> DataFrame:
    v = table(spark, folder, "vectors")
    return v.select("id", "embedding", F.regexp_extract("id", "[0-9]+$", 0).try_cast("long").alias("seq"))


@query(f"WITH sound AS ({_SOUND}) SELECT doc_id, other, round(score, 6) AS score FROM ({_NEAR})")
def candidate_documents(spark, folder):
    return I.candidates(_ordered_vectors(spark, folder)).select("doc_id", "other", F.round("score", 6).alias("score"))


@query(f"WITH sound AS ({_SOUND}) SELECT doc_id AS source_id, other AS target_id, 'SIMILAR_TO' AS relation_type, round(least(1, greatest(0, score)), 6) AS confidence FROM ({_NEAR}) WHERE score >= 0.6")
def similar_to_edges(spark, folder):
    return I.similar_edges(I.candidates(_ordered_vectors(spark, folder))).select("source_id", "target_id", "relation_type", F.round("confidence", 6).alias("confidence"))


@query("SELECT vec_id, printf('%.3f', score) AS shown FROM (SELECT vec_id, list_cosine_similarity(CAST(embedding AS DOUBLE[]), [1.0::DOUBLE] || list_resize([]::DOUBLE[], 63, 0.0::DOUBLE)) AS score FROM embeddings)")
def score_format(spark, folder):
    from hyphae.functions.vector import cosine, literal

    shown = three_decimals(cosine(F.col("embedding"), literal([1.0] + [0.0] * 63)))
    return table(spark, folder, "embeddings").select("vec_id", F.when(shown == "0.000", F.when(F.col("embedding")[0] < 0, "-0.000").otherwise(shown)).otherwise(shown).alias("shown"))


# texts

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_MASK = r"array_to_string(list_transform(regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]+'), lambda t: CASE WHEN regexp_matches(t, '[\p{{L}}\p{{N}}_]') AND NOT regexp_full_match(t, '[A-Za-z0-9_]+') THEN '_' ELSE t END), '')"
_FOUND = f"regexp_extract_all({_MASK.format('text')}, '\\b([A-Z][a-zA-Z0-9]+(?:{T.WHITE}+[A-Z][a-zA-Z0-9]+)*)\\b', 1)"
_NAMED = f"SELECT id, doc_id, text, list_filter(raw, lambda n, i: list_position(raw, n) = i) AS names FROM (SELECT id, doc_id, text, list_filter({_FOUND}, lambda n: length(n) >= 3 AND lower(n) NOT IN ({_STOP})) AS raw FROM documents WHERE text IS NOT NULL)"
_TYPE = "CASE WHEN " + " OR ".join(f"contains(name, '{p}')" for p in T.TECHNOLOGY) + " THEN 'TECHNOLOGY' WHEN " + " OR ".join(f"contains(name, '{p}')" for p in T.ORGANIZATION) + " THEN 'ORGANIZATION' ELSE 'CONCEPT' END"
_MENTIONED = f"SELECT id, doc_id, CAST(i - 1 AS INTEGER) AS pos, names[i] AS name, lower(regexp_replace(names[i], '^{T.WHITE}+|{T.WHITE}+$', '', 'g')) AS key FROM (SELECT *, unnest(generate_series(1, len(names))) AS i FROM ({_NAMED}))"
_CONCEPTS = f"regexp_extract_all({_MASK.format('lower(text)')}, '\\b[a-zA-Z]{{3,}}\\b')"
_SENTENCES = f"regexp_split_to_array(text, '{T.SENTENCE_END}')"
_STRIPPED = f"regexp_replace({{0}}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g')"


def _docs(spark, folder) -> DataFrame:
    return table(spark, folder, "documents").select("id", "doc_id", "text", "metadata", F.col("doc_id").alias("seq"))


@query(f"SELECT doc_id, pos, name FROM ({_MENTIONED})")
def entities(spark, folder):
    return I.document_entities(_docs(spark, folder).where("text is not null").select(F.col("doc_id").alias("id"), "text", "seq")).select("doc_id", "pos", "name")


@query(f"SELECT name, {_TYPE} AS type, count(*) AS documents FROM ({_MENTIONED}) GROUP BY name")
def entity_types(spark, folder):
    return I.document_entities(_docs(spark, folder)).groupBy("name", "type").agg(F.count("*").alias("documents"))


@query(f"SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, c[i] AS concept FROM (SELECT doc_id, c, unnest(generate_series(1, len(c))) AS i FROM (SELECT doc_id, list_filter(r, lambda w, i: list_position(r, w) = i)[1:10] AS c FROM (SELECT doc_id, list_filter({_CONCEPTS}, lambda w: w NOT IN ({_STOP})) AS r FROM documents WHERE text IS NOT NULL)))")
def concepts(spark, folder):
    return table(spark, folder, "documents").select("doc_id", F.posexplode(T.concepts(F.col("text"))).alias("pos", "concept"))


@query(f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS pos, {_STRIPPED.format(f"regexp_extract(s[i], '{T.FACT}', 1)")} AS subject, regexp_extract(s[i], '{T.FACT}', 2) AS predicate, {_STRIPPED.format(f"regexp_extract(s[i], '{T.FACT}', 3)")} AS object
FROM (SELECT doc_id, s, unnest(generate_series(1, len(s))) AS i FROM (SELECT doc_id, list_filter({_SENTENCES}, lambda x: regexp_matches(x, '{T.FACT}')) AS s FROM documents WHERE text IS NOT NULL))""")
def facts(spark, folder):
    found = table(spark, folder, "documents").select("doc_id", F.posexplode(T.facts(F.col("text"))).alias("pos", "f"))
    return found.select("doc_id", "pos", "f.subject", "f.predicate", "f.object")


_PAIRED = f"""SELECT doc_id, id, CAST(k - 1 AS INTEGER) AS sentence, CAST(i AS INTEGER) AS place, here[i] AS source, here[i + 1] AS target FROM (SELECT *, unnest(generate_series(1, len(here) - 1)) AS i FROM
  (SELECT doc_id, id, k, list_filter(names, lambda n: contains(s[k], n)) AS here FROM (SELECT doc_id, id, names, s, unnest(generate_series(1, len(s))) AS k FROM (SELECT doc_id, id, names, {_SENTENCES} AS s FROM ({_NAMED})))) WHERE len(here) >= 2)"""


@query(f"SELECT doc_id, sentence, place, source, target FROM ({_PAIRED})")
def cooccurrence(spark, folder):
    return I.cooccurrences(_docs(spark, folder).select(F.col("doc_id").alias("id"), "text")).select("doc_id", "sentence", "place", "source", "target")


@query("SELECT id, CASE WHEN length(text) > 40 THEN substr(text, 1, 40) || '...' ELSE text END AS label, 'DOCUMENT' AS node_type FROM documents")
def doc_nodes(spark, folder):
    return I.document_nodes(table(spark, folder, "documents")).select("id", "label", "node_type")


@query(f"SELECT 'ent-' || sha256(key) AS id, arg_min(name, [doc_id, pos]) AS label, count(*) AS mentions FROM ({_MENTIONED}) GROUP BY key")
def entity_resolution(spark, folder):
    found = I.document_entities(_docs(spark, folder))
    return I.entity_nodes(found).join(found.groupBy(F.col("entity").alias("id")).agg(F.count("*").alias("mentions")), "id").select("id", "label", "mentions")


@query(f"SELECT id AS source_id, 'ent-' || sha256(key) AS target_id, 'Document ''' || id || ''' explicitly mentions entity ''' || arg_min(name, pos) || '''' AS evidence_text FROM ({_MENTIONED}) GROUP BY id, key")
def mentions_edges(spark, folder):
    return I.mention_edges(I.document_entities(_docs(spark, folder))).select("source_id", "target_id", "evidence_text")


@query(f"""WITH sound AS ({_SOUND}), near AS ({_NEAR}), m AS (SELECT DISTINCT id, key FROM ({_MENTIONED}))
SELECT other AS source_id, 'ent-' || sha256(a.key) AS target_id, round(least(1, greatest(0, max(score))), 6) AS confidence FROM near JOIN m a ON a.id = doc_id JOIN m b ON b.id = other AND b.key = a.key GROUP BY other, a.key""")
def cross_doc_links(spark, folder):
    mentions = I.mention_edges(I.document_entities(_docs(spark, folder)))
    return I.cross_links(I.candidates(_ordered_vectors(spark, folder)), mentions).select("source_id", "target_id", F.round("confidence", 6).alias("confidence"))


@query(f"SELECT 'ent-' || sha256(lower(source)) AS source_id, 'ent-' || sha256(lower(target)) AS target_id, 0.75::DOUBLE AS confidence FROM ({_PAIRED}) GROUP BY ALL")
def intra_document_edges(spark, folder):
    return I.cooccurrence_edges(I.cooccurrences(_docs(spark, folder))).select("source_id", "target_id", "confidence")


@query(f"""WITH sound AS ({_SOUND}), near AS ({_NEAR}), c AS (SELECT doc_id, count(*) AS seen, count(*) FILTER (score >= 0.6) AS near FROM near GROUP BY doc_id)
SELECT d.id, coalesce(len(n.names), 0) AS entities_extracted, coalesce(f.n, 0) AS facts_extracted, coalesce(len(n.names), 0) + coalesce(c.near, 0) + coalesce(p.n, 0) AS relationships_created, coalesce(c.seen, 0) AS candidate_docs_evaluated
FROM documents d LEFT JOIN ({_NAMED}) n ON n.id = d.id LEFT JOIN (SELECT id, count(*) AS n FROM ({_PAIRED}) GROUP BY id) p ON p.id = d.id
LEFT JOIN (SELECT id, len(list_filter({_SENTENCES}, lambda x: regexp_matches(x, '{T.FACT}'))) AS n FROM documents) f ON f.id = d.id LEFT JOIN c ON c.doc_id = d.id""")
def ingest_counters(spark, folder):
    return I.counters(_docs(spark, folder), I.candidates(_ordered_vectors(spark, folder)))


# graph

_NODE = "(SELECT DISTINCT id FROM nodes WHERE id IS NOT NULL)"
_LINK = "(SELECT DISTINCT id, source_id, target_id, relation_type FROM edges WHERE source_id IS NOT NULL AND target_id IS NOT NULL)"


def _neighbours_sql(where: str = "TRUE") -> str:
    return f"""SELECT s.at, s.other, s.edge_id FROM (SELECT source_id AS at, target_id AS other, id AS edge_id FROM {_LINK} WHERE {where} UNION ALL SELECT target_id, source_id, id FROM {_LINK} WHERE source_id <> target_id AND {where}) s
JOIN {_NODE} a ON a.id = s.at JOIN {_NODE} b ON b.id = s.other"""


def _graph(spark, folder) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "nodes"), table(spark, folder, "edges")


@query(_neighbours_sql())
def neighbors(spark, folder):
    return G.neighbours(*_graph(spark, folder))


@query(_neighbours_sql("relation_type IN ('CONTAINS', 'OWNED_BY')"))
def neighbors_typed(spark, folder):
    return G.neighbours(*_graph(spark, folder), types=["CONTAINS", "OWNED_BY"])


def _places(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Customers and suppliers in nations, nations in regions, as a graph."""
    node = lambda t, k, mark: table(spark, folder, t).select(F.concat(F.lit(mark), F.col(k)).alias("id"))
    edge = lambda t, k, mark, to, up: table(spark, folder, t).select(F.concat(F.lit(mark), F.col(k)).alias("source_id"), F.concat(F.lit(up), F.col(to)).alias("target_id"), F.lit("IN").alias("relation_type"))
    nodes = node("region", "r_regionkey", "r").union(node("nation", "n_nationkey", "n")).union(node("customer", "c_custkey", "c")).union(node("supplier", "s_suppkey", "s"))
    edges = edge("nation", "n_nationkey", "n", "n_regionkey", "r").union(edge("customer", "c_custkey", "c", "c_nationkey", "n")).union(edge("supplier", "s_suppkey", "s", "s_nationkey", "n"))
    return nodes, edges.withColumn("id", F.concat_ws("-", "source_id", "target_id"))


_PLACE_STEPS = """l AS (SELECT 'n' || n_nationkey AS a, 'r' || n_regionkey AS b FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
s AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l)"""


@query(f"""WITH RECURSIVE {_PLACE_STEPS}, f AS (SELECT 'r' || r_regionkey AS start_id, 'r' || r_regionkey AS id, 0 AS hop FROM region UNION SELECT f.start_id, s.b, f.hop + 1 FROM f JOIN s ON s.a = f.id WHERE f.hop < 2)
SELECT start_id, id, min(hop) AS hop FROM f GROUP BY start_id, id HAVING min(hop) > 0""")
def bfs_reach(spark, folder):
    nodes, edges = _places(spark, folder)
    return G.reach(nodes, edges, table(spark, folder, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id")), hops=2).select("start_id", "id", "hop")


@query(f"""WITH RECURSIVE {_PLACE_STEPS}, f AS (SELECT 'n0' AS id, 0 AS hop UNION SELECT s.b, f.hop + 1 FROM f JOIN s ON s.a = f.id WHERE f.hop < 2), g AS (SELECT DISTINCT id FROM f)
SELECT a AS source_id, b AS target_id FROM l WHERE a IN (FROM g) AND b IN (FROM g)""")
def subgraph(spark, folder):
    nodes, edges = _places(spark, folder)
    start = spark.createDataFrame([("n0",)], "id string")
    return G.subgraph(nodes.withColumn("label", F.col("id")), edges, start, depth=2)[1].select("source_id", "target_id")


@query("SELECT DISTINCT id, source_id, target_id, relation_type, confidence, evidence_text, properties FROM edges WHERE id = (SELECT min(id) FROM edges)")
def edge_evidence(spark, folder):
    edges = table(spark, folder, "edges")
    return edges.where(F.col("id") == edges.agg(F.min("id")).first()[0]).select("id", "source_id", "target_id", "relation_type", "confidence", "evidence_text", "properties").distinct()


_KEYED = f"lower(regexp_replace({{0}}, '^{T.WHITE}+|{T.WHITE}+$', '', 'g'))"


@query(f"SELECT name AS label, min(n.id) AS id FROM (SELECT DISTINCT name FROM entities WHERE name IS NOT NULL) e JOIN nodes n ON n.node_type = 'ENTITY' AND {_KEYED.format('n.label')} = {_KEYED.format('e.name')} GROUP BY name")
def node_by_label(spark, folder):
    return G.by_label(table(spark, folder, "nodes"), table(spark, folder, "entities").select(F.col("name").alias("label")))


@query("SELECT id, source_id, target_id FROM edges WHERE coalesce(source_id NOT IN (SELECT id FROM nodes WHERE node_type = 'DOCUMENT' AND id IS NOT NULL), true) AND coalesce(target_id NOT IN (SELECT id FROM nodes WHERE node_type = 'DOCUMENT' AND id IS NOT NULL), true)")
def node_delete_cascade(spark, folder):
    nodes, edges = _graph(spark, folder)
    return G.without_nodes(nodes, edges, nodes.where("node_type = 'DOCUMENT'"))[1].select("id", "source_id", "target_id")


@query("SELECT id FROM edges e WHERE NOT EXISTS (SELECT 1 FROM edges x WHERE x.relation_type = 'REPLACES' AND x.source_id = e.source_id AND x.target_id = e.target_id)")
def edge_delete(spark, folder):
    edges = table(spark, folder, "edges")
    gone = edges.where("relation_type = 'REPLACES'").select("source_id", "target_id", F.lit(None).cast("string").alias("relation_type"))
    return G.without_edges(edges, gone).select("id")


@query("SELECT DISTINCT id, label AS name, coalesce(CASE WHEN json_type(properties, '$.entity_type') <> 'NULL' THEN json_extract_string(properties, '$.entity_type') END, 'CONCEPT') AS type FROM nodes WHERE node_type = 'ENTITY'")
def entity_view(spark, folder):
    return G.as_entities(table(spark, folder, "nodes")).select("id", "name", "type").distinct()


@query("SELECT node_type, count(DISTINCT id) AS nodes FROM nodes GROUP BY node_type")
def node_types(spark, folder):
    return table(spark, folder, "nodes").groupBy("node_type").agg(F.countDistinct("id").alias("nodes"))


@query("SELECT id FROM edges WHERE confidence >= 0.6 AND NOT isnan(confidence)")
def confidence_threshold(spark, folder):
    return table(spark, folder, "edges").where("confidence >= 0.6 and not isnan(confidence)").select("id")


def _mentioned_sql(order: str) -> str:
    pick = f"SELECT id, arg_max(text, {order}feed_id) AS text FROM doc_feed WHERE text IS NOT NULL GROUP BY id"
    return _MENTIONED.replace("FROM documents WHERE text IS NOT NULL", f"FROM (SELECT id, 0 AS doc_id, text FROM ({pick}))")


@query(f"""WITH old AS (SELECT DISTINCT id, key FROM ({_mentioned_sql('-')})), new AS (SELECT DISTINCT id, key FROM ({_mentioned_sql('')}))
SELECT coalesce(o.id, n.id) AS doc_id, count(*) FILTER (o.id IS NULL) AS created, count(*) FILTER (o.id IS NOT NULL AND n.id IS NOT NULL) AS updated, count(*) FILTER (n.id IS NULL) AS removed FROM old o FULL JOIN new n ON o.id = n.id AND o.key = n.key GROUP BY 1""")
def update_reconcile(spark, folder):
    feed = table(spark, folder, "doc_feed").where("text is not null and id is not null")
    edges = lambda pick: I.mention_edges(I.document_entities(feed.groupBy("id").agg(pick("text", "feed_id").alias("text")).withColumn("seq", F.lit(0)))).withColumn("doc_id", F.col("source_id"))
    return I.reconcile_counts(I.reconcile(edges(F.min_by), edges(F.max_by)))


# whole queries

_Q = _weights(f"(SELECT 'q' AS id, '{QUESTION}' AS text)")
_HYBRID = f"""w AS ({_weights('documents')}), q AS (SELECT slot, weight FROM ({_Q})), qn AS (SELECT sqrt(sum(weight * weight)) AS n, sum(weight) AS s FROM q),
dots AS (SELECT w.id, sum(w.weight * q.weight) AS d FROM w JOIN q USING (slot) GROUP BY w.id), norms AS (SELECT id, sqrt(sum(weight * weight)) AS n FROM w GROUP BY id),
scored AS (SELECT id, round(CASE WHEN text IS NULL OR text = '' THEN 0 WHEN norms.n IS NULL THEN qn.s / sqrt(384) / qn.n ELSE coalesce(d, 0) / norms.n / qn.n END, 9) AS score FROM documents LEFT JOIN norms USING (id) LEFT JOIN dots USING (id), qn)"""
_HITS = f"""{_HYBRID}, wide AS (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 20),
hits AS (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS place FROM wide JOIN documents USING (id) WHERE json_type(metadata, '$.category') = 'VARCHAR' AND json_extract_string(metadata, '$.category') = 'technology' ORDER BY score DESC, id LIMIT 10)"""
_AROUND = f"""near AS ({_neighbours_sql("relation_type IN ('MENTIONS', 'SIMILAR_TO')")})"""


def _hybrid(spark, folder) -> engine.Result:
    docs = _docs(spark, folder)
    nodes, edges = _graph(spark, folder)
    return engine.execute(parse(FIND), docs, hash_vectors(docs), nodes, edges, hash_vector)


@query(f"WITH {_HYBRID} SELECT id AS document_id, round(score, 6) AS score, coalesce(text, '') AS text, rank FROM (SELECT id, score, CAST(row_number() OVER (ORDER BY score DESC, id) AS INTEGER) AS rank FROM scored) JOIN documents USING (id) WHERE rank <= 10")
def semantic_search(spark, folder):
    docs = _docs(spark, folder)
    return engine.semantic_search(QUESTION, docs, hash_vectors(docs), hash_vector).select("document_id", F.round("score", 6).alias("score"), "text", "rank")


@query(f"WITH {_HITS} SELECT id, round(score, 6) AS score, place FROM hits")
def hybrid_query(spark, folder):
    return _hybrid(spark, folder).documents.select("id", F.round("score", 6).alias("score"), "place")


@query(f"WITH {_HITS} SELECT id, round(score, 6) AS score FROM hits")
def query_scores(spark, folder):
    return _hybrid(spark, folder).scores.select("id", F.round("score", 6).alias("score"))


@query(f"WITH {_HITS}, {_AROUND} SELECT DISTINCT n.id, n.label AS name FROM hits JOIN near ON near.at = hits.id JOIN (SELECT id, min(label) AS label FROM nodes WHERE node_type = 'ENTITY' GROUP BY id) n ON n.id = near.other")
def hybrid_entities(spark, folder):
    return _hybrid(spark, folder).entities.select("id", "name")


@query(f"WITH {_HITS}, {_AROUND} SELECT min(edge_id) AS id FROM hits JOIN near ON near.at = hits.id WHERE near.other <> hits.id GROUP BY hits.id, near.other")
def hybrid_tree(spark, folder):
    docs = _docs(spark, folder)
    nodes, edges = _graph(spark, folder)
    q = parse(FIND)
    hits = engine.matched(docs, engine.sources(docs, hash_vectors(docs), q, hash_vector), q)
    return G.reach(nodes, edges, hits, hops=1, types=q.allowed_relationship_types).select(F.col("edge_id").alias("id"))


@query("SELECT id, 1.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS place FROM documents ORDER BY doc_id LIMIT 10")
def no_semantic_list(spark, folder):
    docs = _docs(spark, folder)
    nodes, edges = _graph(spark, folder)
    return engine.execute(parse("FIND documents RETURN documents"), docs, None, nodes, edges, hash_vector).documents.select("id", "score", "place")


# new and changed records

P3_SQL = """WITH r AS (SELECT run_no, started_at, lag(started_at) OVER (ORDER BY started_at, run_no) AS before FROM ingest_runs WHERE status = 'ok' AND started_at IS NOT NULL),
f AS (SELECT id, coalesce(updated_at, created_at, TIMESTAMPTZ '0001-01-01 00:00:00+00') AS state, landed_at FROM doc_feed WHERE id IS NOT NULL AND landed_at IS NOT NULL),
s AS (SELECT r.run_no, f.id, max(state) AS now, max(state) FILTER (landed_at <= before) AS was FROM r JOIN f ON f.landed_at <= r.started_at GROUP BY r.run_no, f.id)
SELECT run_no, id FROM s WHERE was IS NULL OR now > was"""


@query(P3_SQL)
def p3_found(spark, folder):
    return changed_per_run(table(spark, folder, "doc_feed"), table(spark, folder, "ingest_runs"))
