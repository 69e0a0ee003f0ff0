"""Queries of the training-data operators, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hyphae.llm.leaks import find_leaks
from hyphae.llm.names import same_entities
from hyphae.llm.neardup import near_duplicate_classes, near_duplicate_pairs
from hyphae.llm.neighbours import most_similar
from hyphae.llm.pieces import split_texts
from hyphae.llm.spam import spam_pages
from hyphae.llm.tokenizer import encode_corpus
from hyphae.llm.topn import top_of_group
from hyphae.session import prepare


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return same_entities(_table(spark, folder, "nodes"), _table(spark, folder, "entities"), _table(spark, folder, "given_forms"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return top_of_group(_table(spark, folder, "edges")).select("source_id", "id")


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return most_similar(_table(spark, folder, "vectors")).select("id", "neighbor_id")


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_pieces(spark, folder).select("doc_id").distinct()


def p5_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_texts(_table(spark, folder, "documents"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_pairs(_table(spark, folder, "documents"), n=3, similarity=0.5)


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, folder, "documents"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"), exact=True).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return find_leaks(_table(spark, folder, "documents"), _table(spark, folder, "eval_items"), min_similarity=0.8)


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return spam_pages(docs, docs.where("source = 'handbook'")).select("doc_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"p1_found": p1_found, "p2_found": p2_found, "p4_found": p4_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_groups": p6_groups, "p7_ids": p7_ids, "p8_found": p8_found, "p8_leaks": p8_leaks, "p9_found": p9_found}

_TOP = """SELECT source_id, id FROM (SELECT source_id, id, row_number() OVER (PARTITION BY source_id ORDER BY v DESC, id) AS n FROM
  (SELECT source_id, id, max(confidence + 0.0) AS v FROM edges WHERE source_id IS NOT NULL AND id IS NOT NULL AND NOT isnan(confidence) AND confidence BETWEEN 0 AND 1 GROUP BY source_id, id)) WHERE n <= 3"""

_SOUND = "SELECT id, any_value(embedding) AS e FROM vectors WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY id"
_NEAREST = f"""WITH s AS ({_SOUND}) SELECT id, neighbor_id FROM (SELECT a.id, b.id AS neighbor_id, round(list_cosine_similarity(a.e, b.e), 6) AS c FROM s a, s b WHERE a.id <> b.id)
QUALIFY row_number() OVER (PARTITION BY id ORDER BY c DESC, neighbor_id) <= 5"""

# DuckDB has no form NFKC: NFC with wide forms made narrow and ligatures taken apart stands in for it, by rule
_WIDE, _NARROW = "".join(chr(0xFF01 + k) for k in range(94)), "".join(chr(0x21 + k) for k in range(94)).replace("'", "''")
_FORM = f"replace(replace(replace(translate(nfc_normalize(text), '{_WIDE}', '{_NARROW}'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
_WORDS = rf"regexp_extract_all(lower(regexp_replace({_FORM}, '[\x{{200B}}\x{{200C}}\x{{200D}}\x{{FEFF}}\x{{00AD}}]', '', 'g')), '[\p{{L}}\p{{N}}]+')"


def _grams(table: str, key: str, n: int) -> str:
    """(key, g): the different runs of n words of every text."""
    return f"SELECT DISTINCT id, array_to_string(w[i:i + {n - 1}], ' ') AS g FROM (SELECT id, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM (SELECT {key} AS id, {_WORDS} AS w FROM {table} WHERE text IS NOT NULL))"


_PAIRS = f"""WITH g AS ({_grams("documents", "doc_id", 3)}), n AS (SELECT id, count(*) AS n FROM g GROUP BY id), c AS (SELECT a.id AS doc_a, b.id AS doc_b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.id < b.id GROUP BY a.id, b.id)
SELECT doc_a, doc_b FROM c JOIN n x ON x.id = doc_a JOIN n y ON y.id = doc_b WHERE c * 2 >= x.n + y.n - c"""
_LEAKED = f"SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM ({_grams('documents', 'doc_id', 12)}) d JOIN ({_grams('eval_items', 'item_id', 12)}) i USING (g)"

SQL: dict[str, str] = {"p2_found": _TOP, "p4_found": _NEAREST, "p5_found": "SELECT doc_id FROM documents WHERE length(text) > 4000", "p6_found": _PAIRS, "p8_found": _LEAKED}
