"""Language models for entities, facts and relations: native rules, or a parser where its package is there."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hyphae.functions import text as T

ANALYSIS = "entities array<struct<name: string, type: string>>, concepts array<string>, facts array<struct<subject: string, predicate: string, object: string, confidence: double>>, candidates array<struct<source: string, target: string, relation_type: string, confidence: double, evidence: string>>"


def analyse_by_rules(docs: DataFrame, *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, entities, concepts, facts, candidates) in one native pass."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    pairs = F.transform(T.cooccurrences(text), lambda p: F.struct(p["source"].alias("source"), p["target"].alias("target"), F.lit("CO_OCCURS_WITH").alias("relation_type"), F.lit(T.COOCCURRENCE_CONFIDENCE).alias("confidence"), p["evidence"].alias("evidence")))
    return docs.select(F.col(f"`{id_col}`").alias("id"), T.entities(text).alias("entities"), T.concepts(text).alias("concepts"), T.facts(text).alias("facts"), pairs.alias("candidates"))


def parsed(doc: Any) -> dict[str, list]:
    """Analysis of a parsed text with entities, noun chunks and dependencies."""
    names: dict[str, str] = {}
    for e in doc.ents:
        name = e.text.strip()
        if len(name) > 1:
            names.setdefault(name, e.label_)
    chunks = list(dict.fromkeys(c for c in (n.text.lower().strip() for n in doc.noun_chunks) if len(c) > 2))[:10]
    facts, pairs = [], []
    for sentence in doc.sents:
        for verb in (t for t in sentence if t.pos_ in ("VERB", "AUX")):
            subjects = [c for c in verb.children if c.dep_ in ("nsubj", "nsubjpass")]
            objects = [c for c in verb.children if c.dep_ in ("dobj", "pobj", "attr", "acomp")]
            facts += [{"subject": s.text, "predicate": verb.lemma_, "object": o.text, "confidence": 0.9} for s in subjects for o in objects]
        here = [n for n in names if n in sentence.text]
        pairs += [{"source": a, "target": b, "relation_type": "CONNECTED_TO", "confidence": 0.8, "evidence": sentence.text.strip()} for a, b in zip(here, here[1:])]
    return {"entities": [{"name": n, "type": t} for n, t in names.items()], "concepts": chunks, "facts": facts, "candidates": pairs}


def analyse_by_parser(docs: DataFrame, model: str = "en_core_web_sm", *, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """The same columns from a dependency parser, loaded once a task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = docs.schema[id_col].dataType.simpleString()
    schema = docs.sparkSession.createDataFrame([], f"id {kind}, {ANALYSIS}").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import spacy

        parser = spacy.load(model)
        for batch in batches:
            rows = [{"id": i} | parsed(parser(t or "")) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))

    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, schema)


def analyse(docs: DataFrame, kind: str = "rules", model: str = "en_core_web_sm", **columns: str) -> DataFrame:
    """By a parser if that is asked for and its package and model are there, else by rules."""
    if kind == "parser":
        try:
            import spacy

            spacy.load(model)
            return analyse_by_parser(docs, model, **columns)
        except (ImportError, OSError):
            pass
    return analyse_by_rules(docs, **columns)
