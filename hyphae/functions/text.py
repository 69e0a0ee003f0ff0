"""Entities, concepts, facts and co-occurrences of a text, as native column expressions.

Word boundaries are those of Unicode letters, digits and the underscore, white
space is that of Unicode: both are written out in the patterns, so that every
engine sees the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Unicode.
WHITE = "[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000]"
#: Words that are neither entities nor concepts.
STOP_WORDS = (
    "a an the and or but if because as what which this that these those then just so than such both "
    "through about for is of to in it on by be with are from at into has have had will was were"
).split()
#: Parts of a name that tell its type, the first type that fits counts.
TECHNOLOGY = ["DB", "Database", "Store", "Engine", "Python"]
ORGANIZATION = ["Corp", "Inc", "Company", "Google", "OpenAI"]
#: Verbs of facts, confidences of facts and of co-occurrences.
VERBS = "is uses combines provides supports creates manages has contains".split()
FACT_CONFIDENCE, COOCCURRENCE_CONFIDENCE = 0.85, 0.75

_BEFORE, _AFTER = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
ENTITY = f"{_BEFORE}([A-Z][a-zA-Z0-9]+(?:{WHITE}+[A-Z][a-zA-Z0-9]+)*){_AFTER}"
CONCEPT = f"{_BEFORE}([a-zA-Z]{{3,}}){_AFTER}"
SENTENCE_END = f"[.!?]{WHITE}+"
FACT = f"([A-Z][a-zA-Z0-9_{WHITE[1:-1]}]{{2,20}}){WHITE}+({'|'.join(VERBS)}){WHITE}+([^.!,;]{{3,40}})"


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value worked out a single time for a row, however often the body and its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "")


def stop_words() -> Column:
    return F.array(*[F.lit(w) for w in STOP_WORDS])


def label_key(label: Column) -> Column:
    """What two labels of one node share."""
    return F.lower(strip(label))


def entity_type(name: Column) -> Column:
    holds = lambda parts: F.greatest(*[F.contains(name, F.lit(p)) for p in parts])
    return F.when(holds(TECHNOLOGY), "TECHNOLOGY").when(holds(ORGANIZATION), "ORGANIZATION").otherwise("CONCEPT")


def entity_names(text: Column) -> Column:
    """Names in order of their first appearance; null for a null text."""
    found = F.regexp_extract_all(text, F.lit(ENTITY), 1)
    return F.array_distinct(F.filter(found, lambda n: (F.length(n) >= 3) & ~F.array_contains(stop_words(), F.lower(n))))


def entities(text: Column) -> Column:
    """array<struct<name, type>>"""
    return F.transform(entity_names(text), lambda n: F.struct(n.alias("name"), entity_type(n).alias("type")))


def concepts(text: Column, most: int = 10) -> Column:
    """The first few different words that are no stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(CONCEPT), 1)
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop_words(), w))), 1, most)


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END, -1)


def facts(text: Column) -> Column:
    """array<struct<subject, predicate, object, confidence>>: at most one of each sentence."""
    holding = F.filter(sentences(text), lambda s: F.rlike(s, F.lit(FACT)))
    part = lambda s, k: strip(F.regexp_extract(s, FACT, k))
    return F.transform(holding, lambda s: F.struct(part(s, 1).alias("subject"), part(s, 2).alias("predicate"), part(s, 3).alias("object"), F.lit(FACT_CONFIDENCE).alias("confidence")))


def cooccurrences(text: Column) -> Column:
    """array<struct<sentence, place, source, target, evidence>>: neighbours among the names of each sentence.

    A sentence holds a name if it is a part of it; names keep the order of the
    text, not of the sentence.
    """
    def pairs(e: Column, names: Column) -> Column:
        def steps(here: Column) -> Column:
            each = F.when(F.size(here) >= 2, F.sequence(F.lit(1), F.size(here) - 1)).otherwise(F.array().cast("array<int>"))
            return F.transform(each, lambda i: F.struct(e["k"].alias("sentence"), i.alias("place"), F.element_at(here, i).alias("source"), F.element_at(here, i + 1).alias("target"), strip(e["s"]).alias("evidence")))

        return once(F.filter(names, lambda n: F.contains(e["s"], n)), steps)

    numbered = F.transform(sentences(text), lambda s, k: F.struct(k.alias("k"), s.alias("s")))
    return once(entity_names(text), lambda names: F.flatten(F.transform(numbered, lambda e: pairs(e, names))))
