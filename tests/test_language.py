"""The query language, quirk by quirk."""

import pytest

from hyphae.plans.language import FIELDS, Query, QueryError, parse, plan_steps, tokens


def test_whole_query():
    q = parse('FIND documents WHERE semantic_match("engine storage") AND metadata.category = "tech" AND metadata.version = 2 TRAVERSE 2 HOPS WITH RELATIONSHIPS ["MENTIONS", "SIMILAR_TO"] RETURN documents, scores', strict=True)
    assert q == Query("documents", "engine storage", {"category": "tech", "version": 2}, 2, ["MENTIONS", "SIMILAR_TO"], ["documents", "scores"], 10)
    assert plan_steps(q) == ["VectorSearchStep", "MetadataFilterStep", "GraphTraverseStep", "RankAndAssembleStep"]
    assert plan_steps(Query()) == ["RankAndAssembleStep"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Tesla battery production", Query(semantic_query="Tesla battery production")),
        ("", Query(semantic_query="")),
        ('find documents where metadata.a = "x"', Query()),
        ('FIND Entities WHERE SEMANTIC_MATCH("x")', Query(target="entities", metadata_filters={"SEMANTIC_MATCH": None})),
        ("FIND documents WHERE metadata.y > 5", Query(metadata_filters={"y": 5})),
        ("FIND documents WHERE metadata.y != 5", Query(metadata_filters={"y": 5})),
        ('FIND documents WHERE a = "x" OR b = "y"', Query(metadata_filters={"a": "x", "OR": None, "b": "y"})),
        ("FIND documents WHERE metadata.k = -5", Query(metadata_filters={"k": 5})),
        ("FIND documents WHERE metadata.k = 1.5", Query(metadata_filters={"k": 1.5})),
        ("FIND documents WHERE metadata.k = true", Query(metadata_filters={"k": None, "true": None})),
        ("FIND documents WHERE k = 1 AND k = 2", Query(metadata_filters={"k": 2})),
        ('FIND documents WHERE semantic_match "a" semantic_match("b")', Query(semantic_query="b")),
        ("FIND documents WHERE metadata.k = 'open", Query(metadata_filters={"k": "open"})),
        ("FIND documents TRAVERSE 3 HOPS WITH RELATIONSHIPS []", Query(traverse_hops=3, allowed_relationship_types=[])),
        ("FIND documents RETURN RELATIONSHIPS", Query()),
        ("FIND documents RETURN Documents, SCORES", Query(return_fields=["documents", "scores"])),
        ("FIND documents RETURN documents WHERE a = 1", Query(return_fields=["documents", "a"])),
        ("FIND", Query()),
    ],
)
def test_lenient(text, want):
    assert parse(text) == want


@pytest.mark.parametrize("text", ["FIND documents WHERE metadata.k = 1.2.3", "FIND documents TRAVERSE 1.5 HOPS", 'FIND documents WHERE metadata.a.b = "x"'])
def test_no_meaning(text):
    with pytest.raises(QueryError):
        parse(text)


@pytest.mark.parametrize("text", ["find documents", "FIND documents WHERE a > 5", "FIND documents WHERE a = true", "FIND documents TRAVERSE 2", "FIND documents RETURN documents TRAVERSE 2 HOPS ?"])
def test_strict(text):
    with pytest.raises(QueryError):
        parse(text, strict=True)


def test_tokens():
    assert [(t.kind, t.value) for t in tokens("a_1=.'x\"y' ~")] == [("name", "a_1"), ("=", "="), (".", "."), ("string", 'x"y'), ("unknown", "~"), ("end", "")]
    assert FIELDS == ("documents", "entities", "relationships", "scores")
