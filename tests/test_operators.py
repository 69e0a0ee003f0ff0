"""Text, vectors, metadata and graph against plain Python on small fixtures."""


import math
import re

import pytest
from pyspark.sql import functions as F

from hyphae.functions import text as T
from hyphae.functions.embedding import encoder, hash_buckets, hash_vector, hash_vectors
from hyphae.functions.metadata import equals, matches
from hyphae.functions.models import analyse
from hyphae.functions.vector import cosine, three_decimals
from hyphae.operators import graph as G
from hyphae.operators import ingest as I
from hyphae.operators.search import top_k, top_k_each
from hyphae.session import prepare
from hyphae.streaming.feed import latest

TEXTS = ["Python is used by Google and OpenAI in Paris. The Mind Graph DB provides hybrid vector search!", "", " \n\t", None, "Zoë Foo Bar_x Baz Qux met The And. Foo Bar supports many things. Acme Corp uses Acme Corp. a", "x" * 50_000 + " Long Name", "Incident Store Two! Incident? Two contains three words, and more"]


def names(text):
    out = []
    for m in re.findall(r"\b([A-Z][a-zA-Z0-9]+(?:\s+[A-Z][a-zA-Z0-9]+)*)\b", text):
        if m.lower() not in T.STOP_WORDS and len(m) >= 3 and m not in out:
            out.append(m)
    return out


def test_text(spark):
    df = prepare(spark).createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    rows = df.select("text", T.entities(F.col("text")).alias("e"), T.concepts(F.col("text")).alias("c"), T.facts(F.col("text")).alias("f"), T.cooccurrences(F.col("text")).alias("p")).collect()
    for r in rows:
        if r["text"] is None:
            assert r["e"] is None and r["c"] is None
            continue
        want = names(r["text"])
        assert [x["name"] for x in r["e"]] == want
        words = [w for w in dict.fromkeys(re.findall(r"\b[a-zA-Z]{3,}\b", r["text"].lower())) if w not in T.STOP_WORDS]
        assert r["c"] == words[:10]
        pairs = []
        for k, s in enumerate(re.split(r"[.!?]\s+", r["text"])):
            here = [n for n in want if n in s]
            pairs += [(k, a, b, s.strip()) for a, b in zip(here, here[1:])]
        assert [(p["sentence"], p["source"], p["target"], p["evidence"]) for p in r["p"]] == pairs
    types = {e["name"]: e["type"] for r in rows if r["e"] for e in r["e"]}
    assert types["Python"] == "TECHNOLOGY" and types["Google"] == "ORGANIZATION" and types["Incident"] == "ORGANIZATION" and types["Foo Bar"] == "CONCEPT"
    facts = [(f["subject"], f["predicate"], f["object"]) for r in rows if r["f"] for f in r["f"]]
    assert ("The Mind Graph DB", "provides", "hybrid vector search") in facts and ("Two", "contains", "three words") in facts
    one = analyse(df.where("id = 0")).first()
    assert one["candidates"][0]["relation_type"] == "CO_OCCURS_WITH" and analyse(df.where("id = 0"), "parser").count() == 1


def test_embedding(spark):
    a, b, c = (hash_vector(t, 128) for t in ("graph database stores nodes", "graph database stores edges", "fresh bread with butter"))
    assert len(a) == 128 and abs(sum(x * x for x in a) - 1) < 1e-9
    dot = lambda x, y: sum(p * q for p, q in zip(x, y))
    assert dot(a, b) > dot(a, c)
    assert hash_vector("", 8) == hash_vector(None, 8) == [0.0] * 8 and hash_vector("  ", 4) == [0.5] * 4
    df = prepare(spark).createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    assert {r["id"]: r["embedding"] for r in hash_vectors(df, dim=16).collect()} == {k: hash_vector(t, 16) for k, t in enumerate(TEXTS)}
    buckets = {}
    for r in hash_buckets(df, dim=16).collect():
        buckets.setdefault(r["id"], {})[r["slot"]] = r["weight"]
    for k, w in buckets.items():
        size = math.sqrt(sum(x * x for x in w.values()))
        assert hash_vector(TEXTS[k], 16) == pytest.approx([w.get(s, 0) / size for s in range(16)])
    assert len(encoder("sentence-transformer", "no such model", 12)("word")) == 12


def test_search(spark):
    rows = [("v1", [1.0, 0.0, 0.0], '{"c": "tech"}'), ("v2", [0.0, 1.0, 0.0], '{"c": "finance"}'), ("v3", [0.9, 0.1, 0.0], '{"c": "tech"}'), ("v4", [1.0, 0.0, 0.0], None), ("z", [0.0] * 3, "{}"), ("n", None, None), ("s", [1.0], None), ("x", [float("nan"), 0.0, 0.0], None)]
    v = prepare(spark).createDataFrame(rows, "id string, embedding array<double>, metadata string")
    got = [(r["id"], r["score"]) for r in top_k(v, [1.0, 0.0, 0.0], 3).orderBy("rank").collect()]
    assert [i for i, _ in got] == ["v1", "v4", "v3"] and got[0][1] == pytest.approx(1)
    assert [r["id"] for r in top_k(v, [1.0, 0.0, 0.0], 3, filters={"c": "finance"}).collect()] == ["v2"]
    assert {r["id"]: r["score"] for r in top_k(v, [1.0, 0.0, 0.0], 9).collect()}["z"] == 0
    each = {(r["query_id"], r["rank"]): r["id"] for r in top_k_each(v, v, 2).collect()}
    assert each["v1", 1] == "v1" and each["v1", 2] == "v4" and each["v3", 2] == "v1" and len(each) == 10
    seq = v.withColumn("seq", F.substring("id", 2, 1).try_cast("long"))
    assert {r["id"] for r in top_k_each(seq.where("seq is not null"), seq.where("id = 'v3'"), 9, order_col="seq").collect()} == {"v1", "v2", "v3"}
    assert top_k(v.limit(0), [1.0], 3).count() == 0 and top_k_each(v.limit(0), v, 3).count() == 0
    assert v.where("id = 'v1'").select(cosine(F.col("embedding"), F.lit([0.5])).alias("c")).first()[0] is None
    shown = spark.createDataFrame([(0.0625,), (0.1875,), (1.0,)], "s double").select(three_decimals(F.col("s"))).collect()
    assert [r[0] for r in shown] == ["0.062", "0.188", "1.000"]


def test_metadata(spark):
    values = ['{"k": 1}', '{"k": 1.0}', '{"k": "1"}', '{"k": true}', '{"k": null}', "{}", None, "not json", '{"k": [1]}', '{"k": {"k": 1}}', '{"a.b": 1}']
    df = prepare(spark).createDataFrame([(i, v) for i, v in enumerate(values)], "id int, m string")
    hit = lambda k, v: {r["id"] for r in df.where(equals(F.col("m"), k, v)).collect()}
    assert hit("k", 1) == hit("k", 1.0) == hit("k", True) == {0, 1, 3}
    assert hit("k", "1") == {2} and hit("k", 0) == set() and hit("a.b", 1) == {10}
    assert hit("k", None) == {4, 5, 6, 7, 10}
    assert df.where(matches(F.col("m"), {})).count() == len(values) and df.where(matches(F.col("m"), {"k": 1, "a.b": None})).count() == 3


def graph(spark, edges, nodes="abcdex"):
    n = prepare(spark).createDataFrame([(x, x.upper(), "ENTITY", None) for x in nodes] + [("a", "A", "ENTITY", None)], "id string, label string, node_type string, properties string")
    e = spark.createDataFrame([(f"e{k}", *x, 0.9, None) for k, x in enumerate(edges)], "id string, source_id string, target_id string, relation_type string, confidence double, evidence_text string")
    return n, e


def test_graph(spark):
    n, e = graph(spark, [("a", "b", "T"), ("a", "c", "U"), ("b", "d", "T"), ("c", "d", "T"), ("d", "a", "T"), ("a", "a", "T"), ("a", "b", "T"), ("e", "gone", "T"), (None, "a", "T"), ("d", "e", "T")])
    start = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    got = [(r["other"], r["edge_id"]) for r in G.neighbours(n, e, starts=start("a")).orderBy("edge_id").collect()]
    assert got == [("b", "e0"), ("c", "e1"), ("d", "e4"), ("a", "e5"), ("b", "e6")]
    assert {r["other"] for r in G.neighbours(n, e, starts=start("a"), types=["U"]).collect()} == {"c"} and G.neighbours(n, e, types=[]).count() == 0
    reached = {(r["start_id"], r["id"]): (r["hop"], r["path"]) for r in G.reach(n, e, start("a", "x", "nobody"), hops=3).collect()}
    assert reached == {("a", "b"): (1, ["e0"]), ("a", "c"): (1, ["e1"]), ("a", "d"): (1, ["e4"]), ("a", "e"): (2, ["e4", "e9"])}
    chain_n, chain_e = graph(spark, [("a", "b", "S1"), ("b", "c", "S2"), ("c", "d", "S3")])
    for hops in (0, 1, 2, 3):
        assert G.reach(chain_n, chain_e, start("a"), hops=hops).count() == hops
    nodes, edges = G.subgraph(n, e, start("b"), depth=1)
    assert {r["id"] for r in nodes.collect()} == {"a", "b", "d"} and {r["id"] for r in edges.collect()} == {"e0", "e2", "e4", "e5", "e6"}
    assert G.subgraph(n, e, None)[0].count() == 6
    left_n, left_e = G.without_nodes(n, e, start("a"))
    assert {r["id"] for r in left_e.collect()} == {"e2", "e3", "e7", "e9"} and left_n.where("id = 'a'").count() == 0
    gone = spark.createDataFrame([("a", "b", None), ("d", "a", "U")], "source_id string, target_id string, relation_type string")
    assert {r["id"] for r in G.without_edges(e, gone).collect()} == {"e1", "e2", "e3", "e4", "e5", "e7", "e8", "e9"}
    assert [tuple(r) for r in G.by_label(n, spark.createDataFrame([(" B ",), ("none",)], "label string")).collect()] == [(" B ", "b")]
    assert G.reach(n.limit(0), e, start("a")).count() == 0


def test_reconcile(spark):
    edges = lambda rows: prepare(spark).createDataFrame(rows, "doc_id string, source_id string, target_id string, relation_type string")
    old = edges([("d", "d", "p", "M"), ("d", "d", "g", "M"), ("d", "o", "d", "S"), ("d", "d", "p", "M")])
    new = edges([("d", "d", "p", "M"), ("d", "d", "q", "M")])
    changes = I.reconcile(old, new)
    assert {(r["target_id"], r["change"]) for r in changes.collect()} == {("p", "updated"), ("g", "removed"), ("d", "removed"), ("q", "created")}
    assert tuple(I.reconcile_counts(changes).first()) == ("d", 1, 1, 2)


def test_latest(spark):
    rows = [("a", 1, None, "x"), ("a", 2, "2025-01-01", "y"), ("a", 3, None, "z"), ("b", 1, None, "p"), ("b", 2, None, "q"), (None, 9, None, "r")]
    df = prepare(spark).createDataFrame(rows, "id string, feed_id long, updated_at string, text string")
    assert {(r["id"], r["text"]) for r in latest(df).collect()} == {("a", "y"), ("b", "q")}
