"""A store from end to end."""

import json
import urllib.request
from threading import Thread

import pytest
from pyspark.sql import functions as F

from hyphae.client import Client
from hyphae.service import answer, serve
from hyphae.settings import Settings, logger
from hyphae.streaming.feed import ingest_stream


@pytest.fixture(scope="module")
def client(spark, tmp_path_factory):
    c = Client(spark, f"file://{tmp_path_factory.mktemp('store')}", dim=128, min_confidence=0.3)
    c.create("Google uses Python for the Graph Engine. Python is fast.", {"category": "tech", "version": 1}, "d1")
    c.create("Acme Corp stores records in a Graph Engine with Python.", {"category": "db"}, "d2")
    return c


def test_documents(client, spark):
    for text in ("", "   \n \t "):
        with pytest.raises(ValueError, match="cannot be empty"):
            client.create(text)
    assert client.count() == 2 and client.get("d1")["metadata"] == {"category": "tech", "version": 1} and client.get("nobody") is None
    assert {d["id"] for d in client.list(10)} == {"d1", "d2"} and len(client.list(1, 1)) == 1
    again = Client(spark, client.documents.folder.removesuffix("/documents"), dim=128)
    assert again.count() == 2
    with pytest.raises(KeyError):
        client.update("nobody", "text")
    assert client.delete("nobody") is False


def test_questions(client):
    hits = client.search("Python Graph Engine", 5)
    assert {h["document_id"] for h in hits} == {"d1", "d2"} and hits[0]["score"] >= hits[1]["score"]
    r = client.query('FIND documents WHERE semantic_match("Graph Engine") AND metadata.category = "tech" TRAVERSE 2 HOPS RETURN documents, entities, relationships')
    assert [d["id"] for d in r.documents.collect()] == ["d1"] and r.metadata["plan_steps"][0] == "VectorSearchStep"
    assert {e["name"] for e in r.entities.collect()} >= {"Google", "Python", "Graph Engine"} and r.relationships.where("evidence_text is null").count() == 0
    assert client.query("FIND documents RETURN scores", 1).documents is None
    assert [s["score"] for s in client.query("FIND documents", filters={"category": "db"}).scores.collect()] == [1.0]
    assert client.traverse("nobody") == [] and client.traverse("d1", 1)
    edge = client.neighbours("d1", ["MENTIONS"])[0]["edge_id"]
    assert client.evidence(edge)["relation_type"] == "MENTIONS" and client.evidence("none") is None
    assert client.node_by_label(" python ")["label"] == "Python" and client.entity(client.node_by_label("Python")["id"])["type"] == "TECHNOLOGY"
    assert client.analyse("Google uses Python.")["entities"][0]["name"] == "Google"


def test_shown(client, tmp_path):
    assert "(MENTIONS, conf=1.00)" in client.visualise("text") and "shape=box" in client.visualise("dot")
    assert json.dumps(client.visualise("json", ["d1"], 1)) and "<svg" in client.visualise("html", path=str(tmp_path / "g.html"))
    assert (tmp_path / "g.html").exists()


def test_service(client):
    assert answer(client, "GET", "/health", {}) == (200, {"status": "ok"})
    assert answer(client, "GET", "/api/v1/documents/d1", {})[1]["id"] == "d1" and answer(client, "GET", "/documents/none", {})[0] == 404
    assert answer(client, "POST", "/query", {"query": "FIND documents", "top_k": 1})[1]["query"] == "documents"
    assert answer(client, "GET", "/graph/traverse/none", {})[0] == 404 and answer(client, "PUT", "/nowhere", {})[0] == 404
    server = serve(client, port=0)
    Thread(target=server.serve_forever, daemon=True).start()
    with urllib.request.urlopen(f"http://127.0.0.1:{server.server_port}/health") as got:
        assert json.load(got) == {"status": "ok"} and got.headers["Access-Control-Allow-Origin"] == "*"
    server.shutdown()


def test_update_stream_delete(client, spark, tmp_path):
    got = client.update("d1", "OpenAI uses Python for the Graph Engine.", {"version": 2})
    assert got["relationships_removed"] >= 1 and got["relationships_created"] >= 1 and got["relationships_updated"] >= 1
    labels = {n["label"] for n in client.neighbours("d1", ["MENTIONS"])}
    assert {"OpenAI", "Python"} <= labels and "Google" not in labels
    assert client.get("d1")["metadata"] == {"category": "tech", "version": 2}
    rows = [("s1", "Berlin Store contains many books.", "{}", "2025-01-01", 1), ("s1", "Berlin Store contains maps.", "{}", "2025-01-02", 2), ("s2", " ", "{}", None, 3)]
    spark.createDataFrame(rows, "id string, text string, metadata string, updated_at string, feed_id long").write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("id string, text string, metadata string, updated_at string, feed_id long").parquet(f"{tmp_path}/in")
    ingest_stream(stream, client, f"{tmp_path}/mark").awaitTermination(300)
    assert client.get("s1")["text"] == "Berlin Store contains maps." and client.get("s2") is None
    assert client.delete("d2") and client.get("d2") is None and client.nodes.get("d2") is None and client.vectors.get("d2") is None
    assert client.edges.frame().where((F.col("source_id") == "d2") | (F.col("target_id") == "d2")).count() == 0
    assert client.node_by_label("Acme Corp") is not None and client.delete_node("s1") and not client.delete_node("s1")


def test_settings(monkeypatch):
    monkeypatch.setenv("HYPHAE_EMBEDDING_DIMENSION", "64")
    monkeypatch.setenv("HYPHAE_LOG_LEVEL", "debug")
    s = Settings.from_environment()
    assert s.embedding_dimension == 64 and s.default_top_k == 10 and s.log_level == "debug"
    assert logger("x", "warning").level == 30 and len(logger("x").handlers) == 1
