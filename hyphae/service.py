"""A thin HTTP service over a client, with nothing but the standard library. One process, for small use: the work is Spark's."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, unquote, urlsplit

from hyphae.client import Client

PREFIX = "/api/v1"


def answer(client: Client, method: str, target: str, body: dict[str, Any]) -> tuple[int, Any]:
    """Status and JSON value of a request; every path also works without the prefix."""
    url = urlsplit(target)
    path, asked = url.path.removeprefix(PREFIX).rstrip("/"), {k: v[0] for k, v in parse_qs(url.query).items()}
    parts = [unquote(p) for p in path.split("/") if p]
    match [method, *parts]:
        case ["GET", "health"]:
            return 200, {"status": "ok"}
        case ["POST", "documents"]:
            return 201, client.create(body.get("text", ""), body.get("metadata"), body.get("id"))
        case ["GET", "documents", name]:
            found = client.get(name)
            return (200, found) if found else (404, {"detail": "no such document"})
        case ["PUT" | "PATCH", "documents", name]:
            return 200, client.update(name, body.get("text"), body.get("metadata"))
        case ["DELETE", "documents", name]:
            return (200, {"deleted": name}) if client.delete(name) else (404, {"detail": "no such document"})
        case ["POST", "search"]:
            return 200, client.search(body["query"], int(body.get("top_k", 10)))
        case ["POST", "query"]:
            r = client.query(body["query"], int(body.get("top_k", 10)), body.get("filters"))
            rows = lambda f: [] if f is None else [x.asDict(recursive=True) for x in f.collect()]
            return 200, {"query": r.query, "documents": rows(r.documents), "entities": rows(r.entities), "relationships": rows(r.relationships), "scores": {x["id"]: x["score"] for x in r.scores.collect()}, "metadata": r.metadata}
        case ["GET", "graph", "traverse", name]:
            if client.nodes.get(name) is None:
                return 404, {"detail": "no such node"}
            return 200, client.traverse(name, int(asked.get("max_hops", 2)))
        case ["GET", "graph", "evidence", name]:
            found = client.evidence(name)
            return (200, found) if found else (404, {"detail": "no such relationship"})
        case ["GET", "graph", "visualize"]:
            return 200, client.visualise("html" if asked.get("format") == "html" else "json")
        case _:
            return 404, {"detail": "not found"}


def serve(client: Client, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """A server that isn't started yet: call serve_forever() on it."""

    class Handler(BaseHTTPRequestHandler):
        def _do(self) -> None:
            try:
                size = int(self.headers.get("Content-Length") or 0)
                status, value = answer(client, self.command, self.path, json.loads(self.rfile.read(size) or b"{}") if size else {})
            except KeyError as e:
                status, value = 404, {"detail": f"no {e}"}
            except ValueError as e:
                status, value = 422, {"detail": str(e)}
            page = isinstance(value, str)
            raw = value.encode() if page else json.dumps(value, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "text/html; charset=utf-8" if page else "application/json")
            self.send_header("Access-Control-Allow-Origin", "*")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = do_PUT = do_PATCH = do_DELETE = _do

        def log_message(self, *args: Any) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
