"""The query language: FIND target WHERE … TRAVERSE n HOPS … RETURN ….

Text that doesn't begin with FIND is a semantic query as a whole. The plain mode
is lenient: what it doesn't know is skipped, a comparison counts as equality, a
word without a value has the value None, clauses out of order are ignored. The
strict mode raises a QueryError for each of those.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

FIELDS = ("documents", "entities", "relationships", "scores")
WORDS = ("FIND", "WHERE", "TRAVERSE", "HOPS", "WITH", "RELATIONSHIPS", "RETURN", "AND", "semantic_match")
MARKS = "=()[],."


class QueryError(ValueError):
    """A query text that has no meaning."""


@dataclass
class Query:
    target: str = "documents"
    semantic_query: str | None = None
    metadata_filters: dict[str, Any] = field(default_factory=dict)
    traverse_hops: int = 0
    allowed_relationship_types: list[str] | None = None
    return_fields: list[str] = field(default_factory=lambda: list(FIELDS))
    top_k: int = 10


@dataclass(frozen=True)
class Token:
    kind: str  # one of WORDS, one of MARKS, or "name", "string", "number", "end", "unknown"
    value: str
    at: int


_SCAN = re.compile(r"""(?P<space>\s+)|(?P<string>"[^"]*"?|'[^']*'?)|(?P<number>\d[\d.]*)|(?P<word>[^\W\d]\w*)|(?P<mark>[=()\[\],.])|(?P<unknown>.)""", re.S)


def tokens(text: str) -> list[Token]:
    """Tokens of a query; a string without its closing quote runs to the end. Keywords are told by their exact case."""
    out = []
    for m in _SCAN.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "string":
            out.append(Token("string", value[1:-1] if len(value) > 1 and value[-1] == value[0] else value[1:], m.start()))
        elif kind == "word":
            out.append(Token(value if value in WORDS else "name", value, m.start()))
        elif kind == "mark":
            out.append(Token(value, value, m.start()))
        elif kind != "space":
            out.append(Token(kind, value, m.start()))
    return [*out, Token("end", "", len(text))]


def _number(value: str) -> int | float:
    try:
        return float(value) if "." in value else int(value)
    except ValueError as e:
        raise QueryError(f"{value!r} is no number") from e


class _Reader:
    def __init__(self, text: str, strict: bool):
        found = tokens(text)
        odd = [t for t in found if t.kind == "unknown"]
        if strict and odd:
            raise QueryError(f"unexpected {odd[0].value!r} at {odd[0].at}")
        self.left, self.strict = [t for t in found if t.kind != "unknown"], strict

    @property
    def kind(self) -> str:
        return self.left[0].kind

    def take(self) -> Token:
        return self.left.pop(0) if len(self.left) > 1 else self.left[0]

    def skip(self, kind: str, needed: bool = False) -> bool:
        if self.kind == kind:
            self.take()
            return True
        if needed and self.strict:
            raise QueryError(f"{kind!r} expected at {self.left[0].at}, not {self.left[0].value!r}")
        return False

    def lost(self) -> None:
        if self.strict:
            raise QueryError(f"unexpected {self.left[0].value!r} at {self.left[0].at}")
        self.take()


def _condition(r: _Reader, q: Query) -> None:
    if r.kind == "semantic_match":
        r.take()
        r.skip("(")
        if r.kind == "string":
            q.semantic_query = r.take().value
        elif r.strict:
            raise QueryError("semantic_match needs a string")
        r.skip(")")
        return
    if r.kind in ("name", "."):
        if r.left[0].value.lower() == "metadata" and len(r.left) > 1 and r.left[1].kind == ".":
            r.take()
            r.take()
        if r.kind != "name":
            raise QueryError(f"a key expected at {r.left[0].at}; keys within keys aren't supported")
        key = r.take().value
        r.skip("=", needed=True)
        value: Any = None
        if r.kind == "string":
            value = r.take().value
        elif r.kind == "number":
            value = _number(r.take().value)
        elif r.strict:
            raise QueryError(f"a value for {key!r} expected at {r.left[0].at}")
        q.metadata_filters[key] = value
        return
    if r.kind == "AND":
        r.take()
    else:
        r.lost()


def parse(text: str, *, strict: bool = False) -> Query:
    """Query of a text."""
    trimmed = text.strip()
    q = Query()
    if not re.match(r"FIND\b", trimmed, re.IGNORECASE):
        q.semantic_query = trimmed
        return q
    r = _Reader(trimmed, strict)
    if r.skip("FIND", needed=True) and r.kind == "name":
        q.target = r.take().value.lower()
    if r.skip("WHERE"):
        while r.kind not in ("TRAVERSE", "RETURN", "end"):
            _condition(r, q)
    if r.skip("TRAVERSE"):
        if r.kind == "number":
            value = r.take().value
            if "." in value:
                raise QueryError(f"{value!r} is no number of hops")
            q.traverse_hops = int(value)
        r.skip("HOPS", needed=True)
        if r.skip("WITH"):
            r.skip("RELATIONSHIPS", needed=True)
            if r.skip("["):
                q.allowed_relationship_types = []
                while r.kind not in ("]", "end"):
                    t = r.take()
                    if t.kind == "string":
                        q.allowed_relationship_types.append(t.value)
                r.skip("]", needed=True)
    if r.skip("RETURN"):
        named = []
        while r.kind != "end":
            t = r.take()
            if t.kind == "name":
                named.append(t.value.lower())
        q.return_fields = named or list(FIELDS)
    if strict and r.kind != "end":
        r.lost()
    return q


def plan_steps(q: Query) -> list[str]:
    """Names of the steps that a query needs, in order."""
    wanted = {"VectorSearchStep": bool(q.semantic_query), "MetadataFilterStep": bool(q.metadata_filters), "GraphTraverseStep": q.traverse_hops > 0, "RankAndAssembleStep": True}
    return [name for name, needed in wanted.items() if needed]
