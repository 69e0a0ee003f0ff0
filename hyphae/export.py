"""A graph as text, JSON, DOT and a web page. These collect the graph they are given: pass a subgraph, not a corpus."""

from __future__ import annotations

import html
import json
from typing import Any

from pyspark.sql import DataFrame

_EDGE = ["id", "source_id", "target_id", "relation_type", "confidence", "evidence_text"]


def _rows(nodes: DataFrame, edges: DataFrame) -> tuple[list[dict], list[dict]]:
    n = [r.asDict() for r in nodes.select("id", "label", "node_type", "properties").orderBy("id").collect()]
    e = [r.asDict() for r in edges.select(*_EDGE).orderBy("id").collect()]
    return n, e


def as_text(nodes: DataFrame, edges: DataFrame) -> str:
    n, e = _rows(nodes, edges)
    if not n:
        return "=== Knowledge graph ===\n (empty graph)"
    label = {x["id"]: x["label"] for x in n}
    out = ["=== Knowledge graph ===", f"Nodes ({len(n)} total):"]
    out += [f"  • [{x['node_type']}] {x['id']}: '{x['label']}'" for x in n]
    out += ["", f"Relationships ({len(e)} total):"]
    for x in e:
        why = f" [Evidence: '{x['evidence_text']}']" if x["evidence_text"] else ""
        out.append(f"  • '{label.get(x['source_id'], x['source_id'])}' --({x['relation_type']}, conf={x['confidence'] or 0.0:.2f})--> '{label.get(x['target_id'], x['target_id'])}'{why}")
    return "\n".join(out)


def as_json(nodes: DataFrame, edges: DataFrame) -> dict[str, Any]:
    n, e = _rows(nodes, edges)
    return {"nodes": [x | {"properties": json.loads(x["properties"] or "{}")} for x in n], "relationships": e}


def _quoted(value: Any) -> str:
    return '"' + str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n") + '"'


def as_dot(nodes: DataFrame, edges: DataFrame) -> str:
    n, e = _rows(nodes, edges)
    out = ["digraph knowledge {", '  rankdir="LR";', "  node [style=filled];"]
    for x in n:
        look = "shape=box, fillcolor=lightyellow" if x["node_type"] == "DOCUMENT" else "shape=ellipse, fillcolor=lightcyan"
        out.append(f"  {_quoted(x['id'])} [label={_quoted(x['label'])}, {look}];")
    for x in e:
        named = f"{x['relation_type']} ({x['confidence'] or 0.0:.2f})"
        out.append(f"  {_quoted(x['source_id'])} -> {_quoted(x['target_id'])} [label={_quoted(named)}];")
    return "\n".join([*out, "}"])


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px sans-serif;margin:0;display:flex}}#list{{width:22em;height:100vh;overflow:auto;padding:1em;box-sizing:border-box}}svg{{flex:1;height:100vh}}li{{cursor:pointer}}</style></head>
<body><div id="list"><h1>{title}</h1><input id="find" placeholder="Find a node"><ul id="nodes"></ul><pre id="detail"></pre></div><svg id="plot" viewBox="-500 -500 1000 1000"></svg>
<script>
const graph = {data};
const place = new Map(graph.nodes.map((n, i) => [n.id, [440 * Math.cos(2 * Math.PI * i / graph.nodes.length), 440 * Math.sin(2 * Math.PI * i / graph.nodes.length)]]));
const plot = document.getElementById("plot"), detail = document.getElementById("detail"), list = document.getElementById("nodes");
const make = (tag, attrs, parent) => {{ const x = document.createElementNS("http://www.w3.org/2000/svg", tag); for (const k in attrs) x.setAttribute(k, attrs[k]); parent.appendChild(x); return x; }};
const show = x => {{ detail.textContent = JSON.stringify(x, null, 1); }};
for (const e of graph.relationships) {{ const a = place.get(e.source_id), b = place.get(e.target_id); if (a && b) make("line", {{x1: a[0], y1: a[1], x2: b[0], y2: b[1], stroke: "#999"}}, plot).onclick = () => show(e); }}
for (const n of graph.nodes) {{ const p = place.get(n.id); make("circle", {{cx: p[0], cy: p[1], r: 7, fill: n.node_type === "DOCUMENT" ? "goldenrod" : "steelblue"}}, plot).onclick = () => show(n);
 const li = document.createElement("li"); li.textContent = n.label; li.onclick = () => show(n); list.appendChild(li); }}
document.getElementById("find").oninput = ev => {{ for (const li of list.children) li.hidden = !li.textContent.toLowerCase().includes(ev.target.value.toLowerCase()); }};
</script></body></html>"""


def as_html(nodes: DataFrame, edges: DataFrame, path: str | None = None, title: str = "Knowledge graph") -> str:
    """A page that needs nothing else; also written to `path` if one is given."""
    data = json.dumps(as_json(nodes, edges)).replace("<", "\\u003c")
    page = _PAGE.format(title=html.escape(title), data=data)
    if path:
        with open(path, "w", encoding="utf-8") as f:
            f.write(page)
    return page
