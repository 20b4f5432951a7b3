"""The graph as one file for eyes: a page with its data inside, or a Mermaid diagram.

What a viewer shows is small by its purpose; only what is drawn is collected, texts are made by the workers.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.ids import stable_json
from lattica.model import NODE_KINDS, GraphError
from lattica.operators import graph, shape
from lattica.plans import present


def checked_options(mermaid: bool = False, full: bool = False, columns: bool = False, kinds: str | None = None, schema: str | None = None, min_degree: str | None = None) -> dict:
    """Options of collapse() from what was asked for; what contradicts itself or isn't known is refused."""
    given = {"--full": full, "--columns": columns, "--kinds": kinds is not None, "--schema": schema is not None, "--min-degree": min_degree is not None}
    if mermaid and any(given.values()):
        raise GraphError(f"a Mermaid diagram takes no {next(k for k, v in given.items() if v)}")
    if full and (kinds is not None or columns):
        raise GraphError("--full shows every kind, so --kinds and --columns don't go with it")
    out: dict = {"full": full, "columns": columns}
    if kinds is not None:
        names = [k.strip() for k in kinds.split(",") if k.strip()]
        unknown = [k for k in names if k not in NODE_KINDS]
        if unknown or not names:
            raise GraphError(f"kinds must be some of {', '.join(NODE_KINDS)}; got {', '.join(unknown) or 'none'}")
        out["kinds"] = names
    if schema is not None:
        if not schema:
            raise GraphError("--schema needs a name")
        out["schema"] = schema
    if min_degree is not None:
        if not min_degree.isdecimal():
            raise GraphError(f"--min-degree must be a whole number, not {min_degree}")
        out["min_degree"] = int(min_degree)
    return out


def details(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, detail): of each of wanted (id) the text that describes it in full, from the whole graph."""
    near = graph.neighbor_index(nodes, edges).select("node", "edge_kind", "direction", "edge_id", F.col("id").alias("other")).join(wanted.select(F.col("id").alias("node")), "node", "left_semi")
    other = nodes.select(F.struct(*[F.col(c) for c in nodes.columns]).alias("n"))
    rows = near.join(other, F.col("other") == F.col("n.id")).join(edges.select(F.col("id").alias("edge_id"), F.struct("confidence", "score", "attrs").alias("edge")), "edge_id")
    groups = rows.groupBy(F.col("node").alias("id")).agg(F.to_json(F.collect_list(F.struct("edge_kind", "direction", "edge_id", "n", "edge"))).alias("near"))
    own = nodes.join(wanted.select("id"), "id", "left_semi").select("id", F.to_json(F.struct(*nodes.columns)).alias("own"))

    def texts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        for frame in frames:
            out = []
            for own_, near_ in zip(frame["own"], frame["near"], strict=True):
                groups_: present.Groups = {}
                for r in sorted(json.loads(near_) if near_ else [], key=lambda r: (present.locale_key(r["n"]["qname"]), r["n"]["id"], r["edge_id"])):
                    groups_.setdefault(r["edge_kind"], {}).setdefault(r["direction"], []).append(present.Near({"payload": None, "body_hash": None} | r["n"], {"attrs": None} | r["edge"]))
                out.append(present.describe({"payload": None, "body_hash": None} | json.loads(own_), groups_, "full"))
            yield pd.DataFrame({"id": frame["id"], "detail": out})

    return own.join(groups, "id", "left").mapInPandas(texts, "id STRING, detail STRING")


def data_block(nodes: DataFrame, edges: DataFrame, **options) -> dict:
    """Nodes in order with community, degree and text, edges as pairs of their numbers, and the communities."""
    drawn, links, named = shape.data_block(nodes, edges, **options)
    rows = drawn.join(details(nodes, edges, drawn.select("id")), "id", "left").orderBy("i")
    return {
        "nodes": [{k: r[k] for k in ("i", "label", "kind", "community", "degree", "detail")} for r in rows.toLocalIterator()],
        "edges": [r.asDict() for r in links.toLocalIterator()],
        "communities": [r.asDict() for r in named.toLocalIterator()],
    }


_PAGE = """<!doctype html>
<meta charset="utf-8"><title>Schema graph</title>
<style>body{margin:0;font:14px sans-serif;display:flex;height:100vh}svg{flex:1}pre{width:38em;margin:0;padding:1em;overflow:auto;background:#f4f4f4}circle{cursor:pointer}</style>
<svg id="view"></svg><pre id="text">Choose a node.</pre>
<script id="data" type="application/json">@DATA@</script>
<script>
const data = JSON.parse(document.getElementById("data").textContent), view = document.getElementById("view");
const box = view.getBoundingClientRect(), rings = Math.max(1, data.communities.length), at = [], seen = {};
for (const n of data.nodes) {
  const turn = 2 * Math.PI * n.community / rings, nth = seen[n.community] = (seen[n.community] || 0) + 1;
  const far = 6 * Math.sqrt(nth), spin = nth * 2.4;
  at.push([box.width / 2 + Math.cos(turn) * box.width / 3 + far * Math.cos(spin), box.height / 2 + Math.sin(turn) * box.height / 3 + far * Math.sin(spin)]);
}
const draw = (name, attributes) => {
  const e = document.createElementNS("http://www.w3.org/2000/svg", name);
  for (const k in attributes) e.setAttribute(k, attributes[k]);
  return view.appendChild(e);
};
for (const e of data.edges) draw("line", {x1: at[e.s][0], y1: at[e.s][1], x2: at[e.t][0], y2: at[e.t][1], stroke: "#bbb"});
for (const n of data.nodes) {
  const dot = draw("circle", {cx: at[n.i][0], cy: at[n.i][1], r: 3 + Math.sqrt(n.degree), fill: `hsl(${n.community * 137 % 360} 60% 50%)`});
  dot.onclick = () => document.getElementById("text").textContent = n.detail;
  dot.appendChild(document.createElementNS("http://www.w3.org/2000/svg", "title")).textContent = `${n.label} [${n.kind}]`;
}
</script>
"""


def page(block: dict) -> str:
    """A page that needs nothing else; its data can't end the script that holds it."""
    return _PAGE.replace("@DATA@", stable_json(block).replace("</", "<\\/"))


def mermaid(nodes: DataFrame, edges: DataFrame) -> str:
    return "\n".join(shape.entity_diagram(nodes, edges)) + "\n"
