"""A self-contained page of a graph's nodes and links."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame

LIMIT, LINKS = 1200, 20_000
PAGE = """<!doctype html><meta charset="utf-8"><title>Memory graph</title>
<script id="graph" type="application/json">{data}</script>
<table id="links"></table>
<script>
const g = JSON.parse(document.getElementById("graph").textContent);
const name = Object.fromEntries(g.nodes.map(n => [n.id, n.name]));
const rows = g.links.map(l => [name[l.source] ?? l.source, l.predicate, name[l.target] ?? l.target]);
for (const r of rows) {{
  const tr = document.getElementById("links").insertRow();
  for (const c of r) tr.insertCell().textContent = c;
}}
</script>
"""


def page(nodes: DataFrame, links: DataFrame, limit: int = LIMIT) -> str:
    """The limit nodes of highest degree and the links between them, of each pair and
    predicate one, at most LINKS; the page is a driver-side file, so both limits bound
    what is collected."""
    from ..operators.graph import capped

    top, kept = capped(nodes, links, limit)
    kept = kept.select("source", "target", "predicate").distinct().orderBy("source", "target", "predicate").limit(LINKS)
    data = {
        "nodes": [{"id": r["entity_id"], "name": r["canonical_name"], "type": r["type"], "degree": r["degree"]} for r in top.collect()],
        "links": [{"source": r["source"], "target": r["target"], "predicate": r["predicate"]} for r in kept.collect()],
    }
    return PAGE.format(data=json.dumps(data, ensure_ascii=False).replace("<", "\\u003c"))
