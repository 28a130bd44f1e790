"""A dependency graph as one self-contained HTML page."""

from __future__ import annotations

import html
import json
from pathlib import Path

from millrace.functions.codec import decode
from millrace.operators.engine import Engine
from millrace.plans.graph_frames import snapshot_records

COLORS = {"input": "#4477aa", "external": "#66ccee", "normal": "#228833", "firewall": "#ee6677", "projection": "#ccbb44"}


def shorten(text: str, most: int = 60) -> str:
    """Cut by characters, never inside one."""
    return text if len(text) <= most else text[: most - 3] + "..."


def render(engine: Engine, root: object | None = None, title: str = "Dependencies") -> str:
    """The page: five layouts, search, a filter by type, details, highlighting, a legend."""
    nodes, edges = snapshot_records(engine, root)
    kinds = {n["id"]: n["kind"] for n in nodes}
    shown = [
        {"id": n["id"], "type": engine.registry.short(n["type_name"]), "label": shorten(repr(decode(n["key"]))), "kind": n["kind"], "depth": n["depth"], "fp": n["fingerprint"], "walls": n["firewalls"], "epoch": n["verified"]} for n in nodes
    ]
    links = [{"a": e["caller"], "b": e["callee"], "dirty": e["is_dirty"]} for e in edges if e["callee"] in kinds]
    # "</" must not end the script.
    data = json.dumps({"nodes": shown, "links": links, "colors": COLORS}).replace("</", "<\\/")
    legend = " ".join(f'<span style="color:{c}">&#9632;</span> {k}' for k, c in COLORS.items())
    return _PAGE.replace("__TITLE__", html.escape(title)).replace("__LEGEND__", legend).replace("__DATA__", data)


def write(engine: Engine, path: str, root: object | None = None, title: str = "Dependencies") -> None:
    Path(path).write_text(render(engine, root, title), encoding="utf-8")


_PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>__TITLE__</title>
<style>body{font:13px sans-serif;margin:0}header{padding:8px}svg{width:75vw;height:85vh;border-top:1px solid #ccc}
aside{position:fixed;right:0;top:60px;width:24vw;padding:8px;white-space:pre-wrap;word-break:break-all}
.off{opacity:.12}</style></head><body>
<header><b>__TITLE__</b> <select id="layout"><option>levels</option><option>circle</option><option>grid</option><option>rings</option><option>columns by type</option></select>
<input id="find" placeholder="search"> <select id="type"><option value="">all types</option></select>
<select id="mark"><option>dependencies</option><option>dependents</option><option>inputs</option></select> __LEGEND__ <span style="color:#cc3311">&mdash; dirty</span></header>
<svg id="v"></svg><aside id="d"></aside>
<script>
const G = __DATA__, by = new Map(G.nodes.map(n => [n.id, n])), svg = document.getElementById("v");
const make = (t, a) => { const e = document.createElementNS("http://www.w3.org/2000/svg", t); for (const k in a) e.setAttribute(k, a[k]); svg.append(e); return e; };
const groups = f => { const m = new Map(); G.nodes.forEach(n => { const k = f(n); m.has(k) || m.set(k, []); m.get(k).push(n); }); return [...m.values()]; };
const layouts = {
  "levels": () => groups(n => n.depth).forEach((g, i) => g.forEach((n, j) => { n.x = 80 + j * 150; n.y = 50 + i * 90; })),
  "columns by type": () => groups(n => n.type).forEach((g, i) => g.forEach((n, j) => { n.x = 80 + i * 170; n.y = 50 + j * 50; })),
  "grid": () => { const w = Math.ceil(Math.sqrt(G.nodes.length)); G.nodes.forEach((n, i) => { n.x = 80 + i % w * 150; n.y = 50 + Math.floor(i / w) * 70; }); },
  "circle": () => { const k = G.nodes.length, r = Math.max(150, k * 14); G.nodes.forEach((n, i) => { n.x = r + 80 + r * Math.cos(6.283 * i / k); n.y = r + 50 + r * Math.sin(6.283 * i / k); }); },
  "rings": () => groups(n => n.depth).forEach((g, i) => g.forEach((n, j) => { n.x = 500 + 110 * i * Math.cos(6.283 * j / g.length); n.y = 450 + 110 * i * Math.sin(6.283 * j / g.length); })),
};
function reach(id, up) { const s = new Set([id]), q = [id]; while (q.length) { const x = q.pop(); G.links.forEach(l => { const [f, t] = up ? [l.b, l.a] : [l.a, l.b]; if (f === x && !s.has(t)) { s.add(t); q.push(t); } }); } return s; }
function draw(lit) {
  svg.replaceChildren();
  const text = document.getElementById("find").value.toLowerCase(), type = document.getElementById("type").value;
  const on = n => (!lit || lit.has(n.id)) && (!type || n.type === type) && (!text || (n.type + n.label).toLowerCase().includes(text));
  G.links.forEach(l => { const a = by.get(l.a), b = by.get(l.b); make("line", {x1: a.x, y1: a.y, x2: b.x, y2: b.y, stroke: l.dirty ? "#cc3311" : "#bbb", class: on(a) && on(b) ? "" : "off"}); });
  G.nodes.forEach(n => {
    const c = make("circle", {cx: n.x, cy: n.y, r: 9, fill: G.colors[n.kind] || "#999", class: on(n) ? "" : "off"});
    const t = make("text", {x: n.x + 12, y: n.y + 4, class: on(n) ? "" : "off"}); t.textContent = n.type;
    c.onclick = () => { document.getElementById("d").textContent = JSON.stringify(n, null, 1);
      const how = document.getElementById("mark").value; let s = reach(n.id, how === "dependents");
      if (how === "inputs") s = new Set([n.id, ...[...s].filter(x => ["input", "external"].includes(by.get(x).kind))]); draw(s); };
  });
  const far = f => Math.max(400, ...G.nodes.map(f)) + 150; svg.setAttribute("viewBox", `0 0 ${far(n => n.x)} ${far(n => n.y)}`);
}
[...new Set(G.nodes.map(n => n.type))].sort().forEach(t => { const o = document.createElement("option"); o.textContent = t; document.getElementById("type").append(o); });
const again = () => { layouts[document.getElementById("layout").value](); draw(); };
["layout", "find", "type"].forEach(i => document.getElementById(i).oninput = again); again();
</script></body></html>
"""
