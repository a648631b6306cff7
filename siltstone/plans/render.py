"""Rows as text, and graph views as HTML with a layered drawing. Works on collected rows: results and views are limited before."""

from __future__ import annotations

import html
from collections import defaultdict
from collections.abc import Iterable

MAX_VIEW_NODES = 200


def place(row) -> str:
    return f"{row['file_path']}:{row['start_line']}-{row['end_line']}"


def hits_text(rows: Iterable, width: int = 600) -> str:
    """Hits one after the other: place, symbol, score, then the content."""
    out = []
    for i, r in enumerate(rows, 1):
        head = f"[{i}] {place(r)}" + (f"  {r['symbol']} ({r['kind']})" if r["symbol"] else "") + f"  score {r['score']:.4f}"
        body = r["content"] if len(r["content"]) <= width else r["content"][:width] + " ..."
        out.append(f"{head}\n{body}")
    return "\n\n".join(out) or "Nothing found."


def outline_text(rows: Iterable) -> str:
    return "\n".join(f"{place(r)}  {r['signature']}" + (f"  # {r['doc']}" if r["doc"] else "") for r in rows) or "Nothing found."


def edges_text(rows: Iterable) -> str:
    """A line for each edge; uncertain ones say so."""
    lines = []
    for r in rows:
        unsure = f" ({r['confidence']})" if r["confidence"] == "ambiguous" else ""
        lines.append(f"{r['from_symbol']} --{r['relation']}--> {r['to_symbol']}{unsure}  {r['call_site_file']}:{r['call_site_line']}")
    return "\n".join(sorted(lines)) or "No edges."


def cut(text: str, size: int = 28) -> str:
    return text if len(text) <= size else text[: size - 1] + "…"


def layout(nodes: Iterable, step: tuple[int, int] = (220, 44)) -> dict[str, tuple[int, int]]:
    """A column for each layer from left to right, in it the labels in order."""
    layers = defaultdict(list)
    for n in nodes:
        layers[n["layer"]].append((n["label"], n["id"]))
    return {i: (x * step[0] + 20, y * step[1] + 20) for x, layer in enumerate(sorted(layers)) for y, (_, i) in enumerate(sorted(layers[layer]))}


def view_svg(nodes: list, edges: list[tuple[str, str]]) -> str:
    """nodes with id, label, layer, role; edges as (source id, target id). More than MAX_VIEW_NODES are cut, nearest layers first."""
    shown = sorted(nodes, key=lambda n: (abs(n["layer"]), n["label"], n["id"]))[:MAX_VIEW_NODES]
    at = layout(shown)
    colours = {"seed": "#d9e8fb", "caller": "#fbe7d9", "dependent": "#fbe7d9", "callee": "#e2f4e0", "import": "#e2f4e0"}
    width, height = (max((p[k] for p in at.values()), default=0) + s for k, s in ((0, 220), (1, 60)))
    lines = "".join(f'<line x1="{at[a][0] + 190}" y1="{at[a][1] + 14}" x2="{at[b][0]}" y2="{at[b][1] + 14}" stroke="#999"/>' for a, b in sorted(edges) if a in at and b in at)
    boxes = "".join(f'<g><title>{html.escape(n["label"])}</title><rect x="{at[n["id"]][0]}" y="{at[n["id"]][1]}" width="190" height="28" rx="4" fill="{colours.get(n["role"], "#eee")}" stroke="#666"/><text x="{at[n["id"]][0] + 8}" y="{at[n["id"]][1] + 18}" font-size="12">{html.escape(cut(n["label"]))}</text></g>' for n in shown)
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif">{lines}{boxes}</svg>'


def view_html(title: str, nodes: list, edges: list[tuple[str, str]]) -> str:
    note = f"<p>{MAX_VIEW_NODES} of {len(nodes)} nodes</p>" if len(nodes) > MAX_VIEW_NODES else ""
    rows = "".join(f"<li>{html.escape(n['role'])}: {html.escape(n['label'])}</li>" for n in sorted(nodes, key=lambda n: (n["layer"], n["label"]))[:MAX_VIEW_NODES])
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>{note}{view_svg(nodes, edges)}<ul>{rows}</ul>"
