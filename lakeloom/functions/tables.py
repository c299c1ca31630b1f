"""HTML and Markdown tables as cells, and back to text. Plain functions on one document."""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser

#: table, row, col, rowspan, colspan, is_header, text, parent table (-1 for none)
Cell = tuple[int, int, int, int, int, bool, str, int]


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.cells: list[Cell] = []
        self.captions: dict[int, str] = {}
        self.n = 0

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"at": self.n, "row": -1, "taken": set(), "cell": None, "thead": False, "caption": None, "parent": self.open[-1]["at"] if self.open else -1})
            self.n += 1
        if not self.open:
            return
        t = self.open[-1]
        if tag == "thead":
            t["thead"] = True
        elif tag == "tr":
            self._close(t)
            t["row"] += 1
        elif tag in ("td", "th"):
            self._close(t)
            if t["row"] < 0:
                t["row"] = 0
            a = dict(attrs)
            span = lambda k: max(1, min(1000, int(m[0]))) if (m := re.match(r"\d+", a.get(k) or "")) else 1
            rs, cs = span("rowspan"), span("colspan")
            col = 0
            while (t["row"], col) in t["taken"]:
                col += 1
            t["taken"].update((t["row"] + i, col + j) for i in range(rs) for j in range(cs))
            t["cell"] = [t["row"], col, rs, cs, tag == "th" or t["thead"], []]
        elif tag == "caption":
            t["caption"] = []
        elif tag == "br" and t["cell"]:
            t["cell"][5].append(" ")

    def handle_endtag(self, tag):
        if not self.open:
            return
        t = self.open[-1]
        if tag in ("td", "th", "tr"):
            self._close(t)
        elif tag == "thead":
            self._close(t)
            t["thead"] = False
        elif tag == "caption" and t["caption"] is not None:
            self.captions[t["at"]] = " ".join("".join(t["caption"]).split())
            t["caption"] = None
        elif tag == "table":
            self._close(t)
            self.open.pop()

    def handle_data(self, data):
        if self.open:
            t = self.open[-1]
            if t["caption"] is not None:
                t["caption"].append(data)
            elif t["cell"]:
                t["cell"][5].append(data)

    def _close(self, t):
        if t["cell"]:
            r, c, rs, cs, head, parts = t["cell"]
            self.cells.append((t["at"], r, c, rs, cs, head, " ".join("".join(parts).split()), t["parent"]))
            t["cell"] = None


def html_cells(text: str | None) -> tuple[list[Cell], dict[int, str]]:
    """Cells of all tables of a document, nested ones too, with spans resolved to grid places; and the captions."""
    if not text or "<table" not in text.lower():
        return [], {}
    p = _Tables()
    p.feed(text)
    p.close()
    for t in p.open:
        p._close(t)
    return p.cells, p.captions


_SPAN = re.compile(r"\s*\*\((?:rowspan=(\d+))?(?:,\s*)?(?:colspan=(\d+))?\)\*\s*$")


_RULE = re.compile(r"^\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?$")


def markdown_tables(lines: list[str]) -> list[tuple[int, int, int]]:
    """(start, rule, end) of each Markdown table: successive lines with a pipe around the first rule among them."""
    out: list[tuple[int, int, int]] = []
    start, rule = 0, None
    for i, x in enumerate([*lines, ""]):
        if "|" not in x:
            if rule is not None:
                out.append((start, rule, i))
            start, rule = i + 1, None
        elif i and rule is None and _RULE.match(x):
            rule = i
    return out


def markdown_rows(text: str | None) -> list[tuple[int, str]]:
    """(row_index, chunk): each data row of a document's Markdown tables below the lines that lead to its own table's rule.

    Lines with a pipe between two tables are rows of the first.
    """
    lines = (text or "").split("\n")
    found = markdown_tables([x.strip() for x in lines])
    out: list[tuple[int, str]] = []
    last = 0
    for (start, rule, end), after in zip(found, [*(t[0] for t in found[1:]), len(lines)]):
        above = [x for x in lines[last:start] if x.strip() and not (last and "|" in x)]
        head = "\n".join([*above, *lines[start : rule + 1]])
        for x in lines[rule + 1 : after]:
            if "|" in x:
                out.append((len(out), f"{head}\n{x}"))
        last = end
    return out


def markdown_cells(text: str | None) -> list[Cell]:
    """Cells of all Markdown tables of a document, numbered; the rows above a table's rule are its headers."""
    lines = [x.strip() for x in (text or "").split("\n")]
    out: list[Cell] = []
    for table, (start, rule, end) in enumerate(markdown_tables(lines)):
        for row, i in enumerate(i for i in range(start, end) if i != rule):
            for c, x in enumerate(y.strip() for y in lines[i].strip("|").split("|")):
                m = _SPAN.search(x)
                out.append((table, row, c, int(m[1] or 1) if m else 1, int(m[2] or 1) if m else 1, i < rule, x[: m.start()] if m else x, -1))
    return out


def grid(cells: list[Cell]) -> list[list[str]]:
    """Rows of texts; a merged cell's text stands in its first place only."""
    if not cells:
        return []
    cols = max(c[2] + c[4] for c in cells)
    out = [[""] * cols for _ in range(max(c[1] for c in cells) + 1)]
    for _, r, c, *_rest, text, _p in cells:
        out[r][c] = text
    return out


def header_rows(cells: list[Cell]) -> int:
    """How many rows from the top have header cells only."""
    rows: dict[int, bool] = {}
    for c in cells:
        rows[c[1]] = rows.get(c[1], True) and c[5]
    n = 0
    while rows.get(n):
        n += 1
    return n


def to_markdown(cells: list[Cell], caption: str | None = None, spans: bool = False) -> str:
    rows = grid(cells)
    if not rows:
        return ""
    if spans:
        for _, r, c, rs, cs, _h, text, _p in cells:
            if rs > 1 or cs > 1:
                rows[r][c] = f"{text} *({', '.join(f'{k}={v}' for k, v in (('rowspan', rs), ('colspan', cs)) if v > 1)})*"
    heads = header_rows(cells) or 1
    lines = ["| " + " | ".join(x.replace("|", "\\|") for x in r) + " |" for r in rows]
    lines.insert(heads, "|" + " --- |" * len(rows[0]))
    return "\n".join(([f"**{caption}**", ""] if caption else []) + lines)


def row_chunks(cells: list[Cell], caption: str | None = None) -> list[str]:
    """One Markdown table for each data row, header and caption repeated."""
    rows = grid(cells)
    heads = header_rows(cells) or 1
    lines = ["| " + " | ".join(r) + " |" for r in rows]
    top = ([f"**{caption}**", ""] if caption else []) + lines[:heads] + ["|" + " --- |" * len(rows[0])] if rows else []
    return ["\n".join([*top, x]) for x in lines[heads:]]


def metadata(cells: list[Cell], caption: str | None = None) -> dict:
    rows = grid(cells)
    return {"rows": len(rows), "columns": len(rows[0]) if rows else 0, "has_header": header_rows(cells) > 0, "has_merged": any(c[3] > 1 or c[4] > 1 for c in cells), "caption": caption or "", "headers": [c[6] for c in cells if c[1] == 0 and c[5]]}


def to_json(cells: list[Cell], caption: str | None = None) -> str:
    return json.dumps({**metadata(cells, caption), "cells": [{"row": c[1], "col": c[2], "rowspan": c[3], "colspan": c[4], "header": c[5], "text": c[6]} for c in cells]}, ensure_ascii=False)


def to_html(cells: list[Cell], caption: str | None = None) -> str:
    import html

    by: dict[int, list[Cell]] = {}
    for c in cells:
        by.setdefault(c[1], []).append(c)
    cell = lambda c: f"<{'th' if c[5] else 'td'}{f' rowspan={c[3]}' if c[3] > 1 else ''}{f' colspan={c[4]}' if c[4] > 1 else ''}>{html.escape(c[6])}</{'th' if c[5] else 'td'}>"
    body = "\n".join("<tr>" + "".join(map(cell, sorted(by[r], key=lambda c: c[2]))) + "</tr>" for r in sorted(by))
    return "<table>\n" + (f"<caption>{html.escape(caption)}</caption>\n" if caption else "") + body + "\n</table>"


def best_format(cells: list[Cell], nested: bool) -> str:
    """``row_based`` for simple tables of more than two rows, ``preserving`` for merged, nested or long ones."""
    m = metadata(cells)
    simple = not m["has_merged"] and not nested and m["rows"] <= 10
    return "row_based" if simple and m["rows"] > 2 else "preserving"


def chunks_of(text: str | None) -> list[tuple[int, str, str]]:
    """(table, format, chunk) of each HTML table of a document in the format that suits it."""
    cells, captions = html_cells(text)
    out: list[tuple[int, str, str]] = []
    for t in sorted({c[0] for c in cells}):
        own = [c for c in cells if c[0] == t]
        kind = best_format(own, any(c[7] == t for c in cells))
        caption = captions.get(t)
        out += [(t, kind, x) for x in (row_chunks(own, caption) if kind == "row_based" else [to_markdown(own, caption, spans=True)])]
    return out
