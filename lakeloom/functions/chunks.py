"""Cutting one text into chunks. Plain functions; ``operators.chunking`` applies them in Arrow batches.

All return a list without blank chunks; null and blank texts give none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

PARAGRAPH = re.compile(r"\n\s*\n")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
HEADING = re.compile(r"#+\s+.+$|[A-Z][\w\s]+:$|[IVX]+\.\s+.+$|\d+\.\d*\s+.+$|[A-Z][A-Z\s]+$|={3,}$|-{3,}$|[A-Z][a-z]+\s+\d+:", re.M)
LIST_MARK = re.compile(r"^(\s*)(?:[-*+•]|\d+[.)]|[a-zA-Z][.)])\s+")
CODE_EDGE = re.compile(r"^(?:def |class |async def |function |public |private |protected |export |const |func |fn |impl |SELECT |CREATE |@)")
FENCE = re.compile(r"^```.*?^```[^\n]*$", re.M | re.S)
RULE = re.compile(r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)*\|?\s*$")


def paragraphs(text: str) -> list[str]:
    return [p for x in PARAGRAPH.split(text) if (p := x.strip())]


def sentences(text: str) -> list[str]:
    return [s for x in SENTENCE.split(text) if (s := x.strip())]


def pack(parts: Iterable[str], most: int, glue: str, cost: int | None = None) -> list[str]:
    """Successive parts joined while their lengths, ``cost`` for each part added, stay within ``most``; a longer part stands alone."""
    cost = len(glue) if cost is None else cost
    out: list[list[str]] = []
    used = 0
    for p in parts:
        if out and used + len(p) + cost <= most:
            out[-1].append(p)
            used += len(p) + cost
        else:
            out.append([p])
            used = len(p) + cost
    return [glue.join(x) for x in out]


def windows(text: str | None, most: int) -> list[str]:
    """Windows of at most ``most`` characters that end at a space where there is one."""
    out, at, text = [], 0, text or ""
    while at < len(text):
        end = min(len(text), at + most)
        if end < len(text) and (space := text.rfind(" ", at, end)) > at:
            end = space
        if piece := text[at:end].strip():
            out.append(piece)
        at = end
    return out


def smart(text: str | None, most: int = 1000, overlap: int = 0) -> list[str]:
    """Paragraphs packed; long ones by sentences, of which one that is too long stays whole. ``overlap`` characters of the chunk before go first."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        out.extend(pack(run, most, "\n\n"))
        run.clear()

    for p in paragraphs(text or ""):
        if len(p) <= most:
            run.append(p)
        else:
            flush()
            out.extend(pack(sentences(p), most, " ", 0))
    flush()
    return with_overlap(out, overlap)


def with_overlap(chunks: list[str], overlap: int) -> list[str]:
    """Each chunk after the end of the original chunk before it."""
    return chunks if overlap <= 0 else [c if not i else f"{chunks[i - 1][-overlap:]} {c}" for i, c in enumerate(chunks)]


def by_headings(text: str | None, most: int = 1000) -> list[str]:
    """Paragraphs packed, with a new chunk at each heading."""
    out: list[list[str]] = []
    used = 0
    for p in paragraphs(text or ""):
        if out and not HEADING.match(p) and used + len(p) <= most:
            out[-1].append(p)
            used += len(p) + 4
        else:
            used = len(p) + (0 if out else 4)
            out.append([p])
    return ["\n\n".join(x) for x in out]


def cascade(text: str | None, most: int = 1000, overlap: int = 0) -> list[str]:
    """Paragraphs, then sentences, then clauses, then words, always the coarsest that fits."""

    def split(part: str, level: int) -> list[str]:
        if len(part) <= most:
            return [part]
        if level > 2:
            return windows(part, most)
        pieces = (sentences(part), re.split(r",\s+", part), part.split())[level]
        glue = (" ", ", ", " ")[level]
        return pack([y for x in pieces for y in split(x, level + 1)], most, glue)

    return with_overlap(pack([y for p in paragraphs(text or "") for y in split(p, 0)], most, "\n\n"), overlap)


def prose(text: str | None, most: int = 500) -> list[str]:
    """Paragraphs packed, long ones by sentences, giant sentences by characters."""
    parts: list[str] = []
    for p in paragraphs(text or ""):
        parts += [p] if len(p) <= most else pack([w for s in sentences(p) for w in (windows(s, most) if len(s) > most else [s])], most, " ")
    return pack(parts, most, "\n\n")


def code(text: str | None, most: int = 500) -> list[str]:
    """Definitions packed whole; a longer one by lines, a longer line by characters."""
    blocks: list[list[str]] = []
    for line in (text or "").split("\n"):
        if not blocks or CODE_EDGE.match(line):
            blocks.append([])
        blocks[-1].append(line)
    parts: list[str] = []
    for b in ("\n".join(x).strip("\n") for x in blocks):
        if b.strip():
            parts += [b] if len(b) <= most else pack([y for x in b.split("\n") for y in (windows(x, most) if len(x) > most else [x])], most, "\n")
    return [c for c in pack(parts, most, "\n") if c.strip()]


def table(text: str | None, most: int = 500) -> list[str]:
    """Rows packed below the repeated header (up to the rule of a Markdown table, else the first line)."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    if not lines:
        return []
    rule = next((i for i, x in enumerate(lines) if i and RULE.match(x)), None)
    head = lines[: rule + 1] if rule is not None else lines[:1]
    rows = lines[len(head) :]
    if not rows:
        return ["\n".join(head)]
    top = "\n".join(head)
    return [f"{top}\n{c}" for c in pack(rows, max(1, most - len(top) - 1), "\n")]


def table_rows(text: str | None) -> list[str]:
    """One chunk for each data row of a Markdown table, the header lines repeated; none without a rule."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    rule = next((i for i, x in enumerate(lines) if i and "|" in x and RULE.match(x)), None)
    if rule is None:
        return []
    head = "\n".join(lines[: rule + 1])
    return [f"{head}\n{x}" for x in lines[rule + 1 :] if "|" in x]


def column_spans(lines: list[str], rule_at: int) -> dict[int, str]:
    """Label of each column by the character spans between the pipes of the rule; from the second header row if there are two."""
    label = lines[1] if rule_at >= 2 else lines[0] if rule_at else ""
    edges = [i for i, c in enumerate(lines[rule_at]) if c == "|"]
    return {n: label[a + 1 : b].strip() for n, (a, b) in enumerate(zip(edges, edges[1:]))}


def items(text: str | None, most: int = 500) -> list[str]:
    """List items packed whole, with what is indented below them; a longer item by lines, then by characters."""
    groups: list[list[str]] = []
    for line in (text or "").split("\n"):
        m = LIST_MARK.match(line)
        if line.strip() and (m and len(m[1]) == 0 or not groups):
            groups.append([])
        if line.strip():
            groups[-1].append(line)
    parts: list[str] = []
    for g in ("\n".join(x) for x in groups):
        parts += [g] if len(g) <= most else pack([y for x in g.split("\n") for y in (windows(x, most) if len(x) > most else [x])], most, "\n")
    return pack(parts, most, "\n")


def token_overlap(chunks: list[str], overlap: int, encode, decode) -> list[str]:
    """Each chunk after the last ``overlap`` tokens of the original chunk before it; ``encode`` and ``decode`` are a tokenizer's."""
    return chunks if overlap <= 0 else [c if not i else decode(encode(chunks[i - 1])[-overlap:]) + c for i, c in enumerate(chunks)]


def simple(text: str | None, most: int = 1000) -> list[str]:
    """Paragraphs, or sentences of long ones, packed by their lengths alone; what joins them doesn't count."""
    parts = [s for p in paragraphs(text or "") for s in ([p] if len(p) <= most else sentences(p))]
    return pack(parts, most, "\n\n", 0)


def by_topic(text: str | None, topic, most: int = 1000, least: int = 50, stretch: float = 1.2) -> list[str]:
    """Paragraphs packed, then neighbours of one topic merged up to ``stretch`` times the size; ``topic`` names that of a text of ``least`` characters and more."""
    out: list[tuple[str, str | None]] = []
    for c in pack(paragraphs(text or ""), most, "\n\n"):
        kind = topic(c) if len(c) >= least else None
        if out and kind is not None and out[-1][1] == kind and len(out[-1][0]) + len(c) + 2 <= stretch * most:
            out[-1] = (f"{out[-1][0]}\n\n{c}", kind)
        else:
            out.append((c, kind))
    return [c for c, _ in out]


def share_of(lines: list[str], test) -> float:
    return sum(1 for x in lines if test(x)) / len(lines) if lines else 0.0


def content_scores(text: str | None) -> dict[str, float]:
    """How much of a text is code, table, list, heading, dialogue, technical and prose, by its lines."""
    lines = [x for x in (text or "").split("\n") if x.strip()]
    fenced = sum(len(m[0].split("\n")) for m in FENCE.finditer(text or ""))
    scores = {
        "code": min(1.0, (fenced + share_of(lines, lambda x: bool(re.search(r"[;{}]\s*$|^\s*(?:def|class|import|return|for|if)\b.*[:;(]\s*$|^\s*#!", x))) * len(lines)) / len(lines)) if lines else 0.0,
        "table": share_of(lines, lambda x: x.count("|") >= 2 or "\t" in x or x.count(",") >= 3 and ", " not in x),
        "list": share_of(lines, lambda x: bool(LIST_MARK.match(x))),
        "heading": share_of(lines, lambda x: bool(re.match(r"#{1,6}\s|[A-Z][A-Z\s]+$", x))),
        "dialogue": share_of(lines, lambda x: bool(re.match(r"[A-Z][\w ]{0,20}:\s", x))),
        "technical": min(1.0, len(re.findall(r"\b\w+_\w+\b|\b[a-z]+[A-Z]\w+\b|`[^`]+`", text or "")) / max(1, len((text or "").split())) * 5),
        "math": share_of(lines, lambda x: bool(re.search(r"\$[^$\s][^$]*\$|\\(?:frac|sum|int|begin\{(?:equation|align))|[=<>≤≥]\s*\S+\s*[-+*/^]\s*\S", x))),
        "citation": min(1.0, len(re.findall(r"\[\d+\]|\([A-Z][a-z]+[^()]{0,40},\s*\d{4}\)|\bet al\.", text or "")) / max(1, len(sentences(text or "")))),
    }
    scores["prose"] = max(0.0, 1.0 - max(scores.values()))
    kinds = sum(1 for k in ("code", "table", "list", "heading") if scores[k] > 0.1)
    scores["structured"] = min(1.0, kinds / 3) if kinds > 1 else 0.0
    words = re.findall(r"\w+", (text or "").lower())
    variety = len(set(words)) / len(words) if words else 0.5
    scores["dense"], scores["sparse"] = float(variety > 0.8 and len(words) > 50), float(variety < 0.3 and len(words) > 50)
    return scores


# Factors of the chunk size by content type.
SIZE_FACTORS = {"code": 0.5, "table": 0.4, "list": 0.6, "prose": 1.0, "heading": 1.2, "dialogue": 0.8, "technical": 0.7, "math": 0.5, "citation": 0.9, "structured": 0.7, "dense": 0.6, "sparse": 1.5}


def best_size(scores: dict[str, float], base: int = 500) -> int:
    """The base size by the factors of the types scored over .3, weighted by score, within 200..1500."""
    big = {k: v for k, v in scores.items() if v > 0.3 and k in SIZE_FACTORS}
    factor = sum(SIZE_FACTORS[k] * v for k, v in big.items()) / sum(big.values()) if big else 1.0
    return int(min(1500, max(200, base * factor)))


def mixed(text: str | None, most: int = 500) -> list[str]:
    """Fenced code, tables and lists cut by their own rules, the prose between them by its."""
    out: list[str] = []
    at = 0
    text = text or ""
    for m in FENCE.finditer(text):
        out += _lines(text[at : m.start()], most) + code(m[0], most)
        at = m.end()
    return out + _lines(text[at:], most)


def _lines(text: str, most: int) -> list[str]:
    runs: list[tuple[str, list[str]]] = []
    for x in text.split("\n"):
        kind = "table" if x.count("|") >= 2 else "list" if LIST_MARK.match(x) else "prose" if x.strip() or not runs else runs[-1][0]
        if not runs or runs[-1][0] != kind:
            runs.append((kind, []))
        runs[-1][1].append(x)
    return [c for kind, xs in runs for c in {"table": table, "list": items, "prose": prose}[kind]("\n".join(xs), most)]


def adaptive(text: str | None, most: int = 500) -> list[str]:
    """By the dominant content; several kinds in a long text are cut each by its own rule."""
    s = content_scores(text)
    size = min(most, best_size(s, most))
    kinds = [k for k in ("code", "table", "list") if s[k] > 0.15]
    if len(text or "") > 1000 and (s["structured"] > 0.5 or kinds and s["prose"] > 0.3):
        return mixed(text, size)
    for kind, fn in (("code", code), ("table", table), ("list", items)):
        if s[kind] > 0.4:
            return fn(text, size)
    return prose(text, min(size, 400) if s["technical"] > 0.5 else size)


METHODS = {"windows": windows, "smart": smart, "headings": by_headings, "cascade": cascade, "simple": simple, "prose": prose, "code": code, "table": table, "list": items, "mixed": mixed, "adaptive": adaptive}
