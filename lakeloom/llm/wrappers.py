r"""Wrapper tokens of one page: what stands around its text, without regard to any markup language.

A wrapper is a pair of signs around something: a tag and its end, a bracket and its partner, a run of one sign before and
after words, a sign at the start of a line and the line's end, a command and its braces. Tokens are told apart by context:
the role that they play (``‹`` opens, ``›`` closes, ``^`` starts a line that ``$`` ends, ``=`` is a whole line), the partner
they have, and whether they stand inside a code wrapper (``code:``). A sign without a partner is a token with the role ``?``.

Works on one text, without Spark, in time linear in its length. Defined cases: null and blank texts have no token.
"""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"\n|<!--|-->|</?[A-Za-z][A-Za-z0-9]*|/?>|&#?[A-Za-z0-9]{1,31};|\\[A-Za-z]+\*?|\\[\[\]()]|\{\||\|\}|\[\[|\]\]|\{\{|\}\}|\]\("
    r"|<|&|\\|[(){}\[\]]|([^\w\s<>&\\(){}\[\]])\1*"
)
_NAME = re.compile(r"\{([A-Za-z]+\*?)\}")
_SIGNS_ONLY = re.compile(r"[^\w\s]+(?:[ \t]+[^\w\s]+)*")
_CLOSERS = {")": "(", "]": "[", "}": "{", "]]": "[[", "}}": "{{", "|}": "{|", "-->": "<!--", "\\]": "\\[", "\\)": "\\("}
_OPENERS = frozenset(_CLOSERS.values())
CODE = re.compile(r"```+|~~~+|<(?:pre|xmp|listing|syntaxhighlight|source)|\\begin\{(?:verbatim|lstlisting|minted)\*?\}")


class Page:
    """Counts, first and last places and outer wrappers of a page's tokens."""

    def __init__(self, text: str):
        self.tokens: dict[str, list] = {}
        self.opened: dict[str, list[str]] = {}  # open wrappers by what closes them
        self.outer: list[str] = []
        self.code = ""
        if "\r" in text:
            text = text.replace("\r\n", "\n").replace("\r", "\n")
        self._read(text)

    def add(self, token: str, at: int) -> None:
        if self.code:
            token = "code:" + token
        if (t := self.tokens.get(token)) is not None:
            t[0] += 1
            t[2] = at
        else:
            self.tokens[token] = [1, at, at, self.outer[-1] if self.outer else ""]

    def pair(self, opens: str, closes: str, a: int, z: int) -> None:
        self.add(opens, a)
        self.add(closes, z)

    def _open(self, key: str, token: str, wide: bool = False) -> None:
        self.opened.setdefault(key, []).append(token)
        if wide:
            self.outer.append(token)

    def _close(self, key: str, token: str) -> str | None:
        """The wrapper that a token closes, if one is open."""
        stack = self.opened.get(key)
        if not stack:
            return None
        token = stack.pop()
        if token in self.outer:
            while self.outer and self.outer.pop() != token:
                pass
        return token

    def _read(self, text: str) -> None:
        start, line_open, tag, starts = 0, {}, None, None
        for m in _TOKEN.finditer(text):
            t, a, z = m[0], m.start(), m.end()
            if t == "\n":
                if starts:
                    self.add(f"{starts}$", a)
                start, line_open, starts = z, {}, None
                continue
            head = not text[start:a].strip() if a - start < 40 else False
            if self.code:  # only its end counts
                kind, ends = self.code
                if ends == t or head and kind[0] in "`~" and t.startswith(ends) or t == "\\end" and text.startswith(ends, z):
                    self.code = ""
                    self._close("code", kind)
                    self.add(f"›{kind}", a)
                else:
                    self.add(t, a)
                continue
            if head and t[0] in "`~" and len(t) >= 3:
                self._begin(t[:3], t[:3], a)
            elif t[0] == "<" and len(t) > 1 and t[1] != "!":
                name = t.lower()
                if t[1] == "/":
                    opened = self._close(name[2:], name)
                    self.add(name if opened else f"{name}?", a)
                else:
                    self.add(name, a)
                    if CODE.fullmatch(name):
                        self._begin(name, f"</{t[1:]}", a, False)
                    else:
                        self._open(name[1:], name, True)
                tag = name
            elif t in (">", "/>") and tag:
                self.add(f">{tag}", a)
                tag = None
            elif t[0] == "&" and len(t) > 1:
                self.pair(t[:-1], f";{t[:-1]}", a, z - 1)
            elif t[0] == "\\" and len(t) > 1 and t[1].isalpha():
                n = _NAME.match(text, z) if t in ("\\begin", "\\end") else None
                if n and t == "\\begin":
                    name = f"\\begin{n[0]}"
                    self.add(name, a)
                    if CODE.fullmatch(name):
                        self._begin(name, n[0], a, False)
                    else:
                        self._open(n[0], name, True)
                elif n:
                    opened = self._close(n[0], n[0])
                    self.add(f"\\end{n[0]}" if opened else f"\\end{n[0]}?", a)
                elif text.startswith("{", z):
                    self.add(f"{t}{{", a)
                    line_open["next"] = f"{t}{{"
                else:
                    self.pair(t, f";{t}", a, z)
            elif t in _OPENERS or t == "](":
                if t == "](":
                    opened = self._close("[", t)
                    if opened:
                        self.pair("[", "](", a, a)
                    self._open("(", "](")
                elif t == "{" and line_open.get("next"):
                    self._open("{", line_open.pop("next"))
                else:
                    self._open(t, t, t == "{|")
                if head:
                    starts = f"{t}^"
                    self.add(starts, a)
            elif t in _CLOSERS:
                key = _CLOSERS[t]
                opened = self._close(key, t)
                if opened is None:
                    self.add(f"{t}?", a)
                elif opened in _OPENERS:
                    self.pair(f"{opened}‹", f"›{opened}", a, a)
                else:
                    self.add(f"›{opened}", a)
            else:
                if head:
                    end = text.find("\n", a)
                    line = text[a : end if end >= 0 else len(text)].rstrip()
                    if len(line) > len(t) and len(line) < 2000 and _SIGNS_ONLY.fullmatch(line):
                        t = re.sub(r"(.)\1+", r"\1", "".join(line.split()))
                        self.pair(f"{t[:3]}=", f"{t[:3]}=$", a, a + len(line))
                        continue
                    if len(line) == len(t):
                        self.pair(f"{t[0]}=", f"{t[0]}=$", a, z)
                    starts = f"{t[:6]}^"
                    self.add(starts, a)
                before, after = text[a - 1 : a], text[z : z + 1]
                if t == "$$":
                    if self._close(t, t):
                        self.pair("$$‹", "›$$", a, a)
                    else:
                        self._open(t, t)
                elif t in line_open and before.strip():
                    self.pair(f"{t}‹", f"›{t}", line_open.pop(t), a)
                elif after.strip():
                    line_open[t] = a
                elif not head:
                    self.add(f"{t[:3]}?", a)
        if starts:
            self.add(f"{starts}$", len(text))

    def _begin(self, kind: str, ends: str, at: int, add: bool = True) -> None:
        if add:
            self.add(kind, at)
        self._open("code", kind, True)
        self.code = (kind, ends)


def page_tokens(text: str | None) -> list[tuple[str, int, int, int, str]]:
    """(token, how often, first place, last place, the wrapper around its first occurrence) of each token."""
    if not text or not text.strip():
        return []
    return [(t, *v) for t, v in Page(text).tokens.items()]


def signs_of(tokens: list[str]) -> set[str]:
    """The signs in a text that tokens stand for, without their roles."""
    return {t.removeprefix("code:").strip("‹›?") for t in tokens if t[-1] != "$"} | {t[:-1] for t in tokens if t[-1] in "^="} | {t[0] for t in tokens if t[0] in ";>" and len(t) > 1}


def page_slots(text: str | None, signs: set[str]) -> list[str]:
    """What stands between the signs of a page's template, and between its lines; blank parts are left out."""
    out, at = [], 0
    for m in _TOKEN.finditer(text or ""):
        if m[0] == "\n" or m[0] in signs or m[0].lower() in signs or m[0] + "{" in signs or m[0][:-1] in signs and m[0][0] == "&":
            if part := (text or "")[at : m.start()].strip():
                out.append(part)
            at = m.end()
    if part := (text or "")[at:].strip():
        out.append(part)
    return out
