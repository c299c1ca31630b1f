r"""Reading markup: which languages a text uses, its lines by nature, and its clean text.

Everything here works on one text, without Spark. A text is split into lines; a small state
machine follows the wrappers that span lines (fences, ``<pre>``, tables, lists, environments),
and single-line patterns decide the rest.

Defined cases: ``None``, empty and blank texts have no markup, no lines and an empty clean
text; a wrapper that is never closed reaches to the end of the text; program code that stands
without any wrapper is code, and nothing inside it is markup.
"""

from __future__ import annotations

import html
import re

# Element names of HTML.
HTML_ELEMENTS = (
    "a abbr acronym address applet area article aside audio b base bdi bdo big blockquote body br button canvas "
    "caption center cite code col colgroup data datalist dd del details dfn dialog dir div dl dt em embed fieldset "
    "figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html i iframe img "
    "input ins kbd label legend li link main map mark menu meta meter nav noscript object ol optgroup option output "
    "p param picture pre progress q rp rt ruby s samp script section select small source span strike strong style "
    "sub summary sup svg table tbody td template textarea tfoot th thead time title tr track tt u ul var video wbr"
).split()
_EL = "|".join(sorted(HTML_ELEMENTS, key=len, reverse=True))
TAG = re.compile(rf"</?(?:{_EL})(?:\s[^<>]*)?/?>|<!--(?:(?!<!--).)*?-->|<!doctype[^<>]*>", re.I | re.S)
ENTITY = re.compile(r"&(?:[a-z][a-z0-9]{1,30}|#\d{1,7}|#x[0-9a-f]{1,6});", re.I)

HEADING = re.compile(r"^ {0,3}#{1,6}[ \t]+\S*[^\W\d_]", re.M)
UNDERLINE = re.compile(r"\n {0,3}(?:={3,}|-{3,})[ \t]*(?=\n|\Z)")
STRONG = re.compile(r"\*\*(?=[^\s*])[^*\n]+(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])[^_\n]+(?<=[^\s_])__(?!\w)|(?<![\w*])\*(?=[^\W\d_])[^*\n]*\w\*(?![\w*])")
LINK = re.compile(r"!?\[[^\[\]\n]*\]\((?:[^()\s]+)(?:\s+\"[^\"\n]*\")?\)")
FENCE_LINE = re.compile(r"^ {0,3}(?:```|~~~)[ \t]*[\w+-]*[ \t]*$", re.M)
_RULE = r"[ \t]*\|?[ \t]*(?::-+:?|-+:|-{3,})[ \t]*(?:\|[ \t]*(?::-+:?|-+:|-{3,})[ \t]*)+\|?[ \t]*"
RULE_ROW = re.compile(rf"^{_RULE}$", re.M)
QUOTE = re.compile(r"^ {0,3}>[ \t]+\S*\w", re.M)
INLINE_CODE = re.compile(r"(?<![`\w])`[^`\n]+`(?![`\w])")
TASK = re.compile(r"^[ \t]*[-*+][ \t]+\[[ xX]\][ \t]", re.M)


def _underlined(text: str) -> bool:
    for m in UNDERLINE.finditer(text):
        above = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
        if "|" not in above and any(x.isalpha() for x in above) and not LIST_ITEM.match(above):
            return True
    return False


def is_markdown(text: str) -> bool:
    return bool(
        ("#" in text and HEADING.search(text))
        or ("](" in text and LINK.search(text))
        or (("*" in text or "__" in text) and STRONG.search(text))
        or (("```" in text or "~~~" in text) and FENCE_LINE.search(text))
        or ("|" in text and "-" in text and RULE_ROW.search(text))
        or (("---" in text or "===" in text) and _underlined(text))
        or (">" in text and QUOTE.search(text))
        or ("`" in text and INLINE_CODE.search(text))
        or ("] " in text and TASK.search(text))
    )


WIKI = re.compile(
    r"^(={2,6})[ \t]*[^=\s][^=\n]*?[ \t]*\1[ \t]*$"  # heading
    r"|\[\[[^\W\d_][^\[\]\n]*\]\]|\[\[[^\[\]\n]*[^\W\d_][^\[\]\n]*\]\]"  # link
    r"|'''[^'\n]+?'''|(?<!')''[^'\n]+?''(?!')"  # bold, italic
    r"|\{\{[A-Za-z#][^{}]*\}\}"  # template
    r"|^\{\|.*$|^\|\}[ \t]*$|^\|-+[ \t]*$|^[ \t]*__(?:NO)?TOC__"  # table, switches
    r"|<ref[ >/]|</ref>|<nowiki>|\[https?://[^\s\]]+ [^\]\n]+\]",
    re.M,
)
LATEX = re.compile(
    r"\\(?:begin|end)\{[A-Za-z]+\*?\}"
    r"|\\(?:section|subsection|subsubsection|chapter|paragraph|textbf|textit|emph|texttt|cite[pt]?|ref|label|footnote|caption"
    r"|item|title|author|href|url|frac|sqrt|text|mathbf|mathrm|operatorname|underline|usepackage|documentclass|includegraphics)\*?(?:\[[^\]\n]*\])?[{]"
    r"|\\item(?:\[|\s)"
    r"|\\(?:frac|alpha|beta|gamma|delta|lambda|sigma|sum|prod|int|sqrt|cdot|times|leq|geq|infty|partial|left|right|mathcal|theta|mu|pi)(?![A-Za-z])"
    r"|\\\[|\\\(|\$\$[^$]+\$\$|(?<![\w$\\])\$(?=[^\s\d$])[^$\n]{0,200}(?:[\\^_={}])[^$\n]{0,200}(?<=\S)\$(?![\w$])"
)
_ANY = re.compile(r"[<&#*_`\[\]>|={}\\$'~-]")

PRE = re.compile(r"(<(?:pre|xmp|listing|syntaxhighlight|source)\b[^<>]*>)(.*?)(</(?:pre|xmp|listing|syntaxhighlight|source)\s*>|\Z)", re.I | re.S)
FENCE = re.compile(r"^( {0,3})(`{3,}|~{3,})([ \t]*[\w+-]*[ \t]*)$(.*?)(?:^ {0,3}\2[`~]*[ \t]*$|\Z)", re.M | re.S)
VERB = re.compile(r"(\\begin\{(?:verbatim|lstlisting|minted)\*?\})(.*?)(\\end\{(?:verbatim|lstlisting|minted)\*?\}|\Z)", re.S)

#: A line that only program code has. A text whose lines are mostly such is code without a wrapper.
CODE_LINE = re.compile(
    r"^\s*(?:"
    r"(?:def|class)\s+\w+.*:\s*$|(?:if|elif|for|while|with|try|except|else)\b.*:\s*$|return\b.*(?:[\])};]|\w\(.*\))\s*.*$|return(?:\s+\w+)?;?\s*$"
    r"|(?:import\s+[\w.]+|from\s+[\w.]+\s+import\b.*)\s*;?\s*$|#include\b.*|#!/.*"
    r"|(?:public|private|protected|static|final|const|let|var|function|void|int|package|using|namespace)\b.*[;{(].*$"
    r"|\w[\w.\[\]]*\s*(?:=|\+=|-=|:=)\s*\S.*[\])};\w]\s*$|[\w.]+\([^)]*\)[;:]?\s*$|.*[;{}]\s*$|[)}\]]+[;,)]*\s*$"
    r"|(?:SELECT\b.*|FROM\s+\w+.*|WHERE\b.*|GROUP BY\b.*|ORDER BY\b.*|HAVING\b.*|INSERT INTO\b.*|UPDATE\s+\w+\s+SET\b.*|CREATE TABLE\b.*|(?:LEFT |INNER )?JOIN\b.*|AND\s+\w+[.\w]*\s*(?:=|<|>|!=).*|LIMIT\s+\d+.*|WITH\s+\w+\s+AS\b.*)$"
    r"|(?:do|done|fi|then|esac|set -\w+|mkdir\b.*|echo\b.*|export\s+\w+=.*|cd\s+\S+|rm\s+-.*|cp\s+\S+\s+\S+|curl\b.*|for\s+\w+\s+in\s.*;\s*do)\s*$"
    r"|\w+\s+--\w.*$|--\w[\w-]*\s.*$|//.*|/\*.*|\*/.*|.*\\\s*$|@\w+(?:\(.*\))?\s*$"
    r")"
)
_CODE_HINT = re.compile(r"[;{}\\:)\]]\s*$|^\s*(?:SELECT|FROM|WHERE|HAVING|do|done|mkdir|import)\b")
_COMMENT = re.compile(r"^\s*(?:#|//|--|/\*|\*)\s?.*$")
_PROSE = re.compile(r"[^\W\d_]+(?: [^\W\d_]+){4,}[^;{}]*[.!?]\s*$")


def is_bare_code(lines: list[str]) -> bool:
    """Whether these lines without wrapper are program code: at least two thirds look so, two of them surely."""
    if len(lines) < 2 or not any(_CODE_HINT.search(x) for x in lines):
        return False
    body = [x for x in lines if x.strip()]
    if len(body) < 2:
        return False
    sure = sum(1 for x in body if _is_code_line(x) and not LIST_ITEM.match(x) and not _is_markup_line(x))
    near = sum(1 for x in body if _COMMENT.match(x) and not _is_code_line(x) and not x.lstrip().startswith(("* ", "##")))
    return sure >= 2 and 3 * (sure + near) >= 2 * len(body)


def _is_code_line(x: str) -> bool:
    """A long line is judged by its two ends, so in linear time, if at least a tenth of it are signs."""
    if len(x) < 200:
        return bool(CODE_LINE.match(x))
    solid = len("".join(x.split()))
    return 10 * (solid - sum(map(str.isalnum, x))) >= solid and bool(CODE_LINE.match(x[:100] + x[-100:]))


def _is_markup_line(x: str) -> bool:
    s = x.strip()
    return s.startswith(("\\", "{|", "|", "{{", "<", "!")) or s.endswith("\\\\")


def blank_code(text: str) -> tuple[str, set[str]]:
    """The text with the insides of code blocks blanked, and the languages whose wrappers were found."""
    found: set[str] = set()

    def pre(m: re.Match) -> str:
        found.add("wiki" if re.match(r"<(?:syntaxhighlight|source)", m.group(1), re.I) and "</" in m.group(3) else "html")
        return "\n"

    def fence(m: re.Match) -> str:
        found.add("markdown")
        return "\n"

    def verb(m: re.Match) -> str:
        found.add("latex")
        return "\n"

    if "<" in text:
        text = PRE.sub(pre, text)
    if "```" in text or "~~~" in text:
        text = FENCE.sub(fence, text)
    if "\\begin{" in text:
        text = VERB.sub(verb, text)
    return text, found


def languages(text: str | None) -> set[str]:
    """Markup languages found in a text."""
    if not text or not _ANY.search(text):
        return set()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    rest, found = blank_code(text)
    if is_bare_code(rest.split("\n")):
        return found
    if ("<" in rest and TAG.search(rest)) or ("&" in rest and ENTITY.search(rest)):
        found.add("html")
    if "markdown" not in found and is_markdown(rest):
        found.add("markdown")
    if ("=" in rest or "[[" in rest or "''" in rest or "{" in rest or "|" in rest or "<" in rest) and WIKI.search(rest):
        found.add("wiki")
    if ("\\" in rest or "$" in rest) and LATEX.search(rest):
        found.add("latex")
    return found


LIST_ITEM = re.compile(r"^\s*(?:[-*+•‣·–—◦▪]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\((?:[ivx]{1,5})\)|[ivx]{1,5}[.)])\s+\S")


_DROP = re.compile(r"<(script|style|head)\b.*?(?:</\1\s*>|\Z)|<!--(?:(?!<!--).)*?-->|<!doctype[^<>]*>", re.I | re.S)
_MATH_ENV = re.compile(r"\\begin\{(equation|align|displaymath|gather|eqnarray|math)(\*?)\}(.*?)(?:\\end\{\1\2\}|\Z)", re.S)


def _html(t: str) -> str:
    t = _DROP.sub("", t)
    t = re.sub(r"<h([1-6])\b[^<>]*>\s*(.*?)\s*</h[1-6]\s*>", lambda m: f"\n{'#' * int(m[1])} {m[2]}\n", t, flags=re.I | re.S)
    t = re.sub(r"<li\b[^<>]*>\s*", "\n- ", t, flags=re.I)
    t = re.sub(r"\s*<tr\b[^<>]*>\s*", "\n", t, flags=re.I)
    t = re.sub(r"(?:\s*</t[dh]\s*>\s*|[ \t]*)<t[dh]\b[^<>]*>\s*", " | ", t, flags=re.I)
    t = re.sub(r"^ \| ", "| ", t, flags=re.M)
    t = re.sub(r"<(?:br|hr|p|div|section|article|blockquote|ul|ol|table|dl|dt|dd)\b[^<>]*>|</(?:p|div|section|article|blockquote|ul|ol|table|dl|tr|li)\s*>", "\n", t, flags=re.I)
    return html.unescape(TAG.sub("", t))


def _latex(t: str) -> str:
    t = _MATH_ENV.sub(lambda m: f"\n$$ {m[3].strip()} $$\n", t)
    t = re.sub(r"\\\[(.*?)\\\]", lambda m: f"\n$$ {m[1].strip()} $$\n", t, flags=re.S)
    t = re.sub(r"\\\((.*?)\\\)", lambda m: f"${m[1]}$", t, flags=re.S)
    parts = re.split(r"(\$\$.*?\$\$|\$[^$\n]+\$)", t, flags=re.S)
    for i in range(0, len(parts), 2):
        x = parts[i]
        x = re.sub(r"\\(sub)?(sub)?(?:section|chapter)\*?\{([^{}]*)\}", lambda m: f"\n{'#' * (1 + bool(m[1]) + bool(m[2]))} {m[3]}\n", x)
        x = re.sub(r"^(?=.*(?<!\\)&.*\\\\\s*$)(.*?)\\\\\s*$", lambda m: "| " + " | ".join(c.strip() for c in re.split(r"(?<!\\)&", m[1])), x, flags=re.M)
        x = re.sub(r"\\item(?:\[([^\]]*)\])?[ \t]*", lambda m: f"- {m[1] + ' ' if m[1] else ''}", x)
        x = re.sub(r"\\(?:begin|end)\{[^{}]*\}(?:\[[^\]\n]*\]|\{[^{}\n]*\})*|\\(?:hline|toprule|midrule|bottomrule|centering|maketitle|noindent)\b", "", x)
        x = re.sub(r"\\(?:cite[pt]?|ref|label)\*?(?:\[[^\]]*\])?\{([^{}]*)\}", r"[\1]", x)
        x = re.sub(r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{([^{}]*)\}", r"\1", x)
        parts[i] = re.sub(r"\\([%&_#${}])", r"\1", x)
    return "".join(parts)


def _wiki(t: str) -> str:
    t = re.sub(r"^(={2,6})[ \t]*(.*?)[ \t]*\1[ \t]*$", lambda m: f"{'#' * (len(m[1]) - 1)} {m[2]}", t, flags=re.M)
    t = re.sub(r"\{\{([^{}|]*)((?:\|[^{}]*)?)\}\}", lambda m: "\n".join([m[1].strip(), *("- " + re.sub(r"\s*=\s*", ": ", p.strip(), count=1) for p in m[2].split("|") if p.strip())]) + "\n", t)
    t = re.sub(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]", r"\1", t)
    t = re.sub(r"\[https?://[^\s\]]+ ([^\]\n]+)\]", r"\1", t)
    t = re.sub(r"'{2,5}", "", t)
    t = re.sub(r"^\{\|.*$|^\|\}[ \t]*$|^\|-+[ \t]*$|^\|\+.*$", "", t, flags=re.M)
    t = re.sub(r"^[ \t]*!(?!\[)[ \t]*(.*)$", lambda m: "| " + re.sub(r"\s*!!\s*", " | ", m[1]), t, flags=re.M)
    t = re.sub(r"^[ \t]*\|(?!\|).*\|\|.*$", lambda m: re.sub(r"\s*\|\|\s*", " | ", m[0]), t, flags=re.M)
    return re.sub(r"</?(?:ref|nowiki)\b[^<>]*>", "", t)


def _markdown(t: str) -> str:
    t = re.sub(r"^([^\n|]*\w[^\n|]*)\n {0,3}(={3,}|-{3,})[ \t]*$", lambda m: f"{'#' if m[2][0] == '=' else '##'} {m[1]}", t, flags=re.M)
    t = re.sub(r"^ {0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", r"\1 \2", t, flags=re.M)
    t = re.sub(rf"^{_RULE}(?:\n|\Z)", "", t, flags=re.M)
    t = re.sub(r"!?\[([^\[\]\n]*)\]\([^()\s]+(?:\s+\"[^\"\n]*\")?\)", r"\1", t)
    t = re.sub(r"\*\*(?=[^\s*])([^*\n]+)(?<=[^\s*])\*\*|(?<!\w)__(?=[^\s_])([^_\n]+)(?<=[^\s_])__(?!\w)|(?<![\w*])\*(?=[^\W\d_])([^*\n]*\w)\*(?![\w*])", lambda m: m[1] or m[2] or m[3], t)
    t = re.sub(r"^ {0,3}>[ \t]?", "", t, flags=re.M)
    t = re.sub(r"(?<![`\w])`([^`\n]+)`(?![`\w])", r"\1", t)
    return re.sub(r"^([ \t]*)[*+](?=[ \t])", r"\1-", t, flags=re.M)


def clean(text: str | None) -> str:
    """The text without markup: headings as ``#``, lists as ``-``, table rows as ``| a | b``, code in fences, formulas in ``$``."""
    if not text or not text.strip():
        return ""
    text = text.lstrip("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    found = languages(text)
    if not found:
        return text.strip()
    kept: list[str] = []

    def keep(code: str, escaped: bool) -> str:
        code = html.unescape(re.sub(r"</?code\b[^<>]*>", "", code, flags=re.I)) if escaped else code
        kept.append("```\n" + code.strip("\n") + "\n```")
        return f"\n\x00{len(kept) - 1}\x00\n"

    text = PRE.sub(lambda m: keep(m[2], True), text)
    text = FENCE.sub(lambda m: keep(m[4], False), text)
    text = VERB.sub(lambda m: keep(m[2], False), text)
    for name, fn in (("wiki", _wiki), ("latex", _latex), ("markdown", _markdown), ("html", _html)):
        if name in found:
            text = fn(text)
    text = re.sub(r"[ \t]+$", "", text, flags=re.M)
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    return re.sub("\x00(\\d+)\x00", lambda m: kept[int(m[1])] if int(m[1]) < len(kept) else "", text)
