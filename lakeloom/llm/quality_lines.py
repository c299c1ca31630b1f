r"""The nature of a text's lines, and its text statistics. Works on one text, without Spark.

Natures: ``list``, ``table``, ``code``, ``junk`` and ``prose``. The lines of a wrapper (fence,
``<ul>``, ``{|`` ...) count with what they wrap. Lines that no pattern claims are pooled and
judged together: pooled text that reads like loose words, one repeated phrase or broken
characters is junk, any other is prose.
"""

from __future__ import annotations

import re
from collections import Counter

from .markup import FENCE_LINE, LIST_ITEM, TAG, is_bare_code

WORDS = re.compile(r"\w+")
# Frequent function words by language.
STOP = {
    "en": set("the of and a an to in is are was were be been it its that this these for on with as at by or which from not have has had can may must will you your we our my they them their each other when while after before first then if so but all no do does what where how than who whom there here into over under he she his her me us i also only".split()),
    "fr": set("le la les des du de et un une sur il elle est sont dont dans pour par avec ce cette ces au aux en ne pas que qui se sa son ses plus ou où nous vous ils elles a ont été être dès après avant on l d".split()),
    "de": set("der die das den dem des und ein eine einer einen einem von zu zum zur ist sind wird werden wurde wurden im am in auf mit für nicht sich als auch an aus bei nach vor über unter wenn dass sie er es wir ihr ich alle jede darunter bevor".split()),
    "es": set("el la los las un una unos unas de del y en que es son por para con no se su sus al lo como más pero o si entre antes después sin sobre cada está ser ha han a".split()),
}
ANY_STOP = set().union(*STOP.values())

BROKEN = re.compile(r"ï¿½|\ufffd|Ã[\u0080-\u00bf\w©¼]|Â[\u0080-\u00bf\w]|â€")
LEADER = re.compile(r"(?:[.·•_-] ?){4,}\s*\d*\s*$")
BLOB = re.compile(r"^[A-Za-z0-9+/=_-]{24,}$")
BLOB_TAIL = re.compile(r"^[A-Za-z0-9+/_-]+={0,2}$")
FIELD_LINE = re.compile(r"^\s*[^\W\d_][\w -]{0,40}?\s?:\s+\S")
FIELD_PART = re.compile(r"^\s*[^\W\d_][\w -]{0,40}?\s?:\s*\S")
NUMBERISH = re.compile(r"^[^\w]*[\d][\d.,:%/-]*[^\w]*$")
ROW_PIPES = re.compile(r"^\s*\|.*\|")
CSV_ROW = re.compile(r"^[^,;]*(?:,(?! )[^,]*)+$")
SENTENCE_END = re.compile(r"[.!?;:…](?:[\"')\]]*)(?:\s|$)")
JSON_RECORD = re.compile(r'^\s*(?:\[\s*)?\{\s*"[^"]+"\s*:')
TABLE_OPEN, TABLE_CLOSE = re.compile(r"<table\b|^\s*\{\||\\begin\{(?:tabular|longtable|array)", re.I), re.compile(r"</table|^\s*\|\}|\\end\{(?:tabular|longtable|array)", re.I)
LIST_OPEN, LIST_CLOSE = re.compile(r"<[uo]l\b|\\begin\{(?:itemize|enumerate|description)", re.I), re.compile(r"</[uo]l|\\end\{(?:itemize|enumerate|description)", re.I)
VERB_OPEN, VERB_CLOSE = re.compile(r"\\begin\{(?:verbatim|lstlisting|minted)"), re.compile(r"\\end\{(?:verbatim|lstlisting|minted)")
ANY_WRAP = re.compile(r"<(?:table|ul|ol|pre|xmp|listing)\b|\{\||\\begin\{|```|~~~", re.I)
PRE_MARK = re.compile(r"<(?:pre|xmp|listing|syntaxhighlight)\b", re.I)
PRE_END = re.compile(r"</(?:pre|xmp|listing|syntaxhighlight)", re.I)
OPENERS = (("code", VERB_OPEN, VERB_CLOSE), ("code", PRE_MARK, PRE_END), ("table", TABLE_OPEN, TABLE_CLOSE), ("list", LIST_OPEN, LIST_CLOSE))


def _fields(line: str) -> list[str] | None:
    """The fields of a line laid out in columns (tabs, runs of spaces, pipes or commas); None if it isn't."""
    s = line.strip()
    if "\t" in s:
        return [x.strip() for x in s.split("\t")]
    if s.count("|") >= 1:
        return [x.strip() for x in s.strip("|").split("|")]
    if "  " in s:
        return re.split(r" {2,}", s)
    if "," in s and ", " not in s and CSV_ROW.match(s):
        return s.split(",")
    if ";" in s and "; " not in s:
        return s.split(";")
    return None


def _columns(fields: list[str] | None) -> int:
    """2 for a row of values, 1 for what could be its header, 0 for other text."""
    if not fields or len(fields) < 2 or sum(len(x.split()) for x in fields) > 2.6 * len(fields):
        return 0
    return 2 if 3 * sum(1 for x in fields if NUMBERISH.match(x)) >= len(fields) else 1


def _short_values(parts: list[str]) -> bool:
    """Whether at least half of the parts are short; the other values may have any length."""
    return 2 * sum(1 for x in parts if len(x) < 120 or len(x.split()) <= 20) >= len(parts)


def is_record(text: str) -> bool:
    """One record of ``Field: value`` pairs in one line or as JSON, or several in lines."""
    if JSON_RECORD.match(text) and text.rstrip().endswith(("}", "]")):
        return True
    lines = [x for x in text.split("\n") if x.strip()]
    if len(lines) > 1 and all(map(FIELD_LINE.match, lines)) and _short_values(lines):
        return True
    flat = " ".join(text.split())
    for sep in (";", "|"):
        parts = [x for x in flat.split(sep) if x.strip()]
        if len(parts) > 1 and all(map(FIELD_PART.match, parts)) and _short_values(parts):
            return True
    return False


def _noise(s: str) -> bool:
    """A line of symbols: more signs than letters and digits, or leaders before a page number."""
    solid = len(s.replace(" ", ""))
    signs = solid - sum(map(str.isalnum, s))
    return 2 * signs > solid and solid >= 3 or signs * 3 > solid and bool(LEADER.search(s[-200:]))


_MIXED = re.compile(r"[A-Za-z0-9][^\w\s.,'’/:@-]+[A-Za-z0-9]|[^\w\s.,;:!?()'\"-]{2,}|[.,;:!|~^]{2,}|(?<!\S)[|~^;:,!.]+\w|\w[|~^]")
_LINKS = re.compile(r"<a\b", re.I)


def _scrambled(s: str) -> bool:
    """Letters and signs mixed inside at least a third as many places as there are words."""
    return 3 * len(_MIXED.findall(s)) >= len(s.split())


def _running(s: str) -> bool:
    """Whether a fifth of the words are function words, as in sentences."""
    words = WORDS.findall(s.lower())
    return 5 * sum(1 for x in words if x in ANY_STOP) >= len(words)


def kinds_of_lines(text: str) -> tuple[Counter, str]:
    """How many of the non-blank lines are of each nature, and the pooled text of those that are text."""
    count: Counter = Counter()
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return count, ""
    if is_record(text):
        return Counter(table=len(lines)), ""
    rest: list[tuple[int, str]] = []
    kinds: list[str] = [""] * len(lines)
    if ANY_WRAP.search(text):
        state, close = "", None
        for i, x in enumerate(lines):
            if state:
                kinds[i] = state
                if close.search(x):
                    state = ""
                continue
            if ("```" in x or "~~~" in x) and FENCE_LINE.match(x):
                kinds[i], state, close = "code", "code", FENCE_LINE
                continue
            for kind, opens, closes in OPENERS:
                if m := opens.search(x):
                    kinds[i] = kind
                    if not closes.search(x, m.end()):
                        state, close = kind, closes
                    break
    open_lines = [x for x, k in zip(lines, kinds) if not k]
    if len(open_lines) > 1 and is_bare_code(open_lines):
        kinds = [k or "code" for k in kinds]
    shapes: list[int] = [0] * len(lines)
    blob = False
    for i, x in enumerate(lines):
        if kinds[i]:
            continue
        s = x.strip()
        if TAGGED.search(s):
            t = TAG.sub(" ", s).strip()
            if (links := len(_LINKS.findall(s))) >= 5 and 3 * links >= len(t.split()):
                kinds[i] = "junk"
                continue
            if s.lower().startswith(("<li", "</li")):
                kinds[i] = "list"
                continue
            s = t or s
        if BLOB.match(s) or blob and BLOB_TAIL.match(s):
            kinds[i], blob = "junk", True
            continue
        blob = False
        if BROKEN.search(s) and 3 * len(BROKEN.findall(s)) >= len(s.split()):
            kinds[i] = "junk"
        elif _noise(s):
            kinds[i] = "junk"
        elif LIST_ITEM.match(x) or s.startswith("\\item"):
            kinds[i] = "list"
        elif s.startswith("|") and (s.endswith("|") and len(s) > 2 or s.startswith(("|-", "|}", "||"))) or s.startswith("!") and "!!" in s:
            kinds[i] = "table"
        else:
            f = _fields(x)
            shapes[i] = 0 if f and ("|" in s and _scrambled(s) or ";" in s and _scrambled(" ".join(f))) else _columns(f)
            rest.append((i, s))
    several = sum(1 for x in shapes if x) > 1 or "table" in kinds
    for i, _ in rest:  # rows of values, and the headers beside them; one row alone is no table
        if several and (shapes[i] == 2 or shapes[i] == 1 and any(0 <= j < len(lines) and (shapes[j] == 2 or kinds[j] == "table") for j in (i - 1, i + 1))):
            kinds[i] = "table"
    named = [(i, s) for i, s in rest if not kinds[i] and FIELD_LINE.match(s)]
    fields = [i for i, s in named if not (s.endswith(".") and len(s.split()) > 8) and (len(s) < 100 or not _running(s))]
    if len(fields) >= 2:
        for i in fields:
            kinds[i] = "table"
        if 2 * len(fields) >= len(named):  # a record with some long values
            for i, s in named:
                if len(s) >= 100:
                    kinds[i] = "table"
    pooled = [s for i, s in rest if not kinds[i]]
    text = "\n".join(pooled)
    count.update(k for k in kinds if k)
    if pooled:
        count["junk" if is_junk_text(text) else "prose"] += len(pooled)
    return count, text


TAGGED = re.compile(r"<[a-zA-Z/!]")


def is_junk_text(text: str) -> bool:
    """Text that nobody would read: menus, loose words without sentences, one phrase over and over, scrambled signs."""
    words = WORDS.findall(text.lower())
    n = len(words)
    if n < 8:
        return n < 1 or (n >= 4 and _scrambled(text))
    if n >= 16 and len(set(words)) * 4 <= n:
        return True
    stop = sum(1 for x in words if x in ANY_STOP)
    pipes = text.count("|")
    if stop * 5 >= n and len(text) > 4 * n and not pipes:
        return False
    if _scrambled(text):
        return True
    if pipes >= 4 and pipes * 4 >= n:
        return True
    ends = len(SENTENCE_END.findall(text))
    return n >= 12 and stop * 100 < 14 * n and ends * 25 < n


def language(words: list[str]) -> str:
    """The language whose function words are most frequent, ``und`` if none has a tenth of the words."""
    best, most = "und", max(1, len(words) // 10)
    for lang, stop in STOP.items():
        k = sum(1 for x in words if x in stop)
        if k > most:
            best, most = lang, k
    return best


STATS = ("words", "mean_word", "symbol_ratio", "ended_lines", "common_share", "distinct_share", "longest_word", "digit_share", "marked", "celled", "coded", "mixed")
#: Lines that start with a mark, that have cells, that have signs of program code.
MARKED = re.compile(r"^\s*(?:[-*+•‣·–—◦▪]|\(?\w{1,5}[.)]|<li\b|\\item|</?[uo]l\b|\\(?:begin|end)\{(?:itemize|enumerate))")
CELLED = re.compile(r"[\t|]|  \S|[,;]\S|<t[drh]\b|</?table|tabular|^!|\",? ?\"")
NAMED = re.compile(r"[\w -]{1,41}:\s*\S")
CODED = re.compile(r"[;{}(\[,\\:=]$|^(?:#|//|--|@)|[=<>]=|\w=\S|^(?:```|~~~)|</?(?:pre|code)\b|\\(?:begin|end)\{(?:verb|lst|mint)|^(?:do|done|fi|end|else|try|return|SELECT|FROM|WHERE|GROUP|ORDER|JOIN|import)\b")


def _celled(x: str) -> bool:
    return bool(CELLED.search(x) or NAMED.match(x)) or "&" in x and x.endswith("\\\\")


def _coded(x: str) -> bool:
    """Also a line that is indented, or has something between brackets."""
    s = x.strip()
    return x[:2].isspace() or bool(CODED.search(s)) or any(0 <= s.find(a) < s.rfind(b) for a, b in ("()", "[]", "{}"))


def text_stats(text: str) -> tuple[str, list[float]]:
    """Language and statistics of a text, in the order of ``STATS``."""
    words = WORDS.findall(text.lower())
    n = len(words)
    lang = language(words)
    lines = [x for x in text.replace("\r\n", "\n").replace("\r", "\n").split("\n") if x.strip()] or [""]
    runs = text.split()
    solid = sum(map(len, runs))
    letters = sum(map(len, words))
    signs = (solid - letters) / solid if solid else 0.0
    ended = sum(1 for x in lines if x.rstrip()[-1:] in ".!?:;\"”)")
    stop = STOP.get(lang, ANY_STOP)
    return lang, [
        float(n),
        letters / n if n else 0.0,
        signs,
        ended / len(lines),
        sum(1 for x in words if x in stop) / n if n else 0.0,
        len(set(words)) / n if n else 0.0,
        float(max(map(len, words), default=0)),
        sum(1 for x in words if x[0].isdigit()) / n if n else 0.0,
        sum(1 for x in lines if MARKED.match(x)) / len(lines),
        sum(1 for x in lines if _celled(x.strip())) / len(lines),
        sum(1 for x in lines if _coded(x)) / len(lines),
        len(_MIXED.findall(text)) / len(runs) if signs > 0.08 else 0.0,  # signs inside words, for each run of characters
    ]


def kind_of(count: Counter) -> str:
    """The nature of at least two thirds of the lines; ``prose`` where none of the four has that many."""
    total = sum(count.values())
    for k in ("list", "table", "code", "junk"):
        if total and 3 * count[k] >= 2 * total:
            return k
    return "prose" if total and 3 * count["prose"] >= 2 * total else "mixed"
