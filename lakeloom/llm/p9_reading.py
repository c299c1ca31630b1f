r"""Problem 9: the reading level of each document.

An interpolated n-gram model (words; orders 1 to ``ORDER``, over a uniform floor) is trained on the
labelled examples of each level. A document's surprisal, word by word, under each model is described by the quantiles
of its distribution (lowest level's less highest's) and by the models' means; a ridge regression makes one
number of the description, and an isotonic regression (pool-adjacent-violators) maps that to the graded levels.
Both are fitted on the examples, each described by models that haven't seen it.

Only running English sentences count: code, tables, records, headings and list items that are fragments
are left out, and so are blocks whose function words aren't English. Documents with fewer than
``MIN_WORDS`` such words have no level.

The examples are a bounded set (``MAX_EXAMPLES``, checked; more are an error) and the fitted models go to every task; the
corpus is scanned once without shuffle. Defined cases: null and blank texts have no level; examples with
null text or an unknown level are ignored; without examples of both ends fitting is an error. Other columns
are ignored.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, not_blank, table
from .markup import FENCE, TAG, VERB
from .quality_lines import STOP

LEVELS = ("basic", "middle", "advanced")
ORDER = 2
#: Weight of each order's own estimate, as in Jelinek-Mercer smoothing.
WEIGHT = 0.6
FOLDS = 5
#: Penalty of the regression on standardised values, for each example.
RIDGE = 0.1
MIN_WORDS = 80
MAX_EXAMPLES = 20_000
#: Signs that part words, and those within or at the end of words and numbers.
_SIGNS = str.maketrans(dict.fromkeys(';:!?()"[]{}*_`“”„«»–—…/|<>=+#~^\\%&$€£¿¡', " ") | dict.fromkeys(".,'’"))
_DROP = re.compile(r"<(pre|table|script|style|code)\b.*?(?:</\1\s*>|\Z)|<!--(?:(?!<!--).)*?-->", re.I | re.S)
_BLOCK_TAG = re.compile(r"</?(?:p|div|li|ul|ol|h[1-6]|br|hr|tr|td|th|blockquote|section|article|head|title|body|html)\b[^<>]*>", re.I)
_ENV = re.compile(r"\\begin\{(tabular|equation|align|displaymath|lstlisting|longtable)\*?\}.*?(?:\\end\{\1\*?\}|\Z)", re.S)
_WIKI_TABLE = re.compile(r"^\{\|.*?(?:^\|\}|\Z)", re.M | re.S)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_COMMAND = re.compile(r"\\(?:begin|end|section|subsection|chapter|title|label|ref|cite[pt]?)\*?\{[^{}]*\}|\\item\b|\\[A-Za-z]+\*?(?:\[[^\]]*\])?")
_LINK = re.compile(r"\]\([^()\s]*\)|\[\[[^\[\]|\n]*\|")
_BULLET = re.compile(r"^\s*(?:[-*+•‣·–—>]|\(?\d{1,3}[.)]|\(?[A-Za-z][.)]|\\item)\s+")
_HEADING = re.compile(r"^\s*(?:#{1,6}\s|={2,}|-{3,}\s*$|\\(?:sub)*section)")
_ROW = re.compile(r"^\s*[|!]|\t|\|.*\||^\s*[{\[].*[}\]]\s*$|[;{}]\s*$|^\s*[^\W\d_][\w -]{0,25}:\s+\S+(?:\s\S+){0,4}\s*$|\S {3,}\S+ {3,}")
_CSV = re.compile(r"^[^,\s][^,]{0,40}(?:,(?! )[^,]{1,40}){2,}$")
_EN = STOP["en"]
_OTHER = (STOP["fr"] | STOP["de"] | STOP["es"]) - _EN


def _is_row(line: str) -> bool:
    """A row of a table, a record or code; a long line is one if its cells are short on average."""
    if len(line) < 300:
        return bool(_ROW.search(line) or ("," in line and _CSV.match(line.strip())))
    signs = max(line.count("\t"), line.count("|"), line.count(";"), line.count(",") - line.count(", "))
    return signs >= 3 and len(line.split()) <= 4 * (signs + 1)


def blocks(text: str) -> Iterator[tuple[str, bool]]:
    """The text's paragraphs and list items without markup, and whether each is a list item."""
    text = text.lstrip("\ufeff")
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = FENCE.sub("\n\n", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", _ENV.sub("\n\n", VERB.sub("\n\n", text.replace("\\item", "\n- "))))
    if "{{" in text:
        text = _TEMPLATE.sub(" ", text)
    if "{|" in text:
        text = _WIKI_TABLE.sub("\n\n", text)
    if "<" in text:
        text = re.sub(r"<li\b[^<>]*>", "\n\n- ", _DROP.sub("\n\n", text), flags=re.I)
        text = TAG.sub("", _BLOCK_TAG.sub("\n\n", text))
    if "&" in text:
        text = html.unescape(text)
    if "](" in text or "[[" in text:
        text = _LINK.sub("", text)
    lines = text.split("\n")
    now: list[str] = []
    item = False
    for line in lines:
        bullet = None if line[:1].isalpha() and line[1:2] not in ").]" else _BULLET.match(line)
        quote = bullet is not None and line.lstrip().startswith(">")
        blank = not line.strip()
        if blank or bullet and not quote or _HEADING.match(line):
            if now:
                yield " ".join(now), item
            now, item = [], bool(bullet)
            if blank or not bullet:
                continue
        if _is_row(line):
            if now:
                yield " ".join(now), item
            now, item = [], False
            continue
        now.append(line[bullet.end() :] if bullet else line)
    if now:
        yield " ".join(now), item


def running_words(text: str) -> list[str]:
    """The words of the running English sentences of a text, numbers as ``0``."""
    out: list[str] = []
    for block, item in blocks(text):
        words = block.lower().translate(_SIGNS).split()
        n = len(words)
        if n < 4:
            continue
        end = block.rstrip()[-1:] in ".!?\"”)…" and block.rstrip()[-2:] != "..."
        english = sum(map(_EN.__contains__, words))
        if 5 * english < n and sum(map(_OTHER.__contains__, words)) > english:
            continue
        if item:
            if english * 100 < (12 if block.rstrip()[-1:] in ".!?" else 22) * n:
                continue
        elif not (end or n >= 12) or n >= 12 and english * 100 < 8 * n:
            continue
        out += [w if w[0] > "9" else "0" for w in words if w[0] >= "0"]
    return out


class NGrams:
    """Interpolated n-gram models of words, one for each level, over one vocabulary.

    P(w|h) = a·c(h,w)/c(h) + (1-a)·P(w|shorter h) where the model has seen h, and P(w|shorter h) where it hasn't; the shortest is
    over a uniform floor, so the probabilities of the vocabulary and one unknown word sum to 1. ``rows[k]`` numbers the n-grams
    that any model has seen, ``bits[k]`` are their surprisals under each model, ``turn[k]`` what is added where they are the context of an unseen word.
    """

    def __init__(self, levels: list[list[list[str]]], order: int = ORDER, weight: float = WEIGHT):
        back = -math.log2(1 - weight)
        vocabulary = {w for texts in levels for words in texts for w in words}
        floor = 1.0 / (len(vocabulary) + 1)
        self.order, n = order, len(levels)
        self.rows: list[dict] = []
        self.bits: list[np.ndarray] = []
        self.turn: list[np.ndarray] = []
        for k in range(order):
            counts = [Counter(g for words in texts for g in (zip(*(words[i:] for i in range(k + 1))) if k else words)) for texts in levels]
            contexts = [Counter(g for words in texts for g in (zip(*(words[i:-1] if i == k - 1 else words[i : i - k] for i in range(k))) if k > 1 else words[:-1])) for texts in levels] if k else [Counter({(): sum(c.values())}) for c in counts]
            rows = {g: i for i, g in enumerate(sorted(set().union(*counts)))}
            bits = np.empty((len(rows) + 1, n))
            for g, i in rows.items():
                h = () if not k else g[0] if k == 1 else g[:-1]
                for m in range(n):
                    lower = floor if not k else 2.0 ** -self._bits_of(g[1:] if k > 1 else g[1], k - 1)[m]
                    seen = contexts[m][h]
                    bits[i, m] = -math.log2(weight * counts[m][g] / seen + (1 - weight) * lower) if seen else -math.log2(lower)
            bits[-1] = [-math.log2((1 - weight) * floor) if c else -math.log2(floor) for c in map(len, counts)] if not k else np.nan
            if k:
                turn = np.zeros((len(self.rows[-1]) + 1, n))
                for m in range(n):
                    for h in contexts[m]:
                        turn[self.rows[-1][h], m] = back
                self.turn.append(turn)
            self.rows.append(rows)
            self.bits.append(bits)

    def _bits_of(self, gram, k: int) -> np.ndarray:
        """Surprisals of the last word of an n-gram of ``k + 1`` words under each model."""
        i = self.rows[k].get(gram, -1)
        if i >= 0 or not k:
            return self.bits[k][i]
        h = gram[0] if k == 1 else gram[:-1]
        return self._bits_of(gram[1] if k == 1 else gram[1:], k - 1) + self.turn[k - 1][self.rows[k - 1].get(h, -1)]

    def __call__(self, words: list[str]) -> np.ndarray:
        """Surprisals of each word of a text under each model, given the words before it."""
        get = self.rows[0].get
        at = np.array([get(w, -1) for w in words])
        out = self.bits[0][at]
        for k in range(1, self.order):
            if len(words) <= k:
                break
            get = self.rows[k].get
            longer = np.array([get(g, -1) for g in zip(*(words[i:] for i in range(k + 1)))])
            out[k:] = np.where((longer < 0)[:, None], out[k:] + self.turn[k - 1][at[:-1]], self.bits[k][longer])
            at = longer
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the rising step fit of y on x, by pooling adjacent violators; interpolate between them."""
    order = np.argsort(x, kind="stable")
    sums: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        sums.append([b, 1.0, a, a])
        while len(sums) > 1 and sums[-2][0] / sums[-2][1] >= sums[-1][0] / sums[-1][1]:
            s, n, _, hi = sums.pop()
            sums[-1][0] += s
            sums[-1][1] += n
            sums[-1][3] = hi
    kx, ky = [], []
    for s, n, lo, hi in sums:
        kx += [lo, hi]
        ky += [s / n] * 2
    return np.array(kx), np.array(ky)


#: Quantiles by which a text's distribution of relative surprisal is described.
QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
NAMES = tuple(f"surprisal_{round(100 * q)}" for q in QUANTILES)


_AT = np.array(QUANTILES)


def _quantiles(x: np.ndarray) -> np.ndarray:
    return np.sort(x)[(_AT * (len(x) - 1) + 0.5).astype(np.int64)]


class Reader:
    """The fitted models, and the map from a distribution of surprisal to a level."""

    def __init__(self, examples: list[tuple[str, str]], levels: tuple[str, ...] = LEVELS):
        texts = [(running_words(t), levels.index(level)) for t, level in examples if t and level in levels]
        texts = [(w, y) for w, y in texts if w]
        if not texts or not {y for _, y in texts} >= {0, len(levels) - 1}:
            raise ValueError("examples of the lowest and of the highest level are needed")
        self.levels = levels
        y = np.array([float(y) for _, y in texts])
        held = np.empty((len(texts), len(QUANTILES) + len(levels)))
        for fold in range(min(FOLDS, len(texts))):
            models = self._models([t for i, t in enumerate(texts) if i % FOLDS != fold])
            for i in range(fold, len(texts), FOLDS):
                held[i] = self._described(models(texts[i][0]))
        self.fit_direction(held, y)
        self.held = self.difficulty(held)
        self.x, self.y = isotonic(self.held, y)
        self.models = self._models(texts)

    def _models(self, texts: list[tuple[list[str], int]]) -> NGrams:
        return NGrams([[w for w, y in texts if y == k] for k in range(len(self.levels))])

    @staticmethod
    def _described(bits: np.ndarray) -> np.ndarray:
        """Quantiles of the surprisal under the lowest level's model less that under the highest's, and each model's mean less that of all."""
        mean = bits.sum(0) / len(bits)
        return np.concatenate([_quantiles(bits[:, 0] - bits[:, -1]), mean.mean() - mean])

    def fit_direction(self, held: np.ndarray, y: np.ndarray) -> None:
        """Ridge regression of the level on the standardised description: one number that rises with difficulty."""
        self.centre, self.spread = held.mean(0), np.maximum(held.std(0), 1e-6)
        z = (held - self.centre) / self.spread
        self.weights = np.linalg.solve(z.T @ z + RIDGE * len(z) * np.eye(z.shape[1]), z.T @ (y - y.mean()))

    def difficulty(self, described: np.ndarray) -> np.ndarray:
        return (described - self.centre) / self.spread @ self.weights

    def grade(self, words: list[str]) -> tuple[float, np.ndarray]:
        """Difficulty from 0 to the highest level, and the quantiles of the surprisal relative to the highest level's model."""
        described = self._described(self.models(words))
        return float(np.interp(self.difficulty(described), self.x, self.y)), described[: len(QUANTILES)]

    def level(self, grade: float) -> str:
        return self.levels[int(min(len(self.levels) - 1, max(0, math.floor(grade + 0.5))))]


def fit(examples: DataFrame, text: str = "text", level: str = "reading_level") -> Reader:
    rows = examples.select(text, level).limit(MAX_EXAMPLES + 1).collect()
    if len(rows) > MAX_EXAMPLES:
        raise ValueError(f"more than {MAX_EXAMPLES} examples")
    return Reader(sorted((r[0], r[1]) for r in rows if r[0] is not None and r[1] is not None))


def reading_profile(docs: DataFrame, reader: Reader, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, words, grade, reading_level, and ``NAMES``, the quantiles of the relative surprisal) for each document with enough sentences."""
    shared = docs.sparkSession.sparkContext.broadcast(reader)
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.int32()), ("grade", pa.float64()), ("reading_level", pa.string()), *((q, pa.float64()) for q in NAMES)])

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        r = shared.value
        for k, t in zip(keys, texts):
            words = running_words(t)
            if len(words) >= MIN_WORDS:
                grade, d = r.grade(words)
                yield (k, len(words), grade, r.level(grade), *d.tolist())

    some = docs.where(not_blank(F.col(text))).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return some.mapInArrow(arrow_rows(rows, ["doc_id", "text"], schema), "doc_id long, words int, grade double, reading_level string, " + ", ".join(f"{q} double" for q in NAMES))


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_profile(table(spark, sf_dir, "documents").select("doc_id", "text"), fit(table(spark, sf_dir, "reading_sample")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_profile(spark, sf_dir).select("doc_id", "reading_level")


QUERIES = {"p9_found": p9_found, "p9_profile": p9_profile}
SQL: dict[str, str] = {}
