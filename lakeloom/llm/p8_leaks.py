r"""Problem 8: evaluation texts in training text.

Wu-Manber over words. The patterns are all windows of ``WINDOW`` successive words of the test items. A
block is the pair of the last two words of the window at the current position; the shift table says how
far the window can move on without missing a pattern (``WINDOW - 1`` for a pair that is in none, and
``WINDOW`` for a word that is in none); where the shift is 0 the pair selects a bucket of patterns and
the words are compared directly. Occurrences of one item are then joined into exact runs, and an item
has leaked into a document if

* a run, or runs that together cover successive words of the item, have at least ``SUCCESSIVE`` words, or
* the longest common subsequence of the item and one stretch of the document (``STRETCH`` times its
  length and ``SLACK`` words) has at least ``SHARE`` of its words.

For the second, windows are no guide, as changed words may leave none. An item's rarest words are filed instead: of
its places all but ``1 - SHARE`` must be met, so of that many rarest and ``SURE`` more, ``SURE`` must be. Of what they
select, stretches that hold enough of the item's words in any order are looked for, and only there is the
subsequence computed. None of these steps loses a case.

Parts of a run have ``WINDOW`` words at least; shorter ones are everywhere and say nothing.

The documents are scanned without shuffle; the test items (a held-out set) go to every task, ``MAX_ITEMS`` of
them at a time, so a larger set takes more scans. Defined cases: null and blank texts contain nothing;
items that are null, blank or shorter than ``WINDOW`` words can't leak; an item occurring several times
in a document is one row. Markup and line layout are dropped from the documents before.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, not_blank, table
from .markup import TAG

WINDOW = 4
SUCCESSIVE = 12
SHARE = 0.8
STRETCH = 1.5
SLACK = 4
#: Share of an item's words that its rarest places must show besides those that may be missing.
SURE = 0.3
MAX_ITEMS = 100_000
WORDS = re.compile(r"\w+")
_URL = re.compile(r"\]\([^()\s]*\)")
_WIKI = re.compile(r"\[\[[^\[\]|\n]*\|")
_COMMAND = re.compile(r"\\[A-Za-z]+\*?(?=[{\[\s])")
_MARK = re.compile(r"(?<![^\W_])_+|_+(?![^\W_])")


def plain_words(text: str) -> list[str]:
    """The words of a text in lower case, without markup."""
    if "<" in text:
        text = TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "](" in text:
        text = _URL.sub("] ", text)
    if "[[" in text:
        text = _WIKI.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(" ", text)
    if "_" in text:
        text = _MARK.sub(" ", text)
    return WORDS.findall(text.lower())


class Patterns:
    """Shift table, buckets, rare words and items of the test set."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(case, w) for case, text in items if text and len(w := WORDS.findall(text.lower())) >= WINDOW]
        vocabulary = sorted({w for _, words in self.items for w in words})
        self.ids = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.size = len(vocabulary) + 1
        self.coded = [[self.ids[w] for w in words] for _, words in self.items]
        self.shift: dict[int, int] = {}
        self.bucket: dict[int, dict[tuple[int, ...], list[tuple[int, int]]]] = defaultdict(dict)
        for k, words in enumerate(self.coded):
            for j in range(len(words) - WINDOW + 1):
                window = tuple(words[j : j + WINDOW])
                for p in range(1, WINDOW):
                    pair = window[p - 1] * self.size + window[p]
                    self.shift[pair] = min(self.shift.get(pair, WINDOW), WINDOW - 1 - p)
                self.bucket[window[-2] * self.size + window[-1]].setdefault(window, []).append((k, j))
        self.counts = [Counter(words) for words in self.coded]
        self.need = [math.ceil(SHARE * len(words) - 1e-9) for words in self.coded]
        self.sure: list[int] = []
        self.rare: dict[int, list[tuple[int, int]]] = defaultdict(list)
        items_with = Counter(w for words in self.counts for w in words)
        for k, words in enumerate(self.coded):
            self.sure.append(max(1, int(SURE * len(words))))
            places = sorted(words, key=lambda w: (items_with[w], w))[: len(words) - self.need[k] + self.sure[k]]
            for w, n in Counter(places).items():
                self.rare[w].append((k, n))

    def occurrences(self, words: list[int]) -> dict[int, list[tuple[int, int]]]:
        """Item -> (place in the document, place in the item) of each window found."""
        found: dict[int, list[tuple[int, int]]] = {}
        shift, bucket, size, n = self.shift, self.bucket, self.size, len(words)
        i = WINDOW - 1
        while i < n:
            last = words[i]
            if not last:
                i += WINDOW
                continue
            pair = words[i - 1] * size + last
            s = shift.get(pair, WINDOW - 1)
            if s:
                i += s
                continue
            for k, j in bucket[pair].get(tuple(words[i - WINDOW + 1 : i + 1]), ()):
                found.setdefault(k, []).append((i - WINDOW + 1, j))
            i += 1
        return found

    def leaked(self, text: str) -> Iterator[int]:
        """The items that leaked into a text."""
        get = self.ids.get
        words = [get(w, 0) for w in plain_words(text)]
        found = {k for k, places in self.occurrences(words).items() if self._covers(places)}
        found.update([k for k in self._candidates(words) if k not in found and self._close(words, k)])
        for k in sorted(found):
            yield self.items[k][0]

    def _candidates(self, words: list[int]) -> list[int]:
        """The items of whose rarest words the text has enough."""
        hits: dict[int, int] = defaultdict(int)
        rare = self.rare
        for w in set(words):
            for k, n in rare.get(w, ()):
                hits[k] += n
        return [k for k, n in hits.items() if n >= self.sure[k]]

    @staticmethod
    def _covers(places: list[tuple[int, int]]) -> bool:
        """Whether the windows cover enough successive words of the item."""
        run = end = 0
        for j in sorted({j for _, j in places}):
            run = run + j + WINDOW - end if j <= end and run else WINDOW
            end = j + WINDOW
            if run >= SUCCESSIVE:
                return True
        return False

    def _close(self, words: list[int], k: int) -> bool:
        """Whether one stretch holds enough of the item's words in their order."""
        item, room, need = self.coded[k], self.counts[k], self.need[k]
        span = int(STRETCH * len(item)) + SLACK
        at = [i for i, w in enumerate(words) if w in room]
        if len(at) < need:
            return False
        held: dict[int, int] = dict.fromkeys(room, 0)
        bag = first = 0
        ends: list[int] = []  # of stretches with enough of the words in any order
        for i in at:
            w = words[i]
            bag += held[w] < room[w]
            held[w] += 1
            while i - at[first] >= span:
                w = words[at[first]]
                held[w] -= 1
                bag -= held[w] < room[w]
                first += 1
            if bag >= need:
                ends.append(i + 1)
        while ends:  # stretches that overlap are tried as a whole first
            n = next((j for j in range(1, len(ends)) if ends[j] - ends[j - 1] >= span), len(ends))
            some, ends = ends[:n], ends[n:]
            if _common(item, words[max(0, some[0] - span) : some[-1]]) >= need and any(_common(item, words[max(0, e - span) : e]) >= need for e in some):
                return True
        return False


def _common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        if x and (m := at.get(x)):
            u = row & m
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", case: str = "case_id", passage: str = "ground_truth") -> DataFrame:
    """(key, case) for each document and test item that leaked into it; one scan of the documents for each ``MAX_ITEMS`` items."""
    some_items = items.where(not_blank(items[passage])).select(F.col(case).cast("long").alias("c"), F.col(passage).alias("t"))
    sets = max(1, -(-some_items.count() // MAX_ITEMS))
    schema = pa.schema([(key, pa.int64()), (case, pa.int64())])
    some = docs.where(not_blank(docs[text])).select(docs[key].cast("long").alias(key), docs[text].alias(text))

    def scan(number: int) -> DataFrame:
        own = some_items if sets == 1 else some_items.where(F.pmod(F.xxhash64("c", "t"), F.lit(sets)) == number)
        patterns = docs.sparkSession.sparkContext.broadcast(Patterns([(r[0], r[1]) for r in own.collect()]))  # about MAX_ITEMS items

        def rows(keys: list, texts: list) -> Iterator[tuple]:
            find = patterns.value
            for k, t in zip(keys, texts):
                for c in find.leaked(t):
                    yield k, c

        return some.mapInArrow(arrow_rows(rows, [key, text], schema), f"`{key}` long, `{case}` long")

    return reduce(DataFrame.unionByName, map(scan, range(sets))).distinct()


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "eval_case"))


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents each leaked item is in."""
    return p8_found(spark, sf_dir).groupBy("case_id").count().withColumnRenamed("count", "documents")


QUERIES = {"p8_found": p8_found, "p8_items": p8_items}
SQL: dict[str, str] = {}
