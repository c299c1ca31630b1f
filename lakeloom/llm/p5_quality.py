"""Problem 5: text quality statistics.

``document_stats`` computes each document's statistics; ``stat_sketches`` builds one mergeable KLL quantile sketch
for each language and statistic; ``with_tails`` turns values into percentiles and robust z-scores against them and flags
those in the tails. Natural prose is what lies in no tail. ``kinds_in_tails`` names the rest: a document may be a list,
table, code or junk only if a statistic of that kind lies in a tail (``KIND_TAILS``), and its lines
(``quality_lines.py``) confirm it; documents without such a tail aren't looked at any further.

Documents that show no language (tables, lists, junk) don't set the measure: they are held against the merged sketches of
those that show one. No statistic knows what the line rules say.

Defined cases: null and blank texts have no kind and no statistics, but a stored count of a blank,
non-null text is checked. A statistic's spread is that of the narrower
side of its middle (so up to half of the documents may lie on the other), and at least its ``LEAST_SPREAD``. If no document shows a language, the
measure is that of all documents; without any, 0. Equal rows stay separate rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import JAVA_SPACE, arrow_rows, cut, table
from .quality_lines import STATS, STOP, kind_of, kinds_of_lines, text_stats

LEAST_SPREAD = {
    "words": 5.0,
    "mean_word": 0.4,
    "symbol_ratio": 0.02,
    "ended_lines": 0.1,
    "common_share": 0.03,
    "distinct_share": 0.04,
    "longest_word": 2.0,
    "digit_share": 0.03,
    "marked": 0.1,
    "celled": 0.1,
    "coded": 0.1,
    "mixed": 0.03,
}
#: Robust z-scores beyond which a value lies in a tail.
TAIL_Z = 2.0
#: For each kind the statistics, and on which side of the middle (0: either), in whose tails its documents lie.
KIND_TAILS = {
    "list": {"marked": 1},
    "table": {"celled": 1, "common_share": -1, "digit_share": 1},
    "code": {"coded": 1, "symbol_ratio": 1},
    "junk": dict.fromkeys(("mean_word", "symbol_ratio", "common_share", "distinct_share", "longest_word", "digit_share", "mixed"), 0),
}
#: Ranks of the quantiles that are taken from a sketch.
RANKS = tuple(k / 100 for k in range(1, 100))
_LOW, _MIDDLE, _HIGH = 24, 49, 74


def document_stats(df: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, lang, the statistics of ``STATS``) for each text that isn't blank."""
    schema = pa.schema([(key, pa.string()), ("lang", pa.string()), *((s, pa.float64()) for s in STATS)])

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        for k, t in zip(keys, texts):
            if t is not None and t.strip():
                lang, stats = text_stats(t)
                yield (k, lang, *stats)

    spec = f"`{key}` string, lang string, " + ", ".join(f"{s} double" for s in STATS)
    return df.select(F.col(key).cast("string").alias(key), F.col(text).alias(text)).mapInArrow(arrow_rows(rows, [key, text], schema), spec)


def stat_sketches(stats: DataFrame) -> DataFrame:
    """One row for each language, and one (``und``) of all documents that show a language: a KLL sketch of each statistic.

    The common sketches are merged from those of the languages; nothing is scanned twice.
    """
    by = cut(stats.groupBy("lang").agg(*(F.kll_sketch_agg_double(s).alias(s) for s in STATS)))  # a row for each language
    known = by.withColumn("shown", F.col("lang") != "und")
    merged = known.groupBy("shown").agg(*(F.kll_merge_agg_double(s).alias(s) for s in STATS)).orderBy(F.desc("shown")).limit(1)
    return by.where("lang <> 'und'").unionByName(merged.select(F.lit("und").alias("lang"), *STATS))


def sketch_quantiles(sketches: DataFrame) -> DataFrame:
    """(lang, and for each statistic the array of its quantiles at ``RANKS``); a row for each language, so five rows at most."""
    ranks = F.array(*map(F.lit, RANKS))
    cols = [F.when(F.coalesce(F.kll_sketch_get_n_double(s), F.lit(0)) > 0, F.kll_sketch_get_quantile_double(s, ranks)).alias(s) for s in STATS]
    return sketches.select("lang", *cols)


def with_tails(stats: DataFrame, quantiles: DataFrame) -> DataFrame:
    """``stats`` with a percentile ``p_*`` and a robust z-score ``z_*`` for each statistic and ``tails``, the names of those beyond ``TAIL_Z``."""
    common = quantiles.where("lang = 'und'")
    every = common.select(F.explode(F.array(*map(F.lit, (*STOP, "und")))).alias("lang"), *STATS).join(quantiles.where("lang <> 'und'").select("lang"), "lang", "left_anti").unionByName(quantiles.where("lang <> 'und'"))
    q = F.broadcast(every.select("lang", *(F.col(s).alias(f"q_{s}") for s in STATS)))
    joined = stats.join(q, "lang", "left")

    def z(s: str):
        q = F.col(f"q_{s}")
        spread = F.greatest(F.coalesce(F.least(q[_HIGH] - q[_MIDDLE], q[_MIDDLE] - q[_LOW]) / 0.6745, F.lit(0.0)), F.lit(LEAST_SPREAD[s]))
        return ((F.col(s) - F.coalesce(F.col(f"q_{s}")[_MIDDLE], F.lit(0.0))) / spread).alias(f"z_{s}")

    def p(s: str):
        return F.size(F.filter(f"q_{s}", lambda x: x <= F.col(s))).alias(f"p_{s}")

    scored = joined.select("*", *(z(s) for s in STATS), *map(p, STATS)).drop(*(f"q_{s}" for s in STATS))
    tails = F.filter(F.array(*(F.when(F.abs(F.col(f"z_{s}")) > TAIL_Z, F.lit(s)) for s in STATS)), lambda x: x.isNotNull())
    return scored.withColumn("tails", tails)


class Tails:
    """The middle and spread of each statistic by language, and the kinds in whose tails a document lies."""

    def __init__(self, rows: list):
        self.of = {}
        for r in rows:
            q = [r[s] for s in STATS]
            if all(x is not None for x in q):
                spread = [max(min(x[_HIGH] - x[_MIDDLE], x[_MIDDLE] - x[_LOW]) / 0.6745, LEAST_SPREAD[s]) for s, x in zip(STATS, q)]
                self.of[r["lang"]] = (np.array([x[_MIDDLE] for x in q]), np.array(spread))
        self.of.setdefault("und", (np.zeros(len(STATS)), np.array([LEAST_SPREAD[s] for s in STATS])))
        self.sides = {kind: [(STATS.index(s), side) for s, side in of.items()] for kind, of in KIND_TAILS.items()}

    def kinds(self, lang: str, stats: list[float]) -> list[str]:
        """By the sketch of its language and by that of all; a language with few documents may be mostly junk."""
        out = set()
        for name in {lang, "und"} & self.of.keys():
            middle, spread = self.of[name]
            z = ((stats - middle) / spread).tolist()
            out.update(kind for kind, of in self.sides.items() if any(z[i] * side > TAIL_Z if side else abs(z[i]) > TAIL_Z for i, side in of))
        return sorted(out)


def kinds_in_tails(df: DataFrame, quantiles: DataFrame, key: str = "id", text: str = "content") -> DataFrame:
    """(key, kind): list, table, code or junk for documents in that kind's tails whose lines confirm it."""
    shared = df.sparkSession.sparkContext.broadcast(Tails(quantiles.collect()))  # a row for each language
    schema = pa.schema([(key, pa.string()), ("kind", pa.string())])

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        tails = shared.value
        for k, t in zip(keys, texts):
            if t is None or not t.strip():
                continue
            may = tails.kinds(*text_stats(t))
            if may and (kind := kind_of(kinds_of_lines(t)[0])) in may:
                yield k, kind

    return df.select(F.col(key).cast("string").alias(key), F.col(text).alias(text)).mapInArrow(arrow_rows(rows, [key, text], schema), f"`{key}` string, kind string")


def miscounts(df: DataFrame, key: str = "id", text: str = "content", words: str = "word_count", lines: str = "line_count") -> DataFrame:
    """Keys whose stored counts are wrong; runs in the JVM. Null texts and null counts are no cases."""
    t = F.col(text)
    n_words = F.size(F.regexp_extract_all(t, F.lit(rf"[^{JAVA_SPACE[1:-1]}]+"), F.lit(0)))
    n_lines = F.length(t) - F.length(F.replace(t, F.lit("\n"))) + 1
    wrong = (F.col(words).isNotNull() & (F.col(words) != n_words)) | (F.col(lines).isNotNull() & (F.col(lines) != n_lines))
    return df.where(t.isNotNull() & (F.col(words).isNotNull() | F.col(lines).isNotNull())).where(wrong).select(F.col(key).cast("string").alias(key))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "simulated_vector_db").select("id", "content", F.col("metadata.statistics.word_count").alias("word_count"), F.col("metadata.statistics.line_count").alias("line_count"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _chunks(spark, sf_dir)
    natures = kinds_in_tails(df, sketch_quantiles(stat_sketches(document_stats(df))))
    return natures.unionByName(miscounts(df).select("id", F.lit("miscount").alias("kind")))


def p5_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = cut(document_stats(_chunks(spark, sf_dir)))
    scored = with_tails(stats, sketch_quantiles(stat_sketches(stats)))
    return scored.withColumn("tails", F.array_join("tails", ","))


def p5_miscounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks with wrong counts alone."""
    return miscounts(_chunks(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_stats": p5_stats, "p5_miscounts": p5_miscounts}
SQL = {
    "p5_miscounts": rf"""SELECT id FROM (SELECT id, content, metadata.statistics.word_count AS w, metadata.statistics.line_count AS l, len(regexp_extract_all(content, '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')) AS words,
  length(content) - length(replace(content, chr(10), '')) + 1 AS lines FROM simulated_vector_db WHERE content IS NOT NULL) WHERE coalesce(w <> words, false) OR coalesce(l <> lines, false)"""
}
