"""Enrichment of documents: metadata, neighbours, summaries, language and size filters. One projection each, no shuffle but where said."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X

# Words by which the offline detector tells languages.
PROFILES = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "for", "with", "are"),
    "fr": ("le", "la", "les", "des", "du", "est", "une", "dans", "pour", "sur"),
    "de": ("der", "die", "das", "und", "ein", "ist", "von", "für", "wird", "nach"),
    "es": ("el", "los", "del", "las", "una", "que", "por", "para", "antes", "está"),
}


def rich_metadata(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``meta``: type, dates, entities, topics, sentiment, structure, statistics, hash and confidence.

    In stages, each of which names what the next uses more than once, so that nothing is computed twice.
    """
    own = df.drop("meta")
    c = F.coalesce(F.col(text), F.lit(""))
    t = own.select("*", c.alias("_c"), F.lower(c).alias("_low"), F.size(X.plain_split(c)).alias("_n"))
    t = t.select("*", X.words(F.col("_c")).alias("_w"), X.entities(F.col("_c")).alias("_found"), X.dates(F.col("_c")).alias("_dates"), X.topic_scores(F.col("_low")).alias("_scores"))
    t = t.select("*", X.topics_of(F.col("_scores")).alias("_topics"), X.sentiment_of(F.col("_w")).alias("_mood"), F.aggregate(F.map_values("_found"), F.lit(0), lambda s, v: s + F.size(v)).alias("_n_found"))
    n, found, dates, topics, mood, c = (F.col(x) for x in ("_n", "_found", "_dates", "_topics", "_mood", "_c"))
    confidence = (
        F.lit(0.65)
        + F.when(F.size(dates) > 0, 0.05).otherwise(0.0)
        + F.least(F.lit(0.1), F.col("_n_found") * 0.01)
        + F.least(F.lit(0.1), F.size(topics) * 0.02)
        + F.when(mood["sentiment"] != "neutral", 0.05).otherwise(0.0)
        - F.when(n < 50, 0.2).when(n < 100, 0.1).otherwise(0.0)
    )
    meta = F.struct(
        X.document_type(c).alias("document_type"),
        dates.alias("dates"),
        F.array_min(dates).alias("earliest"),
        F.array_max(dates).alias("latest"),
        found.alias("entities"),
        topics.alias("topics"),
        mood.alias("sentiment"),
        X.structure(c).alias("structure"),
        F.struct(n.alias("word_count"), F.length(c).alias("char_count"), (X.count_literal(c, "\n") + 1).alias("line_count")).alias("statistics"),
        F.md5(c).alias("content_hash"),
        F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.1), confidence)), 4).alias("confidence"),
    )
    return t.select(*own.columns, meta.alias("meta"))


def numeric_data(c: Column) -> Column:
    """ARRAY<STRUCT<value, unit, type>> in the order of the types."""
    units = (
        ("data_size", r"GB|MB|KB|TB|Bytes|B"),
        ("weight", r"kg|g|mg|pounds|lbs|oz"),
        ("distance", r"km|m|cm|mm|miles|inches|ft|foot|feet"),
        ("time", r"hours|hour|hrs|hr|minutes|mins|seconds|secs"),
        ("temperature", r"°C|°F|K|degrees Celsius|degrees Fahrenheit|deg C|deg F"),
    )

    def values(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("value"), F.regexp_extract(m, pattern, 2).alias("unit"), F.lit(name).alias("type")))

    out = [values(name, rf"(?i)\b(\d+(?:\.\d+)?)\s*({unit})\b") for name, unit in units]
    money = r"(?i)\$\s*(\d+(?:,\d{3})*(?:\.\d+)?)|(\d+(?:,\d{3})*(?:\.\d+)?)\s*(?:USD|EUR|JPY|GBP)"
    out.append(F.transform(F.regexp_extract_all(c, F.lit(money), F.lit(0)), lambda m: F.struct(F.regexp_extract(m, r"(\d+(?:,\d{3})*(?:\.\d+)?)", 1).alias("value"), F.lit("").alias("unit"), F.lit("currency").alias("type"))))
    out.append(values("percentage", r"(?i)\b(\d+(?:\.\d+)?)\s*(percent|pct|%)\b"))
    return F.concat(*out)


def with_neighbours(chunks: DataFrame, group: str = "source", order: str = "chunk_index", key: str = "id") -> DataFrame:
    """``neighbor_prev`` and ``neighbor_next``: the ids before and after within a source. One shuffle by source."""
    w = Window.partitionBy(group).orderBy(order, key)
    return chunks.withColumn("neighbor_prev", F.lag(key).over(w)).withColumn("neighbor_next", F.lead(key).over(w))


def section_of(c: Column) -> Column:
    """The first line, at most 100 characters."""
    return F.substring(F.trim(F.split(c, r"\n")[0]), 1, 100)


def language(c: Column) -> Column:
    """STRUCT<lang, share>: by function words of the whole text; null for less than 20 characters or none of them."""
    w = X.words(c)
    among = lambda words: F.size(F.filter(w, lambda x: x.isin(*words)))
    counts = [F.struct(among(words).alias("n"), F.lit(lang).alias("lang")) for lang, words in PROFILES.items()]
    best = F.array_max(F.array(*counts))
    total = F.aggregate(F.array(*counts), F.lit(0), lambda a, x: a + x["n"])
    return F.when((F.length(c) >= 20) & (best["n"] > 0), F.struct(best["lang"].alias("lang"), (best["n"] / total).alias("share")))


def language_filter(df: DataFrame, allowed: tuple[str, ...] = ("en",), least: float = 0.9, text: str = "text") -> DataFrame:
    """Drops what is surely in another language; undetected texts stay."""
    found = language(F.col(text))
    return df.where(F.coalesce(~((~found["lang"].isin(*allowed)) & (found["share"] >= least)), F.lit(True)))


def size_filter(df: DataFrame, least_words: int = 50, text: str = "text") -> DataFrame:
    return df.where(F.size(X.plain_split(F.coalesce(F.col(text), F.lit("")))) >= least_words)


def lead_summary(c: Column, least_chars: int = 200) -> Column:
    """Offline stand-in for a generated summary: the first sentence of texts of some length."""
    return F.when(F.length(c) >= least_chars, F.split(F.trim(c), r"(?<=[.!?])\s+")[0])


def point_id(content: Column, metadata_json: Column) -> Column:
    """Deterministic UUIDv5 (namespace URL) of the metadata and the content."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(F.concat(metadata_json, F.lit("\n"), content), "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, 1)
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


_SINGLE = re.compile(r"\b[^\w\s]\b")


def normalise(text: str | None) -> str | None:
    """Lower case, single spaces, NFKD, no lone signs between word characters."""
    if text is None:
        return None
    return _SINGLE.sub("", unicodedata.normalize("NFKD", re.sub(r"\s+", " ", text.lower()).strip()))


def with_normalised(df: DataFrame, text: str = "text") -> DataFrame:
    """``normalized``: needs Unicode decomposition, so it goes through Arrow in batches."""
    base = df.drop("normalized")
    at = base.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([normalise(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, new], names=[*b.schema.names, "normalized"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("normalized", T.StringType())]))


def token_batches(docs: DataFrame, most_tokens: int = 8000, most_docs: int = 128, key: str = "id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """(id, batch): greedy batches of estimated tokens and a number of documents, packed within hash partitions, by default one for about 10,000 documents."""
    partitions = partitions or 1 + docs.count() // 10_000
    schema = f"id {docs.schema[key].dataType.simpleString()}, batch string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, used, n, now = None, 0, 0, 0
        for b in batches:
            tokens, parts = b.column(1).to_pylist(), b.column(2).to_pylist()
            out = []
            for t, p in zip(tokens, parts):
                if p != part:
                    part, used, n, now = p, 0, 0, 0
                if n and (used + t > most_tokens or n >= most_docs):
                    used, n, now = 0, 0, now + 1
                used, n = used + t, n + 1
                out.append(f"{part}-{now}")
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=["id", "batch"])

    t = docs.select(F.col(key).alias("id"), F.floor(F.length(F.coalesce(F.col(text), F.lit(""))) / 4).cast("long").alias("tokens"), F.pmod(F.xxhash64(key), F.lit(partitions)).alias("part"))
    return t.repartition("part").sortWithinPartitions("part", "id").mapInArrow(run, schema)
