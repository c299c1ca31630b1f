"""Document -> section -> chunk: built by gaps and islands within a source, looked up by joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADING = r"^\s*(?:#{1,6}\s|[A-Z][A-Za-z0-9 ]{0,80}:\s*(?:\n|$)|\d+(?:\.\d+)*\.?\s+[A-Z])"


def sections(chunks: DataFrame, source: str = "source", order: str = "chunk_index", key: str = "id", text: str = "text") -> DataFrame:
    """``chunks`` with ``document_id`` and ``section_id``; a section starts with its source and at each chunk that begins with a heading."""
    w = Window.partitionBy(source).orderBy(F.col(order).asc_nulls_last(), F.col(key))
    start = F.coalesce(F.col(text).rlike(HEADING), F.lit(False)) | (F.row_number().over(w) == 1)
    n = F.sum(F.when(start, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    doc = F.md5(F.coalesce(F.col(source), F.lit("")))
    return chunks.withColumn("section_no", n).withColumn("document_id", doc).withColumn("section_id", F.concat_ws("-", "document_id", "section_no")).drop("section_no")


def section_table(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(section_id, document_id, n_chunks, n_chars, first_id); sizes only, so no section's text gathers in one row."""
    return chunks.groupBy("section_id", "document_id").agg(F.count("*").alias("n_chunks"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("n_chars"), F.min(key).alias("first_id"))


def document_table(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    return chunks.groupBy("document_id").agg(F.countDistinct("section_id").alias("n_sections"), F.count("*").alias("n_chunks"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("n_chars"), F.min(key).alias("first_id"))


def document_preview(chunks: DataFrame, order: str = "chunk_index", key: str = "id", text: str = "text", first: int = 8, chars: int = 1000) -> DataFrame:
    """(document_id, preview): the first characters of a document from its first chunks; bounded by ``first``."""
    w = Window.partitionBy("document_id").orderBy(F.col(order).asc_nulls_last(), F.col(key))
    few = chunks.withColumn("n", F.row_number().over(w)).where(F.col("n") <= first)
    joined = few.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("ts"))
    return joined.select("document_id", F.substring(F.array_join(F.transform("ts", lambda x: x["t"]), " "), 1, chars).alias("preview"))


def points(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """The three levels as one table (id, level, document_id, section_id, n_chars)."""
    c = chunks.select(F.col(key).cast("string").alias("id"), F.lit("chunk").alias("level"), "document_id", "section_id", F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("n_chars"))
    s = section_table(chunks, key, text).select(F.col("section_id").alias("id"), F.lit("section").alias("level"), "document_id", "section_id", "n_chars")
    d = document_table(chunks, key, text).select(F.col("document_id").alias("id"), F.lit("document").alias("level"), "document_id", F.lit(None).cast("string").alias("section_id"), "n_chars")
    return c.unionByName(s).unionByName(d)


def expand(hits: DataFrame, chunks: DataFrame, k: int = 10, key: str = "id") -> DataFrame:
    """Chunk hits with their section (score .4) and document (.3), each once for a query; the best k rows."""
    where = chunks.select(F.col(key).alias("id"), "section_id", "document_id")
    h = hits.join(where, "id", "left")
    every = (
        h.select("query_id", F.col("id").cast("string").alias("id"), F.lit("chunk").alias("level"), "score")
        .unionByName(h.where("section_id is not null").select("query_id", F.col("section_id").alias("id"), F.lit("section").alias("level"), F.lit(0.4).alias("score")))
        .unionByName(h.where("document_id is not null").select("query_id", F.col("document_id").alias("id"), F.lit("document").alias("level"), F.lit(0.3).alias("score")))
    )
    best = every.groupBy("query_id", "id", "level").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "level", "id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def descendants(chunks: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """(ancestor, id): chunks below the given section and document ids."""
    c = chunks.select(F.col(key).alias("id"), F.explode(F.array("section_id", "document_id")).alias("ancestor"))
    return c.join(ids.select(F.col("id").alias("ancestor")), "ancestor")
