"""Sources and sinks: documents from files, collections of points, query and test sets, indexes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

DISTANCES = ("Cosine", "Dot", "Euclid")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(source, text): one row for each file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("text"))


def binary_files(spark: SparkSession, path: str, extract: Callable[[bytes], str] | None = None, glob: str = "*") -> DataFrame:
    """(source, text): files through an extractor of the caller's (PDF and the like); UTF-8 text without one."""
    b = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    if extract is None:
        return b.select(F.col("path").alias("source"), F.decode("content", "UTF-8").alias("text"))

    @F.pandas_udf("string")
    def text_of(content):
        return content.map(lambda x: extract(bytes(x)))

    return b.select(F.col("path").alias("source"), text_of("content").alias("text"))


def html_text(df: DataFrame, html: str = "html") -> DataFrame:
    """``text``: without scripts, styles and tags, one line for each text part. In the JVM."""
    c = F.regexp_replace(F.col(html), r"(?is)<(script|style|head)\b.*?</\1\s*>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^<>]+>", "\n")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return df.withColumn("text", F.regexp_replace(F.regexp_replace(c, r"[ \t]*\n\s*", "\n"), r"^\s+|\s+$", ""))


def conversations_as_documents(posts: DataFrame, channel: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(source, text): the posts of a channel in order, one line each."""
    p = posts.groupBy(channel).agg(F.array_sort(F.collect_list(F.struct(order, F.coalesce(F.col(text), F.lit("")).alias("t")))).alias("ps"))
    return p.select(F.col(channel).cast("string").alias("source"), F.array_join(F.transform("ps", lambda x: x["t"]), "\n").alias("text"))


def json_lines(spark: SparkSession, path: str, schema: str = "query string, ground_truth string, relevant_doc_ids array<string>") -> DataFrame:
    return spark.read.schema(schema).json(path)


class Collection:
    """A named set of points as a Parquet folder: one version at a time, replaced as a whole by each change."""

    def __init__(self, spark: SparkSession, folder: str, name: str, size: int = 3072, distance: str = "Cosine"):
        if distance not in DISTANCES:
            raise ValueError(f"distance must be one of {DISTANCES}")
        self.spark, self.path, self.size, self.distance = spark, f"{folder}/{name}", size, distance

    def _versions(self) -> list[int]:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(hadoop):
            return []
        return sorted(int(s.getPath().getName()[2:]) for s in fs.listStatus(hadoop) if s.getPath().getName().startswith("v=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))

    def exists(self) -> bool:
        return bool(self._versions())

    def scan(self, where=None) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/v={self._versions()[-1]}")
        return df if where is None else df.where(where)

    def upsert(self, points: DataFrame, key: str = "id") -> None:
        """New points, and new versions of those with known ids (the last by ``ingested_at`` if there is one)."""
        if self.exists():
            points = self.scan().join(points.select(key), key, "left_anti").unionByName(points, allowMissingColumns=True)
        order = [F.desc("ingested_at")] if "ingested_at" in points.columns else [F.lit(0)]
        one = points.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
        one.write.parquet(f"{self.path}/v={(self._versions() or [0])[-1] + 1}")

    def purge(self) -> None:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def save_index(index, path: str) -> None:
    """Postings as Parquet, with the corpus figures beside them."""
    index.posts.write.mode("overwrite").parquet(f"{path}/postings")
    index.posts.sparkSession.createDataFrame([(index.n, index.avgdl)], "n long, avgdl double").write.mode("overwrite").parquet(f"{path}/corpus")


def load_index(spark: SparkSession, path: str):
    from ..operators.retrieval import BM25Index

    r = spark.read.parquet(f"{path}/corpus").first()
    return BM25Index(spark.read.parquet(f"{path}/postings"), r["n"], r["avgdl"])
