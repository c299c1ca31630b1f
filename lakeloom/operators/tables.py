"""Tables in documents: cells, formats and counts. Parsing goes through Arrow in batches; counts are aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables as T


def _each(docs: DataFrame, key: str, text: str, fn, names: list[str], types: list[pa.DataType], spec: str) -> DataFrame:
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, rows = [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for r in fn(t):
                    keys.append(k)
                    rows.append(r)
            cols = list(zip(*rows)) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(keys, b.schema.field(0).type), *(pa.array(list(c), ty) for c, ty in zip(cols, types))], names=["key", *names])

    some = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return some.mapInArrow(run, f"key {key_type}, {spec}").withColumnRenamed("key", key)


def html_cells(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, table, row, col, rowspan, colspan, is_header, cell, parent) of all HTML tables; only documents with one go to Python."""
    i, s, b = pa.int32(), pa.string(), pa.bool_()
    has = docs.where(F.lower(F.col(text)).contains("<table"))
    return _each(has, key, text, lambda t: T.html_cells(t)[0], ["table", "row", "col", "rowspan", "colspan", "is_header", "cell", "parent"], [i, i, i, i, i, b, s, i], "table int, row int, col int, rowspan int, colspan int, is_header boolean, cell string, parent int")


def markdown_cells(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    i, s, b = pa.int32(), pa.string(), pa.bool_()
    has = docs.where(F.col(text).contains("|"))
    return _each(has, key, text, T.markdown_cells, ["table", "row", "col", "rowspan", "colspan", "is_header", "cell", "parent"], [i, i, i, i, i, b, s, i], "table int, row int, col int, rowspan int, colspan int, is_header boolean, cell string, parent int")


def table_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, table, format, content): rows below repeated headers for simple tables, the whole for others."""
    has = docs.where(F.lower(F.col(text)).contains("<table"))
    return _each(has, key, text, T.chunks_of, ["table", "format", "content"], [pa.int32(), pa.string(), pa.string()], "table int, format string, content string")


def table_metadata(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each table: its size, and whether it has headers, merged cells and a table inside."""
    own = cells.groupBy(key, "table").agg((F.max("row") + 1).alias("rows"), F.max(F.col("col") + F.col("colspan")).alias("columns"), F.max("is_header").alias("has_header"), F.max((F.col("rowspan") > 1) | (F.col("colspan") > 1)).alias("has_merged"), F.count("*").alias("cells"))
    inner = cells.where("parent >= 0").select(key, F.col("parent").alias("table")).distinct().withColumn("has_nested", F.lit(True))
    return own.join(inner, [key, "table"], "left").withColumn("has_nested", F.coalesce("has_nested", F.lit(False)))


def column_members(cells: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, table, column, row, cell): a cell belongs to every column that it spans."""
    return cells.select(key, "table", F.explode(F.sequence("col", F.col("col") + F.col("colspan") - 1)).alias("column"), "row", "cell")
