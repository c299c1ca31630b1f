"""Chunking of documents: one row in, many rows out, in Arrow batches and without any shuffle."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chunks as C
from ..functions import tables as T
from .tables import _each


def chunk(docs: DataFrame, method: str = "adaptive", most: int = 1000, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, chunk_index, content, chunking_method). Null and blank texts give no row; an unknown method is an error."""
    fn = C.METHODS[method]
    key_type = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, index, content = [], [], []
            for k, t in zip(b.column(0), b.column(1).to_pylist()):
                for i, c in enumerate(fn(t, most, **options)):
                    keys.append(k)
                    index.append(i)
                    content.append(c)
            yield pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], b.schema.field(0).type), pa.array(index, pa.int32()), pa.array(content, pa.string())], names=["key", "chunk_index", "content"])

    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {key_type}, chunk_index int, content string")
    return out.select(F.col("key").alias(key), "chunk_index", "content", F.lit(method).alias("chunking_method"))


def table_row_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, row_index, content): each data row of the Markdown tables below the header lines of its table; only documents with a rule go to Python."""
    has = docs.where(F.col(text).contains("|") & F.col(text).contains("---"))
    return _each(has, key, text, T.markdown_rows, ["row_index", "content"], [pa.int32(), pa.string()], "row_index int, content string")


def boundary_breaks(spans: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, breaks): how many spans (key, span) no chunk of their document holds whole."""
    c = chunks.select(F.col(key).alias("k"), "content")
    whole = spans.join(c, (F.col(key) == F.col("k")) & F.col("content").contains(F.col("span")), "left_anti")
    return whole.groupBy(key).agg(F.count("*").alias("breaks"))
