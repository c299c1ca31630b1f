"""Helpers shared by the training-text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir, written

__all__ = ["JAVA_SPACE", "JAVA_WORD", "arrow_rows", "cut", "not_blank", "shared_dir", "table", "written"]

#: A word: a run of letters, digits and underscores (Java regex spelling of Python's ``\w+``).
JAVA_WORD = r"[\p{L}\p{N}_]+"
#: Unicode white space, as Python's ``str.isspace`` sees it.
JAVA_SPACE = r"[\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def not_blank(c: Column) -> Column:
    """True for texts with at least one character that is not white space; null counts as blank."""
    return F.coalesce(c.rlike(rf"(?s)[^\s\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\u001c-\u001f]"), F.lit(False))


def arrow_rows(fn: Callable[..., Iterator[tuple]], fields: list[str], schema: pa.Schema):
    """A ``mapInArrow`` function from ``fn(*columns as lists)``, which yields the output rows of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(f)).to_pylist() for f in fields]
            rows = list(fn(*cols))
            arrays = list(zip(*rows)) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(a), type=f.type) for a, f in zip(arrays, schema)], schema=schema)

    return run
