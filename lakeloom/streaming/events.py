"""Streams of events: windows, sessions, deduplication, incremental indexing. Each works on a batch table as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, like: DataFrame | None = None, files_per_trigger: int = 16) -> DataFrame:
    """A stream over a folder of Parquet files with a known schema."""
    schema = (like or spark.read.parquet(path)).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "1 hour", at: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """(window_start, by, n, total): tumbling or sliding windows; events later than ``late`` are dropped by a stream."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return e.groupBy(w.alias("w"), F.col(by)).agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("window_start"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", at: str = "ts", user: str = "user_id") -> DataFrame:
    """(user, session_start, session_end, n): events of a user that follow each other within the gap."""
    e = events.withWatermark(at, late) if events.isStreaming else events
    return e.groupBy(F.col(user), F.session_window(at, gap).alias("w")).agg(F.count("*").alias("n")).select(user, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str = "1 hour", at: str = "ts") -> DataFrame:
    """The first of equal events; a stream forgets keys after the watermark, so its state is bounded."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)


def each_batch(stream: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True):
    """Run ``fn(batch, id)`` for each micro-batch; with ``once`` over what is there now."""
    w = stream.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def index_appender(path: str, tokenizer=None, key: str = "id", text: str = "text") -> Callable[[DataFrame, int], None]:
    """For ``each_batch``: write the postings of each batch under its id, so that a repeated batch replaces itself."""
    from ..functions import text as X
    from ..operators.retrieval import postings

    def run(batch: DataFrame, number: int) -> None:
        postings(batch, tokenizer or X.tokens, key, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
