"""Quality of an ingested collection and of retrieval over it. All aggregates; sampling is by hash, so runs repeat."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def coverage(points: DataFrame) -> DataFrame:
    """(vectors, score, passed): steps at 10, 50 and 100 vectors."""
    n = F.count("*")
    return points.agg(n.alias("vectors")).select("vectors", F.when(F.col("vectors") >= 100, 1.0).when(F.col("vectors") >= 50, 0.8).when(F.col("vectors") >= 10, 0.5).otherwise(0.2).alias("score"), (F.col("vectors") >= 10).alias("passed"))


def vector_consistency(points: DataFrame, vector: str = "vector") -> DataFrame:
    """One row: dimensions, share of zeros, non-finite vectors, mean and deviation of the lengths."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    t = points.select(F.size(v).alias("dim"), F.coalesce(finite, F.lit(False)).alias("finite"), F.when(finite, V.norm(v)).alias("length"), F.size(F.filter(v, lambda x: x == 0)).alias("zeros"), v.isNull().alias("missing"))
    return t.agg(
        F.count("*").alias("vectors"),
        F.sum(F.col("missing").cast("int")).alias("missing"),
        F.countDistinct(F.when(~F.col("missing"), F.col("dim"))).alias("dimensions"),
        F.sum((~F.col("finite") & ~F.col("missing")).cast("int")).alias("non_finite"),
        F.round(F.sum(F.when(~F.col("missing"), F.col("zeros"))) / F.sum(F.when(~F.col("missing"), F.col("dim"))), 6).alias("zero_share"),
        F.round(F.avg("length"), 6).alias("mean_length"),
        F.round(F.stddev_samp("length"), 6).alias("sd_length"),
    )


def pair_similarity(points: DataFrame, every: int = 1000, key: str = "id", vector: str = "vector") -> DataFrame:
    """Mean cosine of neighbours in hash order: about one pair for each ``every`` rows, drawn by hash."""
    h = F.xxhash64(F.col(key), F.lit(17))
    some = points.where(F.pmod(h, F.lit(every)) < 2).select(h.alias("h"), F.pmod(h, F.lit(1 << 10)).alias("part"), F.col(vector).alias("v"))
    w = Window.partitionBy("part").orderBy("h")
    return some.withColumn("next", F.lead("v").over(w)).where("next is not null").agg(F.count("*").alias("pairs"), F.avg(V.cosine(F.col("v"), F.col("next"))).alias("mean_cosine"))


def test_queries(docs: DataFrame, n: int = 20, key: str = "id", text: str = "text", seed: int = 42) -> DataFrame:
    """(query_id, expected_id, query): the first sentences of n documents drawn by hash, as questions."""
    first = F.split(F.trim(F.col(text)), r"(?<=[.!?])\s+")[0]
    some = docs.where(F.length(F.trim(F.col(text))) > 20).select(F.col(key).alias("expected_id"), first.alias("s"), F.xxhash64(F.col(key), F.lit(seed)).alias("h")).orderBy("h", "expected_id").limit(n)
    return some.select(F.xxhash64("expected_id").alias("query_id"), "expected_id", F.concat(F.lit("What is said about: "), F.substring("s", 1, 120), F.lit("?")).alias("query"))


def retrieval_quality(hits: DataFrame, expected: DataFrame, within: int = 5) -> DataFrame:
    """(queries, hit_rate, mean_position, score, passed); hits are (query_id, id, rank), expected (query_id, expected_id)."""
    at = hits.where(F.col("rank") <= within).select("query_id", F.col("id").alias("expected_id"), "rank")
    found = expected.select("query_id", "expected_id").join(at, ["query_id", "expected_id"], "left").groupBy("query_id").agg(F.min("rank").alias("rank"))
    t = found.agg(F.count("*").alias("queries"), F.avg(F.col("rank").isNotNull().cast("double")).alias("hit_rate"), F.avg("rank").alias("mean_position"), F.avg((within - (F.col("rank") - 1)) / within).alias("nearness"))
    score = 0.7 * F.col("hit_rate") + 0.3 * F.coalesce("nearness", F.lit(0.0))
    return t.select("queries", F.round("hit_rate", 6).alias("hit_rate"), F.round("mean_position", 6).alias("mean_position"), F.round(score, 6).alias("score"), (F.col("hit_rate") >= 0.5).alias("passed"))


def summary(results: DataFrame) -> DataFrame:
    """(total, passed, failed, critical, status) of (name, passed, score) rows."""
    t = results.agg(F.count("*").alias("total"), F.sum(F.col("passed").cast("int")).alias("passed"), F.sum((~F.col("passed") & (F.col("score") < 0.5)).cast("int")).alias("critical"))
    share = F.col("passed") / F.col("total")
    return t.select("total", "passed", (F.col("total") - F.col("passed")).alias("failed"), "critical", F.when(share == 1, "PASSED").when(share >= 0.7, "PARTIAL").otherwise("FAILED").alias("status"))


def evaluate(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, precision, recall, reciprocal_rank, ndcg) at k; relevant is (query_id, id), each pair once. Queries without a relevant id are left out."""
    rel = relevant.select("query_id", "id").distinct()
    total = rel.groupBy("query_id").agg(F.count("*").alias("n"))
    top = hits.where(F.col("rank") <= k).join(rel, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.count("*").alias("found"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    t = total.join(top, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return t.select("query_id", F.round(zero(F.col("found") / k), 6).alias("precision"), F.round(zero(F.col("found") / F.col("n")), 6).alias("recall"), F.round(zero(1 / F.col("first")), 6).alias("reciprocal_rank"), F.round(zero(F.col("dcg")) / ideal, 6).alias("ndcg"))


def timings(runs: DataFrame, baseline: str, candidate: str) -> DataFrame:
    """Min, max, mean and deviation of (name, seconds), and the speed-up of one name over another in percent."""
    s = runs.groupBy("name").agg(F.count("*").alias("runs"), F.min("seconds").alias("min"), F.max("seconds").alias("max"), F.round(F.avg("seconds"), 6).alias("mean"), F.round(F.stddev_samp("seconds"), 6).alias("stdev"))
    base, cand = (F.max(F.when(F.col("name") == n, F.col("mean"))).over(Window.partitionBy(F.lit(0))) for n in (baseline, candidate))
    return s.withColumn("speedup_percent", F.when((F.col("name") == candidate) & (base > 0), F.round((base - cand) / base * 100, 4)))


def operation_metrics(events: DataFrame, name: str = "event_type", seconds: str = "value", failed: str | None = None) -> DataFrame:
    """Count, mean duration and errors of each operation."""
    bad = F.sum(F.col(failed).cast("int")) if failed else F.lit(0)
    return events.groupBy(F.col(name).alias("name")).agg(F.count("*").alias("count"), F.round(F.avg(seconds), 6).alias("mean_seconds"), bad.alias("errors"))


