"""Fusion of ranked lists: a full outer join of score lists by (request, id), as one partial aggregation.

Input is long: (request_id, list, id, score) with ``list`` in ``vector``, ``bm25``, ``splade``; null and NaN
scores must be gone and ids be unique in a list (``long_lists`` sees to it). Every method gives
(request_id, id, score); ties are in the order of ids. A request with one list is fused with that list alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60
LISTS = {"vector": "vector_results", "bm25": "bm25_results", "splade": "splade_results"}


def long_lists(requests: DataFrame, lists: tuple[str, ...] = ("vector", "bm25")) -> DataFrame:
    """(request_id, alpha, list, id, score) of the distinct requests; an id repeated in a list has its higher score. ``alpha`` is clamped to 0..1, and .5 if null."""
    cols = [F.struct(F.lit(n).alias("list"), F.col(LISTS[n]).alias("hits")) for n in lists]
    alpha = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("strategy.alpha"), F.lit(0.5))))
    distinct = requests.select("request_id", alpha.alias("alpha"), *(LISTS[n] for n in lists)).dropDuplicates()
    each = distinct.select("request_id", "alpha", F.explode(F.array(*cols)).alias("l")).select("request_id", "alpha", "l.list", F.explode("l.hits").alias("h"))
    good = each.select("request_id", "alpha", "list", F.col("h.id").alias("id"), F.col("h.score").alias("score")).where("id is not null and score is not null and not isnan(score)")
    return good.groupBy("request_id", "alpha", "list", "id").agg(F.max("score").alias("score"))


def _list():
    return Window.partitionBy("request_id", "list")


def ranked(hits: DataFrame) -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(_list().orderBy(F.desc("score"), F.asc("id")))).withColumn("n", F.count("*").over(_list()))


def min_max(hits: DataFrame, constant: float = 0.5) -> DataFrame:
    lo, hi = F.min("score").over(_list()), F.max("score").over(_list())
    return hits.withColumn("value", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(F.lit(constant)))


def _two(hits: DataFrame, value: Column, missing_v: Column | float = 0.0, missing_b: Column | float = 0.0) -> DataFrame:
    """One row for each (request, id) with the value of either list."""
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    v = F.max(F.when(F.col("list") == "vector", value))
    b = F.max(F.when(F.col("list") == "bm25", value))
    return hits.groupBy("request_id", "alpha", "id").agg(F.coalesce(v, lit(missing_v)).alias("v"), F.coalesce(b, lit(missing_b)).alias("b"))


def _weighted(two: DataFrame) -> DataFrame:
    return two.select("request_id", "id", F.round(F.col("alpha") * F.col("v") + (1 - F.col("alpha")) * F.col("b"), 6).alias("score"))


def rrf(hits: DataFrame, k: int = RRF_K, missing: str = "last") -> DataFrame:
    """Reciprocal ranks; a missing side has the rank after the last of its list, or adds nothing (``missing="zero"``)."""
    r = ranked(hits)
    if missing == "zero":
        return _weighted(_two(r, 1.0 / (k + F.col("rank"))))
    size = lambda n: F.max(F.max(F.when(F.col("list") == n, F.col("n")))).over(Window.partitionBy("request_id"))
    two = r.groupBy("request_id", "alpha", "id").agg(
        F.max(F.when(F.col("list") == "vector", F.col("rank"))).alias("rv"),
        F.max(F.when(F.col("list") == "bm25", F.col("rank"))).alias("rb"),
        size("vector").alias("nv"),
        size("bm25").alias("nb"),
    )
    last = lambda rank, n: 1.0 / (k + F.coalesce(F.col(rank), F.coalesce(F.col(n), F.lit(0)) + 1))
    return _weighted(two.withColumn("v", last("rv", "nv")).withColumn("b", last("rb", "nb")))


def linear(hits: DataFrame, constant: float = 0.5) -> DataFrame:
    return _weighted(_two(min_max(hits, constant), F.col("value")))


def _softmax(hits: DataFrame, temperature: float, score: str = "score") -> DataFrame:
    """exp(s / t) / sum, less the list's maximum, so that nothing overflows."""
    e = hits.withColumn("e", F.exp((F.col(score) - F.max(score).over(_list())) / temperature))
    return e.withColumn("value", F.col("e") / F.sum("e").over(_list()))


def softmax(hits: DataFrame, temperature: float = 0.1) -> DataFrame:
    return _weighted(_two(_softmax(hits, temperature), F.col("value")))


def logistic(hits: DataFrame, steepness: float = 1.0, middle: float = 0.5) -> DataFrame:
    m = min_max(hits, 0.5)
    constant = F.min("score").over(_list()) == F.max("score").over(_list())
    return _weighted(_two(m.withColumn("value", F.when(constant, F.lit(0.5)).otherwise(1 / (1 + F.exp(-steepness * (F.col("value") - middle))))), F.col("value")))


def ensemble(hits: DataFrame, methods: tuple[str, ...] = ("linear", "softmax", "rrf")) -> DataFrame:
    """Mean of several methods; unknown ones are skipped."""
    known = [METHODS[m](hits).select("request_id", "id", F.col("score").alias("s")) for m in methods if m in METHODS]
    every = known[0]
    for more in known[1:]:
        every = every.unionByName(more)
    return every.groupBy("request_id", "id").agg(F.round(F.sum("s") / len(known), 6).alias("score"))


def maximum(hits: DataFrame) -> DataFrame:
    return min_max(hits, 1.0).groupBy("request_id", "id").agg(F.round(F.max("value"), 6).alias("score"))


def harmonic(hits: DataFrame, floor: float = 1e-4) -> DataFrame:
    """Weighted harmonic mean of min-max scores; both sides are at least ``floor``."""
    two = _two(min_max(hits, 1.0), F.col("value"))
    v, b = F.greatest(F.col("v"), F.lit(floor)), F.greatest(F.col("b"), F.lit(floor))
    return two.select("request_id", "id", F.round(1 / (F.col("alpha") / v + (1 - F.col("alpha")) / b), 6).alias("score"))


def three_way(hits: DataFrame) -> DataFrame:
    """Linear over three lists: weights a, .6(1-a), .4(1-a) where the request has a third list, else a and 1-a."""
    m = min_max(_shares(hits), 1.0)
    return m.groupBy("request_id", "id").agg(F.round(F.sum(F.col("share") * F.col("value")), 6).alias("score"))


def _shares(hits: DataFrame) -> DataFrame:
    """With ``share``, a list's weight: a, .6(1-a), .4(1-a) where the request has a third list, else a and 1-a."""
    third = F.max((F.col("list") == "splade").cast("int")).over(Window.partitionBy("request_id")) == 1
    a = F.col("alpha")
    return hits.withColumn("share", F.when(F.col("list") == "vector", a).when(F.col("list") == "bm25", F.when(third, 0.6 * (1 - a)).otherwise(1 - a)).otherwise(0.4 * (1 - a)))


def softmax_service(hits: DataFrame, sharpness: float = 10.0) -> DataFrame:
    """Softmax of the min-max scores of two or three lists."""
    e = _softmax(min_max(_shares(hits), 1.0), 1 / sharpness, "value").drop("e")
    return e.groupBy("request_id", "id").agg(F.round(F.sum(F.col("share") * F.col("value")), 6).alias("score"))


def rrf_service(hits: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal ranks of two or three lists; an item that a list lacks ranks after its last, first in an empty list."""
    r = ranked(hits)
    of = lambda name, c: F.max(F.when(F.col("list") == name, F.col(c)))
    sizes = r.groupBy("request_id").agg(*(F.coalesce(of(name, "n"), F.lit(0)).alias(f"n_{name}") for name in LISTS))
    each = r.groupBy("request_id", "alpha", "id").agg(*(of(name, "rank").alias(f"r_{name}") for name in LISTS)).join(sizes, "request_id")
    v, b, q = (1 / (k + F.coalesce(F.col(f"r_{name}"), F.col(f"n_{name}") + 1)) for name in LISTS)
    rest = 1 - F.col("alpha")
    score = F.col("alpha") * v + F.when(F.col("n_splade") > 0, rest * (0.6 * b + 0.4 * q)).otherwise(rest * b)
    return each.select("request_id", "id", F.round(score, 6).alias("score"))


METHODS = {"rrf": rrf, "linear": linear, "softmax": softmax, "logistic": logistic, "max": maximum, "harmonic": harmonic, "normalized": softmax}
METHODS |= {"ensemble": ensemble, "rrf_service": rrf_service, "softmax_service": softmax_service}


def fuse(hits: DataFrame, method: str | None) -> DataFrame:
    """An unknown method is linear."""
    return METHODS.get((method or "").strip().lower(), linear)(hits)


def entity_boost(fused: DataFrame, texts: DataFrame, query_entities: DataFrame, factor: float = 0.1, most: float = 0.3) -> DataFrame:
    """Raise a hit by ``min(most, matches * factor)`` of its score for the query's entities that its text contains."""
    t = fused.join(texts.select("id", F.lower("text").alias("_t")), "id", "left").join(query_entities.select("request_id", "entities"), "request_id", "left")
    n = F.size(F.filter(F.coalesce("entities", F.array().cast("array<string>")), lambda e: F.coalesce(F.col("_t").contains(F.lower(e)), F.lit(False))))
    return t.withColumn("score", F.round(F.col("score") * (1 + F.least(F.lit(most), n * factor)), 6)).select("request_id", "id", "score")
