"""Reranking of short hit lists, and packing of a context.

Greedy methods need the items chosen so far, so they run per query on its hits (``MAX_HITS`` at most, checked in
the task: more is an error, not a cut). Input is (query_id, id, score, ...).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as X

MAX_HITS = 10_000


def _per_query(hits: DataFrame, order: Callable[[pd.DataFrame], list[tuple[int, float]]]) -> DataFrame:
    schema = f"query_id {hits.schema['query_id'].dataType.simpleString()}, id {hits.schema['id'].dataType.simpleString()}, score double, rank int"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > MAX_HITS:
            raise ValueError(f"a query has more than {MAX_HITS} hits to rerank")
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        chosen = order(pdf)
        return pd.DataFrame({"query_id": [pdf.query_id[i] for i, _ in chosen], "id": [pdf.id[i] for i, _ in chosen], "score": [s for _, s in chosen], "rank": range(1, len(chosen) + 1)})

    return hits.groupBy("query_id").applyInPandas(run, schema)


def _vectors(pdf: pd.DataFrame, size: int | None = None) -> np.ndarray:
    """The hits' vectors of ``size`` components, by default as many as the longest has; zeros for null, shorter, longer and non-finite ones."""
    own = [np.asarray([] if v is None else v, float) for v in pdf.vector]
    size = size or max(map(len, own), default=0)
    return np.array([v if len(v) == size and np.isfinite(v).all() else np.zeros(size) for v in own])


def _unit(pdf: pd.DataFrame, size: int | None = None) -> np.ndarray:
    x = _vectors(pdf, size)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def mmr(hits: DataFrame, trade: float = 0.5, k: int | None = None, size: int | None = None) -> DataFrame:
    """Maximal marginal relevance: ``trade * score - (1 - trade) * max cosine to those chosen``; the first is the best score, ties the earlier hit.

    A hit without a usable vector (of ``size`` finite components) has similarity 0 to all others.
    """

    def order(pdf: pd.DataFrame) -> list[tuple[int, float]]:
        x, s = _unit(pdf, size), pdf.score.to_numpy(float)
        left, chosen, worst = list(range(len(s))), [], np.full(len(s), -np.inf)
        while left and len(chosen) < (k or len(s)):
            value = s if not chosen else trade * s - (1 - trade) * worst
            i = max(left, key=lambda j: (value[j], -j))
            left.remove(i)
            chosen.append((i, float(s[i])))
            worst = np.maximum(worst, x @ x[i])
        return chosen

    return _per_query(hits.select("query_id", "id", "score", "vector"), order)


def mmr_service(hits: DataFrame, trade: float = 0.7) -> DataFrame:
    """``trade * cos(query, item) + (1 - trade) * min distance to those chosen``; then scores blend with the new places."""

    def order(pdf: pd.DataFrame) -> list[tuple[int, float]]:
        q = np.asarray(pdf.query_vector[0], float)
        x = _unit(pdf, len(q))
        q = q / (np.linalg.norm(q) or 1)
        rel, s = x @ q, pdf.score.to_numpy(float)
        left, chosen, near = list(range(len(s))), [], np.full(len(s), np.inf)
        while left:
            value = rel if not chosen else trade * rel + (1 - trade) * near
            i = max(left, key=lambda j: (value[j], -j))
            left.remove(i)
            chosen.append(i)
            near = np.minimum(near, 1 - x @ x[i])
        n = len(chosen)
        return [(i, float(0.7 * s[i] + 0.3 * (1 - p / n))) for p, i in enumerate(chosen)]

    return _per_query(hits.select("query_id", "id", "score", "vector", "query_vector"), order)


def cluster_diversity(hits: DataFrame, clusters: int = 3, seed: int = 42, size: int | None = None) -> DataFrame:
    """K-means over a query's hits, then one hit of each cluster in turn, best first. Hits without a usable vector are the last cluster."""

    def means(x: np.ndarray) -> np.ndarray:
        k = max(1, min(clusters, len(x) // 2))
        rng = np.random.default_rng(seed)
        centre = x[np.sort(rng.choice(len(x), k, replace=False))]
        for _ in range(25):
            at = ((x[:, None] - centre[None]) ** 2).sum(-1).argmin(1)
            new = np.array([x[at == c].mean(0) if (at == c).any() else centre[c] for c in range(k)])
            if np.allclose(new, centre):
                break
            centre = new
        return at

    def order(pdf: pd.DataFrame) -> list[tuple[int, float]]:
        x, s = _vectors(pdf, size), pdf.score.to_numpy(float)
        full = np.flatnonzero(x.any(axis=1))
        at = np.full(len(s), clusters)
        if len(full):
            at[full] = means(x[full])
        turn = [int((at[:i] == at[i]).sum()) for i in range(len(s))]
        return [(i, float(s[i])) for i in sorted(range(len(s)), key=lambda i: (turn[i], at[i], i))]

    return _per_query(hits.select("query_id", "id", "score", "vector"), order)


def category_diversity(hits: DataFrame, category: str = "category") -> DataFrame:
    """One hit of each category in turn (categories in alphabetical order); score ``.8 s + .2 (1 - place / n)``. No Python."""
    c = F.coalesce(F.col(category), F.lit("unknown"))
    turn = F.row_number().over(Window.partitionBy("query_id", "cat").orderBy(F.desc("score"), F.asc("id")))
    t = hits.select("query_id", "id", "score", c.alias("cat")).withColumn("turn", turn)
    w = Window.partitionBy("query_id")
    placed = t.withColumn("place", F.row_number().over(w.orderBy("turn", "cat")) - 1).withColumn("n", F.count("*").over(w))
    return placed.select("query_id", "id", F.round(0.8 * F.col("score") + 0.2 * (1 - F.col("place") / F.col("n")), 6).alias("score"), (F.col("place") + 1).alias("rank"))


def context_aware(hits: DataFrame) -> DataFrame:
    """``.6 score + .4 relevance`` of (query, text): half the share of query words in the text, .3 for the whole phrase, .2 for the best paragraph's share."""
    q = F.array_distinct(X.words(F.col("query")))
    share = lambda text: F.when(F.size(q) > 0, F.size(F.filter(q, lambda w: text.contains(w))) / F.size(q)).otherwise(0.0)
    low = F.lower(F.coalesce(F.col("text"), F.lit("")))
    best = F.array_max(F.transform(F.split(low, r"\n\s*\n"), share))
    relevance = 0.5 * share(low) + 0.3 * low.contains(F.lower("query")).cast("double") + 0.2 * best
    return hits.withColumn("score", F.round(0.6 * F.col("score") + 0.4 * relevance, 6))


def boosted(hits: DataFrame) -> DataFrame:
    """``boost`` of (query, text): the score, .05 for each of the query's entities in the text (.2 at most), and .1 or .05 for a fitting length."""
    cx = Q.complexity(F.col("query"))["is_complex"]
    text = F.coalesce(F.col("text"), F.lit(""))
    n = F.size(X.plain_split(text))
    matches = F.size(F.filter(Q.entities(F.col("query")), lambda e: F.lower(text).contains(F.lower(e))))
    length = F.when(cx, F.when((n >= 100) & (n <= 500), 0.1).when(n > 500, 0.05).otherwise(0.0)).otherwise(F.when(n < 100, 0.1).otherwise(0.0))
    diverse = cx | (Q.analysis(F.col("query"))["query_type"] == "conceptual")
    return hits.withColumn("boost", F.round(F.col("score") + F.least(F.lit(0.2), matches * 0.05) + length, 6)).withColumn("diverse", diverse)


def context_aware_library(hits: DataFrame, weight: float = 0.3, size: int | None = None) -> DataFrame:
    """Hits by ``boosted``; for complex and conceptual queries with more than three hits the next is the one of highest boost less ``weight``
    times the mean inner product with those chosen. Hits without a usable vector have product 0."""

    def order(pdf: pd.DataFrame) -> list[tuple[int, float]]:
        boost, s = pdf.boost.to_numpy(float), pdf.score.to_numpy(float)
        ranked = sorted(range(len(s)), key=lambda i: (-boost[i], i))
        if not pdf.diverse[0] or len(s) <= 3:
            return [(i, float(s[i])) for i in ranked]
        x = _vectors(pdf, size)
        chosen, left, total = [ranked[0]], set(ranked[1:]), x @ x[ranked[0]]
        while left:
            i = max(left, key=lambda j: (boost[j] - weight * total[j] / len(chosen), -j))
            left.remove(i)
            chosen.append(i)
            total = total + x @ x[i]
        return [(i, float(s[i])) for i in chosen]

    return _per_query(boosted(hits).select("query_id", "id", "score", "vector", "boost", "diverse"), order)


def cross_score(hits: DataFrame) -> DataFrame:
    """Offline stand-in for a cross encoder: share of the query's words in the text."""
    q = F.array_distinct(X.words(F.col("query")))
    t = X.words(F.coalesce(F.col("text"), F.lit("")))
    return hits.withColumn("score", F.round(F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0), 6))


def compress(hits: DataFrame, least_chars: int = 200, least: int = 50, least_share: float = 0.1) -> DataFrame:
    """Sentences that share a word with the query, for texts of ``least_chars`` and more; the text itself where too little remains."""
    q = X.tokens(F.col("query"))
    sentences = F.split(F.col("text"), r"(?<=[.!?])\s+")
    kept = F.array_join(F.filter(sentences, lambda s: F.arrays_overlap(X.tokens(s), q)), " ")
    use = (F.length("text") >= least_chars) & (F.length(kept) >= least) & (F.length(kept) >= least_share * F.length("text"))
    return hits.withColumn("text", F.when(use, kept).otherwise(F.col("text")))


def estimated_tokens(text):
    return F.floor(F.length(text) / 4) + 1


def pack_context(hits: DataFrame, budget: int = 3050, most_chars: int = 1000) -> DataFrame:
    """Hits in score order until the first that overflows the budget of estimated tokens; texts on one line, at most ``most_chars``."""
    flat = F.substring(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\n", " "), 1, most_chars)
    t = hits.select("query_id", "id", "score", flat.alias("text")).withColumn("tokens", estimated_tokens(F.col("text")))
    run = F.sum("tokens").over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id")).rowsBetween(Window.unboundedPreceding, 0))
    return t.withColumn("used", run).where(F.col("used") <= budget)


def pack_context_skipping(hits: DataFrame, budget: int = 3050, most_chars: int = 1000) -> DataFrame:
    """As ``pack_context``, but an item that overflows is skipped and smaller ones after it still go in. Per query over its short hit list."""
    flat = F.substring(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), "\n", " "), 1, most_chars)
    t = hits.select("query_id", F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"), estimated_tokens(flat).alias("tokens")).alias("h"))
    lists = t.groupBy("query_id").agg(F.array_sort(F.collect_list("h")).alias("hs"))
    zero = F.struct(F.lit(0).cast("bigint").alias("used"), F.array().cast("array<string>").alias("ids"))
    fold = F.aggregate("hs", zero, lambda a, h: F.when(a["used"] + h["tokens"] <= budget, F.struct((a["used"] + h["tokens"]).alias("used"), F.concat(a["ids"], F.array(h["id"].cast("string"))).alias("ids"))).otherwise(a))
    return lists.select("query_id", fold.alias("f")).select("query_id", F.col("f.used").alias("used"), F.posexplode("f.ids").alias("place", "id"))


RERANKERS = {"mmr": mmr, "diversity": cluster_diversity, "context_aware": context_aware_library, "context_aware_service": context_aware, "cross_encoder": cross_score}


def reranker(name: str | None):
    """An unknown name is ``mmr``."""
    return RERANKERS.get(name or "", mmr)
