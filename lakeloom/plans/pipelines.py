"""Preparation, retrieval and evaluation as whole plans, with the defaults of their parameters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import query as Q
from ..operators import chunking, dedup, enrich, fusion, hierarchy, rerank, retrieval, validation


@dataclass(frozen=True)
class PrepareConfig:
    method: str = "adaptive"
    chunk_size: int = 1000
    least_words: int = 0
    languages: tuple[str, ...] = ()
    language_threshold: float = 0.9
    deduplicate: bool = True
    rich_metadata: bool = True
    hierarchical: bool = True


def prepare(docs: DataFrame, config: PrepareConfig = PrepareConfig(), key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Documents to chunks: language filter, exact deduplication, chunking, size filter, metadata, hierarchy, neighbours.

    Until the hierarchy, which groups by source, only the deduplication shuffles, and it moves hashes and ids.
    """
    d = docs
    if config.languages:
        d = enrich.language_filter(d, config.languages, config.language_threshold, text)
    if config.deduplicate:
        d = dedup.drop_exact(d, key, text)
    c = chunking.chunk(d.select(key, text), config.method, config.chunk_size, key, text)
    c = c.join(d.select(key, source), key).withColumn("id", F.concat_ws("-", F.col(key).cast("string"), F.lpad(F.col("chunk_index").cast("string"), 6, "0"))).withColumnRenamed("content", "text")
    if config.least_words:
        c = enrich.size_filter(c, config.least_words)
    if config.rich_metadata:
        c = enrich.rich_metadata(c)
    if config.hierarchical:
        c = hierarchy.sections(c, source, "chunk_index")
    return enrich.with_neighbours(c, source)


@dataclass(frozen=True)
class RetrieveConfig:
    k: int = 20
    fusion: str = "auto"
    reranker: str | None = None
    rerank_top: int = 20


def retrieve(index: retrieval.BM25Index, docs: DataFrame, queries: DataFrame, config: RetrieveConfig = RetrieveConfig(), query_vectors: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): lexical and dense hits fused with the weight of each query's analysis, then reranked.

    Query vectors are given as (query_id, vector), or else those of the first lexical hits stand in; documents without
    a column ``vector`` are searched by sparse vectors instead.

    ``auto`` fuses each query by the method of its type; the queries of one type go through one plan.
    """
    q = queries.withColumn("_a", Q.analysis(F.col("query"))).select("query_id", "query", F.col("_a.alpha").alias("alpha"), F.col("_a.fusion_method").alias("method"))
    lexical = retrieval.bm25_search(index, q, config.k)
    two = lexical.select("query_id", "id", "score", F.lit("bm25").alias("list"))
    if "vector" in docs.columns:
        one = retrieval.dense_top_k(docs, retrieval.feedback_vectors(lexical, docs) if query_vectors is None else query_vectors, config.k)
    else:
        one = retrieval.sparse_search(docs, q, config.k)
    one = one.select("query_id", "id", "score", F.lit("vector").alias("list"))
    hits = one.unionByName(two).join(q.select("query_id", "alpha", "method"), "query_id").withColumnRenamed("query_id", "request_id")
    if config.fusion == "auto":
        parts = [fusion.fuse(hits.where(F.col("method") == m), m) for m in ("rrf", "softmax", "linear")]
        fused = parts[0].unionByName(parts[1]).unionByName(parts[2])
    else:
        fused = fusion.fuse(hits, config.fusion)
    top = retrieval.top_k(fused.withColumnRenamed("request_id", "query_id"), config.k)
    if config.reranker is None:
        return top
    few = top.where(F.col("rank") <= config.rerank_top).drop("rank").join(docs, "id").join(queries.select("query_id", "query"), "query_id")
    again = rerank.reranker(config.reranker)(few)
    return again if "rank" in again.columns else retrieval.top_k(again.select("query_id", "id", "score"), config.rerank_top)


def evaluate(hits: DataFrame, relevant: DataFrame, k: int = 10) -> DataFrame:
    """One row: means of precision, recall, reciprocal rank and nDCG at k."""
    e = validation.evaluate(hits, relevant, k)
    return e.agg(*(F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")))
