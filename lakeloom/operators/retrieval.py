"""Retrieval for whole batches of queries: BM25, sparse, dense, hybrid.

Queries and documents are tables; every score is a join followed by a partial aggregation and a top-k
per query. Ties: higher score first, then the smaller id. Query tables may be broadcast only up to
``MAX_QUERIES`` rows (checked by ``small``); beyond that the joins shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources.shared import written

# Constants of Okapi BM25.
K1, B, EPSILON = 1.5, 0.75, 0.25
MAX_QUERIES = 10_000


def top_k(scored: DataFrame, k: int, by: str = "query_id", score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows of each query with their ``rank``. Spark prunes to k inside each partition before it shuffles."""
    w = Window.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def small(df: DataFrame, most: int = MAX_QUERIES) -> bool:
    """Whether a table has at most ``most`` rows; reads no more of it than that."""
    return df.select(F.lit(1)).limit(most + 1).count() <= most


def postings(docs: DataFrame, tokenizer=X.tokens, key: str = "id", text: str = "text") -> DataFrame:
    """(term, id, tf, dl): one row for each term of a document; documents without a token have none.

    A document is one row, so its terms are counted where it is, without a shuffle.
    """
    t = docs.select(F.col(key).alias("id"), tokenizer(F.col(text)).alias("toks")).where(F.size("toks") > 0)
    return t.mapInArrow(_count_terms, f"term string, id {t.schema['id'].dataType.simpleString()}, tf long, dl int")


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column(1)
        ends = lists.offsets.to_numpy()
        n = np.diff(ends)
        coded = lists.values.slice(ends[0], ends[-1] - ends[0]).dictionary_encode()
        width = max(1, len(coded.dictionary))
        pair, tf = np.unique(np.repeat(np.arange(len(n), dtype=np.int64), n) * width + coded.indices.to_numpy(), return_counts=True)
        doc = pair // width
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(pair % width)), b.column(0).take(pa.array(doc)), pa.array(tf.astype(np.int64)), pa.array(n[doc].astype(np.int32))], names=["term", "id", "tf", "dl"])


def term_stats(posts: DataFrame, n: int) -> DataFrame:
    """(term, df, idf); a negative idf is replaced by EPSILON times the mean idf of the vocabulary."""
    df = posts.groupBy("term").agg(F.count("*").alias("df"))
    raw = written(df.select("term", "df", (F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw")))
    mean = raw.agg(F.avg("raw")).first()[0] or 0.0
    return raw.select("term", "df", F.when(F.col("raw") < 0, EPSILON * mean).otherwise(F.col("raw")).alias("idf"))


@dataclass(frozen=True)
class BM25Index:
    """Postings (term, id, tf, dl), the corpus figures and the terms (term, df, idf) that a search needs; both tables are written."""

    posts: DataFrame
    n: int
    avgdl: float
    terms: DataFrame | None = None

    def add(self, docs: DataFrame, tokenizer=X.tokens, key: str = "id", text: str = "text") -> BM25Index:
        """With the documents that the index lacks; those it has, and empty ones, are skipped. Known postings aren't written again."""
        new = docs.join(self.posts.select(F.col("id").alias(key)).distinct(), key, "left_anti")
        return _index(written(postings(new, tokenizer, key, text)), new.count(), self)

    def update(self, docs: DataFrame, tokenizer=X.tokens, key: str = "id", text: str = "text") -> BM25Index:
        """The service's rule: a batch of at least as many documents as the index has replaces it, a smaller one is added. Documents without text are skipped."""
        some = docs.where(F.col(text).isNotNull())
        return build_index(some, tokenizer, key, text) if some.count() >= self.n else _index(written(postings(some, tokenizer, key, text)), some.count(), self)


def _index(posts: DataFrame, n: int, old: BM25Index | None = None) -> BM25Index:
    """Documents without a token count in ``n`` and as empty in the mean length."""
    tokens = posts.agg(F.sum("tf")).first()[0] or 0
    if old is not None:
        posts, n, tokens = old.posts.unionByName(posts), old.n + n, old.n * old.avgdl + tokens
    return BM25Index(posts, n, tokens / n if n and tokens else 1.0, term_stats(posts, n))


def build_index(docs: DataFrame, tokenizer=X.tokens, key: str = "id", text: str = "text") -> BM25Index:
    return _index(written(postings(docs, tokenizer, key, text)), docs.count())


def bm25_search(index: BM25Index, queries: DataFrame, k: int = 10, tokenizer=X.tokens, positive_only: bool = False, query: str = "query") -> DataFrame:
    """(query_id, id, score, rank). A query term counts as often as it occurs in the query; unknown terms add nothing.

    ``positive_only`` is the service form, which drops scores of 0 and less; the library form keeps what matches.
    """
    terms = queries.select("query_id", F.explode(tokenizer(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    terms = terms.join(term_stats(index.posts, index.n) if index.terms is None else index.terms, "term")
    hit = index.posts.join(F.broadcast(terms) if small(queries) else terms, "term")
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / index.avgdl))
    scored = hit.groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    return top_k(scored.where("score > 0") if positive_only else scored, k)


def sparse_vectors(df: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(id, term, w): log(1 + tf) weights over word tokens, the offline stand-in for a learned sparse encoder."""
    return postings(df, X.words, key, text).select("id", "term", F.log1p(F.col("tf").cast("double")).alias("w"))


def sparse_search(docs: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", text: str = "text", query: str = "query") -> DataFrame:
    """Inner product of sparse vectors by an inverted-index join."""
    q = sparse_vectors(queries, "query_id", query).select(F.col("id").alias("query_id"), "term", F.col("w").alias("qw"))
    q = F.broadcast(q) if small(queries) else q
    scored = sparse_vectors(docs, key, text).join(q, "term").groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") * F.col("qw")), 6).alias("score"))
    return top_k(scored, k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "id", vector: str = "vector", metric: str = "cosine", block: int = 4_000_000) -> DataFrame:
    """(query_id, id, score, rank): a stated query set against all rows, in blocks.

    Queries are (query_id, vector) and must fit ``MAX_QUERIES``; each task keeps only its own k best of each query, so
    what is shuffled is k rows for each query and task. Vectors that are null, of another length or not finite are left out.
    """
    rows = queries.select("query_id", F.col(vector).cast("array<double>")).limit(MAX_QUERIES + 1).collect()
    if len(rows) > MAX_QUERIES:
        raise ValueError("too many queries for a block search; split the set")
    rows = [r for r in rows if r[1] and all(x is not None for x in r[1])]
    dim = len(rows[0][1]) if rows else 0
    rows = [r for r in rows if len(r[1]) == dim]
    shared = vectors.sparkSession.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows]).reshape(len(rows), dim)))
    key_type, query_type = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()

    def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if metric == "dot":
            return x @ q.T
        if metric == "euclidean":
            return 1 / (1 + np.sqrt(np.maximum(0, (x * x).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * x @ q.T)))
        length = np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None]
        return np.divide(x @ q.T, length, out=np.zeros(length.shape), where=length > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = shared.value
        best: list[tuple[np.ndarray, list]] = [(np.zeros(0), []) for _ in names]
        step = max(1, block // max(1, len(names)))
        for b in batches:
            if not b.num_rows or not names:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            ids = b.column(0).to_pylist()
            for a in range(0, len(x), step):
                s = np.round(score(x[a : a + step], q), 6)
                few = min(k, len(s))
                edge = np.partition(s, len(s) - few, axis=0)[len(s) - few]
                for j in range(len(names)):
                    at = np.flatnonzero(s[:, j] >= edge[j])
                    cand = sorted([*zip(-best[j][0], best[j][1]), *((-s[i, j], ids[a + i]) for i in at)])[:k]
                    best[j] = (-np.array([c[0] for c in cand]), [c[1] for c in cand])
        out = [(n, i, float(s)) for n, (ss, ii) in zip(names, best) for s, i in zip(ss, ii)]
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("query_id", "id", "score"), r)) for r in out])

    good = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return top_k(good.mapInArrow(run, f"query_id {query_type}, id {key_type}, score double"), k)


def feedback_vectors(hits: DataFrame, docs: DataFrame, first: int = 3, key: str = "id", vector: str = "vector", size: int = 20) -> DataFrame:
    """(query_id, vector): the mean of the whole vectors of a query's first hits, where no encoder gives one."""
    whole = (F.size(vector) == size) & F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    near = hits.where(F.col("rank") <= first).select("query_id", F.col("id").alias(key)).join(docs.where(whole).select(key, vector), key)
    each = near.select("query_id", F.posexplode(F.col(vector).cast("array<double>")).alias("place", "x")).groupBy("query_id", "place").agg(F.avg("x").alias("x"))
    return each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda p: p["x"]).alias("vector"))  # size numbers


def index_score(distance: Column) -> Column:
    """The score of a flat index from its distance: 1 less the distance, 0 beyond 1."""
    return F.when(distance <= 1, 1 - distance).otherwise(0.0)


def reciprocal_ranks(hits: DataFrame) -> DataFrame:
    """Hits with 1 / rank as their score, as the command line fuses them a second time."""
    return hits.withColumn("score", F.round(1.0 / F.col("rank"), 6))


def merge_expansions(hits: DataFrame, k: int = 10) -> DataFrame:
    """Hits of several phrasings of a query: the best score of each id; scores of 0 and less vanish."""
    return top_k(hits.groupBy("query_id", "id").agg(F.max("score").alias("score")).where("score > 0"), k)


def lookup(hits: DataFrame, docs: DataFrame, key: str = "id") -> DataFrame:
    """The hits with their documents' columns; ids without a document drop out."""
    return hits.join(docs, hits["id"] == docs[key]) if key != "id" else hits.join(docs, "id")


def blend(hits: DataFrame, other: DataFrame, share: float = 0.3) -> DataFrame:
    """(1 - share) of a hit's score and share of another retriever's; hits that the other lacks keep their score."""
    o = other.select("query_id", "id", F.col("score").alias("other"))
    return hits.join(o, ["query_id", "id"], "left").withColumn("score", F.when(F.col("other").isNotNull(), (1 - share) * F.col("score") + share * F.col("other")).otherwise(F.col("score"))).drop("other")


def metadata_filter(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of equalities, as plain predicates that reach the scan."""
    for name, value in equal.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def recency(score: Column, at: Column, newest: Column, half_life_days: float) -> Column:
    """Score halved for each half-life that a record is older than the newest."""
    return score * F.pow(F.lit(0.5), (newest.cast("double") - at.cast("double")) / (86400 * half_life_days))
