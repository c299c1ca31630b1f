"""The queries of the core, over whole tables, and the SQL that gives the same rows.

A query without SQL is one that SQL can't express or can't run on whole tables; its test compares it with a
plain Python version on a small fixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions import text as X
from ..functions import vectors as V
from ..operators import chunking, dedup, enrich, fusion, hierarchy, learning, rerank, retrieval, tables, validation
from ..sources.io import table
from ..sources.shared import written
from ..streaming import events as E
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        key = name or fn.__name__
        QUERIES[key] = fn
        if sql:
            SQL[key] = sql
        return fn

    return add


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "simulated_vector_db")
    return t.select("id", F.col("content").alias("text"), "vector", "metadata.source", "metadata.chunk_index", "metadata.title", "ingested_at")


def asked(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "query_set")


# ---------------------------------------------------------------- queries' understanding

WORDS = r"regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+')"
TOKENS = r"list_filter(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_-]+'), lambda t: t NOT IN ('and','the','is','in','to','of','a','for','with','on','at'))"
SPLIT = r"regexp_extract_all(lower({c}), '\S+')"
_IN = lambda words: "(" + ",".join(f"'{w}'" for w in words) + ")"


def _n(words: str, among) -> str:
    return f"len(list_filter({words}, lambda x: x IN {_IN(among)}))"


@query(r"""SELECT query_id, trim(regexp_replace(regexp_replace(list_aggregate(list_transform(range(len(parts)), lambda i:
  CASE WHEN i % 2 = 1 AND i < len(parts) - 1 THEN '"' || parts[i+1] || '"'
       ELSE regexp_replace(CASE WHEN i % 2 = 1 THEN '"' || parts[i+1] ELSE parts[i+1] END, '\b(um|uh|well|so|like|you know|i mean|actually)\b', '', 'g') END), 'string_agg', ''),
  '^(can you|could you|please|would you)?\s*(tell me|show me|let me know|find|search for|find out|explain)\s*', ''), '\s+', ' ', 'g')) AS cleaned
FROM (SELECT query_id, string_split(lower(query), '"') AS parts FROM query_set)""")
def query_preprocess(spark, d):
    return asked(spark, d).select("query_id", Q.preprocess(F.col("query")).alias("cleaned"))


_ENTITIES = rf"""list_sort(list_filter(list_distinct(regexp_extract_all({{c}}, '"([^"]*)"', 1) || regexp_extract_all({{c}}, '\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)\b', 1)
  || regexp_extract_all({{c}}, '\b([a-zA-Z]+(?:[_\-][a-zA-Z]+)+)\b', 1) || regexp_extract_all({{c}}, '\b(\d+(?:\.\d+)?)\b', 1)), lambda e: lower(e) NOT IN {_IN(Q.ENTITY_STOPWORDS)}))"""


@query(f"SELECT query_id, array_to_string({_ENTITIES.format(c='query')}, '; ') AS entities FROM query_set")
def query_entities(spark, d):
    return asked(spark, d).select("query_id", F.array_join(Q.entities(F.col("query")), "; ").alias("entities"))


_CX = rf"""SELECT query_id, query, len(w) AS word_count, round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / greatest(1, len(w)), 6) AS avg_word_length,
  len(list_filter(string_split_regex(query, '[.!?]+'), lambda s: regexp_matches(s, '\S'))) AS sentence_count,
  {_n('w', Q.LOGICAL)} AS logical_complexity, {_n('w', Q.QUESTION)} AS question_complexity, {_n('w', Q.TEMPORAL)} AS temporal_references,
  regexp_matches(query, '\d') AS has_numbers, w FROM (SELECT query_id, query, {SPLIT.format(c='query')} AS w FROM query_set)"""
_CX2 = f"SELECT *, (word_count > 12 OR logical_complexity > 1 OR sentence_count > 1) AS is_complex, temporal_references > 0 AS is_temporal FROM ({_CX})"


@query(f"SELECT query_id, word_count, avg_word_length, sentence_count, logical_complexity, question_complexity, temporal_references, has_numbers, is_complex, is_temporal FROM ({_CX2})")
def query_complexity(spark, d):
    return asked(spark, d).select("query_id", Q.complexity(F.col("query")).alias("c")).select("query_id", "c.*")


_AN = rf"""SELECT *, CASE WHEN factual_score > conceptual_score THEN 'factual' WHEN conceptual_score > factual_score THEN 'conceptual' ELSE 'balanced' END AS query_type FROM (
  SELECT *, {_n('list_distinct(w)', Q.FACTUAL)} + quoted AS factual_score, {_n('list_distinct(w)', Q.CONCEPTUAL)} + is_complex::INT AS conceptual_score FROM (
    SELECT *, len(regexp_extract_all(query, '"([^"]*)"', 1)) AS quoted, len({_ENTITIES.format(c='query')}) AS entity_count FROM ({_CX2})))"""


@query(f"""SELECT query_id, factual_score, conceptual_score, query_type, CASE query_type WHEN 'factual' THEN 0.3 WHEN 'conceptual' THEN 0.7 ELSE 0.5 END::DOUBLE AS alpha,
  CASE query_type WHEN 'factual' THEN 'rrf' WHEN 'conceptual' THEN 'softmax' ELSE 'linear' END AS fusion_method, entity_count, quoted,
  (word_count < 8 AND entity_count < 2 AND quoted = 0) AS expansions_needed FROM ({_AN})""")
def query_analysis(spark, d):
    return asked(spark, d).select("query_id", Q.analysis(F.col("query")).alias("a")).select("query_id", "a.*")


def _choices(cases: list[tuple[str, tuple]]) -> str:
    out = "CASE "
    for when, v in cases:
        s = "{" + f"'p': '{v[0]}', 's': {'NULL::VARCHAR' if v[1] is None else repr(v[1])}, 'w': {v[2]}::DOUBLE, 'm': '{v[3]}', 't': {v[4]}::DOUBLE" + "}"
        out += f"WHEN {when} THEN {s} " if when else f"ELSE {s} END"
    return out


_STRATEGY = _choices([("factual_score > conceptual_score AND (entity_count > 0 OR quoted > 0)", ("bm25", "vector", 0.3, "rrf", 0.6)), ("conceptual_score > factual_score AND is_complex", ("vector", "bm25", 0.7, "softmax", 0.4)), ("word_count > 8 AND word_count < 20", ("hybrid", None, 0.5, "linear", 0.5)), ("word_count < 8 AND entity_count < 2", ("hybrid", "expansion", 0.4, "rrf", 0.7)), ("", ("hybrid", None, 0.5, "linear", 0.5))])
_ROUTE = _choices([("query_type = 'factual' AND entity_count > 0", ("bm25", "vector", 0.3, "rrf", 0.6)), ("query_type = 'conceptual' AND is_complex", ("vector", "bm25", 0.7, "softmax", 0.4)), ("is_temporal", ("hybrid", "recency_boost", 0.5, "linear", 0.5)), ("has_numbers", ("bm25", "vector", 0.4, "rrf", 0.6)), ("word_count < 5", ("hybrid", "expansion", 0.4, "logistic", 0.7)), ("logical_complexity > 1", ("hybrid", None, 0.6, "ensemble", 0.5)), ("", ("hybrid", None, 0.5, "linear", 0.5))])
_FIELDS = "s.p AS primary_retriever, s.s AS secondary_retriever, s.w AS fusion_weight, s.m AS fusion_method, s.t AS rerank_threshold"


@query(f"SELECT query_id, {_FIELDS} FROM (SELECT query_id, {_STRATEGY} AS s FROM ({_AN}))")
def query_strategy(spark, d):
    return asked(spark, d).select("query_id", Q.retrieval_strategy(F.col("query")).alias("s")).select("query_id", "s.*")


@query(f"SELECT query_id, {_FIELDS} FROM (SELECT query_id, {_ROUTE} AS s FROM ({_AN}))")
def query_route(spark, d):
    return asked(spark, d).select("query_id", Q.route(F.col("query")).alias("s")).select("query_id", "s.*")


@query(r"""SELECT query_id, CASE WHEN contains(lower(query), 'summary') OR contains(lower(query), 'overview') OR n < 4 THEN 'document' WHEN n > 15 OR s > 2 THEN 'section' ELSE 'chunk' END AS level
FROM (SELECT query_id, query, len(regexp_extract_all(query, '\S+')) AS n, len(regexp_extract_all(query, '[.!?]+')) + 1 AS s FROM query_set)""")
def query_level(spark, d):
    return asked(spark, d).select("query_id", Q.hierarchy_level(F.col("query")).alias("level"))


@query(rf"""SELECT query_id, n AS word_count, s AS sentence_count, round(len(regexp_replace(query, '\s', '', 'g'))::DOUBLE / greatest(1, n), 6) AS avg_word_length, special AS has_special_characters, num AS has_numbers, asked AS is_question, caps AS entity_count, (n > 10 OR s > 1) AS is_complex,
  (caps = 0 AND NOT asked AND n < 5) AS is_broad, {_n('w', ("who", "what", "when", "where", "which", "list", "name"))} AS factual_score, {_n('w', ("why", "how", "explain", "describe", "compare", "analyze", "evaluate"))} AS conceptual_score,
  (list_contains(w, 'vs') OR list_contains(w, 'versus') OR contains(lower(query), 'compare')) AS diversity_needed
FROM (SELECT query_id, query, len(regexp_extract_all(query, '\S+')) AS n, len(regexp_extract_all(query, '[.!?]+')) + 1 AS s, regexp_matches(query, '[^a-zA-Z0-9\s]') AS special, regexp_matches(query, '\d') AS num,
  (ends_with(trim(query), '?') OR regexp_matches(lower(query), '^(who|what|when|where|why|how)')) AS asked, len(regexp_extract_all(query, '\b([A-Z][a-zA-Z]*)\b')) AS caps, list_distinct({SPLIT.format(c='query')}) AS w FROM query_set)""")
def query_features(spark, d):
    return asked(spark, d).select("query_id", Q.selector_features(F.col("query")).alias("f")).select("query_id", "f.*")


_OTHER = rf"""SELECT *, CASE WHEN f > k THEN 1 WHEN k > f THEN 2 ELSE 3 END AS kind FROM (SELECT query_id, query, n, quoted, ends, {{f}} AS f, {{k}} AS k FROM (
  SELECT query_id, query, list_distinct({SPLIT.format(c='query')}) AS w, len(regexp_extract_all(query, '\S+')) AS n, len(regexp_extract_all(query, '"([^"]*)"', 1)) AS quoted, len(regexp_extract_all(query, '[.!?]+')) AS ends FROM query_set))"""
_CLI = _OTHER.format(f=f"{_n('w', Q.SERVICE_FACTUAL)} + quoted", k=f"{_n('w', Q.SERVICE_FACTUAL)} + (n > 15)::INT")
_SERVICE = _OTHER.format(f=_n("w", Q.SERVICE_FACTUAL), k=_n("w", Q.SERVICE_CONCEPTUAL))
_CLI_ENTITIES = _ENTITIES.format(c="query").replace(f"lower(e) NOT IN {_IN(Q.ENTITY_STOPWORDS)}", "true")


@query(f"""SELECT query_id, [0.3, 0.7, 0.5][kind]::DOUBLE AS alpha, ['hybrid_bm25_heavy', 'hybrid_vector_heavy', 'hybrid_balanced'][kind] AS metric, (n < 8 AND len({_CLI_ENTITIES}) < 2 AND quoted = 0) AS expansions_needed FROM ({_CLI})""")
def query_analysis_cli(spark, d):
    return asked(spark, d).select("query_id", Q.analysis_cli(F.col("query")).alias("a")).select("query_id", "a.*")


@query(rf"""SELECT query_id, ['factual', 'conceptual', 'balanced'][kind] AS query_type, [0.3, 0.7, 0.5][kind]::DOUBLE AS alpha, ['rrf', 'softmax', 'linear'][kind] AS fusion_method, ['bm25', 'vector', 'hybrid'][kind] AS primary_retriever,
  ['vector', 'bm25', NULL][kind] AS secondary_retriever, CASE kind WHEN 1 THEN false WHEN 2 THEN true ELSE hard END AS use_colbert, CASE kind WHEN 1 THEN found > 0 WHEN 2 THEN false ELSE true END AS use_splade,
  CASE kind WHEN 1 THEN CASE WHEN found > 1 THEN 'mmr' END WHEN 2 THEN 'context_aware' ELSE CASE WHEN hard THEN 'diversity' ELSE 'mmr' END END AS rerank_method, found AS entity_count, ends + 1 AS sentence_count, hard AS is_complex
FROM (SELECT *, quoted + len(regexp_extract_all(query, '\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)\b', 1)) AS found, (n > 10 OR ends > 1) AS hard FROM ({_SERVICE}))""")
def query_analysis_service(spark, d):
    return asked(spark, d).select("query_id", Q.analysis_service(F.col("query")).alias("a")).select("query_id", "a.*")


# ---------------------------------------------------------------- retrieval


def _bm25_sql(corpus: str, tok: str, positive: bool = False, k: int = 10) -> str:
    return rf"""WITH toks AS (SELECT id, {tok.format(c="coalesce(text, '')")} AS ts FROM ({corpus})),
  stats AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM toks),
  posts AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, len(ts) AS dl, unnest(ts) AS term FROM toks) GROUP BY ALL),
  dfs AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM posts GROUP BY term), stats),
  idfs AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM dfs) ELSE raw END AS idf FROM dfs),
  qs AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tok.format(c='query')}) AS term FROM query_set) GROUP BY ALL),
  scored AS (SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM posts JOIN qs USING (term) JOIN idfs USING (term), stats GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored {'WHERE score > 0' if positive else ''} QUALIFY rank <= {k}"""


_DOCS = "SELECT doc_id AS id, text FROM documents"
_CHUNKS = "SELECT id, content AS text FROM simulated_vector_db"


def _bm25(spark, d, **options):
    index = retrieval.build_index(docs(spark, d).select(F.col("doc_id").alias("id"), "text"), tokenizer=options.get("tokenizer", X.tokens))
    return retrieval.bm25_search(index, asked(spark, d), **options)


@query(_bm25_sql(_DOCS, TOKENS))
def bm25_search(spark, d):
    return _bm25(spark, d)


@query(_bm25_sql(_DOCS, WORDS, True))
def bm25_search_service(spark, d):
    return _bm25(spark, d, tokenizer=X.words, positive_only=True)


@query(rf"""WITH posts AS (SELECT DISTINCT id, unnest({TOKENS.format(c='text')}) AS term FROM ({_DOCS}))
SELECT term, count(*) AS df FROM posts GROUP BY term""")
def bm25_vocabulary(spark, d):
    p = retrieval.postings(docs(spark, d), key="doc_id")
    return p.groupBy("term").agg(F.count("*").alias("df"))


@query(rf"""WITH dw AS (SELECT id, term, ln(1 + count(*)) AS w FROM (SELECT id, unnest({WORDS.format(c='text')}) AS term FROM ({_CHUNKS})) GROUP BY ALL),
  qw AS (SELECT query_id, term, ln(1 + count(*)) AS qw FROM (SELECT query_id, unnest({WORDS.format(c='query')}) AS term FROM query_set) GROUP BY ALL),
  scored AS (SELECT query_id, id, round(sum(w * qw), 6) AS score FROM dw JOIN qw USING (term) GROUP BY ALL)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10""")
def sparse_search(spark, d):
    return retrieval.sparse_search(chunks(spark, d), asked(spark, d))


_E = "SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings"


def _dense_sql(expr: str) -> str:
    return f"""WITH q AS (SELECT vec_id AS query_id, v AS qv FROM ({_E}) WHERE vec_id % 100 = 0),
  scored AS (SELECT query_id, vec_id AS id, round({expr}, 6) AS score FROM q, ({_E}))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10"""


def _dense(spark, d, metric):
    e = table(spark, d, "embeddings")
    q = e.where(F.col("vec_id") % 100 == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return retrieval.dense_top_k(e.select("vec_id", F.col("embedding").alias("vector")), q, 10, "vec_id", "vector", metric)


@query(_dense_sql("list_cosine_similarity(qv, v)"))
def dense_search(spark, d):
    return _dense(spark, d, "cosine")


@query(_dense_sql("list_dot_product(qv, v)"))
def dense_search_dot(spark, d):
    return _dense(spark, d, "dot")


@query(_dense_sql("1 / (1 + list_distance(qv, v))"))
def dense_search_euclidean(spark, d):
    return _dense(spark, d, "euclidean")


@query(f"""SELECT label, count(*) AS n, round(avg(list_cosine_similarity(v, c)), 5) AS mean_cosine FROM (SELECT label, embedding::DOUBLE[] AS v, first_value(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS c FROM embeddings) GROUP BY label""")
def similarity_to_first(spark, d):
    """Mean cosine of the vectors of a label to its first one."""
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>"))
    first = e.groupBy("label").agg(F.min_by("v", "vec_id").alias("c"))
    return e.join(first, "label").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(V.cosine(F.col("v"), F.col("c"))), 5).alias("mean_cosine"))


# ---------------------------------------------------------------- fusion

_LONG = """WITH req AS (SELECT DISTINCT request_id, greatest(0, least(1, coalesce(strategy.alpha, 0.5))) AS alpha, vector_results AS v, bm25_results AS b{more} FROM fusion_request),
  raw AS (SELECT request_id, alpha, 'vector' AS list, unnest(v) AS h FROM req UNION ALL SELECT request_id, alpha, 'bm25', unnest(b) FROM req{third}),
  hits AS (SELECT request_id, alpha, list, h.id AS id, max(h.score) AS score FROM raw WHERE h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score) GROUP BY ALL),
  n AS (SELECT *, row_number() OVER (PARTITION BY request_id, list ORDER BY score DESC, id) AS rank, count(*) OVER (PARTITION BY request_id, list) AS n,
    min(score) OVER (PARTITION BY request_id, list) AS lo, max(score) OVER (PARTITION BY request_id, list) AS hi FROM hits),
  s AS (SELECT *, exp((score - hi) / 0.1) / sum(exp((score - hi) / 0.1)) OVER (PARTITION BY request_id, list) AS soft FROM n)"""
_LONG2 = _LONG.format(more="", third="")
_LONG3 = _LONG.format(more=", splade_results AS p", third=" UNION ALL SELECT request_id, alpha, 'splade', unnest(p) FROM req")


def _two_sql(value: str) -> str:
    return f"""SELECT request_id, id, alpha, coalesce(max(CASE WHEN list = 'vector' THEN {value} END), 0) AS v, coalesce(max(CASE WHEN list = 'bm25' THEN {value} END), 0) AS b FROM s GROUP BY request_id, id, alpha"""


_MM = "CASE WHEN hi > lo THEN (score - lo) / (hi - lo) ELSE {c} END"
_WEIGHTED = "SELECT request_id, id, round(alpha * v + (1 - alpha) * b, 6) AS score FROM ({two})"
_LOGISTIC = f"CASE WHEN hi > lo THEN 1 / (1 + exp(-({_MM.format(c='0.5')} - 0.5))) ELSE 0.5 END"
_RRF_TWO = """SELECT request_id, id, alpha, 1.0 / (60 + coalesce(max(CASE WHEN list = 'vector' THEN rank END), nv + 1)) AS v, 1.0 / (60 + coalesce(max(CASE WHEN list = 'bm25' THEN rank END), nb + 1)) AS b
  FROM s JOIN (SELECT request_id, coalesce(max(CASE WHEN list = 'vector' THEN n END), 0) AS nv, coalesce(max(CASE WHEN list = 'bm25' THEN n END), 0) AS nb FROM s GROUP BY request_id) USING (request_id) GROUP BY request_id, id, alpha, nv, nb"""


def _long(spark, d, lists=("vector", "bm25")):
    return fusion.long_lists(table(spark, d, "fusion_request"), lists)


def _fusion(name: str, sql: str, fn) -> None:
    query(sql, name)(fn)


_fusion("fuse_linear", f"{_LONG2} {_WEIGHTED.format(two=_two_sql(_MM.format(c='0.5')))}", lambda s, d: fusion.linear(_long(s, d)))
_fusion("fuse_linear_service", f"{_LONG2} {_WEIGHTED.format(two=_two_sql(_MM.format(c='1.0')))}", lambda s, d: fusion.linear(_long(s, d), 1.0))
_fusion("fuse_softmax", f"{_LONG2} {_WEIGHTED.format(two=_two_sql('soft'))}", lambda s, d: fusion.softmax(_long(s, d)))
_fusion("fuse_logistic", f"{_LONG2} {_WEIGHTED.format(two=_two_sql(_LOGISTIC))}", lambda s, d: fusion.logistic(_long(s, d)))
_fusion("fuse_rrf", f"{_LONG2} {_WEIGHTED.format(two=_RRF_TWO)}", lambda s, d: fusion.rrf(_long(s, d)))
_fusion("fuse_rrf_baseline", f"{_LONG2} {_WEIGHTED.format(two=_two_sql('1.0 / (60 + rank)'))}", lambda s, d: fusion.rrf(_long(s, d), missing="zero"))
_fusion("fuse_max", f"{_LONG2} SELECT request_id, id, round(max({_MM.format(c='1.0')}), 6) AS score FROM s GROUP BY request_id, id", lambda s, d: fusion.maximum(_long(s, d)))
_fusion("fuse_harmonic", f"{_LONG2} SELECT request_id, id, round(1 / (alpha / greatest(v, 1e-4) + (1 - alpha) / greatest(b, 1e-4)), 6) AS score FROM ({_two_sql(_MM.format(c='1.0'))})", lambda s, d: fusion.harmonic(_long(s, d)))
_fusion(
    "fuse_three_way",
    f"""{_LONG3} SELECT request_id, id, round(sum(CASE list WHEN 'vector' THEN alpha WHEN 'bm25' THEN CASE WHEN third THEN 0.6 * (1 - alpha) ELSE 1 - alpha END ELSE 0.4 * (1 - alpha) END * ({_MM.format(c='1.0')})), 6) AS score
  FROM (SELECT *, bool_or(list = 'splade') OVER (PARTITION BY request_id) AS third FROM s) GROUP BY request_id, id""",
    lambda s, d: fusion.three_way(_long(s, d, ("vector", "bm25", "splade"))),
)
_W3 = "CASE list WHEN 'vector' THEN alpha WHEN 'bm25' THEN CASE WHEN third THEN 0.6 * (1 - alpha) ELSE 1 - alpha END ELSE 0.4 * (1 - alpha) END"
_S3 = f"SELECT *, bool_or(list = 'splade') OVER (PARTITION BY request_id) AS third, {_MM.format(c='1.0')} AS mm FROM s"
_fusion(
    "fuse_softmax_service",
    f"{_LONG3} SELECT request_id, id, round(sum({_W3} * e), 6) AS score FROM (SELECT *, exp(10 * mm) / sum(exp(10 * mm)) OVER (PARTITION BY request_id, list) AS e FROM ({_S3})) GROUP BY request_id, id",
    lambda s, d: fusion.softmax_service(_long(s, d, ("vector", "bm25", "splade"))),
)
_fusion(
    "fuse_rrf_service",
    f"""{_LONG3}, ids AS (SELECT DISTINCT request_id, alpha, id FROM s), z AS (SELECT request_id, bool_or(list = 'splade') AS third, coalesce(max(CASE WHEN list = 'vector' THEN n END), 0) AS nv, coalesce(max(CASE WHEN list = 'bm25' THEN n END), 0) AS nb, coalesce(max(CASE WHEN list = 'splade' THEN n END), 0) AS ns FROM s GROUP BY request_id),
  p AS (SELECT i.request_id, i.alpha, i.id, third, 1 / (60 + coalesce(v.rank, nv + 1)) AS v, 1 / (60 + coalesce(b.rank, nb + 1)) AS b, 1 / (60 + coalesce(q.rank, ns + 1)) AS q FROM ids i JOIN z ON z.request_id = i.request_id
    LEFT JOIN s v ON v.request_id = i.request_id AND v.id = i.id AND v.list = 'vector' LEFT JOIN s b ON b.request_id = i.request_id AND b.id = i.id AND b.list = 'bm25' LEFT JOIN s q ON q.request_id = i.request_id AND q.id = i.id AND q.list = 'splade')
SELECT request_id, id, round(alpha * v + CASE WHEN third THEN (1 - alpha) * (0.6 * b + 0.4 * q) ELSE (1 - alpha) * b END, 6) AS score FROM p""",
    lambda s, d: fusion.rrf_service(_long(s, d, ("vector", "bm25", "splade"))),
)
_fusion(
    "fuse_ensemble",
    f"""{_LONG2} SELECT request_id, id, round(sum(score) / 3, 6) AS score FROM ({_WEIGHTED.format(two=_two_sql(_MM.format(c='0.5')))} UNION ALL {_WEIGHTED.format(two=_two_sql('soft'))} UNION ALL {_WEIGHTED.format(two=_RRF_TWO)}) GROUP BY request_id, id""",
    lambda s, d: fusion.ensemble(_long(s, d)),
)


# ---------------------------------------------------------------- reranking


def _hits(spark, d):
    """The hybrid hits of the requests, with their chunks' text and vector."""
    return fusion.linear(_long(spark, d)).withColumnRenamed("request_id", "query_id").join(chunks(spark, d).select("id", "text", "vector", F.col("source").alias("category")), "id")


@query(f"""{_LONG2}, lin AS ({_WEIGHTED.format(two=_two_sql(_MM.format(c='0.5')))}),
  h AS (SELECT request_id AS query_id, lin.id, score, coalesce(metadata.source, 'unknown') AS cat FROM lin JOIN simulated_vector_db c ON lin.id = c.id),
  t AS (SELECT *, row_number() OVER (PARTITION BY query_id, cat ORDER BY score DESC, id) AS turn FROM h),
  p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY turn, cat) - 1 AS place, count(*) OVER (PARTITION BY query_id) AS n FROM t)
SELECT query_id, id, round(0.8 * score + 0.2 * (1 - place / n), 6) AS score, place + 1 AS rank FROM p""")
def rerank_categories(spark, d):
    return rerank.category_diversity(_hits(spark, d))


@query(f"""{_LONG2}, lin AS ({_WEIGHTED.format(two=_two_sql(_MM.format(c='0.5')))}),
  h AS (SELECT request_id AS query_id, lin.id, score, (length(replace(left(replace(coalesce(content, ''), chr(10), ' '), 1000), chr(0), '')) // 4) + 1 AS tokens FROM lin JOIN simulated_vector_db c ON lin.id = c.id)
SELECT query_id, id, tokens, sum(tokens) OVER (PARTITION BY query_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM h QUALIFY used <= 1000""")
def context_packing(spark, d):
    return rerank.pack_context(_hits(spark, d).select("query_id", "id", "score", "text"), 1000).select("query_id", "id", "tokens", "used")


@query(f"""WITH RECURSIVE {_LONG2[5:]}, lin AS ({_WEIGHTED.format(two=_two_sql(_MM.format(c='0.5')))}),
  h AS (SELECT request_id AS query_id, lin.id, (length(replace(left(replace(coalesce(content, ''), chr(10), ' '), 1000), chr(0), '')) // 4) + 1 AS tokens, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, lin.id) AS rn FROM lin JOIN simulated_vector_db c ON lin.id = c.id),
  t AS (SELECT query_id, 0::BIGINT AS rn, 0::BIGINT AS sofar, NULL::VARCHAR AS id, -1::BIGINT AS place FROM h WHERE rn = 1
    UNION ALL SELECT h.query_id, h.rn, CASE WHEN sofar + tokens <= 1000 THEN sofar + tokens ELSE sofar END, CASE WHEN sofar + tokens <= 1000 THEN h.id END, CASE WHEN sofar + tokens <= 1000 THEN place + 1 ELSE place END FROM t JOIN h ON h.query_id = t.query_id AND h.rn = t.rn + 1)
SELECT query_id, max(sofar) OVER (PARTITION BY query_id) AS used, place::INT AS place, id FROM t QUALIFY id IS NOT NULL""")
def context_packing_skipping(spark, d):
    return rerank.pack_context_skipping(_hits(spark, d).select("query_id", "id", "score", "text"), 1000)


@query()
def rerank_mmr(spark, d):
    return rerank.mmr(_hits(spark, d), size=20)


@query()
def rerank_clusters(spark, d):
    return rerank.cluster_diversity(_hits(spark, d), size=20)


@query(f"""{_LONG2}, lin AS ({_WEIGHTED.format(two=_two_sql(_MM.format(c='0.5')))}),
  qs AS (SELECT DISTINCT request_id, query_text FROM fusion_request),
  h AS (SELECT request_id AS query_id, lin.id, score, lower(coalesce(content, '')) AS low, lower(query_text) AS q, list_distinct({WORDS.format(c='query_text')}) AS w FROM lin JOIN simulated_vector_db c ON lin.id = c.id JOIN qs USING (request_id)),
  r AS (SELECT *, CASE WHEN len(w) > 0 THEN len(list_filter(w, lambda x: contains(low, x))) / len(w) ELSE 0 END AS share,
    CASE WHEN len(w) > 0 THEN list_max(list_transform(string_split_regex(low, '\\n\\s*\\n'), lambda p: len(list_filter(w, lambda x: contains(p, x))) / len(w))) ELSE 0 END AS best FROM h)
SELECT query_id, id, round(0.6 * score + 0.4 * (0.5 * share + 0.3 * contains(low, q)::INT + 0.2 * best), 6) AS score FROM r""".replace("\\\\n", "\\n").replace("\\\\s", "\\s"))
def rerank_context(spark, d):
    q = table(spark, d, "fusion_request").select(F.col("request_id").alias("query_id"), F.col("query_text").alias("query")).distinct()
    return rerank.context_aware(_hits(spark, d).join(q, "query_id")).select("query_id", "id", "score")


_WHOLE = "len(vector) = 20 AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"


@query(f"""WITH b AS ({_bm25_sql(_CHUNKS, TOKENS, k=20)}), c AS (SELECT id, vector FROM simulated_vector_db WHERE {_WHOLE}),
  e AS (SELECT query_id, unnest(vector) AS x, unnest(range(1, 21)) AS place FROM b JOIN c USING (id) WHERE rank <= 3), m AS (SELECT query_id, place, avg(x) AS x FROM e GROUP BY ALL),
  v AS (SELECT query_id, list(x ORDER BY place) AS v FROM m GROUP BY query_id),
  f AS (SELECT query_id, id, round(CASE WHEN list_sum(list_transform(vector, lambda x: x * x)) > 0 THEN list_cosine_similarity(v, vector) ELSE 0 END, 6) AS score FROM v, c),
  d AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM f QUALIFY rank <= 20),
  a AS (SELECT query_id, CASE query_type WHEN 'factual' THEN 0.3 WHEN 'conceptual' THEN 0.7 ELSE 0.5 END::DOUBLE AS alpha FROM ({_AN})),
  u AS (SELECT query_id, id, max(rv) AS rv, max(rb) AS rb FROM (SELECT query_id, id, rank AS rv, NULL AS rb FROM d UNION ALL SELECT query_id, id, NULL, rank FROM b) GROUP BY ALL),
  n AS (SELECT query_id, count(rv) AS nv, count(rb) AS nb FROM u GROUP BY query_id),
  r AS (SELECT query_id, id, round(alpha * (1.0 / (60 + coalesce(rv, nv + 1))) + (1 - alpha) * (1.0 / (60 + coalesce(rb, nb + 1))), 6) AS score FROM u JOIN n USING (query_id) JOIN a USING (query_id))
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 10""")
def hybrid_search(spark, d):
    """BM25 and dense hits of each query, fused by reciprocal ranks with the weight that the query's analysis gives.

    No encoder is at hand, so a query's vector is the mean of those of its first three lexical hits.
    """
    c, q = chunks(spark, d), asked(spark, d)
    found = written(retrieval.bm25_search(retrieval.build_index(c), q, 20))
    dense = retrieval.dense_top_k(c, retrieval.feedback_vectors(found, c), 20).select("query_id", "id", "score", F.lit("vector").alias("list"))
    alpha = q.select("query_id", Q.analysis(F.col("query"))["alpha"].alias("alpha"))
    long = dense.unionByName(found.select("query_id", "id", "score", F.lit("bm25").alias("list"))).join(alpha, "query_id").withColumnRenamed("query_id", "request_id")
    return retrieval.top_k(fusion.rrf(long).withColumnRenamed("request_id", "query_id"), 10)


# ---------------------------------------------------------------- enrichment


@query(rf"""SELECT doc_id, CASE WHEN p + g > 0 AND (p - g)::DOUBLE / (p + g) > 0.25 THEN 'positive' WHEN p + g > 0 AND (p - g)::DOUBLE / (p + g) < -0.25 THEN 'negative' ELSE 'neutral' END AS sentiment,
  round(CASE WHEN p + g > 0 THEN (p - g)::DOUBLE / (p + g) ELSE 0 END, 2) AS score
FROM (SELECT doc_id, {_n('w', X.POSITIVE)} AS p, {_n('w', X.NEGATIVE)} + {_n('w', ('difficult',))} AS g FROM (SELECT doc_id, {WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL))""")
def text_sentiment(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", X.sentiment(F.col("text")).alias("s")).select("doc_id", "s.*")


@query("SELECT doc_id, " + ", ".join("(" + " + ".join(f"(length(low) - length(replace(low, '{k}', ''))) // {len(k)}" for k in keys) + f")::INT AS {topic}" for topic, keys in X.TOPICS.items()) + " FROM (SELECT doc_id, lower(text) AS low FROM documents WHERE text IS NOT NULL)")
def text_topics(spark, d):
    s = docs(spark, d).where("text is not null").select("doc_id", X.topic_scores(F.col("text")).alias("s"))
    return s.select("doc_id", *(F.col("s")[t].cast("int").alias(t) for t in X.TOPICS))


@query(r"""SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i)\b(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4}|\d{1,2}\s+(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\.?\s+\d{4})\b', 1))), ',') AS dates FROM documents WHERE text IS NOT NULL""")
def text_date_mentions(spark, d):
    found = F.regexp_extract_all(F.col("text"), F.lit(X.DATE), F.lit(1))
    return docs(spark, d).where("text is not null").select("doc_id", F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("dates"))


@query(r"""SELECT doc_id, count(*) AS dates, min(x) AS earliest, max(x) AS latest FROM (SELECT DISTINCT doc_id, strftime(try_strptime(m, ['%Y-%m-%d', '%Y/%m/%d']), '%Y-%m-%d') AS x
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(\d{4}[-/]\d{1,2}[-/]\d{1,2})\b', 1)) AS m FROM documents WHERE text IS NOT NULL)) WHERE x >= '1900-01-01' AND x < '2027-12-32' GROUP BY doc_id""")
def text_dates(spark, d):
    t = docs(spark, d).where("text is not null").select("doc_id", X.dates(F.col("text")).alias("ds")).where(F.size("ds") > 0)
    return t.select("doc_id", F.size("ds").alias("dates"), F.array_min("ds").alias("earliest"), F.array_max("ds").alias("latest"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '(?m)^#+\s+.+$|^[A-Z][A-Za-z0-9\s]+:$')) AS section_count, n > 0 AS has_lists, n AS list_count,
  len(list_filter(string_split_regex(text, '\n\s*\n'), lambda p: regexp_matches(p, '\S'))) AS paragraph_count
FROM (SELECT doc_id, text, len(regexp_extract_all(text, '(?m)^\s*\d+\.\s+[\p{L}\p{N}_]+')) + len(regexp_extract_all(text, '(?m)^\s*[-*•]\s+[\p{L}\p{N}_]+')) AS n FROM documents WHERE text IS NOT NULL)""")
def text_structure(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", X.structure(F.col("text")).alias("s")).select("doc_id", "s.*")


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(text, '^#\s+|\n#{1,6}\s+') THEN 'markdown' WHEN regexp_matches(text, '<html|<body|<div|<p>|<h[1-6]') THEN 'html'
  WHEN regexp_matches(text, 'def\s+[\p{L}\p{N}_]+\s*\(|class\s+[\p{L}\p{N}_]+\s*[:(]|import\s+[\p{L}\p{N}_]+|from\s+[\p{L}\p{N}_]+\s+import') THEN 'code'
  WHEN regexp_matches(text, '\b(?:Dear|To Whom It May Concern|Sincerely|Regards)[,:]') THEN 'letter' WHEN regexp_matches(text, '\b(?:Abstract|Introduction|Methodology|Results|Conclusion|References)\b') THEN 'academic'
  WHEN regexp_matches(text, '\b(?:Table of Contents|Chapter \d+)\b') THEN 'book' ELSE 'text' END AS document_type FROM documents WHERE text IS NOT NULL""")
def text_document_type(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", X.document_type(F.col("text")).alias("document_type"))


@query(r"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, 'https?://(?:[-\w.]|(?:%[\da-fA-F]{2}))+[/\w\.-]*(?:\?\S+)?'))) AS urls,
  len(list_distinct(regexp_extract_all(text, '\$\s*\d+(?:[,.]\d+)*(?:\s*(?:thousand|million|billion|trillion))?|\d+(?:[,.]\d+)*\s*(?:USD|EUR|GBP|JPY|CHF|CAD|AUD|CNY|HKD|NZD|KRW)'))) AS money,
  len(list_distinct(regexp_extract_all(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'))) AS emails FROM documents WHERE text IS NOT NULL""")
def text_entities(spark, d):
    t = docs(spark, d).where("text is not null").select("doc_id", X.entities(F.col("text")).alias("e"))
    count = lambda k: F.when(F.col("e")[k].isNotNull(), F.size(F.col("e")[k])).otherwise(0)
    return t.select("doc_id", count("URL").alias("urls"), count("MONEY").alias("money"), count("EMAIL").alias("emails"))


@query(rf"""SELECT doc_id, round(CASE WHEN length(text) < 10 OR len(ls) = 0 THEN 0.5 ELSE 0.4 * length(regexp_replace(text, '\s', '', 'g')) / length(text) + 0.3 * least(1.0, list_sum(list_transform(ls, lambda x: length(x))) / len(ls) / 100)
  + 0.3 * CASE WHEN len(w) > 0 THEN len(list_distinct(w)) / len(w) ELSE 0.5 END END, 5) AS density
FROM (SELECT doc_id, text, list_filter(string_split_regex(text, '\r\n|\r|\n'), lambda x: length(trim(x, ' ')) > 5) AS ls, {WORDS.format(c='text')} AS w FROM documents WHERE text IS NOT NULL)""")
def text_density(spark, d):
    return docs(spark, d).where("text is not null").select("doc_id", F.round(X.density(F.col("text")), 5).alias("density"))


def _names_sql(words) -> str:
    return "len(list_distinct(" + " || ".join(rf"list_transform(regexp_extract_all(text, '\b([A-Z][A-Za-z0-9\s&''-]+)\s+{w}\b', 1), lambda x: x || ' {w}')" for w in words) + "))"


@query(rf"""SELECT doc_id, len(list_distinct(regexp_extract_all(text, '{X.PHONE}'))) AS phones, {_names_sql(X.ORGANISATIONS)} AS organisations, {_names_sql(X.PLACES)} AS places FROM documents WHERE text IS NOT NULL""")
def text_names(spark, d):
    t = docs(spark, d).where("text is not null").select("doc_id", F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(X.PHONE), F.lit(0)))).alias("phones"), F.size(X.names_before(F.col("text"), X.ORGANISATIONS)).alias("organisations"), F.size(X.names_before(F.col("text"), X.PLACES)).alias("places"))
    return t


@query(r"""SELECT doc_id, len(list_distinct(list_transform(regexp_extract_all(text, '\[(\d+)\]', 1), lambda x: '[' || x || ']'))) AS numbered, len(list_distinct(regexp_extract_all(text, '\(([A-Z][a-z]+(?:[-\s][A-Z][a-z]+)*)(?:[\s,]+(?:et al\.?|and)[\s,]+[A-Z][a-z]+)*[\s,]+(\d{4})\)'))) > 0 AS has_author_year FROM documents WHERE text IS NOT NULL""")
def text_references(spark, d):
    r = docs(spark, d).where("text is not null").select("doc_id", X.references(F.col("text")).alias("r"))
    return r.select("doc_id", F.size(F.filter("r", lambda x: x.rlike(r"^\[\d+\]$"))).alias("numbered"), F.exists("r", lambda x: x.rlike(r"^[A-Z][a-z]+(?:[-\s][A-Z][a-z]+)*, \d{4}$")).alias("has_author_year"))


@query()
def rich_metadata(spark, d):
    m = enrich.rich_metadata(docs(spark, d).select("doc_id", "text"))
    return m.select("doc_id", "meta.document_type", "meta.earliest", "meta.latest", F.array_join("meta.topics", ",").alias("topics"), "meta.sentiment.sentiment", "meta.statistics.word_count", "meta.content_hash", "meta.confidence")


@query()
def numeric_data(spark, d):
    t = docs(spark, d).where("text is not null").select("doc_id", F.explode(enrich.numeric_data(F.col("text"))).alias("n"))
    return t.select("doc_id", "n.*").groupBy("type", "unit").agg(F.count("*").alias("n"), F.countDistinct("value").alias("values"))


@query()
def minhash_similarity(spark, d):
    """Estimated and exact Jaccard similarity of each near-duplicate pair."""
    t = docs(spark, d).select("doc_id", "text")
    pairs = written(dedup.near_duplicates(t, 0.85, "token", "doc_id"))
    w = written(dedup.rows_of(t, pairs, "doc_id").select("doc_id", F.array_distinct(X.words(F.col("text"))).alias("w")))  # once for all permutations
    sig = written(w.select("doc_id", dedup.minhash(F.col("w"), 64).alias("s")))
    both = pairs.join(sig.select(F.col("doc_id").alias("a"), F.col("s").alias("x")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("s").alias("y")), "b")
    return both.select("a", "b", F.round("similarity", 6).alias("similarity"), dedup.signature_similarity(F.col("x"), F.col("y")).alias("estimate"))


_COUNTS = ", ".join(f"len(list_filter(w, lambda x: x IN {_IN(ws)})) AS {lang}" for lang, ws in enrich.PROFILES.items())


@query(rf"""WITH c AS (SELECT doc_id, text, {_COUNTS} FROM (SELECT doc_id, text, {WORDS.format(c='text')} AS w FROM documents)), m AS (SELECT *, greatest(en, fr, de, es) AS n FROM c)
SELECT doc_id, CASE WHEN length(text) >= 20 AND n > 0 THEN CASE n WHEN fr THEN 'fr' WHEN es THEN 'es' WHEN en THEN 'en' ELSE 'de' END END AS lang,
  CASE WHEN length(text) >= 20 AND n > 0 THEN round(n / (en + fr + de + es), 6) END AS share FROM m""")
def language_detection(spark, d):
    return docs(spark, d).select("doc_id", enrich.language(F.col("text")).alias("l")).select("doc_id", "l.lang", F.round("l.share", 6).alias("share"))


@query("""SELECT id, lag(id) OVER w AS neighbor_prev, lead(id) OVER w AS neighbor_next FROM simulated_vector_db WHERE metadata.chunk_index IS NOT NULL WINDOW w AS (PARTITION BY metadata.source ORDER BY metadata.chunk_index, id)""")
def chunk_neighbours(spark, d):
    c = chunks(spark, d).where("chunk_index is not null")
    return enrich.with_neighbours(c).select("id", "neighbor_prev", "neighbor_next")


@query()
def token_batches(spark, d):
    return enrich.token_batches(docs(spark, d), key="doc_id")


# ---------------------------------------------------------------- deduplication

_HASH = f"CASE WHEN trim(regexp_replace(lower(coalesce(text, '')), '{X.SPACE}', ' ', 'g')) = '' THEN '' ELSE sha256(trim(regexp_replace(lower(text), '{X.SPACE}', ' ', 'g'))) END"


@query(f"SELECT h AS hash, min(doc_id) AS first_id, count(*) AS copies FROM (SELECT doc_id, {_HASH} AS h FROM documents) WHERE h <> '' GROUP BY h HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return dedup.exact_groups(docs(spark, d), "doc_id")


@query(f"SELECT doc_id FROM (SELECT doc_id, {_HASH} AS h FROM documents) QUALIFY h = '' OR row_number() OVER (PARTITION BY h ORDER BY doc_id) = 1")
def without_exact_duplicates(spark, d):
    return dedup.drop_exact(docs(spark, d), "doc_id").select("doc_id")


_NEAR = rf"""w AS (SELECT doc_id, list_sort(list_distinct({WORDS.format(c='text')})) AS s FROM documents WHERE text IS NOT NULL),
  r AS (SELECT s, min(doc_id) AS rep FROM w WHERE len(s) > 0 GROUP BY s),
  near AS (SELECT x.rep AS a, y.rep AS b, len(list_intersect(x.s, y.s)) AS n, len(x.s) + len(y.s) AS m FROM r x JOIN r y ON x.rep < y.rep AND least(len(x.s), len(y.s)) >= 0.85 * greatest(len(x.s), len(y.s))),
  pairs AS (SELECT a, b, n / (m - n) AS similarity FROM near WHERE n >= 0.85 * (m - n) - 1e-9 UNION ALL SELECT rep, doc_id, 1.0 FROM w JOIN r USING (s) WHERE doc_id <> rep)"""


@query(f"WITH {_NEAR} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def near_duplicates(spark, d):
    return dedup.near_duplicates(docs(spark, d), 0.85, "token", "doc_id").select("a", "b", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH RECURSIVE {_NEAR}, e AS (SELECT a AS x, b AS y FROM pairs UNION SELECT b, a FROM pairs), reach AS (SELECT x AS id, x AS root FROM e UNION SELECT e.y, reach.root FROM reach JOIN e ON e.x = reach.id)
SELECT id, min(root) AS cluster FROM reach GROUP BY id""")
def duplicate_clusters(spark, d):
    return dedup.clusters(dedup.near_duplicates(docs(spark, d), 0.85, "token", "doc_id"))


# ---------------------------------------------------------------- chunks and tables


def _chunk_query(method: str):
    return lambda spark, d: chunking.chunk(docs(spark, d), method, 800)


for _m in ("windows", "smart", "headings", "cascade", "prose", "code", "table", "list", "mixed", "adaptive"):
    query(None, f"chunk_{_m}")(_chunk_query(_m))


@query()
def table_row_chunks(spark, d):
    return chunking.table_row_chunks(docs(spark, d))


@query()
def html_table_cells(spark, d):
    return tables.html_cells(docs(spark, d))


@query()
def html_table_metadata(spark, d):
    return tables.table_metadata(tables.html_cells(docs(spark, d)))


@query()
def html_table_chunks(spark, d):
    return tables.table_chunks(docs(spark, d))


@query()
def markdown_table_cells(spark, d):
    return tables.markdown_cells(docs(spark, d))


# ---------------------------------------------------------------- hierarchy

_SECTIONS = r"""WITH s AS (SELECT id, md5(coalesce(metadata.source, '')) AS document_id, length(coalesce(content, '')) AS chars,
  sum(CASE WHEN coalesce(regexp_matches(content, '^\s*(?:#{1,6}\s|[A-Z][A-Za-z0-9 ]{0,80}:\s*(?:\n|$)|\d+(?:\.\d+)*\.?\s+[A-Z])'), false) OR rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY src ORDER BY ci NULLS LAST, id ROWS UNBOUNDED PRECEDING) AS no
  FROM (SELECT *, metadata.source AS src, metadata.chunk_index AS ci, row_number() OVER (PARTITION BY metadata.source ORDER BY metadata.chunk_index NULLS LAST, id) AS rn FROM simulated_vector_db))"""


@query(f"{_SECTIONS} SELECT document_id || '-' || no AS section_id, document_id, count(*) AS n_chunks, sum(chars)::BIGINT AS n_chars, min(id) AS first_id FROM s GROUP BY ALL")
def hierarchy_sections(spark, d):
    return hierarchy.section_table(hierarchy.sections(chunks(spark, d)))


@query(f"{_SECTIONS} SELECT document_id, count(DISTINCT no) AS n_sections, count(*) AS n_chunks, sum(chars)::BIGINT AS n_chars, min(id) AS first_id FROM s GROUP BY document_id")
def hierarchy_documents(spark, d):
    return hierarchy.document_table(hierarchy.sections(chunks(spark, d)))


@query(rf"""{_SECTIONS}, asked AS (SELECT query_id, query FROM query_set), dw AS (SELECT id, term, ln(1 + count(*)) AS w FROM (SELECT id, unnest({WORDS.format(c='text')}) AS term FROM ({_CHUNKS})) GROUP BY ALL),
  qw AS (SELECT query_id, term, ln(1 + count(*)) AS qw FROM (SELECT query_id, unnest({WORDS.format(c='query')}) AS term FROM asked) GROUP BY ALL),
  sc AS (SELECT query_id, id, round(sum(w * qw), 6) AS score FROM dw JOIN qw USING (term) GROUP BY ALL), top AS (SELECT query_id, id, score FROM sc QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5),
  h AS (SELECT query_id, top.id, score, document_id, document_id || '-' || no AS section_id FROM top JOIN s ON s.id = top.id),
  u AS (SELECT query_id, id, 'chunk' AS level, score FROM h UNION ALL SELECT query_id, section_id, 'section', 0.4 FROM h UNION ALL SELECT query_id, document_id, 'document', 0.3 FROM h), b AS (SELECT query_id, id, level, max(score) AS score FROM u GROUP BY ALL)
SELECT query_id, id, level, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, level, id) AS rank FROM b QUALIFY rank <= 10""")
def hierarchy_expansion(spark, d):
    c = hierarchy.sections(chunks(spark, d))
    hits = retrieval.sparse_search(chunks(spark, d), asked(spark, d), 5)
    return hierarchy.expand(hits, c)


# ---------------------------------------------------------------- validation, evaluation, learning


@query("SELECT count(*) AS vectors, 1.0::DOUBLE AS score, true AS passed FROM simulated_vector_db")
def validation_coverage(spark, d):
    return validation.coverage(chunks(spark, d))


@query("""SELECT count(*) AS vectors, count(*) FILTER (vector IS NULL) AS missing, count(DISTINCT len(vector)) AS dimensions, count(*) FILTER (NOT ok AND vector IS NOT NULL) AS non_finite,
  round(sum(len(list_filter(vector, lambda x: x = 0))) / sum(len(vector)), 6) AS zero_share, round(avg(CASE WHEN ok THEN sqrt(list_sum(list_transform(vector, lambda x: x * x))) END), 6) AS mean_length,
  round(stddev_samp(CASE WHEN ok THEN sqrt(list_sum(list_transform(vector, lambda x: x * x))) END), 6) AS sd_length
FROM (SELECT vector, coalesce(len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0, false) AS ok FROM simulated_vector_db)""")
def validation_vectors(spark, d):
    return validation.vector_consistency(chunks(spark, d))


def _case_hits(spark, d):
    cases = table(spark, d, "eval_case").select(F.col("case_id").alias("query_id"), "query")
    return retrieval.sparse_search(chunks(spark, d), cases, 10)


def _relevant(spark, d):
    return table(spark, d, "eval_case").select(F.col("case_id").alias("query_id"), F.explode("relevant_doc_ids").alias("id"))


@query(rf"""WITH dw AS (SELECT id, term, ln(1 + count(*)) AS w FROM (SELECT id, unnest({WORDS.format(c='text')}) AS term FROM ({_CHUNKS})) GROUP BY ALL),
  qw AS (SELECT query_id, term, ln(1 + count(*)) AS qw FROM (SELECT case_id AS query_id, unnest({WORDS.format(c='query')}) AS term FROM eval_case) GROUP BY ALL),
  scored AS (SELECT query_id, id, round(sum(w * qw), 6) AS score FROM dw JOIN qw USING (term) GROUP BY ALL),
  top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10),
  rel AS (SELECT DISTINCT case_id AS query_id, unnest(relevant_doc_ids) AS id FROM eval_case),
  tot AS (SELECT query_id, count(*) AS n FROM rel GROUP BY query_id),
  f AS (SELECT query_id, count(*) AS found, min(rank) AS first, sum(1 / log2(rank + 1.0)) AS dcg FROM top SEMI JOIN rel USING (query_id, id) GROUP BY query_id)
SELECT query_id, round(coalesce(found / 10, 0), 6) AS "precision", round(coalesce(found / n, 0), 6) AS recall, round(coalesce(1 / first, 0), 6) AS reciprocal_rank,
  round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg FROM tot LEFT JOIN f USING (query_id)""")
def evaluation(spark, d):
    return validation.evaluate(_case_hits(spark, d), _relevant(spark, d))


_SPARSE = rf"""dw AS (SELECT id, term, ln(1 + count(*)) AS w FROM (SELECT id, unnest({WORDS.format(c='text')}) AS term FROM ({_CHUNKS})) GROUP BY ALL),
  qw AS (SELECT query_id, term, ln(1 + count(*)) AS qw FROM (SELECT query_id, unnest({WORDS.format(c='query')}) AS term FROM asked) GROUP BY ALL),
  scored AS (SELECT query_id, id, round(sum(w * qw), 6) AS score FROM dw JOIN qw USING (term) GROUP BY ALL)"""


@query(f"""WITH asked AS (SELECT case_id AS query_id, query FROM eval_case), {_SPARSE}, top AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 5),
  x AS (SELECT case_id AS query_id, unnest(relevant_doc_ids) AS id FROM eval_case), f AS (SELECT query_id, min(rank) AS rank FROM x LEFT JOIN top USING (query_id, id) GROUP BY query_id),
  t AS (SELECT count(*) AS queries, avg((rank IS NOT NULL)::INT) AS hit, avg(rank) AS pos, avg((5 - (rank - 1)) / 5) AS near FROM f)
SELECT queries, round(hit, 6) AS hit_rate, round(pos, 6) AS mean_position, round(0.7 * hit + 0.3 * coalesce(near, 0), 6) AS score, hit >= 0.5 AS passed FROM t""")
def retrieval_quality(spark, d):
    expected = _relevant(spark, d).withColumnRenamed("id", "expected_id")
    return validation.retrieval_quality(_case_hits(spark, d), expected)


_NAMES = "CASE " + " ".join("WHEN " + " AND ".join(f"strategy.{f} IS NOT DISTINCT FROM {'NULL' if v is None else repr(v) if isinstance(v, str) else str(v).lower()}" for f, v in zip(learning.STRATEGY_FIELDS, vs)) + f" THEN '{k}'" for k, vs in learning.STRATEGIES.items()) + " WHEN strategy IS NULL THEN NULL ELSE 'custom' END"


@query(f"""WITH f AS (SELECT * FROM strategy_feedback QUALIFY row_number() OVER (PARTITION BY feedback_id ORDER BY logged_at NULLS LAST) = 1), g AS (SELECT *, {_NAMES} AS name FROM f)
SELECT name, count(*) AS events, count(*) FILTER (strategy_name IS NOT NULL AND strategy_name <> name) AS misnamed, round(avg(CASE WHEN NOT isnan(metrics['relevance']) THEN metrics['relevance'] END), 6) AS mean_metric FROM g GROUP BY name""")
def strategy_outcomes(spark, d):
    return learning.strategy_outcomes(table(spark, d, "strategy_feedback"))


@query()
def tuned_weights(spark, d):
    f = learning.distinct_feedback(table(spark, d, "strategy_feedback")).withColumn("weight", F.col("strategy.fusion_weight"))
    model = learning.fit_tuner(f, "weight")
    return learning.tune(model, f.select("feedback_id", "features"), 0.1, 0.9).select("feedback_id", F.round("value", 6).alias("value"))


@query()
def selected_strategies(spark, d):
    f = learning.distinct_feedback(table(spark, d, "strategy_feedback"))
    model = learning.fit_selector(f, trees=20)
    return learning.select_strategy(model, f.select("feedback_id", "features")).select("feedback_id", F.col("choices")[0]["name"].alias("strategy"))


@query()
def reduced_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    return learning.project(e, 16, 64)


# ---------------------------------------------------------------- events


@query("SELECT event_type AS name, count(*) AS count, round(avg(value), 6) AS mean_seconds, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY event_type")
def operation_metrics(spark, d):
    e = table(spark, d, "events").withColumn("bad", F.col("event_type") == "error")
    return validation.operation_metrics(e, failed="bad")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(spark, d):
    return E.windowed(table(spark, d, "events"))


@query("""SELECT s AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS s FROM events) GROUP BY ALL""")
def events_sliding(spark, d):
    return E.windowed(table(spark, d, "events"), "1 hour", "30 minutes")


@query("""WITH m AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS start FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
  s AS (SELECT *, sum(start) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM m)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, no""")
def events_sessions(spark, d):
    return E.sessions(table(spark, d, "events"))


@query("SELECT source, lang, count(*) AS documents FROM documents GROUP BY ROLLUP (source, lang)")
def corpus_report(spark, d):
    return docs(spark, d).rollup("source", "lang").agg(F.count("*").alias("documents"))


# ---------------------------------------------------------------- whole plans


@query()
def prepared_chunks(spark, d):
    p = pipelines.prepare(docs(spark, d))
    return p.select("id", "doc_id", "chunk_index", "section_id", "neighbor_prev", "neighbor_next", "meta.document_type", "meta.confidence")


@query()
def retrieved(spark, d):
    c = chunks(spark, d).select("id", "text", "vector")
    return pipelines.retrieve(retrieval.build_index(c), c, asked(spark, d), pipelines.RetrieveConfig(10, reranker="context_aware"))
