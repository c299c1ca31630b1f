"""Understanding of query strings: clean-up, entities, complexity, type and routing. All run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import STOPWORDS, plain_split

# Indicator words.
FACTUAL = ("who", "what", "when", "where", "which", "list", "name", "find", "identify", "locate")
CONCEPTUAL = ("why", "how", "explain", "describe", "compare", "analyze", "evaluate", "summarize", "define", "discuss", "elaborate", "examine")
LOGICAL = ("and", "or", "not", "if", "unless", "except", "but", "between")
QUESTION = ("what", "why", "how", "when", "where", "who", "which")
TEMPORAL = ("today", "yesterday", "recent", "latest", "current", "now", "week", "month", "year")
ENTITY_STOPWORDS = STOPWORDS + ("by", "an", "this", "that")


def preprocess(c: Column) -> Column:
    """Lower case without filler words and one leading request phrase; quoted parts stay as they are."""
    parts = F.split(F.lower(c), '"')
    last = F.size(parts) - 1
    bare = F.transform(parts, lambda x, i: F.when((i % 2 == 1) & (i < last), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(F.regexp_replace(F.when((i % 2 == 1) & (i == last), F.concat(F.lit('"'), x)).otherwise(x), r"\b(um|uh|well|so|like|you know|i mean|actually)\b", "")))
    joined = F.array_join(bare, "")
    asked = F.regexp_replace(joined, r"^(can you|could you|please|would you)?\s*(tell me|show me|let me know|find|search for|find out|explain)\s*", "")
    return F.trim(F.regexp_replace(asked, r"\s+", " "))


def entities(c: Column) -> Column:
    """Quoted spans, capitalised runs, hyphenated terms and numbers, each once, in alphabetical order."""
    found = [
        F.regexp_extract_all(c, F.lit('"([^"]*)"'), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)\b"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"\b([a-zA-Z]+(?:[_\-][a-zA-Z]+)+)\b"), F.lit(1)),
        F.regexp_extract_all(c, F.lit(r"\b(\d+(?:\.\d+)?)\b"), F.lit(1)),
    ]
    return F.array_sort(F.filter(F.array_distinct(F.concat(*found)), lambda e: ~F.lower(e).isin(*ENTITY_STOPWORDS)))


def _count(w: Column, among: tuple[str, ...]) -> Column:
    return F.size(F.filter(w, lambda x: x.isin(*among)))


def complexity(c: Column) -> Column:
    """STRUCT of word, sentence and indicator counts."""
    w = plain_split(F.lower(c))
    n = F.size(w)
    sentences = F.size(F.filter(F.split(c, r"[.!?]+"), lambda s: s.rlike(r"\S")))
    logical, temporal, asked = _count(w, LOGICAL), _count(w, TEMPORAL), _count(w, QUESTION)
    return F.struct(
        n.alias("word_count"),
        F.round(F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(F.lit(1), n), 6).alias("avg_word_length"),
        sentences.alias("sentence_count"),
        logical.alias("logical_complexity"),
        asked.alias("question_complexity"),
        temporal.alias("temporal_references"),
        c.rlike(r"\d").alias("has_numbers"),
        ((n > 12) | (logical > 1) | (sentences > 1)).alias("is_complex"),
        (temporal > 0).alias("is_temporal"),
    )


def analysis(c: Column, default_alpha: float = 0.5) -> Column:
    """STRUCT of scores, type, weight of the dense side, fusion method and whether expansion would help."""
    cx, w, found = complexity(c), F.array_distinct(plain_split(F.lower(c))), entities(c)
    quoted = F.size(F.regexp_extract_all(c, F.lit('"([^"]*)"'), F.lit(1)))
    factual = _count(w, FACTUAL) + quoted
    conceptual = _count(w, CONCEPTUAL) + cx["is_complex"].cast("int")
    pick = lambda f, k, b: F.when(factual > conceptual, f).when(conceptual > factual, k).otherwise(b)
    return F.struct(
        factual.alias("factual_score"),
        conceptual.alias("conceptual_score"),
        pick(F.lit("factual"), F.lit("conceptual"), F.lit("balanced")).alias("query_type"),
        F.round(pick(F.greatest(F.lit(0.3), F.lit(default_alpha - 0.2)), F.least(F.lit(0.7), F.lit(default_alpha + 0.2)), F.lit(default_alpha)), 6).alias("alpha"),
        pick(F.lit("rrf"), F.lit("softmax"), F.lit("linear")).alias("fusion_method"),
        F.size(found).alias("entity_count"),
        quoted.alias("quoted"),
        ((cx["word_count"] < 8) & (F.size(found) < 2) & (quoted == 0)).alias("expansions_needed"),
    )


# Indicator words of the other two analyses.
SERVICE_FACTUAL = ("who", "what", "when", "where", "which", "list", "name")
SERVICE_CONCEPTUAL = ("why", "how", "explain", "describe", "compare", "analyze", "evaluate")


def analysis_cli(c: Column, default_alpha: float = 0.5) -> Column:
    """The command line's analysis: both scores count the same indicators, so quotes and length decide."""
    w, n = F.array_distinct(plain_split(F.lower(c))), F.size(plain_split(c))
    quoted = F.size(F.regexp_extract_all(c, F.lit('"([^"]*)"'), F.lit(1)))
    asked = _count(w, SERVICE_FACTUAL)
    factual, conceptual = asked + quoted, asked + (n > 15).cast("int")
    pick = lambda f, k, b: F.when(factual > conceptual, f).when(conceptual > factual, k).otherwise(b)
    return F.struct(
        F.round(pick(F.lit(max(0.3, default_alpha - 0.2)), F.lit(min(0.7, default_alpha + 0.2)), F.lit(default_alpha)), 6).alias("alpha"),
        pick(F.lit("hybrid_bm25_heavy"), F.lit("hybrid_vector_heavy"), F.lit("hybrid_balanced")).alias("metric"),
        ((n < 8) & (F.size(cli_entities(c)) < 2) & (quoted == 0)).alias("expansions_needed"),
    )


def cli_entities(c: Column) -> Column:
    """As ``entities``, stop words too."""
    found = [F.regexp_extract_all(c, F.lit(p), F.lit(1)) for p in ('"([^"]*)"', r"\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)\b", r"\b([a-zA-Z]+(?:[_\-][a-zA-Z]+)+)\b", r"\b(\d+(?:\.\d+)?)\b")]
    return F.array_sort(F.array_distinct(F.concat(*found)))


def analysis_service(c: Column) -> Column:
    """The service's analysis: type, weight, fusion, and the retrievers and reranker that its strategy asks for."""
    w, n = F.array_distinct(plain_split(F.lower(c))), F.size(plain_split(c))
    factual, conceptual = _count(w, SERVICE_FACTUAL), _count(w, SERVICE_CONCEPTUAL)
    ends = F.size(F.regexp_extract_all(c, F.lit(r"([.!?]+)"), F.lit(1)))
    found = F.size(F.regexp_extract_all(c, F.lit('"([^"]*)"'), F.lit(1))) + F.size(F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*)\b"), F.lit(1)))
    hard = (n > 10) | (ends > 1)
    pick = lambda f, k, b: F.when(factual > conceptual, f).when(conceptual > factual, k).otherwise(b)
    return F.struct(
        pick(F.lit("factual"), F.lit("conceptual"), F.lit("balanced")).alias("query_type"),
        pick(F.lit(0.3), F.lit(0.7), F.lit(0.5)).alias("alpha"),
        pick(F.lit("rrf"), F.lit("softmax"), F.lit("linear")).alias("fusion_method"),
        pick(F.lit("bm25"), F.lit("vector"), F.lit("hybrid")).alias("primary_retriever"),
        pick(F.lit("vector"), F.lit("bm25"), F.lit(None).cast("string")).alias("secondary_retriever"),
        pick(F.lit(False), F.lit(True), hard).alias("use_colbert"),
        pick(found > 0, F.lit(False), F.lit(True)).alias("use_splade"),
        pick(F.when(found > 1, "mmr"), F.lit("context_aware"), F.when(hard, "diversity").otherwise("mmr")).alias("rerank_method"),
        found.alias("entity_count"),
        (ends + 1).alias("sentence_count"),
        hard.alias("is_complex"),
    )


def _strategy(primary: str, secondary: str | None, weight: float, method: str, threshold: float) -> Column:
    return F.struct(F.lit(primary).alias("primary_retriever"), F.lit(secondary).cast("string").alias("secondary_retriever"), F.lit(weight).alias("fusion_weight"), F.lit(method).alias("fusion_method"), F.lit(threshold).alias("rerank_threshold"))


def retrieval_strategy(c: Column) -> Column:
    """Five-way decision on scores, complexity and entities."""
    a, cx = analysis(c), complexity(c)
    return (
        F.when((a["factual_score"] > a["conceptual_score"]) & ((a["entity_count"] > 0) | (a["quoted"] > 0)), _strategy("bm25", "vector", 0.3, "rrf", 0.6))
        .when((a["conceptual_score"] > a["factual_score"]) & cx["is_complex"], _strategy("vector", "bm25", 0.7, "softmax", 0.4))
        .when((cx["word_count"] > 8) & (cx["word_count"] < 20), _strategy("hybrid", None, 0.5, "linear", 0.5))
        .when((cx["word_count"] < 8) & (a["entity_count"] < 2), _strategy("hybrid", "expansion", 0.4, "rrf", 0.7))
        .otherwise(_strategy("hybrid", None, 0.5, "linear", 0.5))
    )


def route(c: Column) -> Column:
    """Seven-way routing."""
    a, cx = analysis(c), complexity(c)
    return (
        F.when((a["query_type"] == "factual") & (a["entity_count"] > 0), _strategy("bm25", "vector", 0.3, "rrf", 0.6))
        .when((a["query_type"] == "conceptual") & cx["is_complex"], _strategy("vector", "bm25", 0.7, "softmax", 0.4))
        .when(cx["is_temporal"], _strategy("hybrid", "recency_boost", 0.5, "linear", 0.5))
        .when(cx["has_numbers"], _strategy("bm25", "vector", 0.4, "rrf", 0.6))
        .when(cx["word_count"] < 5, _strategy("hybrid", "expansion", 0.4, "logistic", 0.7))
        .when(cx["logical_complexity"] > 1, _strategy("hybrid", None, 0.6, "ensemble", 0.5))
        .otherwise(_strategy("hybrid", None, 0.5, "linear", 0.5))
    )


def hierarchy_level(c: Column) -> Column:
    """Which level of a hierarchy a query asks for."""
    n = F.size(plain_split(c))
    sentences = F.size(F.split(c, r"[.!?]+"))
    low = F.lower(c)
    return F.when(low.contains("summary") | low.contains("overview") | (n < 4), "document").when((n > 15) | (sentences > 2), "section").otherwise("chunk")


def selector_features(c: Column) -> Column:
    """Features of the strategy selector; a trailing empty sentence counts."""
    w = plain_split(c)
    low = F.array_distinct(plain_split(F.lower(c)))
    n, sentences = F.size(w), F.size(F.split(c, r"[.!?]+"))
    caps = F.size(F.regexp_extract_all(c, F.lit(r"\b([A-Z][a-zA-Z]*)\b"), F.lit(1)))
    asked = F.trim(c).endswith("?") | F.lower(c).rlike(r"^(who|what|when|where|why|how)")
    return F.struct(
        n.alias("word_count"),
        sentences.alias("sentence_count"),
        F.round(F.aggregate(w, F.lit(0), lambda s, x: s + F.length(x)) / F.greatest(F.lit(1), n), 6).alias("avg_word_length"),
        c.rlike(r"[^a-zA-Z0-9\s]").alias("has_special_characters"),
        c.rlike(r"\d").alias("has_numbers"),
        asked.alias("is_question"),
        caps.alias("entity_count"),
        ((n > 10) | (sentences > 1)).alias("is_complex"),
        ((caps == 0) & ~asked & (n < 5)).alias("is_broad"),
        _count(low, ("who", "what", "when", "where", "which", "list", "name")).alias("factual_score"),
        _count(low, ("why", "how", "explain", "describe", "compare", "analyze", "evaluate")).alias("conceptual_score"),
        (F.array_contains(low, "vs") | F.array_contains(low, "versus") | F.lower(c).contains("compare")).alias("diversity_needed"),
    )
