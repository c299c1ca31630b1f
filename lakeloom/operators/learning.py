"""Learning from feedback: strategy names, parameter tuning, strategy selection, embeddings' reduction."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The named strategies, in the order of STRATEGY_FIELDS.
STRATEGY_FIELDS = ("primary_retriever", "secondary_retriever", "fusion_weight", "fusion_method", "use_colbert", "use_splade", "rerank_method")
STRATEGIES = {
    "bm25_only": ("bm25", None, 0.0, None, False, False, None),
    "vector_only": ("vector", None, 1.0, None, False, False, None),
    "hybrid_balanced": ("hybrid", None, 0.5, "linear", False, False, "mmr"),
    "hybrid_bm25_heavy": ("bm25", "vector", 0.3, "rrf", False, True, "mmr"),
    "hybrid_vector_heavy": ("vector", "bm25", 0.7, "softmax", True, False, "context_aware"),
    "colbert_enhanced": ("vector", "bm25", 0.6, "linear", True, False, "context_aware"),
    "splade_enhanced": ("hybrid", None, 0.4, "rrf", False, True, "mmr"),
    "advanced_fusion": ("hybrid", None, 0.5, "harmonic", True, True, "diversity"),
}


def strategy_name(s: Column) -> Column:
    """The named strategy that equals a strategy struct in every field (nulls equal nulls), else ``custom``."""
    out = F.lit("custom")
    for name, values in STRATEGIES.items():
        same = F.lit(True)
        for f, v in zip(STRATEGY_FIELDS, values):
            same = same & s[f].eqNullSafe(F.lit(v).cast("string") if v is None else F.lit(v))
        out = F.when(same, F.lit(name)).otherwise(out)
    return F.when(s.isNotNull(), out)


def distinct_feedback(feedback: DataFrame) -> DataFrame:
    """Feedback logged twice is one event: the first by time of each feedback_id."""
    keep = [c for c in feedback.columns if c != "feedback_id"]
    row = F.struct(F.col("logged_at").isNull().alias("_n"), F.col("logged_at").alias("_t"))
    best = feedback.groupBy("feedback_id").agg(*(F.min_by(c, row).alias(c) for c in keep))
    return best.select("feedback_id", *keep)


def strategy_outcomes(feedback: DataFrame, metric: str = "relevance") -> DataFrame:
    """For each strategy found by its fields: events, those whose logged name doesn't fit, and the mean of a metric."""
    f = distinct_feedback(feedback).withColumn("name", strategy_name(F.col("strategy")))
    wrong = F.sum((F.col("strategy_name").isNotNull() & (F.col("strategy_name") != F.col("name"))).cast("int"))
    m = F.col("metrics")[metric]
    return f.groupBy("name").agg(F.count("*").alias("events"), wrong.alias("misnamed"), F.round(F.avg(F.when(~F.isnan(m), m)), 6).alias("mean_metric"))


FEATURES = ("word_count", "entity_count", "avg_word_length", "factual_score", "conceptual_score")


def _features(df: DataFrame, names: tuple[str, ...] = FEATURES) -> DataFrame:
    return df.select("*", *(F.coalesce(F.when(~F.isnan(F.col("features")[n]), F.col("features")[n]), F.lit(0.0)).alias(f"f_{n}") for n in names))


def _scaled(names: tuple[str, ...]) -> list:
    return [VectorAssembler(inputCols=[f"f_{n}" for n in names], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]


def fit_tuner(history: DataFrame, target: str, names: tuple[str, ...] = FEATURES, regularisation: float = 0.1, least: int = 10) -> PipelineModel | None:
    """Ridge regression of a parameter on the query's features; None for fewer than ``least`` examples. Examples without the target are left out."""
    rows = _features(history, names).where(F.col(target).isNotNull() & ~F.isnan(target))
    if rows.limit(least).count() < least:
        return None
    return Pipeline(stages=[*_scaled(names), LinearRegression(featuresCol="scaled", labelCol=target, regParam=regularisation, predictionCol="predicted")]).fit(rows)


def tune(model: PipelineModel, queries: DataFrame, low: float, high: float, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``queries`` with ``value``: the prediction clamped to low..high."""
    return model.transform(_features(queries, names)).select(*queries.columns, F.least(F.lit(high), F.greatest(F.lit(low), F.col("predicted"))).alias("value"))


def fit_selector(feedback: DataFrame, names: tuple[str, ...] = FEATURES, trees: int = 100, depth: int = 10, seed: int = 42, least: int = 30) -> PipelineModel | None:
    """A random forest from the query's features to the strategy; None for fewer than ``least`` examples."""
    rows = _features(feedback, names).where("strategy_name is not null")
    if rows.limit(least).count() < least:
        return None
    return Pipeline(stages=[StringIndexer(inputCol="strategy_name", outputCol="label", stringOrderType="alphabetAsc"), *_scaled(names), RandomForestClassifier(featuresCol="scaled", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed)]).fit(rows)


def select_strategy(model: PipelineModel, queries: DataFrame, top: int = 3, names: tuple[str, ...] = FEATURES) -> DataFrame:
    """``queries`` with ``choices``: the most probable strategies with their probabilities."""
    labels = model.stages[0].labels
    out = PipelineModel(stages=model.stages[1:]).transform(_features(queries, names))
    pairs = F.transform(vector_to_array("probability"), lambda p, i: F.struct((-p).alias("n"), F.element_at(F.array(*map(F.lit, labels)), i + 1).alias("name")))
    return out.select(*queries.columns, F.transform(F.slice(F.array_sort(pairs), 1, top), lambda x: F.struct(x["name"].alias("name"), (-x["n"]).alias("probability"))).alias("choices"))


def rule_strategy(query_type: Column, entity_count: Column, word_count: Column, diversity: Column, preferred: Column) -> Column:
    """Fallback by rules: the type's strategy, overridden by entities, length, diversity and the user's mode, in this order."""
    base = F.when(query_type == "factual", "hybrid_bm25_heavy").when(query_type == "conceptual", "hybrid_vector_heavy").otherwise("hybrid_balanced")
    base = F.when(entity_count > 2, "splade_enhanced").otherwise(base)
    base = F.when(word_count > 15, "colbert_enhanced").otherwise(base)
    base = F.when(diversity, "advanced_fusion").otherwise(base)
    return F.coalesce(F.when(preferred.isin(*STRATEGIES), preferred), base)


def reduce_pca(points: DataFrame, k: int, vector: str = "vector") -> DataFrame:
    """The first k principal components; rows without a whole vector are left out."""
    v = points.withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).withColumn(vector, vector_to_array("_p")).drop("_v", "_p")


def project(points: DataFrame, k: int, dim: int, seed: int = 42, vector: str = "vector") -> DataFrame:
    """Gaussian random projection by a seeded matrix, in the JVM."""
    import numpy as np

    m = np.random.default_rng(seed).standard_normal((k, dim)) / np.sqrt(k)
    rows = F.array(*(F.array(*(F.lit(float(x)) for x in r)) for r in m))
    return points.withColumn(vector, F.transform(rows, lambda r: F.aggregate(F.zip_with(r, F.col(vector), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)))


def worker_pool(outcomes: DataFrame, start: int = 20, low: int = 1, high: int = 50, group: str = "pool", order: str = "seq", ok: str = "ok") -> DataFrame:
    """(pool, workers): the pool grows by a quarter after 5 successes in a row and shrinks by a third after 2 failures; a fold over the ordered outcomes of each pool."""
    seq = outcomes.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, ok))), lambda x: x[ok]).alias("oks"))
    zero = F.struct(F.lit(start).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("bad"))

    def step(a: Column, success: Column) -> Column:
        good, bad = a["good"] + 1, a["bad"] + 1
        grown = F.struct(F.least(F.lit(high), F.greatest(a["n"] + 1, F.floor(a["n"] * 1.25).cast("int"))).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("bad"))
        shrunk = F.struct(F.greatest(F.lit(low), F.floor(a["n"] * 0.67).cast("int")).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("bad"))
        return F.when(success, F.when(good >= 5, grown).otherwise(F.struct(a["n"].alias("n"), good.alias("good"), F.lit(0).alias("bad")))).otherwise(F.when(bad >= 2, shrunk).otherwise(F.struct(a["n"].alias("n"), F.lit(0).alias("good"), bad.alias("bad"))))

    return seq.select(group, F.aggregate("oks", zero, step)["n"].alias("workers"))


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)
