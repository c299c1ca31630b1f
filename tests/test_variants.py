"""Additions to the core: names and references, the library's context reranker, chunkers, index updates, duplicate reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.functions import chunks as C
from lakeloom.functions import text as X
from lakeloom.operators import dedup, rerank, retrieval


def test_names_and_references(spark):
    text = "Ask Acme Tools Inc or call. See (Smith, 2020) and [3], [3].\nReferences\nSmith A. On cups\nand boxes.\n\nDoe B. On bags."
    r = spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string").select("id", X.names_before(F.col("t"), X.ORGANISATIONS).alias("n"), X.references(F.col("t")).alias("r"), X.normal_entity(F.lit("PERSON"), F.lit("Dr. Ann  Lee")).alias("p"), X.normal_entity(F.lit("ORGANIZATION"), F.lit("IBM")).alias("o")).collect()
    assert r[0].n == ["Ask Acme Tools Inc"] and r[0].r == ["Smith, 2020", "[3]", "Smith A. On cups and boxes.", "Doe B. On bags."]
    assert r[0].p == "Ann Lee" and r[0].o == "International Business Machines"
    assert r[1].n is None and not r[1].r and r[2].n == [] and r[2].r == []


def test_context_aware_library(spark):
    rows = [("q", f"h{i}", 1 - i / 10, v, "why and how or not does Acme explain the box") for i, v in enumerate([[1.0, 0.0], [1.0, 0.0], None, [0.0, 1.0]])]
    df = spark.createDataFrame(rows, "query_id string, id string, score double, vector array<double>, query string").withColumn("text", F.lit("of Acme"))
    assert [r.id for r in rerank.context_aware_library(df, size=2).orderBy("rank").collect()] == ["h0", "h2", "h1", "h3"]  # .8 over .9 - .3, then .9 - .3 / 2 over .7
    assert [r.id for r in rerank.context_aware_library(df.where("id <> 'h3'"), size=2).orderBy("rank").collect()] == ["h0", "h1", "h2"]
    assert rerank.context_aware_library(df.limit(0)).count() == 0


def test_more_chunkers():
    assert C.token_overlap(["a b c", "d e"], 1, str.split, lambda ts: " ".join(ts) + " ") == ["a b c", "c d e"]
    assert C.simple("one.\n\ntwo.", 8) == ["one.\n\ntwo."] and C.simple(None) == []
    long = ["x" * 60, "y" * 60, "z" * 60]
    assert C.by_topic("\n\n".join(long), lambda c: "z" if c[0] == "z" else "a", 60, 50, 3) == ["\n\n".join(long[:2]), long[2]]
    assert C.best_size({"code": 1.0}) == 250 and C.best_size({"sparse": 1.0}, 1200) == 1500


def test_index_update_and_report(spark):
    docs = spark.createDataFrame([(1, "red cup"), (2, "blue cup"), (3, None), (4, "red  CUP")], "id long, text string")
    index = retrieval.build_index(docs)
    assert index.n == 4 and index.avgdl == 1.5
    more = spark.createDataFrame([(9, "green bag"), (10, None)], "id long, text string")
    assert index.update(more).n == 5 and index.update(docs.unionByName(docs)).n == 6
    assert index.add(more).n == 6 and retrieval.build_index(docs.limit(0)).avgdl == 1.0
    got = {(r.kind, r.cluster, r.size) for r in dedup.detect_duplicates(docs, 0.85).collect()}
    assert got == {("exact", 1, 2), ("near", 1, 2)}
