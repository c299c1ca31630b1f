"""Operators that SQL can't express against plain Python, and edge cases of the others."""

from __future__ import annotations

import itertools
import math
import random
import re
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lakeloom.functions import chunks as C
from lakeloom.functions import query as Q
from lakeloom.functions import tables as T
from lakeloom.functions import text as X
from lakeloom.functions import vectors as V
from lakeloom.operators import chunking, dedup, enrich, fusion, hierarchy, learning, rerank, retrieval, tables, validation
from lakeloom.sources import io
from lakeloom.streaming import events


# ------------------------------------------------------------------ chunks


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. \n,|-#`;", max_size=300), st.sampled_from(sorted(C.METHODS)), st.integers(5, 80))
def test_chunks_lose_no_word(text, method, most):
    got = C.METHODS[method](text, most)
    assert all(c.strip() for c in got)
    letters = lambda s: sorted(re.sub(r"[^ab]", "", s))
    if method != "table":
        parts = "".join(got)
        assert len(letters(parts)) >= len(letters(text)) if method == "mixed" else letters(parts) == letters(text)


def test_chunk_sizes():
    text = "\n\n".join(f"Sentence {i} is here. Another one follows it." for i in range(30))
    for m in ("windows", "smart", "cascade", "prose"):
        assert max(map(len, C.METHODS[m](text, 120))) <= 120
    assert C.windows("aa bb cc", 5) == ["aa", "bb", "cc"]
    assert C.smart("one.\n\ntwo.", 100) == ["one.\n\ntwo."] and C.smart("one. two.", 5) == ["one.", "two."]
    assert C.by_headings("# A\n\ntext\n\n# B\n\nmore", 1000) == ["# A\n\ntext", "# B\n\nmore"]
    assert C.with_overlap(["abc", "def"], 2) == ["abc", "bc def"]


def test_table_chunks_repeat_the_header():
    md = "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    assert C.table_rows(md) == ["| a | b |\n|---|---|\n| 1 | 2 |", "| a | b |\n|---|---|\n| 3 | 4 |"]
    assert all(c.startswith("| a | b |\n|---|---|\n") for c in C.table(md, 35))
    assert C.column_spans(["| a  | b |", "|----|---|"], 1) == {0: "a", 1: "b"}
    assert C.table_rows("no table") == [] and C.table(None) == []


def test_adaptive_picks_the_kind():
    assert C.content_scores("- a\n- b\n- c")["list"] == 1.0
    assert 200 <= C.best_size(C.content_scores("- a\n- b")) <= 1500
    assert C.adaptive("- a\n- b\n- c", 5) == ["- a", "- b", "- c"]


def test_chunk_operator(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, None), (3, " "), (1, "a b c")], "doc_id long, text string").withColumn("key", F.lit("clash"))
    assert [(r.doc_id, r.chunk_index, r.content) for r in chunking.chunk(df, "windows", 3).orderBy("doc_id", "chunk_index").collect()][:2] == [(1, 0, "a"), (1, 0, "a")]
    assert chunking.chunk(df.limit(0), "smart").count() == 0
    md = "x\n| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |"
    rows = chunking.table_row_chunks(spark.createDataFrame([(1, md), (2, None), (3, "a | b")], "doc_id long, text string")).orderBy("row_index").collect()
    assert [r.content.split("\n")[-1] for r in rows] == ["| 1 | 2 |", "| 3 | 4 |"]
    spans = spark.createDataFrame([(1, "b c"), (1, "a")], "doc_id long, span string")
    chunk = spark.createDataFrame([(1, "a b"), (1, "c")], "doc_id long, content string")
    assert [(r.doc_id, r.breaks) for r in chunking.boundary_breaks(spans, chunk).collect()] == [(1, 1)]


# ------------------------------------------------------------------ tables

HTML = """<table><caption>Meals</caption><thead><tr><th>a</th><th colspan=2>b</th></tr></thead>
<tr><td rowspan="2">1</td><td>2</td><td>3</td></tr><tr><td>4<td>5</tr></table>"""


def test_html_cells_resolve_spans():
    cells, captions = T.html_cells(HTML)
    assert captions == {0: "Meals"}
    assert T.grid(cells) == [["a", "b", ""], ["1", "2", "3"], ["", "4", "5"]]
    assert T.header_rows(cells) == 1 and T.metadata(cells)["has_merged"] and T.best_format(cells, False) == "preserving"
    assert "*(colspan=2)*" in T.to_markdown(cells, spans=True)
    again = T.markdown_cells(T.to_markdown(cells, spans=True))
    assert T.grid(again) == T.grid(cells)
    back, _ = T.html_cells(T.to_html(cells, "Meals"))
    assert T.grid(back) == T.grid(cells)
    assert T.row_chunks(cells, "Meals")[0].endswith("| 1 | 2 | 3 |")


def test_language_of_the_whole_text(spark):
    df = spark.createDataFrame([(1, "the house of the king is in the town and " * 100 + "der Hund und die Katze sind nicht auf dem Dach " * 400)], "id long, text string")
    r = df.select(enrich.language(F.col("text")).alias("l")).first().l
    assert r.lang == "de" and 0.5 < r.share < 1
    assert enrich.language_filter(df, ("de",)).count() == 1 and enrich.language_filter(df, ("en",), 0.5).count() == 0


def test_reranking_keeps_hits_without_vectors(spark):
    nan = float("nan")
    vectors = [[1.0, 0.0], [1.0, 0.01], None, [nan, 1.0], [1.0], [0.0, 1.0], [None, 1.0], [float("inf"), 0.0], []]
    rows = [("q", f"h{i}", 1 - i / 100, v) for i, v in enumerate(vectors)] + [("none", "x", 2.0, None), ("none", "y", 1.0, [1.0])]
    df = spark.createDataFrame(rows, "query_id string, id string, score double, vector array<double>")
    for got in (rerank.mmr(df, size=2).collect(), rerank.cluster_diversity(df, size=2).collect()):
        assert sorted((r.query_id, r.id) for r in got) == sorted((q, i) for q, i, _, _ in rows)
        assert [r.id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == "none"] == ["x", "y"]
    order = [r.id for r in rerank.mmr(df.where("query_id = 'q'"), size=2).orderBy("rank").collect()]
    assert order == ["h0", "h2", "h3", "h4", "h5", "h6", "h7", "h8", "h1"]


def test_several_markdown_tables(spark):
    one, two, three = "| a | b |\n|---|---|\n| 1 | 2 |", "c | d\n--- | ---\n3 | 4\n5 | 6", "| e |\n|---|\n| 7 |"
    md = f"first\n{one}\n\n{two}\nthen\n\n{three}\nend"
    df = spark.createDataFrame([(1, md), (2, "x"), (3, None)], "doc_id long, text string")
    cells = [(r.table, r.row, r.col, r.is_header, r.cell) for r in tables.markdown_cells(df).orderBy("table", "row", "col").collect()]
    assert cells == [(0, 0, 0, True, "a"), (0, 0, 1, True, "b"), (0, 1, 0, False, "1"), (0, 1, 1, False, "2"), (1, 0, 0, True, "c"), (1, 0, 1, True, "d"), (1, 1, 0, False, "3"), (1, 1, 1, False, "4"), (1, 2, 0, False, "5"), (1, 2, 1, False, "6"), (2, 0, 0, True, "e"), (2, 1, 0, False, "7")]
    rows = [r.content for r in chunking.table_row_chunks(df).orderBy("row_index").collect()]
    assert rows == [f"first\n{one}", "c | d\n--- | ---\n3 | 4", "c | d\n--- | ---\n5 | 6", f"then\n{three}"]


def test_nested_and_odd_tables():
    cells, _ = T.html_cells("<table><tr><td>x<table><tr><td>y</td></tr></table></td></tr></table>")
    assert {(c[0], c[6], c[7]) for c in cells} == {(0, "x", -1), (1, "y", 0)}
    for odd in (None, "", "<table>", "<table><td>a", "<tr><td>a</td></tr>", "<table><tr><td rowspan=x colspan=-1>a</td></tr>"):
        T.html_cells(odd)
        T.chunks_of(odd)


def test_table_operators(spark):
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "none")], "doc_id long, text string")
    cells = tables.html_cells(df).cache()
    assert cells.count() == 7
    m = tables.table_metadata(cells).collect()
    assert len(m) == 1 and (m[0].rows, m[0].columns, m[0].has_header, m[0].has_merged, m[0].has_nested) == (3, 3, True, True, False)
    assert tables.column_members(cells).where("column = 2").count() == 3
    assert tables.html_cells(df.limit(0)).count() == 0


# ------------------------------------------------------------------ text functions


def test_text_functions(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(X.tokens, "The state-of-the-art, in Rome!") == ["state-of-the-art", "rome"]
    assert one(X.dates, "on 2024-02-30, 3 Mar 2024, 05/06/2023 and 2024/1/2, 2024-01-02") == ["2024-03-03", "2023-06-05", "2024-01-02"]
    assert one(X.topics, "market market software")[0] in ("finance", "marketing")
    assert one(X.content_hash, " A  b") == one(X.content_hash, "a B\n") and one(X.content_hash, None) == ""
    assert one(X.density, "ab") == 0.5 and 0 < one(X.density, "some words in a line of text") <= 1
    assert one(lambda c: X.sentiment(c)["sentiment"], "good good bad") == "positive"
    assert sorted(one(X.char_shingles, "abcd")) == ["abc", "bcd"] and one(X.char_shingles, "ab") == []
    n = one(enrich.numeric_data, "5 GB and 3 kg for $1,200.50, 20 percent")
    assert [(r.value, r.unit, r.type) for r in n] == [("5", "GB", "data_size"), ("3", "kg", "weight"), ("1,200.50", "", "currency"), ("20", "percent", "percentage")]
    assert one(Q.preprocess, 'Could you find um "Like This" actually now') == '"like this" now'
    assert one(Q.entities, 'Ask "the x" of Acme Corp re state-of 42') == ["42", "Acme Corp", "Ask", "state-of", "the x"]
    assert enrich.normalise("Ａ  b") == "a b" and enrich.normalise(None) is None
    long = "https://a.b/" + "x" * 50_000
    assert one(lambda c: F.size(X.entities(c)["URL"]), long) == 1


def test_point_ids(spark):
    got = spark.createDataFrame([("text", '{"a": 1}')], "c string, m string").select(enrich.point_id(F.col("c"), F.col("m")).alias("i")).first().i
    assert got == str(uuid.uuid5(uuid.NAMESPACE_URL, '{"a": 1}\ntext'))


def test_enrichment(spark):
    df = spark.createDataFrame([(1, "The office pays for the list of the costs in 2024-05-06.", "s"), (2, None, "s"), (3, "", None)], "id long, text string, source string").withColumn("meta", F.lit("clash"))
    m = {r.id: r.meta for r in enrich.rich_metadata(df).collect()}
    assert m[1].dates == ["2024-05-06"] and m[2].statistics.word_count == 0 and 0.1 <= m[3].confidence <= 1
    assert {r.id for r in enrich.language_filter(df, ("de",), 0.5).collect()} == {2, 3}
    assert enrich.size_filter(df, 3).count() == 1
    assert [r.normalized for r in enrich.with_normalised(df).orderBy("id").collect()][1] is None
    b = enrich.token_batches(df.select("id", "text"), 10, 2, partitions=1).collect()
    assert len(b) == 3


# ------------------------------------------------------------------ retrieval


def brute_bm25(docs, query, k1=1.5, b=0.75, eps=0.25):
    tok = lambda t: [w for w in re.findall(r"[\w-]+", (t or "").lower()) if w not in X.STOPWORDS]
    d = {i: tok(t) for i, t in docs}
    n, avg = len(d), sum(map(len, d.values())) / len(d)
    df: dict = {}
    for w in d.values():
        for x in set(w):
            df[x] = df.get(x, 0) + 1
    idf = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(idf.values()) / len(idf)
    idf = {w: eps * mean if v < 0 else v for w, v in idf.items()}
    out = {}
    for i, w in d.items():
        hit = [q for q in tok(query) if q in w]
        if hit:
            out[i] = round(sum(idf[q] * w.count(q) * (k1 + 1) / (w.count(q) + k1 * (1 - b + b * len(w) / avg)) for q in hit), 6)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def test_bm25(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choices("red blue green lamp box of the road".split(), k=rng.randint(1, 12)))) for i in range(40)] + [(90, None), (91, "")]
    df = spark.createDataFrame(docs, "id long, text string").withColumn("term", F.lit("clash"))
    q = spark.createDataFrame([(1, "red red lamp"), (2, "the unknown"), (3, None)], "query_id long, query string")
    index = retrieval.build_index(df)
    got = [(r.id, r.score) for r in retrieval.bm25_search(index, q, 7).where("query_id = 1").orderBy("rank").collect()]
    want = brute_bm25(docs, "red red lamp")[:7]
    assert [i for i, _ in got] == [i for i, _ in want] and [s for _, s in got] == pytest.approx([s for _, s in want], abs=2e-6)
    more = index.add(spark.createDataFrame([(0, "red"), (200, "red lamp")], "id long, text string"))
    assert more.n == index.n + 1 and more.posts.where("id = 200").count() == 2
    assert retrieval.bm25_search(retrieval.build_index(df.limit(0)), q).count() == 0


def test_dense(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((80, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(100, None), (101, [1.0]), (102, [float("nan")] * 5)], "id long, vector array<double>")
    q = df.where("id < 4").select(F.col("id").alias("query_id"), "vector")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.dense_top_k(df, q, 3).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert all(got[(i, 1)] == i and got[(i, 2)] == int(np.argsort(-(u @ u[i]))[1]) for i in range(4))
    assert retrieval.dense_top_k(df.limit(0), q).count() == 0
    a = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0], [1.0, 1.0]])], "q array<array<double>>, d array<array<double>>")
    assert a.select(V.max_sim(F.col("q"), F.col("d")).alias("s")).first().s == pytest.approx(1 + 1 / math.sqrt(2))


def test_hits_helpers(spark):
    h = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.9), (1, "b", -1.0), (1, "c", 0.2)], "query_id long, id string, score double")
    assert [(r.id, r.score) for r in retrieval.merge_expansions(h).orderBy("rank").collect()] == [("a", 0.9), ("c", 0.2)]
    o = spark.createDataFrame([(1, "c", 1.0)], "query_id long, id string, score double")
    assert {r.id: round(r.score, 3) for r in retrieval.blend(h.where("id = 'c'"), o).collect()} == {"c": 0.44}


def test_fusion_unknown_method_is_linear(spark):
    one = "array<struct<id:string,score:double>>"
    df = spark.createDataFrame([("r", [("a", 1.0), ("b", 0.0)], [("b", 5.0)], None, (0.5, "x"))], f"request_id string, vector_results {one}, bm25_results {one}, splade_results {one}, strategy struct<alpha:double,method:string>")
    long = fusion.long_lists(df)
    assert sorted(map(tuple, fusion.fuse(long, "nope").collect())) == sorted(map(tuple, fusion.linear(long).collect())) == [("r", "a", 0.5), ("r", "b", 0.25)]
    assert fusion.fuse(fusion.long_lists(df.limit(0)), "rrf").count() == 0
    e = spark.createDataFrame([("r", ["Rome", "x"])], "request_id string, entities array<string>")
    t = spark.createDataFrame([("a", "in rome"), ("b", None)], "id string, text string")
    assert {r.id: r.score for r in fusion.entity_boost(fusion.linear(long), t, e).collect()} == {"a": 0.55, "b": 0.25}


# ------------------------------------------------------------------ reranking


def test_mmr(spark):
    rows = [(1, "a", 0.9, [1.0, 0.0]), (1, "b", 0.89, [1.0, 0.01]), (1, "c", 0.5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "query_id long, id string, score double, vector array<double>")
    assert [r.id for r in rerank.mmr(df, 0.5).orderBy("rank").collect()] == ["a", "c", "b"]
    assert [r.id for r in rerank.mmr(df, 1.0).orderBy("rank").collect()] == ["a", "b", "c"]
    q = df.withColumn("query_vector", F.array(F.lit(1.0), F.lit(0.0)))
    assert [r.id for r in rerank.mmr_service(q).orderBy("rank").collect()][0] == "a"
    assert sorted(r.id for r in rerank.cluster_diversity(df).collect()) == ["a", "b", "c"]
    assert rerank.mmr(df.limit(0)).count() == 0


def test_context_packing(spark):
    rows = [(1, "a", 0.9, "x" * 40), (1, "b", 0.8, "y" * 400), (1, "c", 0.7, "z" * 20), (1, "d", 0.6, None)]
    df = spark.createDataFrame(rows, "query_id long, id string, score double, text string")
    assert [r.id for r in rerank.pack_context(df, 50).collect()] == ["a"]
    assert [r.id for r in rerank.pack_context_skipping(df, 50).orderBy("place").collect()] == ["a", "c", "d"]
    c = df.withColumn("query", F.lit("find me"))
    assert rerank.cross_score(c).count() == rerank.compress(c).count() == 4


# ------------------------------------------------------------------ deduplication


def test_near_duplicates(spark):
    rng = random.Random(4)
    base = [[f"w{rng.randint(0, 150)}" for _ in range(rng.randint(3, 40))] for _ in range(30)]
    texts = [" ".join(b) for b in base] + [" ".join(b[1:] + ["new"]) for b in base] + [" ".join(base[0])] * 3 + [None, "", "!"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    sets = {i: frozenset(re.findall(r"\w+", (t or "").lower())) for i, t in enumerate(texts)}
    first: dict = {}
    for i, s in sets.items():
        first.setdefault(s, i)
    want = {(a, b) for a, b in itertools.combinations(sorted(first.values()), 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    want |= {(first[s], i) for i, s in sets.items() if s and first[s] != i}
    got = dedup.near_duplicates(df, 0.8)
    assert {(r.a, r.b) for r in got.collect()} == want
    label = {r.id: r.cluster for r in dedup.clusters(got).collect()}
    assert all(label[a] == label[b] for a, b in want)
    out, stats = dedup.deduplicate(df.withColumn("source", F.lit("s")), 0.8)
    s = stats.first()
    assert s.original == len(texts) and s.final == out.count() == len(texts) - sum(1 for i, c in label.items() if i != c)
    assert dedup.near_duplicates(df.limit(0)).count() == 0


def test_clusters_of_a_chain(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.id: r.cluster for r in dedup.clusters(pairs).collect()}
    assert set(got.values()) == {0, 100} and len(got) == 43


def test_clusters_of_a_long_shuffled_chain(spark):
    ids = list(range(400))
    random.Random(1).shuffle(ids)
    star = [(1000 + i, 2000) for i in range(50)]
    got = {r.id: r.cluster for r in dedup.clusters(spark.createDataFrame([*zip(ids, ids[1:]), *star, (3000, 3000)], "a long, b long")).collect()}
    assert got == {i: 0 for i in ids} | {i: 1000 for p in star for i in p} | {3000: 3000}


def test_minhash(spark):
    df = spark.createDataFrame([([str(i) for i in range(100)], [str(i) for i in range(10, 110)], [])], "a array<string>, b array<string>, e array<string>")
    r = df.select(dedup.signature_similarity(dedup.minhash(F.col("a"), 100), dedup.minhash(F.col("b"), 100)).alias("s"), dedup.signature_similarity(dedup.minhash(F.col("e"), 10), dedup.minhash(F.col("a"), 10)).alias("z")).first()
    assert abs(r.s - 90 / 110) < 0.15 and r.z == 0


# ------------------------------------------------------------------ hierarchy, validation, learning


def test_hierarchy(spark):
    rows = [("c1", "s", 0, "# A\nx"), ("c2", "s", 1, "more"), ("c3", "s", 2, "# B"), ("c4", "t", None, None)]
    df = hierarchy.sections(spark.createDataFrame(rows, "id string, source string, chunk_index int, text string"))
    assert {r.first_id: r.n_chunks for r in hierarchy.section_table(df).collect()} == {"c1": 2, "c3": 1, "c4": 1}
    assert {r.first_id: r.n_sections for r in hierarchy.document_table(df).collect()} == {"c1": 2, "c4": 1}
    hits = spark.createDataFrame([(1, "c1", 0.9), (1, "c2", 0.8), (1, "gone", 0.1)], "query_id long, id string, score double")
    got = [(r.level, r.score) for r in hierarchy.expand(hits, df).orderBy("rank").collect()]
    assert got == [("chunk", 0.9), ("chunk", 0.8), ("section", 0.4), ("document", 0.3), ("chunk", 0.1)]
    assert hierarchy.points(df).count() == 4 + 3 + 2
    assert {r.preview for r in hierarchy.document_preview(df).collect()} == {"# A\nx more # B", ""}
    ids = hierarchy.document_table(df).where("first_id = 'c1'").select(F.col("document_id").alias("id"))
    assert hierarchy.descendants(df, ids).count() == 3


def test_validation(spark):
    hits = spark.createDataFrame([(1, "a", 1), (2, "b", 3), (3, "x", 1)], "query_id long, id string, rank int")
    want = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "query_id long, expected_id string")
    r = validation.retrieval_quality(hits, want).first()
    assert (r.queries, r.hit_rate, r.mean_position, r.passed) == (3, 0.666667, 2.0, True)
    e = {r.query_id: r for r in validation.evaluate(hits, want.withColumnRenamed("expected_id", "id")).collect()}
    assert e[1].ndcg == 1.0 and e[2].reciprocal_rank == 0.333333 and e[3].recall == 0
    s = validation.summary(spark.createDataFrame([("a", True, 1.0), ("b", False, 0.2)], "name string, passed boolean, score double")).first()
    assert (s.total, s.failed, s.critical, s.status) == (2, 1, 1, "FAILED")
    t = {r.name: r for r in validation.timings(spark.createDataFrame([("o", 4.0), ("o", 2.0), ("n", 1.5)], "name string, seconds double"), "o", "n").collect()}
    assert t["n"].speedup_percent == 50.0 and t["o"].mean == 3.0
    assert validation.test_queries(spark.createDataFrame([(i, f"A sentence with number {i}. More.") for i in range(9)], "id long, text string"), 4).count() == 4
    pts = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(50)], "id long, vector array<double>")
    assert validation.pair_similarity(pts, 2).count() == 1 and validation.vector_consistency(pts.limit(0)).first().vectors == 0


def test_worker_pool(spark):
    def fold(oks, n=20):
        good = bad = 0
        for ok in oks:
            good, bad = (good + 1, 0) if ok else (0, bad + 1)
            if good >= 5:
                n, good, bad = min(50, max(n + 1, int(n * 1.25))), 0, 0
            elif bad >= 2:
                n, good, bad = max(1, int(n * 0.67)), 0, 0
        return n

    rng = random.Random(0)
    runs = {p: [rng.random() < 0.8 for _ in range(60)] for p in ("a", "b")}
    df = spark.createDataFrame([(p, i, ok) for p, oks in runs.items() for i, ok in enumerate(oks)], "pool string, seq int, ok boolean")
    assert {r.pool: r.workers for r in learning.worker_pool(df).collect()} == {p: fold(o) for p, o in runs.items()}


def test_learning(spark):
    rows = [(i, {"word_count": float(i % 20)}, 0.1 + 0.04 * (i % 20), "a" if i % 20 < 10 else "b") for i in range(80)]
    df = spark.createDataFrame(rows, "feedback_id long, features map<string,double>, weight double, strategy_name string")
    model = learning.fit_tuner(df, "weight", regularisation=0.0)
    got = {r.feedback_id: r.value for r in learning.tune(model, df.select("feedback_id", "features"), 0.0, 1.0).collect()}
    assert got[3] == pytest.approx(0.22, abs=1e-3)
    assert learning.fit_tuner(df.limit(3), "weight") is None and learning.fit_selector(df.limit(3)) is None
    chosen = learning.select_strategy(learning.fit_selector(df, trees=10), df.select("feedback_id", "features")).collect()
    assert sum(r.choices[0].name == ("a" if r.feedback_id % 20 < 10 else "b") for r in chosen) >= 76
    p = spark.createDataFrame([(i, [float(i), 2.0 * i, 1.0]) for i in range(10)], "id long, vector array<double>")
    assert len(learning.reduce_pca(p, 2).first().vector) == 2 and len(learning.project(p, 2, 3).first().vector) == 2
    name = lambda **k: learning.rule_strategy(F.lit(k.get("t", "x")), F.lit(k.get("e", 0)), F.lit(k.get("w", 5)), F.lit(k.get("d", False)), F.lit(k.get("p", None)).cast("string"))
    r = spark.range(1).select(name(t="factual").alias("a"), name(e=3).alias("b"), name(e=3, w=20).alias("c"), name(d=True).alias("d"), name(d=True, p="bm25_only").alias("e")).first()
    assert tuple(r) == ("hybrid_bm25_heavy", "splade_enhanced", "colbert_enhanced", "advanced_fusion", "bm25_only")


# ------------------------------------------------------------------ sources and streams


def test_collection(spark, tmp_path):
    c = io.Collection(spark, str(tmp_path), "docs", 2)
    assert not c.exists()
    c.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int"))
    c.upsert(spark.createDataFrame([("b", 3), ("c", 4)], "id string, n int"))
    assert {r.id: r.n for r in c.scan().collect()} == {"a": 1, "b": 3, "c": 4} and c.scan("n > 3").count() == 1
    c.purge()
    assert not c.exists()
    with pytest.raises(ValueError):
        io.Collection(spark, str(tmp_path), "x", 2, "Other")


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo")
    assert io.text_files(spark, str(tmp_path / "*.txt")).first().text == "one\ntwo"
    assert io.binary_files(spark, str(tmp_path), lambda b: b.decode().upper(), "*.txt").first().text == "ONE\nTWO"
    html = spark.createDataFrame([("<p>a &amp; b</p><script>x</script><p>c</p>",), (None,)], "html string")
    assert [r.text for r in io.html_text(html).collect()] == ["a & b\nc", None]
    posts = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, None)], "conv_id long, turn long, text string")
    assert {r.source: r.text for r in io.conversations_as_documents(posts).collect()} == {"1": "a\nb", "2": ""}
    (tmp_path / "q.jsonl").write_text('{"query": "x", "relevant_doc_ids": ["a"]}\n')
    assert io.json_lines(spark, str(tmp_path / "q.jsonl")).first().relevant_doc_ids == ["a"]
    index = retrieval.build_index(spark.createDataFrame([(1, "a b")], "id long, text string"))
    io.save_index(index, str(tmp_path / "index"))
    assert io.load_index(spark, str(tmp_path / "index")).n == 1


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, 1_700_000_000 + 97 * i, i % 3, "ab"[i % 2], float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id int, event_type string, value double").withColumn("ts", F.timestamp_seconds("s"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = events.read(spark, str(tmp_path / "in"))
    q = events.windowed(stream, late="10 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, events.windowed(df).collect()))
    seen = []
    q = events.each_batch(events.distinct_within(stream, ["user_id", "event_type"]), lambda b, n: seen.extend(b.select("user_id", "event_type").collect()), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert len(seen) == 6


def test_streamed_index(spark, tmp_path):
    df = spark.createDataFrame([(i, f"word{i} shared") for i in range(20)], "id long, text string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    q = events.each_batch(events.read(spark, str(tmp_path / "in"), files_per_trigger=1), events.index_appender(str(tmp_path / "posts")), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "posts"))
    assert {(r.term, r.id) for r in got.collect()} == {(r.term, r.id) for r in retrieval.postings(df).collect()}


# ------------------------------------------------------------------ whole plans


def test_prepare_and_retrieve(spark):
    from lakeloom.plans import pipelines as P

    rows = [(1, "# A\n\nThe red lamp is in the box. It is old.", "s"), (2, "# A\n\nThe red lamp is in the box. It is old.", "s"), (3, "Der Dienst und die Anlagen sind in dem Haus und der Stadt.", "t"), (4, None, "t"), (5, "blue cart", "t")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = P.prepare(df, P.PrepareConfig(languages=("en",), language_threshold=0.5)).collect()
    assert {r.doc_id for r in got} == {1, 5} and all(r.section_id for r in got)
    docs = spark.createDataFrame([("a", "red lamp"), ("b", "blue cart"), ("c", None)], "id string, text string")
    q = spark.createDataFrame([(1, "what is the red lamp"), (2, "explain blue")], "query_id long, query string")
    hits = P.retrieve(retrieval.build_index(docs), docs, q, P.RetrieveConfig(5, reranker="context_aware_service"))
    assert {r.query_id: r.id for r in hits.where("rank = 1").collect()} == {1: "a", 2: "b"}
    rel = spark.createDataFrame([(1, "a"), (2, "b")], "query_id long, id string")
    assert P.evaluate(hits, rel).first().reciprocal_rank == 1.0
