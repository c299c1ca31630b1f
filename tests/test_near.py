"""Near duplicates where sets share few distinct elements, so that nearly all pairs have to be discarded."""

from __future__ import annotations

import itertools
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.functions import text as X
from lakeloom.operators import dedup
from lakeloom.plans import catalog


def texts(n: int, words: int, seed: int = 3) -> list[str]:
    """Random texts of few distinct words, half of them with a near copy."""
    rng = random.Random(seed)
    out = []
    for _ in range(n // 2):
        one = [f"w{rng.randrange(words)}" for _ in range(rng.choice((7, 20, 60, 150)))]
        two = [w for w in one if rng.random() > 0.05] + [f"w{rng.randrange(words)}" for _ in range(rng.randrange(4))]
        out += [" ".join(one), " ".join(two)]
    return out


def alike(sets: list[frozenset], t: float) -> set:
    return {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if sets[i] != sets[j] and len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]) - 1e-12}


@pytest.mark.parametrize("t", [0.5, 0.85, 0.95])
def test_parities_lose_nothing(t):
    some = texts(300, 400)
    sets = [frozenset(x.split()) for x in some]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(len(some)), pa.int64()), "s": pa.array([None] * len(some), pa.list_(pa.string())), "low": some})
    rows = pa.Table.from_batches(dedup._signed(iter([batch])))
    assert rows["n"].to_pylist() == [len(s) for s in sets]
    side = dedup._Side(rows)
    ids = side.ids.to_numpy()
    got = {tuple(sorted((int(ids[i]), int(ids[j])))) for x, y in dedup._near(side, side, t) for i, j in zip(x, y)}
    want = alike(sets, t)
    assert want and want <= got and len(got) < len(want) + (len(some) ** 2 / 50 if t < 0.8 else 20)
    far = dedup._Side(rows.take(pa.array([0])))
    assert list(dedup._near(far, far, t)) == []


def test_few_candidates_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(dedup, "CHUNK", (2_000, 8_000))
    some = texts(400, 300) + [None, "", "!", "été œil “oui”", "Été ŒIL oui", "ΑΒΓ дом x1", "αβγ ДОМ x1"]
    sets = [frozenset(re.findall(r"\w+", (x or "").lower())) for x in some]
    df = spark.createDataFrame([(1000 + i, x) for i, x in enumerate(some)], "id long, text string")
    first = {s: i for i, s in reversed(list(enumerate(sets)))}
    want = {(i, j) for i, j in alike(sets, 0.85) if first[sets[i]] == i and first[sets[j]] == j} | {(first[s], i) for i, s in enumerate(sets) if s and first[s] != i}
    seen = []
    keep = dedup._candidates
    monkeypatch.setattr(dedup, "_candidates", lambda *a: seen.append(keep(*a)) or seen[0])
    assert {(r.a - 1000, r.b - 1000) for r in dedup.near_duplicates(df).collect()} == want
    assert seen[0].count() <= len(want) + 20  # of 80,000 pairs, which share most of their words' prefixes


def test_characters_are_words_alike(spark):
    chars = [chr(i) for i in range(0x180)] + [chr(i) for i in (0x2003, *range(0x2010, 0x2028), 0x20AC, 0xFEFF)]
    df = spark.createDataFrame([(c,) for c in chars], "c string")
    got = df.select("c", F.col("c").rlike(X.WORD).alias("word"), F.col("c").rlike(dedup.ALIKE).alias("rare")).collect()
    assert [r.c for r in got if r.rare or r.word != bool(re.search(r"\w", r.c))] == []


def test_clusters_read_pairs_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    pairs = spark.createDataFrame([(i, i + 1) for i in range(30)], "a long, b long").mapInArrow(counted, "a long, b long")
    got = {r.id: r.cluster for r in dedup.clusters(pairs).collect()}
    assert got == dict.fromkeys(range(31), 0) and seen.value == 30


def test_minhash_signs_paired_documents_only(spark, tmp_path, monkeypatch):
    some = [*texts(60, 200), None, ""]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(some)], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    signed = []
    keep = catalog.written
    monkeypatch.setattr(catalog, "written", lambda df: signed.append(keep(df)) or signed[-1])
    got = {(r.a, r.b): (r.similarity, r.estimate) for r in catalog.minhash_similarity(spark, str(tmp_path)).collect()}
    pairs = dedup.near_duplicates(docs, 0.85, "token", "doc_id")
    every = {r.doc_id: r.s for r in docs.select("doc_id", dedup.minhash(F.array_distinct(X.words(F.col("text"))), 64).alias("s")).collect()}
    assert got == {(r.a, r.b): (round(r.similarity, 6), sum(x == y for x, y in zip(every[r.a], every[r.b])) / 64) for r in pairs.collect()}
    ids = {i for pair in got for i in pair}
    assert 0 < len(ids) < len(some) and {r.doc_id for r in signed[-1].collect()} == ids
