"""Problems 2, 3, 4, 6, 7: operators on sets of records."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeloom.llm import p2_ledger, p3_near, p4_knn, p6_fusion, p7_packing


def test_canonical_text(spark):
    same = ["Owner: a b\nUnit: 3.5\nCity: Rome", '{"City": "rome", "Owner": "A  B", "Unit": "3.5"}', "UNIT: 3.5; owner: a b; City: Rome", "City: Rome | Unit: 3.5 | Owner: a b"]
    other = ["Owner: rome\nUnit: 3.5\nCity: a b"]
    rows = [*same, *other, "Hello,  World!", "hello world", "helloworld\r\n", None, "", "\u00a0\t", "----", "- ---", '{"a": "1", "a": "1"}', '{"a": ', "x" * 200_000, '{"k": "' + 'v\\"' * 20_000 + '"}']
    df = spark.createDataFrame(list(enumerate(rows)), "id int, t string")
    got = {r.id: r.c for r in df.select("id", p2_ledger.canonical_text(F.col("t")).alias("c")).collect()}
    assert len({got[i] for i in range(4)}) == 1 and got[4] != got[0]
    assert got[5] == got[6] == got[7] and got[8] is got[9] is got[10] is None
    assert got[11] == got[12] and all(got[i] for i in range(13, 17))


def test_ledger_adds_batches(spark):
    rows = [(f"i{k:03d}", f"text number {k % 7}", None if k % 5 == 0 else k) for k in range(60)] + [("z", None, 1), ("y", " ", 1)]
    df = spark.createDataFrame(rows, "id string, content string, t int").withColumn("ingested_at", F.timestamp_seconds("t")).withColumn("key", F.lit("clash"))
    keys = p2_ledger.keyed(df, also=("ingested_at",))
    ledger = p2_ledger.build_ledger(p2_ledger._batches(keys, "ingested_at"))
    assert sorted((r.first_id, r.copies) for r in ledger.collect()) == [(f"i{k:03d}", 9 if k < 4 else 8) for k in range(7)]
    pairs = {(r.first_id, r.copy_id) for r in p2_ledger.copies(keys, ledger).collect()}
    assert pairs == {(f"i{k % 7:03d}", f"i{k:03d}") for k in range(7, 60)}
    empty = p2_ledger.build_ledger([keys.limit(0)])
    assert empty.count() == 0
    counts = p2_ledger.batch_counts
    assert p2_ledger.merge_ledger(empty, counts(keys)).count() == 7 and p2_ledger.merge_ledger(ledger, counts(keys.limit(0))).count() == 7


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    def batch(*texts):
        return p2_ledger.keyed(spark.createDataFrame([(f"{t}-{i}", t) for i, t in enumerate(texts)], "id string, content string"))

    ledger = p2_ledger.Ledger(spark, f"{tmp_path}/ledger")
    ledger.add(batch(*(f"text number {k}" for k in range(400)))).add(batch("text number 3", "TEXT, number 3!"))
    first, second = ledger._complete()
    touched = [b for b, g in ledger.latest().items() if g == second]
    assert len(touched) == 1 and len(ledger.latest()) > 20
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "ledger" / f"g={first}").rglob("*.parquet")}
    ledger.add(batch("quite another text", None, " "))
    assert {f: f.stat().st_mtime_ns for f in (tmp_path / "ledger" / f"g={first}").rglob("*.parquet")} == before
    plan = ledger.read(touched)._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    rows = {r.first_id: r.copies for r in p2_ledger.Ledger(spark, ledger.path).read().collect()}
    assert len(rows) == 401 and sorted(rows.values())[-2:] == [1, 3]
    ledger.vacuum()
    assert sum(r.copies for r in ledger.read().collect()) == 403


def test_records_meet_equal_plain_texts(spark):
    same = ["Name: Anna\nCity: Rome", "Name: Anna City: Rome", "name: anna, city: rome", "- **Name:** Anna\n- **City:** Rome", "Name: An\nna\nCity: Rome", "City:Rome; Name:Anna", '{"City": "Rome", "Name": "Anna"}', "City: Rome, Name: Anna", "; City: Rome; Name: Anna"]
    other = ["Name: Rome\nCity: Anna", "City: Rome Name: Anna Maria"]
    chain = ["A: x y\nB: z", "A: x, y B: z", "A: x\ny B: z", "y B: z | A: x", "B: z; A: x y"]
    df = spark.createDataFrame([(f"{g}{i}", x) for g, xs in zip("soc", (same, other, chain)) for i, x in enumerate(xs)], "id string, content string").withColumn("ingested_at", F.lit(None).cast("timestamp"))
    keys = p2_ledger.keyed(df, also=("ingested_at",)).cache()
    ledger = p2_ledger.build_ledger([keys])
    assert {(r.first_id, r.copy_id) for r in p2_ledger.copies(keys, ledger).collect()} == {("s0", f"s{i}") for i in range(1, len(same))} | {("c0", f"c{i}") for i in range(1, len(chain))}
    assert sorted(r.copies for r in p2_ledger.groups(ledger).select("group", "copies").distinct().collect()) == [1, 1, len(chain), len(same)]


def texts(rng, n):
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = rng.choices(vocabulary, k=rng.randint(1, 70)) if not out or rng.random() < 0.4 else list(rng.choice(out))
        for _ in range(rng.randint(0, max(1, len(base) // 6))):
            at = rng.randrange(len(base) + 1)
            if rng.random() < 0.5 and len(base) > 1:
                del base[min(at, len(base) - 1)]
            else:
                base.insert(at, rng.choice(vocabulary))
        out.append(base)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("block", [65536, 3])
def test_near_duplicates_against_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(p3_near, "BLOCK", block)
    rng = random.Random(3)
    t = texts(rng, 250)
    rows = [(f"c{i:04d}", x) for i, x in enumerate([*t, *t[:20], None, "", " ", "!!!", " ".join(f"v{i}" for i in range(3000)), " ".join(f"v{i}" for i in range(1, 3001))])]
    df = spark.createDataFrame(rows, "id string, content string").withColumn("key", F.lit(0)).withColumn("rep", F.lit("clash"))
    sets = p3_near.word_sets(df).cache()
    links = p3_near.class_links(p3_near.classes_of(sets), sets)
    member = {r.id: r.rep for r in p3_near.members_of(sets).collect()}
    words = {i: frozenset(re.findall(r"\w+", x.lower())) for i, x in rows if x and re.search(r"\w", x)}
    reps = sorted(set(member.values()))
    want = {(a, b) for a, b in itertools.combinations(reps, 2) if len(words[a] & words[b]) >= 0.8 * len(words[a] | words[b]) - 1e-9}
    assert {(r.a, r.b) for r in links.collect()} == want and len(want) > 30
    assert set(member) == set(words)
    none = p3_near.word_sets(df.limit(0))
    assert p3_near.class_links(p3_near.classes_of(none), none).count() == 0


def prefix_blocks(texts, filer, counts=None):
    """Rows of the blocks of ``texts`` (ids t0, t1, ...), sorted as the joiner wants them."""
    words = [[int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little", signed=True) for w in sorted(set(x.split()))] for x in texts]
    if counts is None:
        counts = np.bincount(np.concatenate(words) % p3_near.BUCKETS, minlength=p3_near.BUCKETS).astype(np.int32)
    batch = pa.RecordBatch.from_arrays([pa.array([f"t{i}" for i in range(len(texts))]), pa.array(words, pa.list_(pa.int64()))], names=["rep", "words"])
    rows = pa.Table.from_batches(filer(SimpleNamespace(value=counts))(iter([batch])))
    return rows.sort_by([(c, "ascending") for c in ("word", "salt", "looks", "pos", "n")]).combine_chunks()


def one_subject(seed, n):
    """Long texts over a few words, no two alike but for those changed on purpose."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(160)]
    plain = [rng.sample(vocabulary, rng.randint(85, 110)) for _ in range(n)]
    return [" ".join(x) for x in [*plain, *([*x[4:], "v1", "v2"] for x in plain[:20])]]


def alike(texts, t=0.8):
    words = [frozenset(x.split()) for x in texts]
    return {tuple(sorted((f"t{i}", f"t{j}"))) for i, j in itertools.combinations(range(len(texts)), 2) if len(words[i] & words[j]) >= t * len(words[i] | words[j]) - 1e-9}


def test_a_large_block_leaves_few_pairs_to_verify():
    # the words of a subject don't grow with its records, so what bounds can't tell apart grows with their square
    t = one_subject(1, 600)
    got = [r for b in p3_near._joiner(0.8)(iter(prefix_blocks(t, lambda c: p3_near._filer(c, 0.8)).to_batches(max_chunksize=10_000))) for r in zip(*b.to_pydict().values())]
    found, true = {tuple(sorted(p)) for p in got}, alike(t)
    assert true <= found and len(true) >= 20
    assert len(found) <= 1.5 * len(true) + 20


@pytest.mark.parametrize("tiled", [0, 300, 10**9])
@pytest.mark.parametrize("at_once", [300, 10_000])
def test_tiles_and_leaves_against_all_pairs(tiled, at_once, monkeypatch):
    monkeypatch.setattr(p3_near, "TILED", tiled)
    monkeypatch.setattr(p3_near, "TILE", (5, 7))
    rng = random.Random(5)
    long = [f"l{i}" for i in range(1500)]
    t = [*texts(rng, 120), *one_subject(2, 40), *(" ".join(rng.sample(long, k)) for k in (300, 700, 1400))]
    t = list({frozenset(x.split()): x for x in [*t, *(" ".join(x.split()[k:] + ["v3"]) for k, x in enumerate(t[-3:], 3))] if x}.values())
    for sim in (0.6, 0.8):
        rows = prefix_blocks(t, lambda c, sim=sim: p3_near._filer(c, sim))
        found = {tuple(sorted(p)) for b in p3_near._joiner(sim)(iter(rows.to_batches(max_chunksize=at_once))) for p in zip(*b.to_pydict().values())}
        true = alike(t, sim)
        assert true <= found and len(true) > 10


def test_lookups_are_repeated_for_filed_points_only(spark, monkeypatch):
    # "the" is in all records, but the last of their words: nothing is filed under it, so there is no block to split
    monkeypatch.setattr(p3_near, "BLOCK", 40)
    t = [f"the {' '.join(f'w{(i * 7 + k) % 997}' for k in range(30))} {'hot' if i % 2 else ''}" for i in range(400)]
    sets = p3_near.word_sets(spark.createDataFrame(list(enumerate(t)), "id int, content string"))
    counts = SimpleNamespace(value=p3_near._counts(sets))
    parts = p3_near._parts(sets, counts, 0.8, 40, 1)
    assert parts is None and counts.value.max() == 400
    filed = p3_near._parts(sets, counts, 0.8, 3, 1)
    assert filed.max() > 1 and filed.max() <= -(-counts.value.max() // 3) // 4
    # a block that is split gives the same pairs
    want = {(r.a, r.b) for r in p3_near.class_links(p3_near.classes_of(sets), sets).collect()}
    monkeypatch.setattr(p3_near, "BLOCK", 3)
    assert {(r.a, r.b) for r in p3_near.class_links(p3_near.classes_of(sets), sets).collect()} == want


def test_nearest_vectors(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 20))
    x[300:] = x[:300] + 0.05 * rng.standard_normal((300, 20))
    rows = [(f"v{i:04d}", r.tolist()) for i, r in enumerate(x)] + [("n", None), ("s", [1.0]), ("q", [1.0] * 20), ("k", [float("nan")] + [1.0] * 19), ("i", [float("inf")] + [1.0] * 19), ("e", []), ("m", [None] + [1.0] * 19), ("big", (x[0] * 1e300).tolist())]
    df = spark.createDataFrame(rows, "id string, vector array<double>").withColumn("v", F.lit("clash"))
    for cell in (p4_knn.CELL, 50):
        monkeypatch.setattr(p4_knn, "CELL", cell)
        got: dict = {}
        for r in p4_knn.nearest(df).collect():
            got.setdefault(r.id, []).append((r.near_id, r.cosine))
        u = x / np.linalg.norm(x, axis=1)[:, None]
        s = u @ u.T
        np.fill_diagonal(s, -2)
        hit = sum(len({f"v{j:04d}" for j in np.argsort(-s[i])[:5]} & {n for n, _ in got[f"v{i:04d}"]}) for i in range(600))
        assert hit / 3000 >= 0.9
        assert set(got) == {f"v{i:04d}" for i in range(600)} | {"big"}
        assert all(len(v) == 5 and i not in dict(v) for i, v in got.items())
    few = p4_knn.nearest(df.where("id in ('v0000', 'v0001', 'n')")).collect()
    assert {(r.id, r.near_id) for r in few} == {("v0000", "v0001"), ("v0001", "v0000")}
    assert p4_knn.nearest(df.limit(0)).count() == 0


def brute_nearest(rows, k=5):
    x = np.array([v for _, v in rows], float)
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    s = x @ x.T
    return {i: [n for _, n in sorted((-round(float(s[a, b]), 5), rows[b][0]) for b in range(len(rows)) if b != a)[:k]] for a, (i, _) in enumerate(rows)}


def test_equal_vectors_are_neighbours(spark):
    """Equal vectors are one class; of equally similar ones the smaller ids come first, in whatever order the rows come."""
    rng = np.random.default_rng(4)
    kinds = np.round(rng.standard_normal((12, 20)), 1)
    rows = [(f"v{i:03d}", kinds[0 if i < 60 else i % 12].tolist()) for i in range(150)]
    want = brute_nearest(rows)
    for some in (rows, rows[::-1], random.Random(1).sample(rows, len(rows))):
        got: dict = {}
        for r in p4_knn.nearest(spark.createDataFrame(some, "id string, vector array<double>").repartition(3)).orderBy("id", F.desc("cosine"), "near_id").collect():
            got.setdefault(r.id, []).append(r.near_id)
        assert got == want
    df = spark.createDataFrame(rows, "id string, vector array<double>")
    exact: dict = {}
    for r in p4_knn.exact_nearest(df, df.where("id like '%5'")).orderBy("id", F.desc("cosine"), "near_id").collect():
        exact.setdefault(r.id, []).append(r.near_id)
    assert exact == {i: n for i, n in want.items() if i.endswith("5")}
    assert p4_knn.recall(df, p4_knn.nearest(df), df.where("id like '%5'")).first().recall == 1.0
    with pytest.raises(ValueError):
        old, p4_knn.MAX_QUERIES = p4_knn.MAX_QUERIES, 3
        try:
            p4_knn.exact_nearest(df, df)
        finally:
            p4_knn.MAX_QUERIES = old


def test_plans_hold_their_recall_for_more_rows(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 20))
    x[1000:] = x[rng.integers(0, 1000, 2000)] + 0.3 * rng.standard_normal((2000, 20))
    df = spark.createDataFrame([(f"v{i:05d}", r.tolist()) for i, r in enumerate(x)], "id string, vector array<double>")
    own = p4_knn.unit_vectors(df).cache()
    plans = [p4_knn.fit_plan(own, n) for n in (3_000, 300_000, 30_000_000)]
    assert plans[0].functions < plans[1].functions <= plans[2].functions
    for plan in plans:
        assert p4_knn.recall(df, p4_knn.nearest(df, plan=plan), df.where("id like '%00'")).first().recall >= 0.9


def test_probe_order_is_by_success():
    order = p4_knn.probe_order(4, 12)
    assert order[0] == () and order[1] == (0,) and len(set(order)) == 12
    assert all(7 - p not in places for places in order for p in places)


HITS = "array<struct<id:string,score:double>>"


def test_fusion(spark):
    nan = float("nan")
    lists = lambda *xs: [None if x is None else [None if h is None else {"id": h[0], "score": h[1]} for h in x] for x in xs]
    a = [("x", 0.9), ("y", 0.8), ("z", 0.1), ("u", 0.05)]
    b = [("y", 4000.0), ("x", 30.0), ("z", 10.0), ("v", 9.0)]
    rows = [
        ("r1", *lists(a, b, None)),
        ("r1", *lists(a, b, None)),
        ("r2", *lists(a, None, [])),
        ("r3", *lists([("p", nan), ("q", None)], a, [("k", 5.0), ("m", 5.0)])),
        ("r4", *lists([("p", 1.0), ("p", 3.0), ("q", 2.0), None, (None, 9.0)], [("q", -5.0), ("p", -9.0), ("w", -20.0)], None)),
        ("r5", *lists(None, None, None)),
        ("r6", *lists([("p", math.inf), ("q", 1.0), ("s", 0.0)], [("q", 2.0), ("p", 3.0), ("s", 0.0)], None)),
        ("r7", *lists([("k", 5.0), ("j", 5.0)], [("m", 1.0)], None)),
    ]
    df = spark.createDataFrame(rows, f"request_id string, vector_results {HITS}, bm25_results {HITS}, splade_results {HITS}").withColumn("rank", F.lit("clash"))
    top = {r.request_id: r.id for r in p6_fusion.fuse(df, top=1).collect()}
    assert set(top) == {"r1", "r3", "r4", "r6", "r7"} and top["r3"] == "x" and top["r4"] in ("p", "q") and top["r6"] == "p" and top["r7"] == "j"
    every = p6_fusion.fuse(df).where("request_id = 'r1'").collect()
    assert len(every) == 5 and [r.rank for r in sorted(every, key=lambda r: r.rank)] == [1, 2, 3, 4, 5]
    assert p6_fusion.fuse(df.limit(0)).count() == 0


def test_fusion_ignores_range():
    base = [{"a": 3.0, "b": 2.0, "c": 1.0, "d": 0.5}, {"b": 3.0, "a": 2.9, "c": 1.0, "d": 0.5}]
    scaled = [base[0], {k: 1e6 * v + 77 for k, v in base[1].items()}]
    assert [i for i, _ in p6_fusion.closeness(base)] == [i for i, _ in p6_fusion.closeness(scaled)]


def test_vector_normalisation_decides():
    """Without its length a list with one leader would weigh as much at each place as one whose items are close together."""
    lists = [{"a": 10.0, "b": 9.8, "c": 9.6, "d": 9.4, "e": 0.0}, {"b": 10.0, "a": 0.3, "c": 0.2, "d": 0.1, "e": 0.0, "f": 5.0}]
    plain = {i: sum((v - min(x.values())) / (max(x.values()) - min(x.values())) for x in lists for k, v in x.items() if k == i) for x in lists for i in x}
    got = [i for i, _ in p6_fusion.closeness(lists)]
    assert got[0] == "b" and got != sorted(plain, key=lambda i: -plain[i])
    heavy = [i for i, _ in p6_fusion.closeness(lists, [20.0, 0.1])]
    assert heavy[0] == "a" and heavy != got


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_valid_and_bounded(seed):
    rng = random.Random(seed)
    cap = rng.choice([50, 100, 512])
    sizes = [rng.randint(1, cap) for _ in range(rng.randint(1, 120))]
    bins = p7_packing.pack(sizes, cap)
    assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in b) <= cap for b in bins)
    falling = sorted(sizes, reverse=True)
    assert p7_packing.lower_bound(falling, cap) <= len(bins) <= len(p7_packing.best_fit(falling, cap))


def optimum(sizes, cap):
    best = len(sizes)

    def go(rest, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if not rest:
            best = len(rooms)
            return
        s = rest[0]
        for k in {r: k for k, r in enumerate(rooms) if r >= s}.values():
            go(rest[1:], (*rooms[:k], rooms[k] - s, *rooms[k + 1 :]))
        go(rest[1:], (*rooms, cap - s))

    go(sorted(sizes, reverse=True), ())
    return best


@pytest.mark.parametrize("seed", range(25))
def test_packing_without_budget_is_exact(seed):
    rng = random.Random(700 + seed)
    sizes = [rng.choice([rng.randint(20, 50), rng.randint(1, 100), 34]) for _ in range(10)]
    bins = p7_packing.pack(sizes, 100, nodes=None, keep=None)
    assert len(bins) == optimum(sizes, 100) and sorted(i for b in bins for i in b) == list(range(10)) and all(sum(sizes[i] for i in b) <= 100 for b in bins)


@pytest.mark.parametrize("seed", range(15))
def test_packing_against_exhaustive_search(seed):
    rng = random.Random(100 + seed)
    sizes = [rng.randint(5, 60) for _ in range(9)]
    assert p7_packing.lower_bound(sorted(sizes, reverse=True), 100) <= optimum(sizes, 100) <= len(p7_packing.pack(sizes, 100)) <= optimum(sizes, 100) + 1
    assert len(p7_packing.pack([44, 6, 24, 6, 22, 30, 18, 50, 100, 100], 100)) == 4  # 400 in all


def test_token_counts_equal_the_tokenizer():
    count = p7_packing.TokenCounter(p7_packing.TOKENIZER)
    for t in ("It's 3,440 items  at\n\n C:\\x — don't!", "tab\t\ttwo\r\n", "it'll 've 'S", "  ", "éa ñ 漢字", "a\x0bb\x1cc", "x" * 3000, "'s's"):
        assert count(t) == len(count.encode(t))


def test_pack_documents(spark):
    rows = [(1, "word " * 40), (2, "a b c"), (3, None), (4, " \n"), (5, "a b c"), (5, "a b c"), (6, "x y z " * 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    sizes = p7_packing.token_sizes(df).cache()
    caps = spark.createDataFrame([("s", 16), ("l", 100)], "profile string, capacity_tokens int")
    got = p7_packing.pack_documents(sizes, caps).collect()
    total = sum(r.tokens for r in sizes.collect())
    for p, cap in (("s", 16), ("l", 100)):
        own = [r for r in got if r.profile == p]
        assert sum(r.tokens for r in own) == total
        by: dict = {}
        for r in own:
            by[r.container] = by.get(r.container, 0) + r.tokens
        assert max(by.values()) <= cap
        assert {r.doc_id for r in own} == {1, 2, 5, 6}
        assert all(len([r for r in own if r.doc_id == d]) == 1 for d in (2,))
    assert p7_packing.pack_documents(sizes.limit(0), caps).count() == 0 and p7_packing.pack_documents(sizes, caps.limit(0)).count() == 0
    for r in p7_packing.packing_report(sizes, caps).collect():
        assert r.bound <= r.packed <= r.best_fit and r.shards == 1 and r.at_bound <= 1
    assert p7_packing.packing_report(sizes.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        p7_packing.pack_documents(sizes, spark.createDataFrame([("s", None)], "profile string, capacity_tokens int"))
