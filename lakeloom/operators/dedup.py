"""Deduplication of document tables: exact by content hash, near by set similarity, merging of groups.

Near duplicates: identical sets collapse first. Of each other set the parities of its elements' hash groups are kept;
sizes and parities discard pairs (as matrices, nothing is lost), and what is left is compared exactly.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import text as X
from ..sources.shared import cut, written


def exact_groups(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(hash, first_id, copies) of contents that occur more than once."""
    h = docs.select(F.col(key).alias("id"), X.content_hash(F.col(text)).alias("hash")).where("hash <> ''")
    return h.groupBy("hash").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")).where("copies > 1")


def drop_exact(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """The first of each content; null and blank texts all stay."""
    h = docs.withColumn("_hash", X.content_hash(F.col(text)))
    group = F.when(F.col("_hash") == "", F.concat(F.lit("#"), F.col(key).cast("string"))).otherwise(F.col("_hash"))
    first = h.groupBy(group.alias("_group")).agg(F.min(key).alias("_first"))
    return docs.join(first.select(F.col("_first").alias(key)), key, "left_semi")


#: Bytes of a chunk of sets (at least, at most), and how many chunks small inputs are cut into.
CHUNK, CHUNKS = (1 << 19, 1 << 23), 12
#: Sets compared at once as a matrix, and pairs after which the matrices' finds are compared in full.
TILE, PAIRS_AT_ONCE = (64, 1024), 1_000_000
#: Characters of which Python's and Java's ideas of a word character are the same.
ALIKE = r"[^\x{00}-\x{17f}\x{2003}\x{2010}-\x{2027}\x{20ac}\x{feff}]"
#: Pairs up to which their ids go to every task.
FEW = 100_000
#: Hashes of elements that a task remembers.
KNOWN = 1 << 20


def _width(n: np.ndarray) -> np.ndarray:
    """Numbers of 64 parities for a set of n elements: the power of two that gives four for each."""
    return 1 << np.ceil(np.log2(np.maximum(n, 16) / 16)).astype(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, h, n, parities) of (id, elements, text in lower case, whose words count where there are no elements)."""
    find, known = re.compile(r"\w+").findall, {}
    for b in batches:
        places, hs, flat, ns = [], [], [], []
        for i, (given, low) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
            s = set(given) if given is not None else set(find(low)) if low is not None else ()
            if not s:
                continue
            if len(known) > KNOWN:
                known = {}
            try:
                marks = [known[w] for w in s]
            except KeyError:
                for w in s:
                    if w not in known:
                        known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=4).digest(), "little")
                marks = [known[w] for w in s]
            places.append(i)
            hs.append(hashlib.sha256("\u0001".join(sorted(s)).encode()).digest())
            ns.append(len(s))
            flat.append(np.array(marks, np.int64))
        n = np.array(ns, np.int64)
        width, out = _width(n), [b""] * len(n)
        for w in np.unique(width):
            mine = np.flatnonzero(width == w)
            step = max(1, (1 << 16) // int(w))
            for k in range(0, len(mine), step):
                some, bits = mine[k : k + step], 64 * int(w)
                at = np.repeat(np.arange(len(some)), n[some]) * bits + (np.concatenate([flat[i] for i in some]) & (bits - 1))
                odd = (np.bincount(at, minlength=len(some) * bits) & 1).astype(np.uint8).reshape(len(some), bits)
                for i, packed in zip(some, np.packbits(odd, axis=1, bitorder="little")):
                    out[i] = packed.tobytes()
        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(places, pa.int64())), pa.array(hs, pa.binary()), pa.array(n.astype(np.int32)), pa.array(out, pa.binary())], names=["id", "h", "n", "parities"])


def _chunks(n: np.ndarray, count: np.ndarray, threshold: float) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """For sets in order of size: where each size begins in bytes, a chunk's bytes, and for each chunk the first and last one whose sets may be similar to its own."""
    weight = count * (64 + 8 * _width(n))
    begins = np.cumsum(weight) - weight
    total = int(weight.sum())
    each = min(max(total / CHUNKS, CHUNK[0]), CHUNK[1])
    edges = np.arange(int(total // each) + 1) * each
    low = n[np.searchsorted(begins, edges, "right") - 1]
    high = n[np.searchsorted(begins, np.minimum(edges + each, total - 1), "right") - 1]
    return begins, each, np.searchsorted(high, threshold * low - 1e-9, "left"), np.searchsorted(threshold * low - 1e-9, high, "right") - 1


def _dealt(plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(one, two, larger, id, n, parities): each set in each pair of chunks that its chunk has part in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, count, begins, each, first, last = plan.value
        for b in batches:
            n = b.column(1).to_numpy().astype(np.int64)
            of = np.searchsorted(sizes, n)
            spread = np.array([zlib.crc32(str(i).encode()) for i in b.column(0).to_pylist()], np.int64)  # by the id, so that a repeated task deals alike
            mine = ((begins[of] + spread % count[of] * (64 + 8 * _width(n))) // each).astype(np.int64)
            times = last[mine] - first[mine] + 1
            rows = np.repeat(np.arange(len(n)), times)
            other = np.arange(len(rows)) - np.repeat(np.cumsum(times) - times, times) + first[mine][rows]
            own = mine[rows]
            for k in range(0, len(rows), 20_000):
                i, o, m = rows[k : k + 20_000], other[k : k + 20_000], own[k : k + 20_000]
                cols = [pa.array(np.minimum(o, m).astype(np.int32)), pa.array(np.maximum(o, m).astype(np.int32)), pa.array(o <= m), *(b.column(c).take(pa.array(i)) for c in range(3))]
                yield pa.RecordBatch.from_arrays(cols, names=["one", "two", "larger", "id", "n", "parities"])

    return run


class _Side:
    """The sets of a chunk in order of size, with their parities folded to any smaller width."""

    def __init__(self, rows: pa.Table):
        rows = rows.take(pa.array(np.argsort(rows["n"].to_numpy(), kind="stable"))).combine_chunks()
        self.ids, self.n = rows["id"].combine_chunks(), rows["n"].to_numpy().astype(np.int64)
        self.width, self.folded = _width(self.n), {}
        flat, start = np.frombuffer(b"".join(rows["parities"].to_pylist()), np.uint64), np.cumsum(self.width) - self.width
        ends = np.flatnonzero(np.r_[self.width[1:] != self.width[:-1], True])
        self.parts = [(i, e + 1, flat[start[i] : start[e] + self.width[e]].reshape(e + 1 - i, -1)) for i, e in zip(np.r_[0, ends[:-1] + 1], ends)]

    def at(self, width: int) -> np.ndarray:
        """(width, sets); of sets with fewer parities nothing is used."""
        if width not in self.folded:
            out = np.zeros((width, len(self.n)), np.uint64)
            for i, e, m in self.parts:
                if m.shape[1] >= width:
                    out[:, i:e] = np.bitwise_xor.reduce(m.reshape(e - i, -1, width), axis=1).T
            self.folded[width] = out
        return self.folded[width]


def _near(x: _Side, y: _Side, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs, in x the smaller set and in y the larger, that the parities leave. x is y: each pair once.

    Two sets differ in at least as many elements as parities; folding makes fewer parities of many.
    """
    slack = (1 - threshold) / (1 + threshold)
    held: list[np.ndarray] = []

    def left() -> tuple[np.ndarray, np.ndarray]:
        i, j = np.concatenate([p for p, _ in held]), np.concatenate([p for _, p in held])
        held.clear()
        width, keep = x.width[i], []
        for w in np.unique(width):
            some = np.flatnonzero(width == w)
            a, b = x.at(int(w)), y.at(int(w))
            differ = np.zeros(len(some), np.int64)
            for k in range(int(w)):
                differ += np.bitwise_count(a[k][i[some]] ^ b[k][j[some]])
            keep.append(some[differ <= slack * (x.n[i[some]] + y.n[j[some]]) + 1e-6])
        ok = np.concatenate(keep)
        return i[ok], j[ok]

    waiting = 0
    for s in range(0, len(y.n), TILE[0]):
        e = min(s + TILE[0], len(y.n))
        lo, hi = np.searchsorted(x.n, threshold * y.n[s] - 1e-6, "left"), e if x is y else np.searchsorted(x.n, y.n[e - 1], "right")
        for k in range(lo, hi, TILE[1]):
            m = min(k + TILE[1], hi)
            most = slack * (y.n[e - 1] + x.n[k:m]) + 1e-6
            width = int(min(x.width[k], y.width[s], 1 << max(0, math.ceil(math.log2(3 * most[-1] / 64)))))
            a, b = x.at(width), y.at(width)
            differ = np.bitwise_count(b[0, s:e, None] ^ a[0, k:m])
            if width > 3:
                differ = differ.astype(np.int32)
            for w in range(1, width):
                differ += np.bitwise_count(b[w, s:e, None] ^ a[w, k:m])
            hit = np.flatnonzero(differ <= most.clip(max=64 * width).astype(differ.dtype))
            i, j = k + hit % (m - k), s + hit // (m - k)
            if x is y and m > s:
                i, j = i[i < j], j[i < j]
            if len(i):
                held.append((i, j))
                waiting += len(i)
            if waiting > PAIRS_AT_ONCE:
                yield left()
                waiting = 0
    if held:
        yield left()


def _compared(threshold: float, schema: pa.Schema) -> Callable[[pa.Table], pa.Table]:
    def run(rows: pa.Table) -> pa.Table:
        larger = rows["larger"].to_numpy()
        same = rows["one"][0].as_py() == rows["two"][0].as_py()
        if not same and larger.all() or not larger.any():
            return pa.Table.from_batches([], schema)
        y = _Side(rows.filter(pa.array(larger)))
        x = y if same else _Side(rows.filter(pa.array(~larger)))
        found = [pa.RecordBatch.from_arrays([x.ids.take(pa.array(i)), y.ids.take(pa.array(j))], schema=schema) for i, j in _near(x, y, threshold)]
        return pa.Table.from_batches(found, schema)

    return run


def _candidates(whole: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of different sets, a < b, of which sizes and parities don't show that they are too different.

    Sets are cut into chunks by size; each two chunks that may hold similar sets are compared in one task, set by set.
    """
    spark, kind = whole.sparkSession, whole.schema["id"].dataType
    some = whole.where(F.col("n") >= threshold / (1 - threshold) - 1e-6) if threshold < 1 else whole.limit(0)  # smaller sets are similar to equal ones only
    got = some.groupBy("n").count().toArrow()  # a row for each size
    order = np.argsort(got["n"].to_numpy())
    n, count = got["n"].to_numpy()[order].astype(np.int64), got["count"].to_numpy()[order]
    if not len(n):
        return spark.createDataFrame([], f"a {kind.simpleString()}, b {kind.simpleString()}")
    begins, each, first, last = _chunks(n, count, threshold)
    plan = spark.sparkContext.broadcast((n, count, begins, each, first, last))
    rows = some.select("id", "n", "parities").mapInArrow(_dealt(plan), f"one int, two int, larger boolean, id {kind.simpleString()}, n int, parities binary")
    tasks = int((np.arange(len(first)) - first + 1).sum())
    ids = to_arrow_type(kind)
    pairs = rows.repartition(min(tasks, 2_000), "one", "two").groupBy("one", "two").applyInArrow(_compared(threshold, pa.schema([("a", ids), ("b", ids)])), f"a {kind.simpleString()}, b {kind.simpleString()}")
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def rows_of(docs: DataFrame, pairs: DataFrame, key: str = "id") -> DataFrame:
    """The rows whose key is in a pair; ``pairs`` is read twice."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias(key)).distinct()
    return docs.join(F.broadcast(ids) if pairs.count() < FEW else ids, key, "left_semi")


def similar_pairs(docs: DataFrame, elements: Column, threshold: float = 0.85, key: str = "id", words_of: Column | None = None) -> DataFrame:
    """(a, b, similarity), a < b, of representatives of different sets; and of copies with their representative (similarity 1).

    ``words_of``: where the elements are the words of this text. ``docs`` is read twice: for the sets, and for those of the candidates.
    """
    id_ = F.col(key).alias("id")
    if words_of is None:
        given = docs.select(id_, elements.alias("s"), F.lit(None).cast("string").alias("low"))
    else:
        low = F.lower(words_of)
        rare = (F.octet_length(low) > F.length(low)) & low.rlike(ALIKE)
        given = docs.select(id_, F.when(rare, elements).alias("s"), F.when(~rare, low).alias("low"))
    sets = written(given.mapInArrow(_signed, f"id {docs.schema[key].dataType.simpleString()}, h binary, n int, parities binary"))
    whole = written(sets.groupBy("h").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("parities").alias("parities"), F.count("*").alias("copies")))
    several = whole.where("copies > 1").select("h", F.col("id").alias("a"))
    copies = sets.select("id", "h").join(several, "h").where("id <> a").select("a", F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    cand = written(_candidates(whole, threshold))
    found = rows_of(docs, cand, key).select(id_, F.array_sort(F.array_distinct(elements)).alias("s"))
    found = written(found.select("id", "s", F.unhex(F.sha2(F.concat_ws("\u0001", "s"), 256)).alias("h")))  # else a test for null by the join below takes the elements of all rows
    reps = found.join(whole.select("id", "h"), ["id", "h"], "left_semi").dropDuplicates(["id", "h"])
    checked = cand.join(reps.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a").join(reps.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    sim = checked.select("a", "b", X.jaccard(F.col("sa"), F.col("sb")).alias("similarity")).where(F.col("similarity") >= threshold - 1e-12)
    return sim.unionByName(copies)


def near_duplicates(docs: DataFrame, threshold: float = 0.85, kind: str = "token", key: str = "id", text: str = "text") -> DataFrame:
    """Pairs by word sets (``token``) or by character 3-grams (``shingle``)."""
    c = F.col(text)
    docs = docs.select(key, text)
    return similar_pairs(docs, X.words(c), threshold, key, c) if kind == "token" else similar_pairs(docs, X.char_shingles(c), threshold, key)


def clusters(pairs: DataFrame) -> DataFrame:
    """(id, cluster): connected components, named by their smallest id; the loop ends when no edge is left.

    In each round every node hooks onto its smallest neighbour if that is smaller, and a smallest node that nobody hooked
    onto does so too. This gives trees of two nodes at least; they are jumped flat and contracted, so nodes halve each round.
    """
    both = F.explode(F.array(F.struct(F.col("a").alias("x"), F.col("b").alias("y")), F.struct(F.col("b").alias("x"), F.col("a").alias("y"))))  # a union would search for the pairs twice
    edges = cut(pairs.select(both.alias("e")).select("e.*").distinct())
    label = edges.select(F.col("x").alias("id"), F.col("x").alias("label")).distinct()
    edges = edges.where("x <> y")
    while edges.limit(1).count():
        least = cut(edges.groupBy("x").agg(F.min("y").alias("up")))
        down = least.where("up < x")
        up = cut(down.unionByName(least.where("up > x").join(down.select(F.col("up").alias("x")).distinct(), "x", "left_anti")))
        while True:
            over = cut(up.join(up.select(F.col("x").alias("up"), F.col("up").alias("over")), "up", "left").select("x", F.coalesce("over", "up").alias("up"), F.col("over").isNotNull().alias("moved")))
            up = over.select("x", "up")
            if not over.where("moved").limit(1).count():
                break
        root = lambda df, c: df.join(up.select(F.col("x").alias(c), F.col("up").alias("_up")), c, "left").withColumn(c, F.coalesce("_up", c)).drop("_up")  # noqa: E731, B023
        label = cut(root(label, "label"))
        edges = cut(root(root(edges, "x"), "y").where("x <> y").select("x", "y").distinct())
    return label.join(label.groupBy("label").agg(F.min("id").alias("cluster")), "label").select("id", "cluster")


def detect_duplicates(docs: DataFrame, threshold: float = 0.85, kind: str = "shingle", key: str = "id", text: str = "text") -> DataFrame:
    """(kind, cluster, size): exact groups by hash and clusters of similar texts, named by their smallest id."""
    exact = exact_groups(docs, key, text).select(F.lit("exact").alias("kind"), F.col("first_id").alias("cluster"), F.col("copies").alias("size"))
    near = clusters(near_duplicates(docs, threshold, kind, key, text)).groupBy("cluster").agg(F.count("*").alias("size")).select(F.lit("near").alias("kind"), "cluster", "size")
    return exact.unionByName(near)


def merge(docs: DataFrame, members: DataFrame, key: str = "id", text: str = "text", source: str = "source") -> DataFrame:
    """One row for each cluster: the longest text (the first on a tie), the distinct sources, and what was merged."""
    m = docs.join(members.select(F.col("id").alias(key), "cluster"), key)
    order = F.struct(F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"))
    best = m.groupBy("cluster").agg(F.max(order["n"]).alias("n"), F.count("*").alias("merged_from"), F.array_sort(F.collect_set(source)).alias("sources"))
    longest = m.join(best.select("cluster", "n"), "cluster").where(F.length(F.coalesce(F.col(text), F.lit(""))) == F.col("n")).groupBy("cluster").agg(F.min(key).alias(key))
    return longest.join(best.drop("n"), "cluster").join(docs.select(key, text), key).select("cluster", key, text, "merged_from", "sources", (F.col("merged_from") > 1).alias("is_merged"))


def deduplicate(docs: DataFrame, threshold: float = 0.85, key: str = "id", text: str = "text", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The table without copies, near-copies merged into one row each; and a one-row summary."""
    first = written(drop_exact(docs, key, text).select(key, text, source))
    group = clusters(near_duplicates(first, threshold, "token", key, text))
    merged = merge(first, group, key, text, source)
    alone = first.join(group.select(F.col("id").alias(key)), key, "left_anti").select(F.col(key).alias("cluster"), key, text, F.lit(1).cast("bigint").alias("merged_from"), F.array(source).alias("sources"), F.lit(False).alias("is_merged"))
    out = merged.unionByName(alone)
    stats = docs.agg(F.count("*").alias("original")).select("original", F.lit(first.count()).alias("after_exact"), F.lit(out.count()).alias("final"))
    return out, stats


def minhash(elements: Column, permutations: int = 100, seed: int = 1) -> Column:
    """Signature of a set by a seeded hash family, so that signatures compare; empty for an empty set."""
    least = lambda i: F.array_min(F.transform(elements, lambda e: F.xxhash64(F.lit(seed * 7919 + i), e)))
    return F.when(F.size(elements) > 0, F.array(*map(least, range(permutations)))).otherwise(F.array().cast("array<bigint>"))


def signature_similarity(a: Column, b: Column) -> Column:
    same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(F.size(a) > 0, same / F.size(a)).otherwise(0.0)


