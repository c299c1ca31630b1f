r"""Problem 3: near-duplicate records.

Two records are alike if their sets of distinct words have a Jaccard similarity of at least ``t``.

1. Records with equal word sets collapse into a class, whose smallest id stands for it.
2. Words are put in one global order, rare ones first (by the exact count of their hash bucket). With
   ``n`` words, a class is filed under its first ``n - ceil(2t/(1+t) n) + 1`` words and looks itself up
   under its first ``n - ceil(t n) + 1``: of two alike classes the smaller is filed under a word under
   which the larger looks. This splits the work; the rest happens in each word's block.
3. Words are hashed into ``GROUPS`` groups, and a class is the point of its group counts. The points of
   a block are packed into the leaves of an R-tree (sorted by size and partial sums, ``LEAF`` points
   each, with the bounding box of each leaf). The sum over the groups of the smaller coordinate bounds
   the overlap from above, for a leaf by the upper corner of its box, for a pair by the two points;
   with the sizes and the words' places this discards leaves and pairs.
4. Counts in ``PARITIES`` further groups are kept as odd or even. Two classes differ in at least as many
   words as parities, so one exclusive-or discards a pair. In a block of more than ``TILED`` pairs, where
   boxes discard next to nothing, the leaves are instead ranges of places and sizes, and their
   parities are compared as matrices.
5. The words of the surviving pairs are compared exactly.

Nothing is lost: each bound is an upper bound, no block is capped. A block with more than about ``BLOCK``
filed points (estimated from a sample of the classes) is split by salt, and those that look are sent to
every part. Memory in a task is bounded by its part of a block and one batch of lookups.

Defined cases: null, empty and blank texts, and texts without any word, take no part. Equal rows are
one record each; pairs need two different ids. Results carry ids only, so other columns can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import JAVA_WORD, not_blank, table, written

GROUPS = 32
#: A coordinate's largest value (four bits); words beyond it count as possibly shared.
FULL = 15
#: Groups of which only the parity is kept: two words of 64 bits.
PARITIES = 128
LEAF = 48
BLOCK = 1 << 18
#: Pairs from which on a block is compared in tiles of so many lookups and filed points.
TILED = 20_000
TILE = (64, 1024)
#: One in so many classes is looked at to estimate how many points are filed under a word.
SAMPLE = 8
#: Hash buckets of the word counts: bounds what the driver gathers, and changes only the order of words.
BUCKETS = 1 << 18
PAIRS_AT_ONCE = 1_000_000


def word_sets(df: DataFrame, id_col: str = "id", text: str = "content") -> DataFrame:
    """(id, key, form): the distinct words, sorted and joined by spaces, and the SHA-256 of that."""
    words = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit(JAVA_WORD), F.lit(0))))
    form = df.where(not_blank(F.col(text))).select(F.col(id_col).cast("string").alias("id"), F.array_join(words, " ").alias("form"))
    return form.where("form <> ''").select("id", F.unhex(F.sha2("form", 256)).alias("key"), "form")


def classes_of(sets: DataFrame) -> DataFrame:
    """(rep, form, copies): one row for each distinct word set."""
    return sets.groupBy("key").agg(F.min("id").alias("rep"), F.first("form").alias("form"), F.count("*").alias("copies")).drop("key")


def _counts(sets: DataFrame) -> np.ndarray:
    """How many records have a word of each bucket; the driver gathers ``BUCKETS`` numbers at most."""
    hashed = sets.select(F.explode(F.split("form", " ")).alias("w")).select(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b"))
    counted = hashed.groupBy("b").count().select("b", F.col("count").cast("int").alias("n"))
    got = counted.toArrow()
    out = np.zeros(BUCKETS, np.int32)
    out[got["b"].to_numpy()] = got["n"].to_numpy()
    return out


def _need(t: float, n: np.ndarray) -> np.ndarray:
    return np.ceil(t * n - 1e-9).astype(np.int64)


#: The parities and the point of a class are two numbers each.
MARKS = ("parity_0", "parity_1", "point_0", "point_1")
ROWS = pa.schema([("word", pa.int64()), ("salt", pa.int32()), ("looks", pa.bool_()), ("rep", pa.string()), ("n", pa.int32()), ("pos", pa.int32()), *((x, pa.int64()) for x in MARKS)])
ROWS_SQL = "word long, salt int, looks boolean, rep string, n int, pos int, " + ", ".join(f"{x} long" for x in MARKS)


def _grouped(doc: np.ndarray, group: np.ndarray, docs: int, groups: int) -> np.ndarray:
    return np.bincount(doc * groups + group, minlength=docs * groups).reshape(docs, groups)


def _marks(doc: np.ndarray, h: np.ndarray, docs: int) -> np.ndarray:
    """One row of ``MARKS`` for each class."""
    odd = (_grouped(doc, (h >> 20) & (PARITIES - 1), docs, PARITIES) & 1).astype(np.uint8)
    point = _grouped(doc, (h >> 40) & (GROUPS - 1), docs, GROUPS).clip(max=FULL).astype(np.uint8)
    both = np.hstack([np.packbits(odd, axis=1, bitorder="little"), point[:, ::2] | (point[:, 1::2] << 4)])
    return np.ascontiguousarray(both).view(np.int64).reshape(docs, len(MARKS))


def _filed_counts(counts, t: float):
    """(b, n): how many of the classes are filed under the words of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for rows in _filer(counts, t)(batches):
            filed = rows.column(0).to_numpy()[~rows.column(2).to_numpy(zero_copy_only=False)]
            total += np.bincount(np.mod(filed, BUCKETS), minlength=BUCKETS)
        b = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(b.astype(np.int32)), pa.array(total[b])], names=["b", "n"])

    return run


def _hashed(classes: DataFrame) -> DataFrame:
    return classes.select("rep", F.transform(F.split("form", " "), lambda w: F.xxhash64(w)).alias("words"))


def _parts(sets: DataFrame, counts, t: float, block: int, sample: int) -> np.ndarray | None:
    """The parts of the block of each bucket's words; nothing if none needs to be split."""
    if counts.value.max(initial=0) <= block:
        return None
    some = _hashed(classes_of(sets.where(F.pmod(F.xxhash64("key"), F.lit(sample)) == 0)))
    got = some.mapInArrow(_filed_counts(counts, t), "b int, n long").groupBy("b").agg(F.sum("n").alias("n")).where(F.col("n") * sample > block).toArrow()
    parts = np.ones(BUCKETS, np.int32)
    parts[got["b"].to_numpy()] = -(-got["n"].to_numpy() * sample // block)
    return parts if got.num_rows else None


def _filer(counts, t: float, parts=None):
    """Rows of the classes under the words they are filed under and look themselves up under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_bucket = counts.value
        parts_of = parts.value if parts is not None else np.ones(BUCKETS, np.int32)
        for b in batches:
            lists, reps = b.column(1), b.column(0)
            ends = lists.offsets.to_numpy()
            h = lists.values.to_numpy()[ends[0] : ends[-1]]
            n = np.diff(ends)
            doc = np.repeat(np.arange(len(n)), n)
            marks = _marks(doc, h, len(n))
            count = of_bucket[np.mod(h, BUCKETS)]
            order = np.lexsort((h, count, doc))
            h, count = h[order], count[order]
            pos = np.arange(len(h)) - (ends[:-1] - ends[0])[doc]
            look = n - _need(t, n) + 1
            file = n - _need(2 * t / (1 + t), n) + 1
            for looks, most in ((False, file), (True, look)):
                at = np.flatnonzero((pos < most[doc]) & (n[doc] > 1))
                split = parts_of[np.mod(h[at], BUCKETS)]
                if looks:  # to every part of a split block
                    at = np.repeat(at, split)
                    first = np.r_[True, at[1:] != at[:-1]] if len(at) else np.zeros(0, bool)
                    run_start = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0)) if len(at) else at
                    salt = np.arange(len(at)) - run_start
                else:
                    salt = np.zeros(len(at), np.int64)
                    hot = np.flatnonzero(split > 1)  # by the id, so that a repeated task files alike
                    salt[hot] = [zlib.crc32(reps[int(d)].as_py().encode()) % int(p) for d, p in zip(doc[at[hot]], split[hot])]
                for k in range(0, len(at), 50_000):
                    a, s = at[k : k + 50_000], salt[k : k + 50_000]
                    d = doc[a]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(h[a]),
                            pa.array(s.astype(np.int32)),
                            pa.array(np.full(len(a), looks)),
                            reps.take(pa.array(d)),
                            pa.array(n[d].astype(np.int32)),
                            pa.array(pos[a].astype(np.int32)),
                            *(pa.array(marks[d, k]) for k in range(len(MARKS))),
                        ],
                        names=ROWS.names,
                    )

    return run


def _points(marks: np.ndarray) -> np.ndarray:
    """The coordinates of packed points."""
    packed = np.ascontiguousarray(marks[:, 2:]).view(np.uint8)
    out = np.empty((len(marks), GROUPS), np.uint8)
    out[:, ::2], out[:, 1::2] = packed & FULL, packed >> 4
    return out


def _spread(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges: the range each element belongs to, and the element."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - (np.cumsum(sizes) - sizes)[of] + starts[of]


def _may_be_alike(c: dict, x: np.ndarray, y: np.ndarray, t: float) -> np.ndarray:
    """Which pairs (filed row, looking row) sizes, places, parities and points leave."""
    share = t / (1 + t)
    na, nb, pa_, pb = c["n"][x], c["n"][y], c["pos"][x], c["pos"][y]
    need = np.ceil(share * (na + nb) - 1e-9)
    out = np.flatnonzero((na <= nb) & (na >= t * nb - 1e-9) & (np.minimum(na - pa_, nb - pb) >= need) & (pa_ + pb <= na + nb - 2 * need))
    for k in range(0, len(out), PAIRS_AT_ONCE):
        i = out[k : k + PAIRS_AT_ONCE]
        differ = np.bitwise_count(c["marks"][x[i], :2] ^ c["marks"][y[i], :2]).sum(1, dtype=np.int64)
        i = i[differ <= (na + nb - 2 * need)[i]]
        one, two = _points(c["marks"][x[i]]), _points(c["marks"][y[i]])
        beyond = np.minimum(na[i] - one.sum(1, dtype=np.int64), nb[i] - two.sum(1, dtype=np.int64))
        i = i[np.minimum(one, two).sum(1, dtype=np.int64) + beyond >= need[i]]
        out[k : k + PAIRS_AT_ONCE] = np.r_[i, np.full(min(PAIRS_AT_ONCE, len(out) - k) - len(i), -1)]
    return out[out >= 0]


def _by_leaves(c: dict, filed: np.ndarray, looks: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (filed row, looking row) of many blocks that the bounds leave."""
    filed = filed[np.lexsort((_points(c["marks"][filed])[:, : GROUPS // 2].sum(1), c["n"][filed], c["g"][filed]))]
    g = c["g"][filed]
    first = np.r_[True, g[1:] != g[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
    new = first | ((np.arange(len(g)) - start) % LEAF == 0)
    leaf_at = np.flatnonzero(new)
    leaf_size = np.diff(np.r_[leaf_at, len(g)])
    top = np.maximum.reduceat(_points(c["marks"][filed]), leaf_at, axis=0)
    n_low, n_high = np.minimum.reduceat(c["n"][filed], leaf_at), np.maximum.reduceat(c["n"][filed], leaf_at)
    pos_low = np.minimum.reduceat(c["pos"][filed], leaf_at)
    leaf_g = g[leaf_at]
    b = {"n": c["n"][looks], "pos": c["pos"][looks], "p": _points(c["marks"][looks])}
    b["beyond"] = b["n"] - b["p"].sum(1, dtype=np.int64)
    lo, hi = np.searchsorted(c["g"][looks], leaf_g, "left"), np.searchsorted(c["g"][looks], leaf_g, "right")
    share = t / (1 + t)
    work = np.cumsum(hi - lo)
    cuts = np.searchsorted(work, np.arange(PAIRS_AT_ONCE, (work[-1] if len(work) else 0) + PAIRS_AT_ONCE, PAIRS_AT_ONCE), "left") + 1
    s = 0
    for e in cuts:
        e = min(int(e), len(leaf_at))
        if e <= s:
            continue
        of, y = _spread(lo[s:e], (hi - lo)[s:e])
        leaf = of + s
        s = e
        nb = b["n"][y]
        ok = (n_low[leaf] <= nb) & (n_high[leaf] >= t * nb - 1e-9)
        leaf, y, nb = leaf[ok], y[ok], nb[ok]
        need = np.ceil(share * (np.maximum(n_low[leaf], np.ceil(t * nb - 1e-9)) + nb) - 1e-9)
        ok = nb - b["pos"][y] >= need
        ok &= pos_low[leaf] + b["pos"][y] <= (1 - 2 * share) * (np.minimum(n_high[leaf], nb) + nb) + 1e-9
        leaf, y, need = leaf[ok], y[ok], need[ok]
        ok = np.minimum(top[leaf], b["p"][y]).sum(1, dtype=np.int64) + b["beyond"][y] >= need
        leaf, y = leaf[ok], y[ok]
        for k in range(0, len(leaf), PAIRS_AT_ONCE // LEAF):
            of, x = _spread(leaf_at[leaf[k : k + PAIRS_AT_ONCE // LEAF]], leaf_size[leaf[k : k + PAIRS_AT_ONCE // LEAF]])
            x, yy = filed[x], looks[y[k : k + PAIRS_AT_ONCE // LEAF][of]]
            ok = _may_be_alike(c, x, yy, t)
            yield x[ok], yy[ok]


def _by_tiles(c: dict, filed: np.ndarray, looks: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (filed row, looking row) of one block that the bounds leave; both come sorted by place and size."""
    share = t / (1 + t)
    slack = 1 - 2 * share
    n, pos, q, nb = c["n"][filed], c["pos"][filed], c["pos"][looks], c["n"][looks]
    wide = int(max(n.max(), nb.max())) + 2
    key, places = pos * wide + n, np.unique(pos)
    new = np.r_[True, q[1:] != q[:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
    at = np.flatnonzero((np.arange(len(q)) - start) % TILE[0] == 0)  # groups of lookups of one place and of sizes n1 to n2
    end = np.r_[at[1:], len(q)]
    n1, n2, q = nb[at][:, None], nb[end - 1][:, None], q[at][:, None]
    least = np.maximum(np.maximum(t * n1, (places + q) / slack - n2), (places + share * n1) / (1 - share))
    most = np.minimum(n2, (n2 - q) / share - n2) + 0 * places
    lo = np.searchsorted(key, places * wide + np.ceil(least - 1e-6).clip(0, wide - 1).astype(np.int64), "left")
    hi = np.searchsorted(key, places * wide + np.floor(most + 1e-6).clip(-1, wide - 2).astype(np.int64), "right")
    size = np.maximum(hi - lo, 0)
    parity = np.ascontiguousarray(c["marks"][filed, 0]), np.ascontiguousarray(c["marks"][looks, 0])
    out_x, out_y, held = [], [], 0
    for k in np.flatnonzero(size.any(1)):
        x = _spread(lo[k], size[k])[1]
        mine = parity[1][at[k] : end[k], None]
        for j in range(0, len(x), TILE[1]):
            some = x[j : j + TILE[1]]
            may = (slack * (n[some] + n2[k]) + 1e-6).clip(max=64).astype(np.uint8)
            hit = np.flatnonzero(np.bitwise_count(mine ^ parity[0][some]) <= may)
            out_x.append(filed[some[hit % len(some)]])
            out_y.append(looks[at[k] + hit // len(some)])
            held += len(hit)
        if held > PAIRS_AT_ONCE:
            yield _left(c, out_x, out_y, t)
            out_x, out_y, held = [], [], 0
    if out_x:
        yield _left(c, out_x, out_y, t)


def _left(c: dict, xs: list[np.ndarray], ys: list[np.ndarray], t: float) -> tuple[np.ndarray, np.ndarray]:
    x, y = np.concatenate(xs), np.concatenate(ys)
    ok = _may_be_alike(c, x, y, t)
    return x[ok], y[ok]


def _candidates(c: dict, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (filed row, looking row) that the bounds leave, of rows sorted by block number ``g``, filed ones first, place and size."""
    g, looks = c["g"], c["looks"]
    blocks = int(g[-1]) + 1
    f, k = np.bincount(g[~looks], minlength=blocks), np.bincount(g[looks], minlength=blocks)
    tiled = f * k > TILED
    few = (~tiled & (f > 0) & (k > 0))[g]
    if few.any():
        yield from _by_leaves(c, np.flatnonzero(few & ~looks), np.flatnonzero(few & looks), t)
    start = np.cumsum(f + k) - f - k
    for b in np.flatnonzero(tiled):
        middle = start[b] + f[b]
        yield from _by_tiles(c, np.arange(start[b], middle), np.arange(middle, middle + k[b]), t)


def _joiner(t: float):
    """Candidate pairs of a partition sorted by (word, salt, looks, pos, n): the filed rows of a block come before its lookups."""

    def columns(rows: pa.Table) -> dict:
        block = np.stack([rows["word"].to_numpy(), rows["salt"].to_numpy().astype(np.int64)])
        change = np.r_[False, (block[:, 1:] != block[:, :-1]).any(0)]
        marks = np.stack([rows[x].to_numpy() for x in MARKS], axis=1)
        return {"g": np.cumsum(change), "looks": rows["looks"].to_numpy(), "n": rows["n"].to_numpy().astype(np.int64), "pos": rows["pos"].to_numpy().astype(np.int64), "marks": marks.view(np.uint64)}

    def named(reps: pa.Array, x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([reps.take(pa.array(x)), reps.take(pa.array(y))]).dictionary_encode()
        one, two = np.split(coded.indices.to_numpy().astype(np.int64), 2)
        wide = len(coded.dictionary)
        pairs = np.unique((np.minimum(one, two) * wide + np.maximum(one, two))[one != two])
        if len(pairs):
            yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(pairs // wide)), coded.dictionary.take(pa.array(pairs % wide))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None  # the filed rows of the last block
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch.select(ROWS.names)])
            rows = pa.concat_tables([kept, rows]).combine_chunks() if kept is not None else rows
            c = columns(rows)
            reps = rows["rep"].combine_chunks()
            xs, ys, held = [], [], 0
            for x, y in _candidates(c, t):
                xs.append(x)
                ys.append(y)
                held += len(x)
                if held > PAIRS_AT_ONCE:
                    yield from named(reps, np.concatenate(xs), np.concatenate(ys))
                    xs, ys, held = [], [], 0
            if held:
                yield from named(reps, np.concatenate(xs), np.concatenate(ys))
            last = np.flatnonzero((c["g"] == c["g"][-1]) & ~c["looks"])
            kept = rows.take(pa.array(last)) if len(last) else None

    return run


def class_links(classes: DataFrame, sets: DataFrame, t: float = 0.8) -> DataFrame:
    """(a, b, similarity): all links between different word sets, once each, ``a < b``."""
    spark = classes.sparkSession
    counts = spark.sparkContext.broadcast(_counts(sets))  # BUCKETS numbers
    parts = _parts(sets, counts, t, BLOCK, SAMPLE if BLOCK >= 1 << 15 else 1)
    parts = spark.sparkContext.broadcast(parts) if parts is not None else None  # as many
    rows = _hashed(classes).mapInArrow(_filer(counts, t, parts), ROWS_SQL)
    blocks = rows.repartition("word", "salt").sortWithinPartitions("word", "salt", "looks", "pos", "n")
    found = blocks.mapInArrow(_joiner(t), "a string, b string").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    form = classes.select("rep", "form")
    pairs = found.join(form.select(F.col("rep").alias("a"), F.col("form").alias("form_a")), "a").join(form.select(F.col("rep").alias("b"), F.col("form").alias("form_b")), "b")
    wa, wb = F.split("form_a", " "), F.split("form_b", " ")
    both = F.size(F.array_intersect(wa, wb))
    return pairs.select("a", "b", (both / (F.size(wa) + F.size(wb) - both)).alias("similarity")).where(F.col("similarity") >= t - 1e-12)


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(word_sets(table(spark, sf_dir, "simulated_vector_db").select("id", "content")))


def members_of(sets: DataFrame) -> DataFrame:
    """(id, rep): the class of each record."""
    rep = sets.groupBy("key").agg(F.min("id").alias("rep"))
    return sets.select("id", "key").join(rep, "key").select("id", "rep")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of records: links between classes, opened up into their records, and the pairs within a class."""
    sets = _sets(spark, sf_dir)
    links = class_links(classes_of(sets), sets)
    members = members_of(sets)
    x, y = members.select(F.col("id").alias("x"), F.col("rep").alias("a")), members.select(F.col("id").alias("y"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b").select("x", "y")
    within = x.join(y, F.col("a") == F.col("b")).where("x < y").select("x", "y")
    return across.unionByName(within).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record: its class, how many records the class has, and how many other classes it is linked to."""
    sets = _sets(spark, sf_dir)
    classes = classes_of(sets)
    links = class_links(classes, sets).select("a", "b")
    n = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("links"))
    size = classes.select("rep", "copies")
    return members_of(sets).join(size, "rep").join(n, "rep", "left").select("id", F.col("rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))


QUERIES = {"p3_found": p3_found, "p3_classes": p3_classes}
SQL = {
    "p3_found": r"""WITH w AS (SELECT id, list_distinct(regexp_extract_all(lower(content), '[\p{L}\p{N}_]+')) AS s FROM simulated_vector_db WHERE content IS NOT NULL), g AS (SELECT id, s, len(s) AS n FROM w WHERE len(s) > 0),
  p AS (SELECT x.id AS id_a, y.id AS id_b, x.n + y.n AS m, len(list_intersect(x.s, y.s)) AS k FROM g x JOIN g y ON x.id < y.id AND least(x.n, y.n) >= 0.8 * greatest(x.n, y.n) - 1e-9)
SELECT id_a, id_b FROM p WHERE k >= 0.8 * (m - k) - 1e-9"""
}
