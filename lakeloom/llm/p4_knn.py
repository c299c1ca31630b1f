r"""Problem 4: the k most similar vectors of every vector, by multiprobe p-stable hashing.

A table has ``M`` hash functions ``floor((a·v + b) / W)``; their directions are orthonormal (a rotation
of Gaussian directions, so each is 2-stable) and scaled to unit variance. The ``M`` values are a bucket.
A vector visits its own bucket and then perturbed ones, in the order of the estimated success of the
perturbation sets (by the expected squared distances to the boundaries, as in multiprobe LSH), and is
compared with the members by exact cosine; the candidates of all visits and tables are merged.

The work is moved by *cells*: the buckets that share their first ``C`` values. A vector goes once to
each cell its probes fall in, not once to each bucket, so what is shuffled is (cells visited) rows of one
vector each. A cell with more than ``CELL`` members is split by salt and visited in every part. Within a
cell, blocks of queries x members of at most ``BLOCK`` numbers are multiplied, so memory is bounded.

The plan (hash functions, bucket width, tables, probes) is fitted, not fixed: the exact neighbours of ``SAMPLE`` vectors,
drawn by a hash of their ids, are found in one scan, and of the plans that would find at least ``TARGET`` of them the
cheapest is taken, so recall is held at every size. Every row is indexed and every row is a query. ``exact_nearest`` is
the exact way for a stated query set, and ``recall`` compares the two.

Equal vectors are collapsed first: a class of them is searched once, by its smallest id, and its members get each other
and the class's neighbours, so a group of copies costs nothing however large it is.

Defined cases: a vector that is null, has not exactly ``dim`` components, has a null, NaN or infinite
component, or has all components equal takes no part. Of equally similar vectors (as 4-byte floats) the smaller id
comes first. With fewer than k + 1 usable vectors each gets all others. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

CELL = 65536
BLOCK = 2_000_000
DIM = 20
#: Vectors whose exact neighbours a plan is fitted on, and vectors from which sizes of buckets are estimated.
SAMPLE, SIZES = 256, 16384
#: Share of the sample's neighbours that a plan must find.
TARGET = 0.96
#: What moving a vector to a cell and looking into a bucket cost, in comparisons of two vectors.
MOVE, LOOK = 2000, 100
#: Queries that ``exact_nearest`` sends to every task at once.
MAX_QUERIES = 100_000


@dataclass(frozen=True)
class Plan:
    """Hash functions, bucket width (in standard deviations of a projection), tables, probes, values that make a cell."""

    functions: int
    width: float
    tables: int
    probes: int
    cell_values: int
    seed: int = 7


#: The plans that are tried: tables, probes, widths, functions; and how many rows a bucket should hold on average.
TABLES, PROBES, WIDTHS, ROWS = 4, (10, 14, 20, 28, 40, 56, 80, 112, 160), (1.6, 2.2), (100, 4000)


def usable(v: Column, dim: int = DIM) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dim) & finite & (F.array_max(v) > F.array_min(v)), F.lit(False))


def probe_order(m: int, probes: int) -> list[tuple[int, ...]]:
    """Perturbation sets as places among the 2m boundary distances in rising order, most promising first."""
    e = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    out: list[tuple[int, ...]] = [()]
    heap: list[tuple[float, tuple[int, ...]]] = [(e[0], (0,))]
    while heap and len(out) < probes:
        s, places = heapq.heappop(heap)
        if all(2 * m - 1 - x not in places for x in places):
            out.append(places)
        last = places[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (s - e[last] + e[last + 1], (*places[:-1], last + 1)))
            heapq.heappush(heap, (s + e[last + 1], (*places, last + 1)))
    return out


class Hash:
    """The hash functions of one table."""

    def __init__(self, plan: Plan, at: int, dim: int):
        rng = np.random.default_rng(plan.seed * 1000 + at)
        self.m, self.w, self.c = min(plan.functions, dim), plan.width, plan.cell_values
        q, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        self.a = (q[:, : self.m] * math.sqrt(dim)).astype(np.float32)
        self.b = rng.uniform(0, self.w, self.m).astype(np.float32)
        mix = [pow(11400714819323198485, j + 1, 1 << 64) for j in range(self.m)]
        self.mix = np.array(mix, np.uint64)
        self.order = probe_order(self.m, plan.probes)

    def codes(self, x: np.ndarray, values: int | None = None) -> np.ndarray:
        """The buckets that the rows are in, or their cells for the first ``values``."""
        return self._code(np.floor((x @ self.a + self.b) / self.w)[:, :values])

    def _code(self, h: np.ndarray) -> np.ndarray:
        return (h.astype(np.int64).astype(np.uint64) * self.mix[: h.shape[-1]]).sum(-1, dtype=np.uint64).view(np.int64)

    def probes(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the codes of the cells and of the buckets it visits, in order; the first is its own."""
        f = (x @ self.a + self.b) / self.w
        h = np.floor(f)
        r = f - h
        z = np.concatenate([r, 1 - r], 1)
        rank = np.argsort(z, axis=1)
        rows = np.arange(len(x))
        cells, buckets = np.empty((len(x), len(self.order)), np.int64), np.empty((len(x), len(self.order)), np.int64)
        for k, places in enumerate(self.order):
            g = h.copy()
            for p in places:
                j = rank[:, p]
                g[rows, j % self.m] += np.where(j < self.m, -1, 1)
            cells[:, k], buckets[:, k] = self._code(g[:, : self.c]), self._code(g)
        return cells, buckets


def unit_vectors(df: DataFrame, id_col: str = "id", vector: str = "vector", dim: int = DIM) -> DataFrame:
    """(id, v): usable vectors, of length 1, as 4-byte floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                x = x / np.abs(x).max(1)[:, None]  # so that squares neither overflow nor vanish
                x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), _binary(x)], names=["id", "v"])

    good = df.where(usable(F.col(vector), dim)).select(F.col(id_col).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    return good.mapInArrow(run, "id string, v binary")


def _binary(x: np.ndarray) -> pa.Array:
    width = x.shape[1] * x.itemsize
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), len(x), [None, pa.py_buffer(np.ascontiguousarray(x).tobytes())]).cast(pa.binary())


def _floats(col: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.float32).reshape(-1, dim)


def _visits(plan: Plan, dim: int, hot: dict[tuple[int, int], int]):
    """A row for each cell a vector visits; ``home`` marks its own, where it is a member too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Hash(plan, t, dim) for t in range(plan.tables)]
        for b in batches:
            if not b.num_rows:
                continue
            x = _floats(b.column(1), dim)
            for t, h in enumerate(hashes):
                cells, _ = h.probes(x)
                own = cells[:, 0]
                ordered = np.sort(cells, axis=1)
                new = np.ones(ordered.shape, bool)
                new[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
                row, col = np.nonzero(new)
                cell = ordered[row, col]
                home, salt = cell == own[row], np.zeros(len(row), np.int32)
                if hot:
                    parts = np.array([hot.get((t, int(c)), 1) for c in cell.tolist()])
                    at = np.repeat(np.arange(len(row)), parts)
                    part = np.arange(len(at)) - (np.cumsum(parts) - parts)[at]
                    mine = np.array([zlib.crc32(i.encode()) for i in b.column(0).to_pylist()])[row] % parts  # by the id, so that a repeated task splits alike
                    home, row, cell, salt = home[at] & (mine[at] == part), row[at], cell[at], part.astype(np.int32)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), t, np.int32)), pa.array(cell), pa.array(salt), pa.array(~home), b.column(0).take(take), b.column(1).take(take)], names=["tab", "cell", "salt", "visitor", "id", "v"])

    return run


VISITS = "tab int, cell long, salt int, visitor boolean, id string, v binary"
NEAREST = "id string, near array<string>, cosine array<float>"


def _best(q: np.ndarray, m: np.ndarray, s: np.ndarray, k: int, rank_of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of triples (query, member, similarity) the k best of each query, in order, ties by the members' ranks."""
    order = np.lexsort((rank_of[m], -s, q))
    q, m, s = q[order], m[order], s[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0)) if len(q) else q
    ok = rank < k
    return q[ok], m[ok], s[ok]


class _Cell:
    """The members of a cell by bucket."""

    def __init__(self, ids: pa.Array, x: np.ndarray, h: Hash):
        code = h.codes(x) if len(x) else np.zeros(0, np.int64)
        order = np.argsort(code, kind="stable")
        self.ids, self.x, self.h = ids.take(pa.array(order)), x[order], h
        self.rank = pc.rank(self.ids, "ascending", tiebreaker="first").to_numpy().astype(np.int64)
        self.codes, self.starts = np.unique(code[order], return_index=True)
        self.ends = np.r_[self.starts[1:], len(order)]

    def search(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The k best members of the probed buckets, for each query row."""
        buckets = self.h.probes(x)[1]
        at = np.searchsorted(self.codes, buckets)
        at[at == len(self.codes)] = 0
        there = self.codes[at] == buckets
        floor = np.full(len(x), -2.0, np.float32)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        first = np.argmax(there, axis=1)
        one = np.zeros(there.shape, bool)
        one[np.arange(len(x)), first] = there[np.arange(len(x)), first]
        for some in (one, there & ~one):
            row, col = np.nonzero(some)
            bucket = at[row, col]
            order = np.argsort(bucket, kind="stable")
            row, bucket = row[order], bucket[order]
            marks = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
            for i, a in enumerate(marks):
                z = marks[i + 1] if i + 1 < len(marks) else len(bucket)
                lo, hi = self.starts[bucket[a]], self.ends[bucket[a]]
                members = self.x[lo:hi].T
                step = max(1, BLOCK // (hi - lo))
                for c in range(a, z, step):
                    q = row[c : min(z, c + step)]
                    s = x[q] @ members
                    if some is one and hi - lo > k:
                        floor[q] = np.maximum(floor[q], np.partition(s, hi - lo - k, axis=1)[:, -k])
                    i_, m = np.nonzero(s >= floor[q][:, None])
                    v = s[i_, m]
                    if len(v) > 4 * k * len(q):  # many ties with the floor, or none yet
                        i_, m, v = _best(i_, m, v, k, self.rank[lo:hi])
                    found.append((q[i_], m + lo, v))
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(0, np.float32)
        return _best(*(np.concatenate(p) for p in zip(*found)), k, self.rank)


def _searcher(plan: Plan, dim: int, k: int):
    """Candidates of each visit; the rows come sorted by (tab, cell, salt, visitor), members first."""
    keys = ["tab", "cell", "salt"]

    def answer(cell: _Cell, ids: pa.Array, x: np.ndarray) -> pa.RecordBatch | None:
        q, m, s = cell.search(x, k + 1)
        if not len(q):
            return None
        mine, near = ids.take(pa.array(q)), cell.ids.take(pa.array(m))
        other = pc.not_equal(mine, near).to_numpy(zero_copy_only=False)
        q, s, near = q[other], s[other], near.filter(pa.array(other))
        if not len(q):
            return None
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        rank = np.arange(len(q)) - first[np.cumsum(np.r_[True, q[1:] != q[:-1]]) - 1]
        ok = rank < k
        q, s, near = q[ok], s[ok], near.filter(pa.array(ok))
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        offsets = pa.array(np.r_[first, len(q)].astype(np.int32))
        return pa.RecordBatch.from_arrays([ids.take(pa.array(q[first])), pa.ListArray.from_arrays(offsets, near), pa.ListArray.from_arrays(offsets, pa.array(s.astype(np.float32)))], names=["id", "near", "cosine"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = [Hash(plan, t, dim) for t in range(plan.tables)]
        now, members, cell = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = np.stack([b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in keys])
            visitor = b.column(b.schema.get_field_index("visitor")).to_numpy(zero_copy_only=False)
            ids, vec = b.column(b.schema.get_field_index("id")), b.column(b.schema.get_field_index("v"))
            marks = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0) | (visitor[1:] != visitor[:-1])])
            for i, a in enumerate(marks):
                z = marks[i + 1] if i + 1 < len(marks) else b.num_rows
                at = tuple(key[:, a].tolist())
                if at != now:
                    yield from _own(members, cell, now, hashes, dim, answer)
                    now, members, cell = at, [], None
                part = (ids.slice(a, z - a), _floats(vec.slice(a, z - a), dim))
                if not visitor[a]:
                    members.append(part)
                    continue
                if cell is None and members:
                    cell = _Cell(pa.concat_arrays([p[0] for p in members]), np.concatenate([p[1] for p in members]), hashes[at[0]])
                if cell is not None and (got := answer(cell, *part)) is not None:
                    yield got
        yield from _own(members, cell, now, hashes, dim, answer)

    return run


def _own(members: list, cell: _Cell | None, now: tuple | None, hashes: list[Hash], dim: int, answer) -> Iterator[pa.RecordBatch]:
    """The members of a finished cell as its own queries."""
    if not members:
        return
    if cell is None:
        cell = _Cell(pa.concat_arrays([p[0] for p in members]), np.concatenate([p[1] for p in members]), hashes[now[0]])
    for ids, x in members:
        if (got := answer(cell, ids, x)) is not None:
            yield got


def _merger(k: int):
    """The k best over all rows of an id; the rows come sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for b in _and_end(batches):
            some = [t for t in (kept, None if b is None or not b.num_rows else pa.Table.from_batches([b])) if t is not None]
            if not some or b is not None and not b.num_rows:
                continue
            rows = pa.concat_tables(some)
            ids = rows["id"].combine_chunks()
            code = ids.dictionary_encode()
            q = code.indices.to_numpy().astype(np.int64)
            done = np.ones(len(q), bool) if b is None else q != q[-1]
            kept = None if b is None else rows.filter(pa.array(~done))
            rows = rows.filter(pa.array(done))
            if not rows.num_rows:
                continue
            near = rows["near"].combine_chunks()
            n = np.diff(near.offsets.to_numpy())
            names = near.flatten().dictionary_encode()
            q, m, s = np.repeat(q[done], n), names.indices.to_numpy().astype(np.int64), rows["cosine"].combine_chunks().flatten().to_numpy()
            rank = np.empty(len(names.dictionary), np.int64)
            rank[np.argsort(np.array(names.dictionary.to_pylist(), object))] = np.arange(len(rank))
            pair = q * len(names.dictionary) + m
            _, one = np.unique(pair, return_index=True)
            q, m, s = q[one], m[one], s[one]
            order = np.lexsort((rank[m], -s, q))
            q, m, s = q[order], m[order], s[order]
            q, m, s = _first(q, m, s, k)
            yield pa.RecordBatch.from_arrays([code.dictionary.take(pa.array(q)), names.dictionary.take(pa.array(m)), pa.array(s.astype(np.float32))], names=["id", "near_id", "cosine"])

    return run


def _first(q: np.ndarray, m: np.ndarray, s: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = np.r_[True, q[1:] != q[:-1]]
    rank = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return q[rank < k], m[rank < k], s[rank < k]


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _exact(queries: tuple[np.ndarray, np.ndarray], dim: int, k: int):
    """The k nearest rows of a task's share for each query (number, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = queries
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            x = _floats(b.column(1), dim)
            rank = pc.rank(b.column(0), "ascending", tiebreaker="first").to_numpy().astype(np.int64)
            step = max(1, BLOCK // len(x))
            for a in range(0, len(ids), step):
                s = np.round(q[a : a + step] @ x.T, 6)  # equal rows may differ in the last bit
                few = min(k, len(x))
                i, m = np.nonzero(s >= np.partition(s, len(x) - few, axis=1)[:, [len(x) - few]])
                i, m, v = _best(i, m, s[i, m], k, rank)
                at = pa.array(m)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + step][i]), b.column(0).take(at), pa.array(v.astype(np.float32)), b.column(1).take(at)], names=["query", "near_id", "cosine", "v"])

    return run


def _exact_rows(vectors: DataFrame, x: np.ndarray, k: int, dim: int) -> DataFrame:
    """(query, near_id, cosine, v): the k nearest of all vectors to each row of ``x``, itself too if it is one of them."""
    shared = vectors.sparkSession.sparkContext.broadcast((np.arange(len(x)), x))
    each = vectors.select("id", "v").mapInArrow(lambda batches: _exact(shared.value, dim, k)(batches), "query long, near_id string, cosine float, v binary")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "near_id")
    return each.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def fit_plan(vectors: DataFrame, n: int, k: int = 5, dim: int = DIM, target: float = TARGET) -> Plan:
    """The cheapest plan that would find ``target`` of the true neighbours of the sample; ``vectors`` are (id, v).

    What the driver gathers is about ``SIZES`` vectors and ``SAMPLE`` times k + 1 neighbours, whatever the data. If no plan
    reaches the target, the one that finds most is taken.
    """
    some = vectors.where(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(max(n, 1))) < SIZES).select("id", "v").toArrow().sort_by("id")
    if not some.num_rows:
        return Plan(2, WIDTHS[0], 2, 10, 1)
    x = _floats(some["v"].combine_chunks(), dim)
    order = np.argsort([zlib.crc32(i.encode()) for i in some["id"].to_pylist()], kind="stable")[:SAMPLE]
    q = x[order]
    found = _exact_rows(vectors, q, k + 1, dim).where(F.col("cosine").isNotNull()).select("query", "near_id", "v").toArrow()
    own = np.array(some["id"].to_pylist(), object)[order]
    at, near = found["query"].to_numpy(), _floats(found["v"].combine_chunks(), dim)
    other = own[at] != np.array(found["near_id"].to_pylist(), object)
    at, near = at[other], near[other]
    best: tuple[bool, float, Plan] = (False, 1.0, Plan(2, WIDTHS[0], 2, PROBES[0], 1))
    for w in WIDTHS:
        held = {m: _held(Hash(Plan(m, w, 1, 1, 1), 0, dim), x, n, m) for m in range(2, dim + 1)}
        for m in [m for m, rows in held.items() if ROWS[0] <= rows <= ROWS[1]] or [min(held, key=lambda m: abs(math.log(held[m] / ROWS[1])))]:
            first, rank, size = Hash(Plan(m, w, 1, 1, 1), 0, dim), [], []
            for t in range(TABLES):
                h = Hash(Plan(m, w, TABLES, PROBES[-1], 1), t, dim)
                codes, counts = np.unique(h.codes(x), return_counts=True)
                _, probed = h.probes(q)
                hit = probed[at] == h.codes(near)[:, None]
                rank.append(np.where(hit.any(1), hit.argmax(1), PROBES[-1]))
                place = np.searchsorted(codes, probed).clip(max=len(codes) - 1)
                there = np.where(codes[place] == probed, counts[place], 0)
                there[:, 0] -= 1  # the query itself
                size.append(there.mean(0).cumsum() * n / len(x))
            values = next((c for c in range(1, m + 1) if _held(first, x, n, c) <= CELL / 2), m)
            for probes in (p for p in PROBES if p <= probed.shape[1]):
                plan = Plan(m, w, 1, probes, values)
                moved = visits_of(plan, q, dim)
                for tables in range(2, TABLES + 1):
                    share = float((np.min(rank[:tables], axis=0) < probes).mean()) if len(at) else 1.0
                    cost = tables * (MOVE * moved + LOOK * probes) + sum(float(c[probes - 1]) for c in size[:tables])
                    best = min(best, (share >= target, cost if share >= target else 1 - share, replace(plan, tables=tables)), key=lambda p: (not p[0], p[1]))
    return best[2]


def _held(h: Hash, x: np.ndarray, n: int, values: int) -> float:
    """How many of ``n`` rows the bucket (cell) of a row holds on average."""
    counts = np.unique(h.codes(x, values), return_counts=True)[1].astype(float)
    return 1 + float((counts * (counts - 1)).sum()) * (n - 1) / max(1, len(x) * (len(x) - 1))


def visits_of(plan: Plan, x: np.ndarray, dim: int) -> float:
    """How many cells of a table a vector visits on average."""
    cells = np.sort(Hash(plan, 0, dim).probes(x)[0], axis=1)
    return float(1 + (cells[:, 1:] != cells[:, :-1]).sum(1).mean())


def _search(vectors: DataFrame, k: int, dim: int, plan: Plan) -> DataFrame:
    """(id, near_id, cosine): up to k rows for each of the distinct ``vectors``."""
    visits = vectors.mapInArrow(_visits(plan, dim, {}), VISITS)
    full = visits.where(~F.col("visitor")).groupBy("tab", "cell").count().where(F.col("count") > CELL).collect()  # rows / CELL of them at most
    hot = {(r["tab"], r["cell"]): -(-r["count"] // CELL) for r in full}
    if hot:
        visits = vectors.mapInArrow(_visits(plan, dim, hot), VISITS)
    cells = visits.repartition("tab", "cell", "salt").sortWithinPartitions("tab", "cell", "salt", "visitor")
    found = cells.mapInArrow(_searcher(plan, dim, k), NEAREST)
    return found.repartition("id").sortWithinPartitions("id").mapInArrow(_merger(k), "id string, near_id string, cosine float")


def _with_copies(found: DataFrame, members: DataFrame, k: int) -> DataFrame:
    """Neighbours of classes opened up into those of their members; ``members`` are (id, rep) of all vectors.

    Of each class only the k + 1 smallest ids can be anyone's neighbour, and only they are sent.
    """
    few = members.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("n") <= k + 1).select("rep", F.col("id").alias("near_id"))
    own = few.select(F.col("rep").alias("of"), "near_id", F.lit(1.0).cast("float").alias("cosine"))
    others = found.select(F.col("id").alias("of"), F.col("near_id").alias("rep"), "cosine").join(few, "rep").select("of", "near_id", "cosine")
    near = own.unionByName(others)
    near = near.withColumn("n", F.row_number().over(Window.partitionBy("of").orderBy(F.desc("cosine"), "near_id"))).where(F.col("n") <= k + 1).drop("n")
    each = members.join(near, F.col("rep") == F.col("of")).where("id <> near_id").select("id", "near_id", "cosine")
    return each.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near_id"))).where(F.col("n") <= k).drop("n")


def nearest(df: DataFrame, k: int = 5, id_col: str = "id", vector: str = "vector", dim: int = DIM, plan: Plan | None = None) -> DataFrame:
    """(id, near_id, cosine): up to k rows for each usable vector."""
    vectors = unit_vectors(df, id_col, vector, dim)
    classes = written(vectors.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")))
    total = classes.agg(F.count("*").alias("n"), F.sum((F.col("n") > 1).cast("int")).alias("several")).first()
    own = classes.select("id", "v")
    found = _search(own, k, dim, plan or fit_plan(own, total["n"], k, dim))
    if not total["several"]:
        return found
    members = vectors.join(classes.select("v", F.col("id").alias("rep")), "v").select("id", "rep")
    return _with_copies(found, members, k)


def exact_nearest(df: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "id", vector: str = "vector", dim: int = DIM) -> DataFrame:
    """(id, near_id, cosine) by comparison with every row, for a stated query set of ``MAX_QUERIES`` rows at most (more are an error)."""
    asked = unit_vectors(queries, id_col, vector, dim).limit(MAX_QUERIES + 1).toArrow()
    if asked.num_rows > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries; split the set")
    spark = df.sparkSession
    names = spark.createDataFrame([(i, n) for i, n in enumerate(asked["id"].to_pylist())], "query long, id string")
    rows = _exact_rows(unit_vectors(df, id_col, vector, dim), _floats(asked["v"].combine_chunks(), dim) if asked.num_rows else np.zeros((0, dim), np.float32), k + 1, dim)
    each = rows.join(F.broadcast(names), "query").where("id <> near_id")
    return each.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "near_id"))).where(F.col("n") <= k).select("id", "near_id", "cosine")


def recall(df: DataFrame, found: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(queries, pairs, found, recall): how many of the exact neighbours of a query set the search has found."""
    exact = exact_nearest(df, queries, k).select("id", "near_id")
    both = exact.join(found.select("id", "near_id").withColumn("hit", F.lit(1)), ["id", "near_id"], "left")
    return both.agg(F.countDistinct("id").alias("queries"), F.count("*").alias("pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("found")).withColumn("recall", F.col("found") / F.col("pairs"))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "simulated_vector_db").select("id", "vector")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = nearest(_vectors(spark, sf_dir))
    return pairs.select(F.least("id", "near_id").alias("id_a"), F.greatest("id", "near_id").alias("id_b")).distinct()


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_vectors(spark, sf_dir))


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search against brute force, for the rows whose number is divisible by 100."""
    df = _vectors(spark, sf_dir)
    return recall(df, nearest(df), df.where(F.regexp_extract("id", r"(\d+)", 1).cast("long") % 100 == 0))


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall}
SQL: dict[str, str] = {}
