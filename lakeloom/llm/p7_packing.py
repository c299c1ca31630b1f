r"""Problem 7: filling containers of fixed capacity with documents.

Sizes are tokens of a public tokenizer. A document longer than the capacity fills containers of its own
and its rest is an item like any other; no other document is split. Items are dealt by hash into shards
of about ``SHARD`` items, each packed in one task, so no task grows with the data and at most one
partly filled container is lost for each shard.

A shard is packed by bin completion: the best-fit-decreasing packing is the incumbent; if it has more
containers than the lower bound (the larger of the volume bound and the Martello-Toth bound), branch and
bound looks for fewer. It takes the largest remaining document, enumerates fillings of the rest of its
container that no other filling dominates, goes on with the one of least waste, and gives up a branch
whose waste so far can't lead to fewer containers than the incumbent. A search with a budget (``NODES`` containers
opened, ``KEEP`` fillings of each) ends early with the incumbent; without one (``nodes=None, keep=None``) it
enumerates every undominated filling and its result is the least number of containers. ``packing_report``
says how many shards are at the bound and what the search added.

Defined cases: null and blank texts, and texts without a token, need no container and have no row. Equal
rows are packed as often as they occur. A capacity that is null or less than 1 is an error, and so are more
than ``MAX_PROFILES`` profiles. Other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, not_blank, table, written

#: Ranks of a public byte-level BPE; a path on every node. Never copied into the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The split pattern that belongs to the ranks, and its equal for ASCII texts.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
ASCII_PATTERN = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+")
SHARD = 4096
NODES = 4000
KEEP = 3
MAX_PROFILES = 1000
#: Pieces of text whose token counts a task remembers; beyond it they are counted each time.
REMEMBERED = 200_000


class TokenCounter:
    def __init__(self, path: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
        encoding = tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.encode = encode = encoding.encode_ordinary

        class Known(dict):
            def __missing__(self, piece: str) -> int:
                n = len(encode(piece))
                if len(self) < REMEMBERED and len(piece) < 64:
                    self[piece] = n
                return n

        self.of_piece = Known().__getitem__

    def __call__(self, text: str) -> int:
        if text.isascii():
            return sum(map(self.of_piece, ASCII_PATTERN.findall(text)))
        return len(self.encode(text))


def token_sizes(df: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) for each text with at least one token that isn't blank."""
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int64())])
    counters: dict[str, TokenCounter] = {}

    def rows(keys: list, texts: list) -> Iterator[tuple]:
        if tokenizer not in counters:
            counters[tokenizer] = TokenCounter(tokenizer)
        count = counters[tokenizer]
        for k, t in zip(keys, texts):
            yield k, count(t)

    some = df.where(not_blank(F.col(text))).select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return some.mapInArrow(arrow_rows(rows, ["doc_id", "text"], schema), "doc_id long, tokens long").where("tokens > 0")


def lower_bound(sizes: list[int], cap: int) -> int:
    """No packing of ``sizes`` (falling) has fewer containers: volume, and Martello and Toth's second bound."""
    best = -(-sum(sizes) // cap)
    rising = sizes[::-1]
    sums = [0]
    for s in rising:
        sums.append(sums[-1] + s)
    half = len(rising) - bisect_right(rising, cap // 2)  # larger than half
    for a in sorted({s for s in rising if 2 * s <= cap} | {0}):
        low, mid, top = bisect_left(rising, a), bisect_right(rising, cap // 2), bisect_right(rising, cap - a)
        room = (top - mid) * cap - (sums[top] - sums[mid])
        best = max(best, half + max(0, -(-(sums[mid] - sums[low] - room) // cap)))
    return best


def best_fit(sizes: list[int], cap: int) -> list[list[int]]:
    """Best-fit decreasing; ``sizes`` falls. Containers as lists of places in ``sizes``."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i, s in enumerate(sizes):
        at = bisect_left(room, (s, -1))
        if at == len(room):
            left, b = cap, len(bins)
            bins.append([])
        else:
            left, b = room.pop(at)
        bins[b].append(i)
        insort(room, (left - s, b))
    return bins


class _Rest:
    """The sizes that remain, with their numbers."""

    def __init__(self, sizes: list[int]):
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.keys = sorted(self.count)

    def take(self, s: int) -> None:
        self.count[s] -= 1
        if not self.count[s]:
            del self.keys[bisect_left(self.keys, s)]

    def put(self, s: int) -> None:
        if not self.count.get(s):
            insort(self.keys, s)
            self.count[s] = 0
        self.count[s] += 1


def _swapped(rest: _Rest, waste: int, chosen: tuple[int, ...]) -> bool:
    """Whether an item can give way to the next larger one that remains; quick, for searches with a budget."""
    for s in set(chosen):
        at = bisect_right(rest.keys, s)
        if at < len(rest.keys) and rest.keys[at] - s <= waste and rest.count[rest.keys[at]] > chosen.count(rest.keys[at]):
            return True
    return False


def _dominated(rest: _Rest, waste: int, chosen: tuple[int, ...]) -> bool:
    """Whether an item can give way to a larger one, or two to one, without more in the container than fits."""
    have = {s: chosen.count(s) for s in chosen}

    def free(low: int, high: int) -> bool:
        for k in range(bisect_left(rest.keys, low), len(rest.keys)):
            s = rest.keys[k]
            if s > high:
                return False
            if rest.count[s] > have.get(s, 0):
                return True
        return False

    if any(free(s + 1, s + waste) for s in have):
        return True
    return any(free(a + b, a + b + waste) for i, a in enumerate(chosen) for b in chosen[i + 1 :])


def every_filling(rest: _Rest, room: int) -> Iterator[tuple[int, ...]]:
    """All undominated fillings of ``room``, those with the largest items first; a container is never left open for an item that fits."""

    def extend(chosen: tuple[int, ...], left: int, top: int) -> Iterator[tuple[int, ...]]:
        at = bisect_right(rest.keys, min(left, top))
        for s in rest.keys[:at][::-1]:
            if rest.count.get(s, 0) > 0:
                rest.take(s)
                yield from extend((*chosen, s), left - s, s)
                rest.put(s)
        if not rest.keys or rest.keys[0] > left:
            for s in chosen:
                rest.put(s)
            good = not _dominated(rest, left, chosen)
            for s in chosen:
                rest.take(s)
            if good:
                yield chosen

    yield from extend((), room, room)


def fillings(rest: _Rest, room: int, keep: int | None = KEEP) -> list[tuple[int, ...]]:
    """Undominated fillings of ``room``, least waste first; all of them without ``keep``.

    With it the largest sizes go first, until nothing fits, and the last three choices are enumerated anew.
    """
    if keep is None:
        return sorted(dict.fromkeys(every_filling(rest, room)), key=lambda c: -sum(c))
    base: list[int] = []
    left = room
    while left and rest.keys and (at := bisect_right(rest.keys, left)):
        s = rest.keys[at - 1]
        rest.take(s)
        base.append(s)
        left -= s
    for s in base:
        rest.put(s)
    if not base or not left:
        return [tuple(base)]
    fixed, gap = base[:-3], left + sum(base[-3:])
    for s in fixed:
        rest.take(s)
    found: list[tuple[int, tuple[int, ...]]] = []
    steps = 0

    def extend(chosen: tuple[int, ...], left: int, top: int) -> None:
        nonlocal steps
        at = bisect_right(rest.keys, min(left, top))
        if len(chosen) == 4 or not at:
            found.append((left, chosen))
            return
        for k in range(at - 1, max(-1, at - 9), -1):
            steps += 1
            if steps > 120 or found and min(found)[0] == 0:
                return
            s = rest.keys[k]
            rest.take(s)
            extend((*chosen, s), left - s, s)
            rest.put(s)

    extend((), gap, gap)
    found.sort()
    good = [c for w, c in found if not w or not _swapped(rest, w, c)] or [c for _, c in found[:1]]
    for s in fixed:
        rest.put(s)
    return [(*fixed, *c) for c in dict.fromkeys(good)][:keep]


def complete(sizes: list[int], cap: int, fewer_than: int, nodes: int | None = NODES, keep: int | None = KEEP) -> list[list[int]] | None:
    """Containers (as sizes), fewer than ``fewer_than``, or None if the search finds none within ``nodes``."""
    may_waste = (fewer_than - 1) * cap - sum(sizes)
    rest = _Rest(sizes)
    stack: list[tuple[int, Iterator[tuple[int, ...]], int]] = []
    bins: list[list[int]] = []
    waste = 0
    while rest.keys:
        if nodes is not None:
            nodes -= 1
            if nodes < 0:
                return None
        big = rest.keys[-1]
        rest.take(big)
        options = iter(fillings(rest, cap - big, keep))
        rest.put(big)
        stack.append((big, options, waste))
        while stack:
            big, options, waste = stack[-1]
            if len(bins) == len(stack):  # come back: empty the container again
                for s in bins.pop():
                    rest.put(s)
            chosen = next(options, None)
            if chosen is None:
                stack.pop()
                continue
            lost = cap - big - sum(chosen)
            if waste + lost > may_waste:
                continue
            waste += lost
            bins.append([big, *chosen])
            for s in bins[-1]:
                rest.take(s)
            break
        if not stack:
            return None
    return bins


def pack(sizes: list[int], cap: int, nodes: int | None = NODES, keep: int | None = KEEP) -> list[list[int]]:
    """Containers as lists of places in ``sizes``; no size is over ``cap``. Without a budget it is the least number."""
    return _pack(sizes, cap, nodes, keep)[0]


def _pack(sizes: list[int], cap: int, nodes: int | None = NODES, keep: int | None = KEEP) -> tuple[list[list[int]], int, int]:
    """``pack``, the lower bound, and how many containers best fit has."""
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    falling = [sizes[i] for i in order]
    incumbent = best_fit(falling, cap)
    bound, first = lower_bound(falling, cap), len(incumbent)
    while len(incumbent) > bound and (better := complete(falling, cap, len(incumbent), nodes, keep)):
        places: dict[int, list[int]] = {}
        for k, s in enumerate(falling):
            places.setdefault(s, []).append(k)
        incumbent = [[places[s].pop() for s in b] for b in better]
        if nodes is not None:  # the budget is for one search
            break
    return [[order[k] for k in b] for b in incumbent], bound, first


PACKED = pa.schema([("profile", pa.string()), ("container", pa.string()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("tokens", pa.int64())])
REPORT = pa.schema([("profile", pa.string()), ("shard", pa.int64()), ("bound", pa.int64()), ("best_fit", pa.int64()), ("packed", pa.int64())])


def _packer(batches: Iterator[pa.RecordBatch], nodes: int | None = NODES, keep: int | None = KEEP, report: bool = False) -> Iterator[pa.RecordBatch]:
    """Packs each (profile, shard), or reports on it; the rows come sorted by them."""

    def flush(key: tuple, rows: list[tuple]) -> pa.RecordBatch:
        profile, shard, cap = key
        bins, bound, first = _pack([r[2] for r in rows], cap, nodes, keep)
        if report:
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((profile, shard, bound, first, len(bins)), REPORT)], schema=REPORT)
        out = [(profile, f"{shard}-{n}", rows[i][0], rows[i][1], rows[i][2]) for n, b in enumerate(bins) for i in b]
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), PACKED)], schema=PACKED)

    now, rows = None, []
    for b in batches:
        d = b.to_pydict()
        for key, row in zip(zip(d["profile"], d["shard"], d["capacity"]), zip(d["doc_id"], d["piece"], d["tokens"])):
            if key != now:
                if rows:
                    yield flush(now, rows)
                now, rows = key, []
            rows.append(row)
    if rows:
        yield flush(now, rows)


def _items(sizes: DataFrame, profiles: DataFrame, shard: int) -> tuple[DataFrame, DataFrame]:
    """The items of each profile and shard, sorted by them, and the containers that long documents fill alone."""
    every = profiles.select("profile", F.col("capacity_tokens").cast("long").alias("cap")).limit(MAX_PROFILES + 1).collect()
    if len(every) > MAX_PROFILES or any(r["cap"] is None or r["cap"] < 1 for r in every):
        raise ValueError(f"profiles need capacities of 1 and more, and there may be {MAX_PROFILES} of them")
    shards = max(1, -(-sizes.count() // shard))
    caps = F.array(*(F.struct(F.lit(r["profile"]).alias("profile"), F.lit(r["cap"]).cast("long").alias("capacity")) for r in every)) if every else F.expr("array_remove(array(struct('' as profile, 0L as capacity)), struct('' as profile, 0L as capacity))")
    each = sizes.select("doc_id", "tokens", F.explode(caps).alias("p")).select("doc_id", "tokens", "p.profile", "p.capacity").withColumn("whole", F.floor(F.col("tokens") / F.col("capacity")))
    full = each.where("whole > 0").select("profile", "capacity", "doc_id", F.explode(F.expr("sequence(0L, whole - 1)")).alias("piece"))
    full = full.select("profile", F.concat(F.lit("full-"), "doc_id", F.lit("-"), "piece").alias("container"), "doc_id", "piece", F.col("capacity").alias("tokens"))
    items = each.select("profile", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard"), "capacity", "doc_id", F.col("whole").alias("piece"), (F.col("tokens") - F.col("whole") * F.col("capacity")).alias("tokens")).where("tokens > 0")
    return items.repartition("profile", "shard").sortWithinPartitions("profile", "shard"), full


def pack_documents(sizes: DataFrame, profiles: DataFrame, shard: int = SHARD, nodes: int | None = NODES, keep: int | None = KEEP) -> DataFrame:
    """(profile, container, doc_id, piece, tokens): ``piece`` counts the parts of a document from 0."""
    items, full = _items(sizes, profiles, shard)
    spec = "profile string, container string, doc_id long, piece long, tokens long"
    return items.mapInArrow(lambda batches: _packer(batches, nodes, keep), spec).unionByName(full)


def packing_report(sizes: DataFrame, profiles: DataFrame, shard: int = SHARD, nodes: int | None = NODES, keep: int | None = KEEP) -> DataFrame:
    """(profile, shards, bound, best_fit, packed, at_bound, improved): containers of all shards, and how many shards are at their bound or bettered by the search."""
    spec = "profile string, shard long, bound long, best_fit long, packed long"
    each = _items(sizes, profiles, shard)[0].mapInArrow(lambda batches: _packer(batches, nodes, keep, True), spec)
    count = lambda c: F.sum(c.cast("int"))
    return each.groupBy("profile").agg(F.count("*").alias("shards"), *(F.sum(c).alias(c) for c in ("bound", "best_fit", "packed")), count(F.col("packed") == F.col("bound")).alias("at_bound"), count(F.col("packed") < F.col("best_fit")).alias("improved"))


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = written(token_sizes(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return pack_documents(sizes, table(spark, sf_dir, "pack_profile"))


def p7_waste(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each profile: containers, tokens, and the share of unused space."""
    packed = p7_containers(spark, sf_dir)
    by = packed.groupBy("profile").agg(F.countDistinct("container").alias("containers"), F.sum("tokens").alias("tokens"))
    return by.join(F.broadcast(table(spark, sf_dir, "pack_profile")), "profile").select("profile", "containers", "tokens", (1 - F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("unused"))


def p7_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the search adds to best fit, and how far the packing is from the bound."""
    sizes = written(token_sizes(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return packing_report(sizes, table(spark, sf_dir, "pack_profile"))


QUERIES = {"p7_containers": p7_containers, "p7_waste": p7_waste, "p7_search": p7_search}
SQL: dict[str, str] = {}
