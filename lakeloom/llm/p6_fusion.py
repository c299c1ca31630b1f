"""Problem 6: one ranking from several differently-scaled scores.

Ideal-point ranking. Each list's scores are winsorised at their ``TRIM`` and ``1 - TRIM`` quantiles,
shifted so that the last is 0 and divided by their Euclidean length over the request's items (vector
normalisation), so that each list brings the same energy whatever its range; all lists have the same weight
unless ``weights`` says otherwise. Items are sorted by relative closeness d- / (d+ + d-) of their weighted
distances to the ideal and the anti-ideal point, ties by id.

Requests are independent and a request is one row, so nothing is shuffled but what removes requests
delivered twice. Defined cases: null and NaN scores, null hits and null ids are no hits; an id repeated
in a list counts with its higher score; a list without hits, or whose scores are all equal, says nothing;
an item missing from a list is last in it; infinite scores count as very large ones. If no list says
anything, items are in the order of their ids. Requests with fewer than ``min_lists`` non-empty lists
have no ranking. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_rows, table

TRIM = 0.1
LISTS = ("vector_results", "bm25_results", "splade_results")


def hits(found: list | None) -> dict[str, float]:
    out: dict[str, float] = {}
    for h in found or ():
        if h is None or h["id"] is None or h["score"] is None or math.isnan(h["score"]):
            continue
        s = min(max(h["score"], -1e150), 1e150)
        if s > out.get(h["id"], -math.inf):
            out[h["id"]] = s
    return out


def closeness(lists: list[dict[str, float]], weights: list[float] | None = None) -> list[tuple[str, float]]:
    """Items by relative closeness to the ideal point; ``weights`` are 1 for each list by default."""
    ids = sorted({i for x in lists for i in x})
    place = {i: k for k, i in enumerate(ids)}
    columns = []
    for x, weight in zip(lists, weights or [1.0] * len(lists)):
        v = np.array(list(x.values()))
        if len(v) < 2 or v.min() == v.max():
            continue
        a, b = np.quantile(v, [TRIM, 1 - TRIM])
        if not b > a:
            a, b = v.min(), v.max()
        col = np.zeros(len(ids))
        col[[place[i] for i in x]] = (np.clip(v, a, b) - a) / (b - a)  # so that squares neither overflow nor vanish
        columns.append(weight * col / np.linalg.norm(col))
    if not columns:
        return [(i, 0.0) for i in ids]
    m = np.column_stack(columns)
    up, down = np.linalg.norm(m - m.max(0), axis=1), np.linalg.norm(m - m.min(0), axis=1)
    c = np.round(down / (up + down), 12)
    return [(ids[k], float(c[k])) for k in np.lexsort((np.arange(len(ids)), -c))]


SCHEMA = pa.schema([("request_id", pa.string()), ("id", pa.string()), ("closeness", pa.float64()), ("rank", pa.int32())])


def fuse(requests: DataFrame, lists: tuple[str, ...] = LISTS, min_lists: int = 2, top: int | None = None) -> DataFrame:
    """(request_id, id, closeness, rank) for each distinct request; ``top`` keeps the first ranks only."""

    def rows(keys: list, *found: list) -> Iterator[tuple]:
        for key, *each in zip(keys, *found):
            some = [x for x in map(hits, each) if x]
            if len(some) >= min_lists:
                for r, (i, c) in enumerate(closeness(some)[:top], 1):
                    yield key, i, c, r

    distinct = requests.select("request_id", *lists).dropDuplicates()
    return distinct.mapInArrow(arrow_rows(rows, ["request_id", *lists], SCHEMA), "request_id string, id string, closeness double, rank int")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(table(spark, sf_dir, "fusion_request"), top=1).select("request_id", "id")


def p6_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse(table(spark, sf_dir, "fusion_request"))


QUERIES = {"p6_found": p6_found, "p6_ranking": p6_ranking}
_HITS = """WITH req AS (SELECT DISTINCT request_id, vector_results AS v, bm25_results AS b, splade_results AS s FROM fusion_request),
  raw AS (SELECT request_id, 1 AS l, unnest(v) AS h FROM req UNION ALL SELECT request_id, 2, unnest(b) FROM req UNION ALL SELECT request_id, 3, unnest(s) FROM req),
  hits AS (SELECT request_id, l, h.id AS id, max(greatest(-1e150, least(1e150, h.score))) AS s FROM raw WHERE h.id IS NOT NULL AND h.score IS NOT NULL AND NOT isnan(h.score) GROUP BY ALL)"""
SQL = {
    "p6_found": f"""{_HITS},
  ids AS (SELECT DISTINCT request_id, id FROM hits SEMI JOIN (SELECT request_id FROM hits GROUP BY request_id HAVING count(DISTINCT l) >= 2) USING (request_id)),
  q AS (SELECT request_id, l, min(s) AS lo, max(s) AS hi, quantile_cont(s, {TRIM}) AS a, quantile_cont(s, {1 - TRIM}) AS b FROM hits GROUP BY ALL HAVING min(s) < max(s)),
  w AS (SELECT request_id, l, CASE WHEN b > a THEN a ELSE lo END AS a, CASE WHEN b > a THEN b ELSE hi END AS b FROM q),
  x AS (SELECT request_id, l, id, (least(greatest(s, a), b) - a) / (b - a) AS x FROM hits JOIN w USING (request_id, l)),
  y AS (SELECT request_id, l, id, x / sqrt(sum(x * x) OVER (PARTITION BY request_id, l)) AS y FROM x),
  top AS (SELECT request_id, l, max(y) AS hi FROM y GROUP BY ALL),
  d AS (SELECT request_id, id, sqrt(sum((coalesce(y, 0) - hi) * (coalesce(y, 0) - hi))) AS up, sqrt(sum(coalesce(y, 0) * coalesce(y, 0))) AS down FROM ids LEFT JOIN top USING (request_id) LEFT JOIN y USING (request_id, l, id) GROUP BY ALL)
SELECT request_id, id FROM d QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY round(coalesce(down / (up + down), 0), 12) DESC, id) = 1"""
}
