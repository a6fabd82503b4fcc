"""Exact top-k search by inner product: a ball tree in each shard, searched by branch and bound.

1. *Shards.* A split tree is fitted on a bounded sample (``sample`` rows); every row gets its leaf, and rows
   in the order of (leaf, uid) are cut into shards of ``per_shard`` rows, so that neighbours share a shard and
   a vector that very many rows share fills several. The sample only decides the order, never a result.
2. *Trees.* Each shard is one row: its vectors in the order of the leaves of a ball tree (halves along the line
   between two far points), and centre and radius of each node.
3. *Search.* For a query q a node's scores are at most q·centre + |q| radius. Each query opens its node of the
   highest bound next, in lockstep with all queries of its block, and stops when no open node reaches its
   k-th score. That score is shared from shard to shard (``vectors.search``): shards that no query of a block
   needs are not sent to it at all.

Edge cases: rows with a null vector or a null or non-finite component take no part; an empty vector scores 0;
fewer candidates than ``k`` give fewer rows; ties go to the smaller vec_id, null ids last; rows that repeat a
vec_id are rows of their own, and only a query's own row is no candidate of it; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvigil.llm.common import hash_order
from docvigil.llm.vectors import Arrays, Best, by_id, ids, known, matrix, narrow, packed, placed, scores, search, summaries, whole_rows

LEAF_ROWS = 128
#: Bounds are widened by this share of their parts, far above what rounding can do.
SLACK = 1e-9


def _halves(x: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, float, np.ndarray]:
    """A direction between two far rows, the median along it, and the order of the rows along it."""
    part = x[rows].astype(np.float64)
    middle = part.mean(axis=0)
    a = part[np.argmax(((part - middle) ** 2).sum(axis=1))]
    b = part[np.argmax(((part - a) ** 2).sum(axis=1))]
    along = part @ (b - a)
    order = np.argsort(along, kind="stable")
    return b - a, float(along[order[len(order) // 2]]), order


def ball_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS) -> tuple[np.ndarray, Arrays]:
    """The order of the rows (in a leaf as given), and of each node: centre, radius, first and last place, children (-1: none)."""
    order = np.arange(len(x))
    first, last, left, right = [0], [len(x)], [-1], [-1]
    node = 0
    while node < len(first):
        a, b = first[node], last[node]
        if b - a > leaf_rows:
            rows = order[a:b]
            order[a:b] = rows[_halves(x, rows)[2]]
            left[node], right[node] = len(first), len(first) + 1
            middle = (a + b) // 2
            first += [a, middle]
            last += [middle, b]
            left += [-1, -1]
            right += [-1, -1]
        else:
            order[a:b].sort()
        node += 1
    centre = np.stack([x[order[a:b]].mean(axis=0) for a, b in zip(first, last, strict=True)])
    radius = [np.sqrt(((x[order[a:b]] - c) ** 2).sum(axis=1).max(initial=0)) for a, b, c in zip(first, last, centre, strict=True)]
    return order, {"centre": centre, "radius": np.array(radius), "first": np.array(first), "last": np.array(last), "left": np.array(left), "right": np.array(right)}


def ball_bounds(q: np.ndarray, centre: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner products of query rows with what the balls hold."""
    q = q.astype(np.float64)
    size = np.sqrt((q**2).sum(axis=1))[:, None]
    return q @ centre.T + size * radius + SLACK * (1 + size * (radius + np.sqrt((centre**2).sum(axis=1))))


def _visit(q: Arrays, shard: Arrays, best: Best, limit: np.ndarray) -> None:
    """Best first in lockstep: each query opens its node of the highest bound until none reaches its k-th score."""
    queries, x = q["x"], shard["x"]
    open_ = np.full((len(queries), len(shard["first"])), -np.inf)
    open_[:, 0] = ball_bounds(queries, shard["centre"][:1], shard["radius"][:1])[:, 0]
    live = np.arange(len(queries))
    while True:
        node = open_[live].argmax(axis=1)
        top = open_[live, node]
        on = (top > -np.inf) & (top >= best.kth[live])
        live, node = live[on], node[on]
        if not len(live):
            return
        open_[live, node] = -np.inf
        for n in np.unique(node):
            asked = live[node == n]
            if shard["left"][n] < 0:
                a, b = shard["first"][n], shard["last"][n]
                allowed = q["uid"][asked][:, None] != shard["uid"][a:b]
                best.offer(asked, scores(queries[asked], x[a:b]), allowed, shard["id"][a:b], shard["uid"][a:b])
            else:
                both = [shard["left"][n], shard["right"][n]]
                open_[np.ix_(asked, both)] = ball_bounds(queries[asked], shard["centre"][both], shard["radius"][both])
        best.settle()


def _bounds(q: Arrays, group: Arrays, kth: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    upper = ball_bounds(q["x"], group["centre"], group["radius"])
    return upper, upper >= kth[:, None]


def _splits(x: np.ndarray, leaves: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A complete tree of splits of a sample: directions and cuts of each level."""
    parts, levels = [np.arange(len(x))], []
    for _ in range(max(0, leaves - 1).bit_length()):
        below, ways, cuts = [], [], []
        for rows in parts:
            if len(rows) > 1:
                way, cut, order = _halves(x, rows)
                below += [rows[order[: len(order) // 2]], rows[order[len(order) // 2 :]]]
            else:
                way, cut = np.zeros(x.shape[1]), 0.0
                below += [rows, rows[:0]]
            ways.append(way)
            cuts.append(cut)
        levels.append((np.stack(ways), np.array(cuts)))
        parts = below
    return levels


def _leaf(x: np.ndarray, levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for ways, cuts in levels:
        node = node * 2 + (np.einsum("ij,ij->i", x.astype(np.float64), ways[node]) >= cuts[node])
    return node


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, per_shard: int = 4096, per_query_block: int = 1024, sample: int = 8192) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id`` and ``score`` of the ``k`` best rows of each row of
    ``vectors(vec_id, embedding)`` for which ``is_query`` holds."""
    rows = whole_rows(vectors, scale, vec_id=F.col("vec_id").cast("long"), asks=F.coalesce(is_query, F.lit(False)))
    n, dims = rows.agg(F.count("uid"), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    drawn = rows.orderBy(hash_order(F.col("uid"))).limit(sample).select("x").toArrow()
    splits = _splits(matrix(drawn.column("x"), dims), min(-(-n // per_shard), sample // 8))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = _leaf(matrix(batch.column("x"), dims), splits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaf)], names=[*batch.schema.names, "leaf"])

    def shard(group: pa.Table) -> Arrays:
        group = by_id(group)
        x = matrix(group.column("x"), dims)
        order, tree = ball_tree(x)
        return {"x": narrow(x[order]), "uid": group.column("uid").to_numpy()[order], "id": ids(group.column("vec_id"))[order]} | tree

    def block(group: pa.Table) -> Arrays:
        return {"x": narrow(matrix(group.column("x"), dims)), "uid": group.column("uid").to_numpy(), "id": ids(group.column("vec_id"))}

    routed = rows.mapInArrow(route, "vec_id long, asks boolean, x array<long>, uid long, leaf long")
    shards = packed(placed(routed.drop("asks"), "leaf"), shard, per_shard)
    queries = packed(placed(routed.filter("asks"), "leaf"), block, per_query_block)
    groups = summaries(shards, lambda s: {"centre": s["centre"][0], "radius": s["radius"][0]})
    hits = search(queries, shards, groups, _bounds, _visit, k)
    return hits.select(known("asker_id").alias("query_id"), F.col("nth").alias("rank"), known("id").alias("vec_id"), "score")
