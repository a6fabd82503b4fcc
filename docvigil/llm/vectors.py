"""What the vector operators share: rows that take part, positions in an order, packed blocks, and the
search of a stated query set against blocks of candidates under bounds.

A *block* is a bounded number of rows packed into one row of a Parquet table. A search meets blocks of
queries with blocks of candidates in three steps, none of which holds more than a few blocks at once:

1. Bounds. Summaries of the candidate blocks (packed by ``GROUP``) meet each block of queries; the best
   ``per_unit`` blocks of each block of queries are its first unit.
2. First units are visited; they give each slot (a query, or one window of a query) its k-th score.
3. Bounds are taken again. A block that no slot of a block of queries can still use is never sent; the
   others are visited in units of ``per_unit`` blocks, best bound first, and each block that a unit visits
   lowers the work of the next, as its k-th scores are shared.

Bounds are widened by more than their rounding, so results are exact.

Vectors of unequal length count as filled with zeros at their end. Scores must fit 64 bits, else an
OverflowError is raised.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docvigil.llm.common import materialize, numbered

#: Summaries of so many candidate blocks meet a block of queries at once.
GROUP = 512
LOWEST = np.iinfo(np.int64).min
NO_ID = np.iinfo(np.int64).max
HITS = "qblock long, slot int, asker long, asker_id long, score long, id long, uid long"

Arrays = dict[str, np.ndarray]


def taking_part(vector: str) -> Column:
    """Neither the vector nor a component is null, NaN or infinite."""
    v = F.col(vector)
    odd = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(odd, F.lit(True))


def whole_rows(df: DataFrame, scale: int, **cols: Column) -> DataFrame:
    """``uid``, the named columns and ``x``, the floors of ``scale`` times each component, of the rows that
    take part; written, so that ``uid`` stays."""
    x = F.transform(F.col("embedding"), lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    rows = df.filter(taking_part("embedding")).select(*[c.alias(n) for n, c in cols.items()], x.alias("x"))
    return materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "vectors")


def matrix(column: pa.Array | pa.ChunkedArray, dims: int, kind=np.int64) -> np.ndarray:
    """Rows of a list column as a matrix of ``dims`` columns; short rows are filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat, size = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    if (size == dims).all():
        return flat.reshape(len(column), dims).astype(kind, copy=False)
    out = np.zeros((len(column), dims), kind)
    out[np.arange(dims) < size[:, None]] = flat
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type that holds them."""
    most = int(np.abs(x).max(initial=0))
    return x.astype(next((t for t in (np.int16, np.int32) if 0 <= most <= np.iinfo(t).max), np.int64))


def pack(arrays: Arrays) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> Arrays:
    with np.load(io.BytesIO(data), allow_pickle=False) as file:
        return {k: file[k] for k in file.files}


def packed(rows: DataFrame, build: Callable[[pa.Table], Arrays], per_block: int) -> DataFrame:
    """(block, data) of rows with a ``place`` from 0, ``per_block`` neighbours a block; written."""

    def one(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([pack(build(group))], pa.binary())})

    rows = rows.withColumn("block", F.floor(F.col("place") / per_block))
    return materialize(rows.groupBy("block").applyInArrow(one, "block long, data binary"), "blocks")


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows."""
    most = int(np.abs(q).max(initial=0)) * int(np.abs(x).max(initial=0)) * q.shape[1]
    if 0 <= most < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if not 0 <= most < 1 << 63:
        raise OverflowError("inner products beyond 64 bits")
    return q.astype(np.int64) @ x.astype(np.int64).T


class Best:
    """The best ``k`` hits of each slot: higher scores first, ties to smaller ids.

    ``kth`` is what a hit must reach; it starts at what earlier units found.
    """

    def __init__(self, kth: np.ndarray, k: int):
        self.kth, self.k = kth, k
        self.slot, self.score, self.id, self.uid = (np.zeros(0, np.int64) for _ in range(4))

        self.waiting: list[tuple[np.ndarray, ...]] = []

    def offer(self, slots: np.ndarray, found: np.ndarray, allowed: np.ndarray, id_: np.ndarray, uid: np.ndarray) -> None:
        """Scores of slots (rows) and candidates (columns, by rising id and uid), of which only the allowed
        ones count; the best of each slot wait until they are settled."""
        floor = np.where(allowed, found, LOWEST)
        good = allowed & (floor >= self.kth[slots][:, None])
        if found.shape[1] > self.k:
            least = np.partition(floor, -self.k, axis=1)[:, -self.k][:, None]
            above, equal = floor > least, floor == least
            room = self.k - above.sum(axis=1, keepdims=True)
            good &= above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room))
        r, c = np.nonzero(good)
        self.waiting.append((slots[r], found[r, c], id_[c], uid[c]))

    def settle(self) -> None:
        parts = [(self.slot, self.score, self.id, self.uid), *self.waiting]
        self.waiting = []
        if not any(len(p[0]) for p in parts[1:]):
            return
        slot, score, id_, uid = (np.concatenate(p) for p in zip(*parts, strict=True))
        order = np.lexsort((uid, id_, -score, slot))
        slot, score, id_, uid = slot[order], score[order], id_[order], uid[order]
        begins = np.flatnonzero(np.diff(slot, prepend=-1))
        rank = np.arange(len(slot)) - np.repeat(begins, np.diff(begins, append=len(slot)))
        keep = rank < self.k
        last = rank == self.k - 1
        self.kth[slot[last]] = np.maximum(self.kth[slot[last]], score[last])
        self.slot, self.score, self.id, self.uid = slot[keep], score[keep], id_[keep], uid[keep]


#: Of a block of queries, the summaries of blocks, the k-th scores and given limits of slots: an upper bound
#: for each query and block, and which of them can still matter.
Bounds = Callable[[Arrays, Arrays, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
#: Of a block of queries, a block of candidates, what was found so far, and the limits: adds to what was found.
Visit = Callable[[Arrays, Arrays, Best, np.ndarray], None]


def summaries(blocks: DataFrame, describe: Callable[[Arrays], Arrays]) -> DataFrame:
    """(grp, data): the summaries of ``GROUP`` blocks in one row; written."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("block").to_pylist(), batch.column("data"), strict=True):
                yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "data": pa.array([pack(describe(unpack(data.as_py())))], pa.binary())})

    def together(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        parts = [unpack(d.as_py()) for d in group.column("data")]
        arrays = {k: np.stack([p[k] for p in parts]) for k in parts[0]} | {"block": group.column("block").to_numpy()}
        return pa.table({"grp": pa.array([key[0].as_py()], pa.int64()), "data": pa.array([pack(arrays)], pa.binary())})

    rows = blocks.mapInArrow(each, "block long, data binary").withColumn("grp", F.floor(F.col("block") / GROUP))
    return materialize(rows.groupBy("grp").applyInArrow(together, "grp long, data binary"), "summaries")


def _limits(table: pa.Table, name: str, n: int, empty: int) -> np.ndarray:
    """A number for each slot from a one-row list column of (slot, value)."""
    out = np.full(n, empty, np.int64)
    for row in table.column(name).to_pylist():
        for entry in row or ():
            out[entry["slot"]] = entry["value"]
    return out


def by_block(rows: DataFrame, value: Column, name: str) -> DataFrame:
    """(qblock, list of (slot, value)); a block has a bounded number of slots."""
    return rows.groupBy("qblock").agg(F.collect_list(F.struct(F.col("slot"), value.cast("long").alias("value"))).alias(name))


def search(queries: DataFrame, blocks: DataFrame, groups: DataFrame, bounds: Bounds, visit: Visit, k: int, slots: int = 1, most: DataFrame | None = None, per_unit: int = 4) -> DataFrame:
    """Hits (``HITS``): the best ``k`` of each slot with their ``nth`` from 1.

    ``queries(block, data)`` and ``blocks(block, data)`` come from ``packed``, ``groups`` from ``summaries``.
    Slot s of a block of queries is window s % ``slots`` of its query s // ``slots``; ``most(qblock, most)`` may
    give each slot a limit by ``by_block``; where it is given, slots without one are not searched.
    """
    queries = queries.withColumnRenamed("block", "qblock")
    if most is not None:
        queries = queries.join(most, "qblock")
    else:
        queries = queries.withColumn("most", F.lit(None).cast("array<struct<slot:int,value:bigint>>"))
    n_groups = groups.count()
    if not n_groups:
        return queries.sparkSession.createDataFrame([], HITS + ", nth int")
    wide_open = most is None

    def read(table: pa.Table) -> tuple[Arrays, np.ndarray, np.ndarray]:
        q = unpack(table.column("data")[0].as_py())
        n = len(q["uid"]) * slots
        return q, _limits(table, "kth", n, LOWEST), _limits(table, "most", n, NO_ID if wide_open else LOWEST)

    def bound(first: bool):
        def one(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
            q, kth, limit = read(left)
            group = unpack(right.column("data")[0].as_py())
            upper, needed = bounds(q, group, kth, limit)
            best = np.where(needed, upper, -np.inf).max(axis=0, initial=-np.inf)
            chosen = np.flatnonzero(needed.any(axis=0))
            chosen = chosen[np.lexsort((group["block"][chosen], -best[chosen]))]
            if first:
                chosen = chosen[:per_unit]
            n = len(chosen)
            return pa.table({"qblock": pa.array([key[0].as_py()] * n, pa.int64()), "block": pa.array(group["block"][chosen], pa.int64()), "upper": pa.array(best[chosen], pa.float64())})

        return one

    def unit(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        q, kth, limit = read(left)
        best = Best(kth, k)
        order = np.lexsort((right.column("block").to_numpy(), -right.column("upper").to_numpy()))
        for i in order:
            visit(q, unpack(right.column("data")[int(i)].as_py()), best, limit)
        return pa.table({"qblock": pa.array([key[0].as_py()] * len(best.slot), pa.int64()), "slot": pa.array(best.slot, pa.int32()), "asker": q["uid"][best.slot // slots], "asker_id": q["id"][best.slot // slots], "score": best.score, "id": best.id, "uid": best.uid})

    def pairs(asked: DataFrame, first: bool) -> DataFrame:
        each = F.explode(F.expr(f"sequence(0L, {n_groups - 1}L)")).alias("grp")
        left, right = asked.select("*", each), asked.select(F.col("qblock").alias("of"), each).join(groups, "grp").withColumnRenamed("grp", "with")
        return left.groupBy("qblock", "grp").cogroup(right.groupBy("of", "with")).applyInArrow(bound(first), "qblock long, block long, upper double")

    rank = F.row_number().over(Window.partitionBy("qblock").orderBy(F.desc("upper"), "block"))

    def visited(asked: DataFrame, chosen: DataFrame) -> DataFrame:
        left = asked.join(chosen.select("qblock", "unit").distinct(), "qblock")
        right = chosen.join(blocks, "block").withColumnsRenamed({"qblock": "of", "unit": "with"})
        return left.groupBy("qblock", "unit").cogroup(right.groupBy("of", "with")).applyInArrow(unit, HITS)

    asked = queries.withColumn("kth", F.lit(None).cast("array<struct<slot:int,value:bigint>>"))
    first = pairs(asked, True).withColumn("nth", rank).filter(F.col("nth") <= per_unit).select("qblock", "block", "upper", F.lit(0).alias("unit"))
    first = materialize(first, "pairs")
    early = materialize(visited(asked, first), "hits")
    kth = by_block(early.groupBy("qblock", "slot").agg(F.count("uid").alias("n"), F.min("score").alias("value")).filter(F.col("n") == k), F.col("value"), "kth")
    asked = queries.join(kth, "qblock", "left")
    rest = pairs(asked, False).join(first.select("qblock", "block"), ["qblock", "block"], "left_anti")
    rest = materialize(rest.select("qblock", "block", "upper", F.floor((rank - 1) / per_unit).alias("unit")), "pairs")
    hits = early.unionByName(visited(asked, rest))
    nth = F.row_number().over(Window.partitionBy("qblock", "slot").orderBy(F.desc("score"), "id", "uid"))
    return materialize(hits.withColumn("nth", nth).filter(F.col("nth") <= k), "hits")


def placed(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with their ``place`` from 0 in the order of ``keys``; hot keys are cut by ``uid``."""
    return numbered(rows, *keys, "uid", name="place")


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """Ids with null as the largest: ties go to known ids."""
    return column.fill_null(NO_ID).to_numpy()


def by_id(group: pa.Table) -> pa.Table:
    """Rows by rising id, null last."""
    return group.take(pa.array(np.lexsort((group.column("uid").to_numpy(), ids(group.column("vec_id"))))))


def known(name: str) -> Column:
    """An id of ``ids`` as it was."""
    return F.nullif(F.col(name), F.lit(NO_ID))
