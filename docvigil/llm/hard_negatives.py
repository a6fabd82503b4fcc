"""Hard negatives: for each anchor and positive, the best rows of another label whose score lies in a window
under the positive's, read from blocks that a Hilbert curve orders and zone maps describe.

1. *Blocks.* Components are cut into ``2**bits`` cells; a row's cells give its key on the Hilbert curve through
   all dimensions. Rows in the order of the key (then uid, so that a vector that very many rows share fills
   several blocks) are cut into Parquet blocks of ``per_block`` rows.
2. *Zone maps.* A block's summary is the least and greatest component of each dimension. By interval
   arithmetic an anchor's scores with the block lie between sum(min(a*lo, a*hi)) and sum(max(a*lo, a*hi)).
3. *Positives.* The best ``positives`` other rows of the anchor's label; a block is read while its upper bound
   reaches the anchor's k-th score (``vectors.search``).
4. *Windows.* A positive of score p opens the window from ``percent`` percent of p up to p. A block is read for
   an anchor if its interval meets one of the anchor's windows above that window's k-th score so far.

Edge cases: rows with a null label, a null vector or a null or non-finite component take no part; fewer
positives or negatives than asked for give fewer rows, none at all for a positive of negative score; ties go
to the smaller vec_id, null ids last; rows that repeat a vec_id are rows of their own; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docvigil.llm.vectors import LOWEST, Arrays, Best, by_block, by_id, ids, known, matrix, narrow, packed, placed, scores, search, summaries, whole_rows

#: Anchors whose scores with a block are held at once.
ANCHORS = 256
#: Bounds are widened by this share of their parts, far above what rounding can do.
SLACK = 1e-9


def hilbert_keys(cells: np.ndarray, bits: int) -> list[bytes]:
    """The keys of rows of cells, each from 0 to 2**bits - 1, on the Hilbert curve through all columns.

    The cube is halved bit by bit: where a dimension lies in its upper half the first one is mirrored, else
    both swap what lies below the bit; Gray codes then order the halves.
    """
    axes = cells.astype(np.uint32).T.copy()
    dims = len(axes)
    for b in range(bits - 1, 0, -1):
        below = np.uint32((1 << b) - 1)
        for i in range(dims):
            upper = (axes[i] >> np.uint32(b)) & np.uint32(1) == 1
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & below).astype(np.uint32)
            axes[0] ^= np.where(upper, below, swap).astype(np.uint32)
            axes[i] ^= swap
    axes = np.bitwise_xor.accumulate(axes, axis=0)
    turn = np.zeros(axes.shape[1], np.uint32)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where((axes[-1] >> np.uint32(b)) & np.uint32(1) == 1, np.uint32((1 << b) - 1), np.uint32(0)).astype(np.uint32)
    axes ^= turn
    levels = np.stack([(axes >> np.uint32(b)) & np.uint32(1) for b in range(bits - 1, -1, -1)])  # bit, dimension, row
    return [row.tobytes() for row in np.packbits(levels.reshape(bits * dims, -1).T.astype(np.uint8), axis=1)]


def box_bounds(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the inner products of rows with what lies in boxes, by interval arithmetic."""
    q, low, high = (a.astype(np.float64) for a in (q, low, high))
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    slack = SLACK * (1 + np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T)
    return up @ low.T + down @ high.T - slack, up @ high.T + down @ low.T + slack


def _zone(block: Arrays) -> Arrays:
    return {"low": block["x"].min(axis=0), "high": block["x"].max(axis=0), "label_low": block["label"].min(), "label_high": block["label"].max()}


def _box(block: Arrays) -> tuple[np.ndarray, np.ndarray]:
    return block["x"].min(axis=0, keepdims=True), block["x"].max(axis=0, keepdims=True)


def _positive_bounds(q: Arrays, group: Arrays, kth: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    upper = box_bounds(q["x"], group["low"], group["high"])[1]
    label = q["label"][:, None]
    return upper, (upper >= kth[:, None]) & (group["label_low"] <= label) & (label <= group["label_high"])


def _visit_positives(q: Arrays, block: Arrays, best: Best, limit: np.ndarray) -> None:
    upper = box_bounds(q["x"], *_box(block))[1][:, 0]
    asked = np.flatnonzero(upper >= best.kth)
    for at in range(0, len(asked), ANCHORS):
        a = asked[at : at + ANCHORS]
        allowed = (q["label"][a][:, None] == block["label"]) & (q["uid"][a][:, None] != block["uid"])
        best.offer(a, scores(q["x"][a], block["x"]), allowed, block["id"], block["uid"])
        best.settle()


def _floor_of(limit: np.ndarray, percent: int) -> np.ndarray:
    """The least score of each window; above the limit where the window is empty or not asked for."""
    if int(np.abs(limit[limit > LOWEST]).max(initial=0)) * 100 >= 1 << 63:
        raise OverflowError("scores beyond 64 bits")
    asked = np.where(limit > LOWEST, limit, -100)
    return np.where(limit > LOWEST, -((-percent * asked) // 100), np.iinfo(np.int64).max)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, percent: int = 80, scale: int = 256, bits: int = 4, per_block: int = 2048, per_anchor_block: int = 512) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` from 1, ``negative_id``, ``positive_score`` and ``negative_score``
    of ``vectors(vec_id, embedding, ...)``; ``label`` is the label that counts."""
    rows = whole_rows(vectors.filter(label.isNotNull()), scale, vec_id=F.col("vec_id").cast("long"), label=label.cast("long"), asks=F.coalesce(is_anchor, F.lit(False)))
    n, dims, low, high = rows.agg(F.count("uid"), F.max(F.size("x")), F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    if not n or not dims:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    low, high = min(low, 0), max(high, 0)  # short rows are filled with zeros

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = ((matrix(batch.column("x"), dims) - float(low)) * ((1 << bits) / (high - low + 1.0))).clip(0, (1 << bits) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells, bits), pa.binary())], names=[*batch.schema.names, "curve"])

    def block(group: pa.Table) -> Arrays:
        group = by_id(group)
        return {"x": narrow(matrix(group.column("x"), dims)), "uid": group.column("uid").to_numpy(), "id": ids(group.column("vec_id")), "label": group.column("label").to_numpy()}

    routed = rows.mapInArrow(keyed, "vec_id long, label long, asks boolean, x array<long>, uid long, curve binary")
    blocks = packed(placed(routed.drop("asks"), "curve"), block, per_block)
    anchors = packed(placed(routed.filter("asks"), "curve"), block, per_anchor_block)
    zones = summaries(blocks, _zone)

    near = search(anchors, blocks, zones, _positive_bounds, _visit_positives, positives)
    window = (F.col("slot") * positives + F.col("nth") - 1).cast("int")
    near = near.select("qblock", window.alias("slot"), known("id").alias("positive_id"), F.col("score").alias("positive_score"))

    def windows(limit: np.ndarray, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The scores from and to which each anchor's windows still ask."""
        least = np.maximum(_floor_of(limit, percent), kth)
        return least.reshape(-1, positives), limit.reshape(-1, positives)

    def bounds(q: Arrays, group: Arrays, kth: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lower, upper = box_bounds(q["x"], group["low"], group["high"])
        least, most = windows(limit, kth)
        needed = np.zeros(upper.shape, bool)
        for r in range(positives):
            a, b = least[:, r, None], most[:, r, None]
            needed |= (a <= b) & (upper >= a) & (lower <= b)
        label = q["label"][:, None]
        return upper, needed & ~((group["label_low"] == label) & (label == group["label_high"]))

    def visit(q: Arrays, block: Arrays, best: Best, limit: np.ndarray) -> None:
        needed = bounds(q, {k: np.expand_dims(v, 0) for k, v in _zone(block).items()}, best.kth, limit)[1][:, 0]
        asked = np.flatnonzero(needed)
        for at in range(0, len(asked), ANCHORS):
            a = asked[at : at + ANCHORS]
            found = scores(q["x"][a], block["x"])
            other = q["label"][a][:, None] != block["label"]
            least, most = (w[a] for w in windows(limit, best.kth))
            for r in range(positives):
                inside = other & (found >= least[:, r, None]) & (found <= most[:, r, None])
                some = inside.any(axis=1)
                best.offer(a[some] * positives + r, found[some], inside[some], block["id"], block["uid"])
            best.settle()

    hits = search(anchors, blocks, zones, bounds, visit, negatives, slots=positives, most=by_block(near, F.col("positive_score"), "most"))
    hits = hits.select("qblock", "slot", known("asker_id").alias("anchor_id"), F.col("nth").alias("rank"), known("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hits.join(near, ["qblock", "slot"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
