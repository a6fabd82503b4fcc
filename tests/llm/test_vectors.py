"""Search, mining and whitening of vectors against plain versions, on tables with every awkward row."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from docvigil.llm import vectors as shared
from docvigil.llm.ball_search import ball_bounds, ball_tree, top_k
from docvigil.llm.hard_negatives import box_bounds, hard_negatives, hilbert_keys
from docvigil.llm.vectors import Best, scores
from docvigil.llm.whitening import fit_whitening, whiten, whole_rows

CLASHES = ["x", "uid", "place", "leaf", "curve", "asks", "block", "data", "slot", "qblock", "grp", "kth", "most", "unit", "nth", "range", "at", "n"]
SCHEMA = "vec_id long, embedding array<float>, label int"
LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 4 ELSE label END"


def awkward(n: int = 260, dims: int = 6, seed: int = 1) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows: list[tuple] = [(i, [float(c) for c in rng.normal(size=dims) / 2], int(rng.integers(4))) for i in range(n)]
    hot = rows[7][1]
    rows += [(n + i, hot, i % 4) for i in range(90)]  # a third of all rows are one vector
    rows += [rows[0], rows[50], rows[50]]  # rows that repeat whole
    rows += [(None, hot, 1), (None, None, None), (2 * n, None, 1), (2 * n + 20, [math.nan] * dims, 1), (2 * n + 40, [math.inf] + [0.0] * (dims - 1), 2)]
    rows += [(3 * n, [None] + [0.5] * (dims - 1), 1), (4 * n, [], 1), (5 * n, [0.25, -0.25], 2), (6 * n, [0.0] * dims, None), (7 * n + 20, hot, None)]
    return rows


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    return df.select("*", *[F.lit("other").alias(c) for c in CLASHES])


def whole(rows, scale=256):
    """Rows that take part: id, integer vector filled with zeros, label."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    dims = max((len(v) for _, v, _ in kept), default=0)
    return [(i, [math.floor(scale * float(np.float32(c))) for c in v] + [0] * (dims - len(v)), lab) for i, v, lab in kept]


def last(i):
    return (i is None, i or 0)


def best_of(query, rows, k, allowed):
    found = [(-sum(a * b for a, b in zip(query, v, strict=True)), last(i), i) for j, (i, v, _) in enumerate(rows) if allowed(j)]
    return [(i, -s) for s, _, i in sorted(found, key=lambda f: f[:2])[:k]]


def plain_top_k(rows, k=5, every=10):
    v = whole(rows)
    out = []
    for j, (i, x, _) in enumerate(v):
        if i is not None and i % every == 0:
            out += [(i, r + 1, c, s) for r, (c, s) in enumerate(best_of(x, v, k, lambda m, j=j: m != j))]
    return sorted(out, key=str)


def plain_negatives(rows, every=20):
    v = [(i, x, (lab + 1) % 4 if i is not None and i % 7 == 0 else lab) for i, x, lab in whole([r for r in rows if r[2] is not None])]
    out = []
    for j, (i, x, lab) in enumerate(v):
        if i is not None and i % every == 0:
            for p, ps in best_of(x, v, 5, lambda m, j=j, lab=lab: m != j and v[m][2] == lab):
                window = best_of(x, v, len(v), lambda m, lab=lab: v[m][2] != lab)
                out += [(i, p, r + 1, c, ps, s) for r, (c, s) in enumerate([(c, s) for c, s in window if 80 * ps <= 100 * s <= 100 * ps][:5])]
    return sorted(out, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("per_shard, per_query_block, group", [(4096, 1024, 512), (16, 8, 4), (33, 1000, 512)])
def test_top_k_equals_all_scores(spark, monkeypatch, per_shard, per_query_block, group):
    monkeypatch.setattr(shared, "GROUP", group)
    rows = awkward()
    got = top_k(frame(spark, rows), F.col("vec_id") % 10 == 0, per_shard=per_shard, per_query_block=per_query_block, sample=64)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert collected(got) == plain_top_k(rows)


@pytest.mark.parametrize("per_block, group", [(2048, 512), (16, 4)])
def test_hard_negatives_equal_all_scores(spark, monkeypatch, per_block, group):
    monkeypatch.setattr(shared, "GROUP", group)
    rows = awkward()
    got = hard_negatives(frame(spark, rows), F.col("vec_id") % 20 == 0, F.expr(LABEL), per_block=per_block, per_anchor_block=7)
    assert collected(got) == plain_negatives(rows)


@pytest.mark.parametrize("rows", [[], [(0, None, 1)], [(0, [0.5, 1.0], 1)], [(0, [0.5], 1), (1, [0.25], 1)], [(0, [], 1), (50, [], 2)]])
def test_few_rows(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    v = whole(rows)
    assert collected(top_k(df, F.col("vec_id") % 50 == 0)) == (plain_top_k(rows, every=50) if v else [])
    assert collected(hard_negatives(df, F.col("vec_id") % 100 == 0, F.col("label"))) == []
    assert all(r["component"] == 1 for r in whiten(df).collect())


def test_trees_bound_their_rows():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 9))
    x[100:250] = x[100]
    order, tree = ball_tree(x, 20)
    assert sorted(order) == list(range(500))
    leaf = tree["left"] < 0
    assert sum(tree["last"][leaf] - tree["first"][leaf]) == 500 and (tree["last"] - tree["first"])[leaf].max() <= 20
    q = rng.integers(-300, 300, (40, 9))
    bound = ball_bounds(q, tree["centre"], tree["radius"])
    found = q @ x[order].T
    for node, (a, b) in enumerate(zip(tree["first"], tree["last"], strict=True)):
        assert (found[:, a:b].max(axis=1) <= bound[:, node]).all()


def test_boxes_bound_their_rows():
    rng = np.random.default_rng(3)
    x, q = rng.integers(-300, 300, (60, 9)), rng.integers(-300, 300, (40, 9))
    low, high = box_bounds(q, x.min(axis=0)[None], x.max(axis=0)[None])
    found = q @ x.T
    assert (low[:, 0] <= found.min(axis=1)).all() and (found.max(axis=1) <= high[:, 0]).all()


@pytest.mark.parametrize("bits, dims", [(1, 4), (3, 2), (2, 5), (4, 3)])
def test_hilbert_neighbours_touch(bits, dims):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = hilbert_keys(cells, bits)
    assert len(set(keys)) == len(cells)
    steps = np.abs(np.diff(cells[sorted(range(len(cells)), key=keys.__getitem__)], axis=0)).sum(axis=1)
    assert set(steps) == {1}


def test_scores_are_exact_or_refused():
    wide = np.array([[1 << 29, (1 << 29) + 1]], np.int64)
    assert scores(wide, wide)[0, 0] == sum(int(c) ** 2 for c in wide[0])
    with pytest.raises(OverflowError):
        scores(wide << 10, wide)


def test_ties_keep_the_smallest_ids():
    best = Best(np.full(2, np.iinfo(np.int64).min), 2)
    for first in (8, 4, 0):  # ids fall from block to block
        best.offer(np.array([0, 1]), np.ones((2, 4), np.int64), np.array([[True] * 4, [False, True, True, False]]), np.arange(4) + first, np.arange(4) + first)
        best.settle()
    assert list(zip(best.slot, best.id, strict=True)) == [(0, 0), (0, 1), (1, 1), (1, 2)]


def check_whitening(spark, rows, dims, components=8):
    got = whiten(frame(spark, rows), components).collect()
    x = np.array([v for _, v, _ in whole(rows, 1024)], np.int64).reshape(-1, dims) + 100_000
    n, sums = len(x), x.sum(axis=0)
    centred = x - sums / n
    values, ways = np.linalg.eigh(centred.T @ centred / n)
    values, ways = values[::-1], ways[:, ::-1]
    rank = min(components, int((values > 1e-9 * values.sum()).sum()))
    assert len(got) == n * rank and {r["n"] for r in got} == {n}
    want = sorted(sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, sums, strict=True)) for row in x)
    assert sorted(int(r["deviation"]) for r in got if r["component"] == 1) == want
    assert all(r["identity_error"] <= 1e-9 for r in got)
    for k in range(rank):
        mine = [r for r in got if r["component"] == k + 1]
        assert all(abs(r["explained"] / (values[k] / values.sum()) - 1) < 1e-9 for r in mine)
        alone = min([abs(values[k] - v) for i, v in enumerate(values) if i != k], default=1) > 1e-6 * values[0]
        if alone:  # the direction is unique
            plain = centred @ ways[:, k] / np.sqrt(values[k])
            found = np.array(sorted(r["whitened"] for r in mine))
            assert min(np.abs(found - np.sort(s * plain)).max() for s in (1, -1)) < 1e-8


def test_whitening_equals_a_dense_solver(spark):
    check_whitening(spark, awkward(), 6)
    check_whitening(spark, awkward(400, 20, seed=5), 20)
    check_whitening(spark, awkward(400, 20, seed=5), 20, components=3)


def test_whitening_of_few_directions(spark):
    rng = np.random.default_rng(8)
    flat = rng.integers(-40, 40, (70, 2)) @ np.array([[1, 0, 2, 0, -1], [0, 3, 0, 1, 1]]) / 1024
    check_whitening(spark, [(i, [float(c) for c in v], 1) for i, v in enumerate(flat)], 5)
    # equal eigenvalues: the corners of a cube
    cube = [(i, [float(c) for c in v], 1) for i, v in enumerate(itertools.product((-0.5, 0.5), repeat=4))]
    check_whitening(spark, cube, 4)
    assert whiten(frame(spark, [(i, [0.5, 0.25], 1) for i in range(9)])).count() == 0
    assert whiten(frame(spark, [])).count() == 0


def test_whitening_stops_early_on_wide_rows(spark):
    """With few strong directions far fewer steps than dimensions are needed."""
    rng = np.random.default_rng(9)
    strong = rng.normal(size=(300, 3)) * [9, 5, 3] @ rng.normal(size=(3, 60)) + rng.normal(size=(300, 60)) * 1e-2
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(strong)], SCHEMA)
    rows = whole_rows(df, 1024, vec_id=F.col("vec_id"))
    fit = fit_whitening(rows, 3)
    x = np.array([v for _, v, _ in whole([(i, list(map(float, v)), 1) for i, v in enumerate(strong)], 1024)])
    centred = x - x.mean(axis=0)
    assert np.allclose(fit.eigenvalues, np.linalg.svd(centred, compute_uv=False)[:3] ** 2 / len(x), rtol=1e-10)
    assert np.allclose(fit.components.T @ fit.components, np.eye(3), atol=1e-12)


def test_exact_sums_and_deviations_beyond_64_bits(spark):
    rows = [(i, [float(2**40 + i * 2**25), float(-(2**41))], 1) for i in range(40)]
    x = [v for _, v, _ in whole(rows, 1024)]
    n, sums = len(x), [sum(c) for c in zip(*[[a + 100_000 for a in v] for v in x], strict=True)]
    want = sorted(sum((n * (a + 100_000) - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x)
    assert sorted(int(r["deviation"]) for r in whiten(frame(spark, rows), 1).collect()) == want
