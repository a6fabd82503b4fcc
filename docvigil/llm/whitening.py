"""Principal components and whitening by Golub-Kahan-Lanczos bidiagonalisation.

With X the n centred rows, right vectors v and left vectors u grow side by side: X v_j = b u_(j-1) + a u_j and
X'u_j = a v_j + c v_(j+1). Each step is one pass over the rows: a task multiplies its rows by a vector p, which
gives its part of u = X p, and at once adds up X'u, u'u and U'u. A left vector is never stored: each is
u_j = X w_j of a short vector w_j, so a task finds its part of all earlier u_j by one small product and survives
the loss of any other. Both families are reorthogonalised in full at each step, the left one by U'u, the right
one twice on the driver. The driver holds ``dims`` x steps numbers; n appears in no driver step.

The singular values of the small bidiagonal matrix B, over sqrt(n), are the deviations of the components, and
V times its right singular vectors are the components. Steps end when the residuals of the wanted ones
are below ``tolerance`` of the greatest singular value, or with ``dims`` steps, where they are exact. Where the
rows' space is exhausted (few or repeated rows, equal eigenvalues), a fresh vector, orthogonal to all before,
starts the next block of B.

Edge cases: rows with a null vector or a null or non-finite entry take no part; components without variance
(fewer different rows or dimensions than components) have no rows; an empty table, or one whose rows are all
equal, gives an empty result; ties and repeated rows count as often as they occur; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docvigil.llm.vectors import matrix, whole_rows

#: Rows that one numpy step of a task handles.
ROWS = 4096
#: A pivot or an eigenvalue below this share of the greatest counts as zero.
ZERO = 1e-12


@dataclass
class Whitening:
    """A fit: ``n`` rows, exact sums of each dimension, unit components (columns), their eigenvalues, and the
    trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float


def _centred(column: pa.Array, n: int, sums: list[int]) -> np.ndarray:
    """Rows less their means: whole parts are taken off as integers, so that only a fraction is rounded."""
    whole = np.array([s // n for s in sums], np.int64)
    part = np.array([(s % n) / n for s in sums])
    return (matrix(column, len(sums)) - whole).astype(np.float64) - part


def _totals(rows: DataFrame, parts: Callable[[np.ndarray], np.ndarray], n: int, sums: list[int], size: int) -> np.ndarray:
    """The sum over all rows of ``parts``, ``size`` numbers for a chunk of centred rows. A task sends its own sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                total += parts(_centred(batch.column("x").slice(at, ROWS), n, sums))
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(size), pa.int32()), "v": pa.array(total)})

    found = rows.select("x").mapInArrow(add, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size)
    for r in found:
        out[r["i"]] = r["v"]
    return out


def _fresh(rng: np.random.Generator, v: list[np.ndarray], dims: int) -> np.ndarray:
    """A unit vector orthogonal to those in ``v``."""
    x = rng.standard_normal(dims)
    for _ in range(3):
        for y in v:
            x = x - y * (y @ x)
        x /= np.linalg.norm(x)
    return x


def bidiagonalise(rows: DataFrame, n: int, sums: list[int], wanted: int, tolerance: float = 1e-13) -> tuple[np.ndarray, np.ndarray]:
    """(right singular vectors as columns, singular values) of the centred rows, ``wanted`` at most."""
    dims = len(sums)
    rng = np.random.default_rng(7)
    v, w, xtu = [_fresh(rng, [], dims)], [], []  # right vectors, left vectors as X w, and X'u of each
    upper = np.zeros((dims, dims + 1))  # B, with the coupling to the vector after the last
    while True:
        j = len(w)
        p = v[j] - (upper[j - 1, j] * w[j - 1] if j else 0)
        left = np.stack([p, *w], axis=1)

        def parts(x: np.ndarray, left: np.ndarray = left) -> np.ndarray:
            u = x @ left  # this step's left vector and all before it
            return np.concatenate([u[:, 0] @ u, u[:, 0] @ x])

        total = _totals(rows, parts, n, sums, left.shape[1] + dims)
        square, mixed, product = total[0], total[1 : j + 1], total[j + 1 :]
        for i in range(j):  # full reorthogonalisation of the left vectors
            p, product = p - mixed[i] * w[i], product - mixed[i] * xtu[i]
        pivot = np.sqrt(max(0.0, square - mixed @ mixed))
        scale = max(pivot, np.abs(upper).max())
        if pivot > ZERO * scale and scale > 0:
            upper[j, j] = pivot
            w.append(p / pivot)
            xtu.append(product / pivot)
        else:
            w.append(np.zeros(dims))
            xtu.append(np.zeros(dims))
        following = xtu[j] - upper[j, j] * v[j]
        for _ in range(2):  # full reorthogonalisation of the right vectors
            for y in v:
                following = following - y * (y @ following)
        coupling = float(np.linalg.norm(following))
        if coupling <= ZERO * scale:
            coupling = 0.0
        upper[j, j + 1] = coupling
        a, values, b = np.linalg.svd(upper[: j + 1, : j + 1])
        k = min(wanted, dims)
        residual = np.abs(coupling * a[j, :k])
        # a zero coupling alone proves nothing about directions that no vector has met yet
        done = j + 1 == dims or (coupling > 0 and j + 1 >= k and (residual <= tolerance * values[0]).all())
        if done:
            return np.stack(v, axis=1) @ b[:k].T, values[:k]
        v.append(following / coupling if coupling else _fresh(rng, v, dims))


def fit_whitening(rows: DataFrame, components: int = 8) -> Whitening | None:
    """The fit over all rows of ``rows(x)``, arrays of whole numbers; None without rows."""
    n, dims = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("x")), F.lit(0))).first()
    if not n or not dims:
        return None

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dims
        for batch in batches:
            x = matrix(batch.column("x"), dims)
            step = x.sum(axis=0, dtype=np.int64) if int(np.abs(x).max(initial=0)) * len(x) < 1 << 62 else [sum(c) for c in x.T.tolist()]
            total = [a + int(b) for a, b in zip(total, step, strict=True)]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dims), pa.int32()), "s": pa.array([str(t) for t in total])})

    exact = rows.select("x").mapInArrow(add, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = [int(s) for _, s in sorted((r["i"], r["s"]) for r in exact)]
    trace = float(_totals(rows, lambda x: np.array([(x**2).sum()]), n, sums, 1)[0]) / n
    if trace <= 0:
        return Whitening(n, sums, np.zeros((dims, 0)), np.zeros(0), trace)
    vectors, values = bidiagonalise(rows, n, sums, components)
    eigen = values**2 / n
    keep = eigen > ZERO * trace
    return Whitening(n, sums, vectors[:, keep], eigen[keep], trace)


def _scores(fit: Whitening) -> Callable[[np.ndarray], np.ndarray]:
    ways = fit.components / np.sqrt(fit.eigenvalues)
    return lambda x: x @ ways


def identity_error(rows: DataFrame, fit: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, by one more pass."""
    k, scores = len(fit.eigenvalues), _scores(fit)

    def parts(x: np.ndarray) -> np.ndarray:
        z = scores(x)
        return np.concatenate([z.sum(axis=0), (z.T @ z).ravel()])

    total = _totals(rows, parts, fit.n, fit.sums, k + k * k)
    mean = total[:k] / fit.n
    covariance = total[k:].reshape(k, k) / fit.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(k)).max(initial=0))


def whitened_rows(rows: DataFrame, fit: Whitening) -> DataFrame:
    """``rows(uid, vec_id, x)`` with ``deviation``, an exact decimal, and ``whitened``, a list of doubles."""
    dims, n, sums, scores = len(fit.sums), fit.n, fit.sums, _scores(fit)
    least, most = min(sums), max(sums)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = matrix(part.column("x"), dims)
                wide = max(n * int(x.max()) - least, most - n * int(x.min()))  # at least each |n x - S|
                if wide**2 * dims < 1 << 63 and n * int(np.abs(x).max()) < 1 << 63:
                    deviation = ((x * n - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x.tolist()]
                z = scores(_centred(part.column("x"), n, sums))
                yield pa.RecordBatch.from_pydict({"vec_id": part.column("vec_id"), "deviation": pa.array([str(d) for d in deviation]), "whitened": pa.array(list(z), pa.list_(pa.float64()))})

    found = rows.select("vec_id", "x").mapInArrow(add, "vec_id long, deviation string, whitened array<double>")
    return found.withColumn("deviation", F.col("deviation").cast("decimal(38,0)"))


def whiten(vectors: DataFrame, components: int = 8, scale: int = 1024, offset: int = 100_000) -> DataFrame:
    """One row for each row of ``vectors(vec_id, embedding)`` that takes part and each component: ``vec_id``,
    ``component`` from 1, ``n``, ``deviation``, ``whitened``, ``explained`` and ``identity_error``."""
    spark = vectors.sparkSession
    rows = whole_rows(vectors, scale, vec_id=F.col("vec_id").cast("long"))
    dims = rows.agg(F.max(F.size("x"))).first()[0] or 0
    filled = F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))
    rows = rows.withColumn("x", F.transform(filled, lambda c: c + offset))
    fit = fit_whitening(rows, components)
    names = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if fit is None or not len(fit.eigenvalues):
        return spark.createDataFrame([], names)
    error = identity_error(rows, fit)
    explained = F.array(*[F.lit(float(e / fit.trace)) for e in fit.eigenvalues])
    each = whitened_rows(rows, fit).select("vec_id", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).alias("component"), F.lit(fit.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"))
