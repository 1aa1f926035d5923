"""Whitening of embeddings by spectrum slicing.

The covariance of the distinct vectors is summed up in the tasks from exactly centred whole numbers. Its leading
eigenvalues are then isolated one by one: an LDLᵀ factorisation of the covariance less a shift has as many positive
pivots as there are eigenvalues above the shift, so counts cut the spectrum into intervals with one eigenvalue each.
Rayleigh quotient iteration converges inside an interval, and counts just below and above the found value certify its
number. The driver handles the covariance alone; vectors are projected where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stash
from ._vectors import LARGEST, largest, matrix, scaled, usable

#: Constant of the pivoting: a smaller diagonal pivot than this share of its column would let numbers grow.
ALPHA = (1 + 17**0.5) / 8
#: Rows of one batch of projections; steps of an iteration, at most.
ROWS, STEPS = 4_096, 12


class Whitener(NamedTuple):
    """What the fit gives: size and sums of the fit list, eigenvalues and eigenvectors (as rows), trace, identity error."""

    n: int
    sums: tuple[int, ...]
    values: tuple[float, ...]
    vectors: tuple[tuple[float, ...], ...]
    trace: float
    identity_error: float


def above(a, shift: float) -> int:
    """How many eigenvalues of a symmetric matrix exceed ``shift``: positive pivots of LDLᵀ with 1 x 1 and 2 x 2 pivots."""
    import numpy as np

    m = np.array(a, float)
    d = len(m)
    m[np.arange(d), np.arange(d)] -= shift
    k = count = 0

    def swap(i: int, j: int) -> None:
        if i != j:
            m[[i, j]] = m[[j, i]]
            m[:, [i, j]] = m[:, [j, i]]

    while k < d:
        column = np.abs(m[k + 1 :, k])
        r = k + 1 + int(column.argmax()) if len(column) else k
        off, own, size = (column.max() if len(column) else 0.0), abs(m[k, k]), 1
        if max(off, own) == 0:
            k += 1
            continue
        if own < ALPHA * off:
            row = np.abs(m[r, k:])
            row[r - k] = 0
            widest = row.max()
            if own * widest < ALPHA * off * off:
                if abs(m[r, r]) >= ALPHA * widest:
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        rest = m[k + size :, k : k + size].copy()
        if size == 1:
            count += m[k, k] > 0
            m[k + 1 :, k + 1 :] -= np.outer(rest[:, 0], rest[:, 0] / m[k, k])
        else:  # one positive and one negative eigenvalue
            count += 1
            m[k + 2 :, k + 2 :] -= rest @ np.linalg.solve(m[k : k + 2, k : k + 2], rest.T)
        k += size
    return int(count)


def leading(a, most: int) -> tuple[list[float], list]:
    """The ``most`` largest eigenvalues of a symmetric positive semidefinite matrix and their unit eigenvectors.

    Eigenvalues closer to each other than rounding are one cluster, of which any orthonormal vectors are given.
    """
    import numpy as np

    a = np.array(a, float)
    d, eps = len(a), np.finfo(float).eps
    scale = float(np.abs(a).sum(1).max(initial=0))
    if scale == 0:
        return [0.0] * min(most, d), list(np.eye(d)[:most])
    width = 4 * eps * scale  # below this an interval is a point
    counts = {-scale: d, scale * (1 + 1e-9): 0}
    values, vectors = [], []

    def ask(shift: float) -> int:
        if shift not in counts:
            counts[shift] = above(a, shift)
        return counts[shift]

    def apart(x):
        """``x`` as a unit vector orthogonal to the vectors found so far."""
        for _ in range(2):
            for v in vectors:
                x = x - v * (v @ x)
        return x / np.linalg.norm(x)

    def solved(shift: float, x):
        for nudge in (0.0, 1.0, 3.0):
            try:
                y = np.linalg.solve(a - (shift + nudge * eps * scale) * np.eye(d), x)
            except np.linalg.LinAlgError:
                continue
            if np.isfinite(y).all() and y.any():
                return y / np.abs(y).max()
        return x

    def refined(low: float, high: float):
        """Rayleigh quotient iteration from the middle of an interval: (value, vector), or None if it leaves the interval."""
        x = apart(np.cos(np.arange(1, d + 1) * 1.7 + len(vectors)))
        for _ in range(3):
            x = apart(solved((low + high) / 2, x))
        last = float("inf")
        for _ in range(STEPS):
            rho = float(x @ a @ x)
            residual = float(np.linalg.norm(a @ x - rho * x))
            if not low - width <= rho <= high + width:
                return None
            if residual >= last / 2:
                break
            best, last = (rho, x), residual
            x = apart(solved(rho, x))
        return best if last <= 64 * eps * scale * d**0.5 else None

    for number in range(1, min(most, d) + 1):
        low, high = max(s for s, c in counts.items() if c >= number), min(s for s, c in counts.items() if c < number)
        while True:
            alone = counts[low] == number and counts[high] == number - 1
            found = refined(low, high) if alone or high - low <= width else None
            if found:
                slack = max(2 * width, 64 * eps * scale)
                if ask(found[0] - slack) >= number > ask(found[0] + slack):
                    break
            if high - low <= width:
                raise ArithmeticError(f"eigenvalue {number} near {low:.17g} does not converge")
            middle = (low + high) / 2
            low, high = (middle, high) if ask(middle) >= number else (low, middle)
        values.append(max(found[0], 0.0))
        vectors.append(found[1])
    return values, vectors


def centred(x, n: int, sums):
    """(n*x - S, x - S/n) of whole-number vectors: exact, as Python's integers where 64 bits may not do, and as doubles."""
    import numpy as np

    most = max(int(np.abs(x).max(initial=0)), max((abs(s) for s in sums), default=0) // max(n, 1) + 1)
    if 2 * most * n >= 1 << 62:
        exact = x.astype(object) * n - np.array(sums, object)
        return exact, (exact / n).astype(float)
    exact = x * np.int64(n) - np.array(sums, np.int64)
    return exact, exact / n


def fit(rows: DataFrame, dims: int, components: int) -> Whitener:
    """Fit to the distinct vectors ``x``, all of ``dims`` whole numbers."""
    import numpy as np

    spark = rows.sparkSession
    distinct = stash(rows.select("x").distinct(), "whiten-fit")

    def summed(part) -> dict:
        """Sums of what ``part`` makes of each batch's vectors, an array of any size per task; cell -> sum."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                own = part(matrix(batch.column(0), dims))
                total = own if total is None else total + own
            if total is not None:
                yield pa.RecordBatch.from_pydict({"cell": np.arange(len(total)), "value": total.astype(float)})

        return {r["cell"]: r["value"] for r in distinct.mapInArrow(run, "cell long, value double").groupBy("cell").agg(F.sum("value").alias("value")).collect()}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * dims
        for batch in batches:
            x = matrix(batch.column(0), dims)
            n += len(x)
            own = x.sum(0) if len(x) * float(np.abs(x).max(initial=0)) < LARGEST else x.astype(object).sum(0)
            sums = [s + int(v) for s, v in zip(sums, own)]
        yield pa.RecordBatch.from_pydict({"cell": np.arange(-1, dims), "value": pa.array([Decimal(v) for v in [n, *sums]], pa.decimal128(38, 0))})

    exact = {r["cell"]: int(r["value"]) for r in distinct.mapInArrow(counted, "cell long, value decimal(38,0)").groupBy("cell").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect()}
    n, sums = exact.get(-1, 0), tuple(exact.get(i, 0) for i in range(dims))
    if not n or not dims:
        return Whitener(n, sums, (), (), 0.0, 0.0)
    i, j = np.triu_indices(dims)

    def products(x):
        y = centred(x, n, sums)[1]
        return (y.T @ y)[i, j]

    cells = summed(products)
    v = np.zeros((dims, dims))
    v[i, j] = v[j, i] = np.array([cells[c] for c in range(len(i))]) / n
    trace = float(np.trace(v))
    values, vectors = leading(v, components)
    whole = [e > dims * np.finfo(float).eps * trace for e in values]
    basis = np.array([u / e**0.5 for u, e, w in zip(vectors, values, whole) if w]).reshape(-1, dims).T
    k = basis.shape[1]
    error = 0.0
    if k:

        def measured(x):
            w = centred(x, n, sums)[1] @ basis
            return np.concatenate((w.sum(0), (w.T @ w).ravel()))

        cells = summed(measured)
        got = np.array([cells[c] for c in range(k + k * k)]) / n
        error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    return Whitener(n, sums, tuple(values), tuple(tuple(map(float, u)) for u in vectors), trace, error)


def whiten(vectors: DataFrame, *, components: int = 4, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error), ``components`` rows per vector.

    Entries are floor(``scale`` * c). Vectors that are null or hold null or non-finite entries are left out; shorter ones
    count as filled up with zeros; entries beyond 2^62 raise a ValueError. The fit list is each distinct vector once;
    ``deviation`` is the exact sum of (n*x - S)^2, a decimal of 38 digits. Repeated rows, null ids and equal ids give rows of
    their own. With fewer dimensions there are fewer components; one whose eigenvalue is zero within rounding (as all are
    with one distinct vector) has a null ``whitened`` and no part in ``identity_error``. Equal eigenvalues: any
    orthonormal vectors of theirs. An empty table gives no rows; other columns are not read.
    """
    import numpy as np

    id_type = vectors.schema[id_col].dataType.simpleString()
    v = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).alias("vec_id"), scaled(F.col(vector_col), scale).alias("x"), largest(F.col(vector_col), scale).alias("largest"))
    v = stash(v, "whiten-vectors")
    dims, most = v.agg(F.coalesce(F.max(F.size("x")), F.lit(0)), F.coalesce(F.max("largest"), F.lit(0.0))).first()
    if most >= LARGEST:
        raise ValueError(f"entries of up to {most:.6g} after scaling by {scale} do not fit")
    rows = v.select("vec_id", F.when(F.size("x") == dims, F.col("x")).otherwise(F.concat("x", F.array_repeat(F.lit(0).cast("long"), F.lit(dims) - F.size("x")))).alias("x"))
    model = fit(rows, dims, components)
    n, sums = model.n, model.sums
    whole = [e > dims * np.finfo(float).eps * model.trace for e in model.values]
    basis = np.array([np.array(u) / e**0.5 if w else np.full(dims, np.nan) for u, e, w in zip(model.vectors, model.values, whole)]).reshape(len(whole), dims).T
    explained, k = [e / model.trace if model.trace else 0.0 for e in model.values], len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for first in range(0, len(whole_batch) if k else 0, ROWS):
                batch = whole_batch.slice(first, ROWS)
                exact, y = centred(matrix(batch.column(1), dims), n, sums)
                if exact.dtype == object or float(np.abs(exact).max(initial=0)) ** 2 * dims >= LARGEST:
                    deviation = pa.array([Decimal(int(d)) for d in (exact.astype(object) ** 2).sum(1)], pa.decimal128(38, 0))
                else:
                    deviation = pa.array((exact**2).sum(1)).cast(pa.decimal128(38, 0))
                at = np.repeat(np.arange(len(batch)), k)
                w = (y @ basis).ravel()
                cols = [batch.column(0).take(pa.array(at)), pa.array(np.tile(np.arange(1, k + 1, dtype="i4"), len(batch))), pa.array(np.full(len(at), n)), deviation.take(pa.array(at)), pa.array(w, mask=np.isnan(w)), pa.array(np.tile(explained, len(batch))), pa.array(np.full(len(at), model.identity_error))]
                yield pa.RecordBatch.from_arrays(cols, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(run, f"vec_id {id_type}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double")


def op11_whitening(spark, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).withColumn("deviation", F.col("deviation").cast("long"))
