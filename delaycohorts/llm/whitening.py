"""Whitening of embeddings with eigenvectors found by spectrum slicing.

The covariance of the (scaled, whole-numbered) vectors is summed by Spark in two passes, sums first,
then products of centred entries. Only this matrix, whose size depends on the dimension and not on the rows,
is taken apart in one place: the inertia of V - s I, read off a pivoted LDL^T factorisation, tells how
many eigenvalues lie above s (Sylvester). Bisection with these counts isolates each leading eigenvalue,
Rayleigh quotient iteration converges to it, and two more counts beside the result certify its number.
Rows are projected in one narrow map.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

COMPONENTS = 32
SCALE, OFFSET = 64.0, 1_000_000
LARGEST = float(1 << 40)  # scaled entries beyond it count as it
ROWS = 4096
_PIVOT = (1 + 17**0.5) / 8  # growth bound of the pivot choice


def inertia(matrix: np.ndarray) -> tuple[int, int, int]:
    """Numbers of positive, negative and zero eigenvalues, from pivots of 1 x 1 and 2 x 2 of P M P^T = L D L^T."""
    a = np.array(matrix, np.float64)
    tiny = len(a) * np.finfo(float).eps * (np.abs(a).max() if a.size else 0.0)
    plus = minus = zero = 0
    while len(a):
        column = np.abs(a[1:, 0])
        r = 1 + int(column.argmax()) if len(column) else 0
        low = float(column[r - 1]) if r else 0.0
        size = 1
        if max(abs(a[0, 0]), low) <= tiny:
            zero, a = zero + 1, a[1:, 1:]
            continue
        if r and abs(a[0, 0]) < _PIVOT * low:
            beside = np.abs(a[:, r])
            beside[r] = 0.0
            high = float(beside.max())
            if abs(a[0, 0]) * high < _PIVOT * low * low:
                if abs(a[r, r]) >= _PIVOT * high:
                    a[[0, r]] = a[[r, 0]]
                    a[:, [0, r]] = a[:, [r, 0]]
                else:
                    a[[1, r]] = a[[r, 1]]
                    a[:, [1, r]] = a[:, [r, 1]]
                    size = 2
        if size == 1:
            plus, minus = plus + (a[0, 0] > 0), minus + (a[0, 0] < 0)
            a = a[1:, 1:] - np.outer(a[1:, 0], a[1:, 0] / a[0, 0])
        else:  # such a pivot has a negative determinant
            plus, minus = plus + 1, minus + 1
            a = a[2:, 2:] - a[2:, :2] @ np.linalg.solve(a[:2, :2], a[:2, 2:])
    return plus, minus, zero


def above(v: np.ndarray, shift: float) -> int:
    """How many eigenvalues of ``v`` are larger than ``shift``."""
    return inertia(v - shift * np.eye(len(v)))[0]


def _quotient(v: np.ndarray, start: np.ndarray, found: list[np.ndarray], shift: float) -> tuple[float, np.ndarray, float]:
    """Rayleigh quotient iteration from ``shift`` at right angles to ``found``: value, unit vector, residual."""
    basis = np.array(found).reshape(len(found), len(v))
    clean = lambda x: x - basis.T @ (basis @ x)
    x = clean(clean(start))
    x /= np.linalg.norm(x)
    best, scale = (shift, x, np.inf), max(1e-300, float(np.abs(v).max()))
    for turn in range(30):
        try:
            y = np.linalg.solve(v - shift * np.eye(len(v)), x)
        except np.linalg.LinAlgError:  # the shift is an eigenvalue to the last bit
            shift += scale * np.finfo(float).eps * (1 + turn)
            continue
        y = clean(clean(y / np.linalg.norm(y)))
        x = y / np.linalg.norm(y)
        theta = float(x @ v @ x)
        residual = float(np.linalg.norm(v @ x - theta * x))
        if residual < best[2]:
            best = theta, x, residual
        elif turn > 3:
            break
        if turn:  # the first step keeps the middle of the interval as its shift
            shift = theta
        if residual <= 4 * np.finfo(float).eps * scale:
            break
    return best


def leading(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues that are not zero to working precision, falling, and their unit vectors as rows.

    Equal eigenvalues cannot be isolated; bisection stops at the precision of the matrix and the vectors
    of such a cluster are found at right angles to each other. Raises if the counts beside a value do not
    confirm its number.
    """
    d = len(v)
    bound = float(np.abs(v).sum(axis=1).max()) if d else 0.0  # no eigenvalue is larger
    zero = d * np.finfo(float).eps * bound
    precision = max(4 * zero, 1e-300)
    counts = {bound * (1 + 1e-12) + precision: 0, zero: above(v, zero) if bound else 0}
    values: list[float] = []
    vectors: list[np.ndarray] = []
    random = np.random.default_rng(13)
    for k in range(1, min(most, counts[zero]) + 1):

        def bracket() -> tuple[float, float]:
            return max(s for s, c in counts.items() if c >= k), min(s for s, c in counts.items() if c < k)

        def halve() -> None:
            low, high = bracket()
            counts[(low + high) / 2] = above(v, (low + high) / 2)

        while True:  # one eigenvalue in the interval, or as narrow as the precision allows
            low, high = bracket()
            if high - low <= precision or (counts[low] == k and counts[high] == k - 1):
                break
            halve()
        while True:
            low, high = bracket()
            theta, x, residual = _quotient(v, random.standard_normal(d), vectors, (low + high) / 2)
            slack = max(residual, precision)
            if low - slack <= theta <= high + slack and residual <= 1e3 * precision:
                break
            if high - low <= precision:
                raise ArithmeticError(f"eigenvalue {k} did not converge")
            halve()
        if not above(v, theta + 2 * slack) < k <= above(v, theta - 2 * slack):
            raise ArithmeticError(f"{theta} is not eigenvalue {k}")
        values.append(theta)
        vectors.append(x)
    order = np.argsort(-np.array(values), kind="stable")  # only members of a cluster can change places
    return np.array(values)[order], np.array(vectors).reshape(len(values), d)[order]


def _matrix(part: pa.RecordBatch, column: str, dimension: int) -> np.ndarray:
    """Whole-numbered entries of a batch; what a short vector lacks counts as 0."""
    lists = part.column(column)
    if isinstance(lists, pa.LargeListArray | pa.ListArray):
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    else:
        raise TypeError(lists.type)
    if (sizes == dimension).all():
        entries = flat.reshape(len(lists), dimension)
    else:
        entries = np.zeros((len(lists), dimension))
        entries[np.repeat(np.arange(len(lists)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    with np.errstate(over="ignore"):
        return np.floor(np.clip(SCALE * entries, -LARGEST, LARGEST)).astype(np.int64) + OFFSET


def valid(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector is there and has finite entries only."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return rows.where(F.col(vector).isNotNull() & ~F.exists(vector, bad))


def _sums(rows: DataFrame, vector: str, dimension: int) -> tuple[int, list[int]]:
    """Number of vectors and exact sum per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.slice(at, ROWS), vector, dimension)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimension + 1)), pa.array(np.append(x.sum(axis=0), len(x)))], ["i", "total"])

    total = rows.select(vector).mapInArrow(run, "i long, total long").groupBy("i").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    found = {r["i"]: int(r["total"]) for r in total.collect()}  # one row per dimension
    return found.get(dimension, 0), [found.get(i, 0) for i in range(dimension)]


def _products(rows: DataFrame, vector: str, dimension: int, width: int, of) -> np.ndarray:
    """Sum over the rows of y y^T, y of ``width`` entries being ``of`` a block of vectors.

    Every task adds up its own rows and hands on one triangle; the triangles meet by cell.
    """
    upper = np.triu_indices(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                y = of(_matrix(batch.slice(at, ROWS), vector, dimension))
                total += y.T @ y
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(upper[0] * width + upper[1]), pa.array(total[upper])], ["cell", "total"])

    found = rows.select(vector).mapInArrow(run, "cell long, total double").groupBy("cell").agg(F.sum("total").alias("total")).toArrow()
    out = np.zeros(width * width)
    out[found.column("cell").to_numpy()] = found.column("total").to_numpy()
    out = out.reshape(width, width)
    return out + np.triu(out, 1).T


def whiten(rows: DataFrame, vector: str = "embedding", most: int = COMPONENTS) -> tuple[DataFrame, dict]:
    """(vec_id, deviation, whitened array per row; the model: n, sums, values, vectors, trace, identity_error).

    Rows whose vector is null or has a null or non-finite entry are left out. The dimension is the
    largest length of the others; what a shorter vector lacks counts as 0, and an empty one is such a vector. Entries
    beyond 2^40 / 64 count as that. Repeated rows and null ids keep their own results. Directions
    without spread (eigenvalue 0 to working precision) have no component: of one vector, or of equal ones, none. A
    deviation that does not fit 63 bits is null. Other columns are not read.
    """
    fit = valid(rows.select("vec_id", vector), vector)
    dimension = fit.agg(F.max(F.size(vector))).first()[0] or 0
    n, sums = _sums(fit, vector, dimension)
    middle = np.array([round(s / n) for s in sums] if n else [0] * dimension, np.int64)
    rest = np.array([(s - n * int(m)) / n for s, m in zip(sums, middle)] if n else [0.0] * dimension)  # of the mean beside middle, exact to the last bit
    centred = lambda x: (x - middle) - rest
    v = _products(fit, vector, dimension, dimension, centred) / max(n, 1)
    values, vectors = leading(v, most)
    project = (vectors / np.sqrt(values)[:, None]).T if len(values) else np.zeros((dimension, 0))
    check = _products(fit, vector, dimension, len(values), lambda x: centred(x) @ project) / max(n, 1)
    error = float(np.abs(check - np.eye(len(values))).max()) if len(values) else 0.0
    remains = [s - n * int(m) for s, m in zip(sums, middle)]  # n x - S = n (x - middle) - remains

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = _matrix(part, vector, dimension)
                apart = x - middle
                widest = n * (int(np.abs(apart).max(initial=0)) + 1)
                if widest * widest * max(dimension, 1) < 1 << 63:
                    deviation = ((n * apart - np.array(remains, np.int64)) ** 2).sum(axis=1).tolist()
                else:
                    big = ((n * apart.astype(object) - np.array(remains, object)) ** 2).sum(axis=1)
                    deviation = [int(b) if b < 1 << 63 else None for b in big]
                white = centred(x) @ project
                flat = pa.FixedSizeListArray.from_arrays(pa.array(white.ravel()), white.shape[1]).cast(pa.list_(pa.float64())) if white.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id").cast(pa.int64()), pa.array(deviation, pa.int64()), flat], ["vec_id", "deviation", "whitened"])

    out = fit.mapInArrow(run, "vec_id long, deviation long, whitened array<double>")
    model = {"n": n, "sums": sums, "values": values, "vectors": vectors, "trace": float(np.trace(v)), "identity_error": error}
    return out, model


def digest_rows(rows: DataFrame) -> DataFrame:
    out, model = whiten(rows)
    shares = F.array(*[F.lit(float(e / model["trace"])) for e in model["values"]]).cast("array<double>")
    each = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model["n"]).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(model["identity_error"]).alias("identity_error"),
    )
