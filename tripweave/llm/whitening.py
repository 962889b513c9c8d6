"""Embedding whitening: the leading principal components of all vectors, at unit variance.

Sums and the centred covariance are added up over partitions, a row of the matrix at a time.  Its size depends on the length
of the vectors only, so the matrix itself is small: it is made tridiagonal by Householder reflections, its leading eigenvalues
are bisected by Sturm counts, and their vectors found by inverse iteration, close ones made orthogonal.  The
components go to the tasks that project the vectors.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripweave.llm.common import arrow_schema, map_arrow
from tripweave.session import cut_lineage

COMPONENTS, SCALE = 4, 256
#: Grid values up to this are used; sums of squares of larger ones fit nothing.
_MOST = 1 << 62
_ROWS = 2000
_EPS = np.finfo(float).eps


# --- eigenvectors of one small matrix -----------------------------------------------------------------


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Diagonal and off-diagonal of H a H for reflections H, and these: (first place, unit vector)."""
    a = a.astype(np.float64).copy()
    n = len(a)
    mirrors = []
    for k in range(n - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if np.linalg.norm(x[1:]) <= _EPS * size or size == 0:
            continue  # the column is done already
        x[0] += np.copysign(size, x[0])
        u = x / np.linalg.norm(x)
        rest = a[k + 1 :, k + 1 :]
        p = 2 * rest @ u
        p -= u * (u @ p)
        rest -= np.outer(u, p) + np.outer(p, u)
        a[k + 1 :, k] -= 2 * u * (u @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        mirrors.append((k + 1, u))
    return np.diag(a).copy(), np.diag(a, -1).copy(), mirrors


def below(d: np.ndarray, e: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sturm counts: for each of ``x`` the number of eigenvalues of the tridiagonal matrix below it."""
    least = np.finfo(float).tiny / _EPS
    square = np.r_[0.0, e * e]
    q = np.ones_like(x)
    count = np.zeros(len(x), int)
    for di, s in zip(d, square):
        q = di - x - s / q
        q = np.where(np.abs(q) < least, -least, q)
        count += q < 0
    return count


def leading_values(d: np.ndarray, e: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` largest eigenvalues, falling, bisected until no number lies between the bounds."""
    n = len(d)
    radius = np.r_[0.0, np.abs(e)] + np.r_[np.abs(e), 0.0]
    low, high = np.full(m, (d - radius).min()), np.full(m, (d + radius).max())
    span = np.maximum(np.abs(low), np.abs(high)) * 4 * _EPS + np.finfo(float).tiny
    low, high = low - span, high + span
    wanted = n - 1 - np.arange(m)  # eigenvalue number m from above has so many below it
    while True:
        x = (low + high) / 2
        if ((x <= low) | (x >= high)).all():
            return x
        over = below(d, e, x) > wanted
        low, high = np.where(over, low, x), np.where(over, x, high)


def _solve(d: np.ndarray, e: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """x of a tridiagonal system, rows exchanged where that is safer; a zero pivot counts as ``least``."""
    n = len(d)
    diag, up, up2, low, x = d.copy(), np.r_[e, 0.0], np.zeros(n), e.copy(), b.copy()
    for i in range(n - 1):
        if abs(diag[i]) >= abs(low[i]):
            f = low[i] / (diag[i] if diag[i] != 0 else least)
            diag[i + 1] -= f * up[i]
            x[i + 1] -= f * x[i]
        else:
            f = diag[i] / low[i]
            diag[i], up[i], diag[i + 1], up2[i] = low[i], diag[i + 1], up[i] - f * diag[i + 1], up[i + 1]
            up[i + 1] *= -f
            x[i], x[i + 1] = x[i + 1], x[i] - f * x[i + 1]
    for i in range(n - 1, -1, -1):
        rest = x[i] - (up[i] * x[i + 1] if i + 1 < n else 0) - (up2[i] * x[i + 2] if i + 2 < n else 0)
        x[i] = rest / (diag[i] if abs(diag[i]) > least else np.copysign(least, diag[i]))
        if abs(x[i]) > 1e200:  # only the direction counts
            x /= abs(x[i])
    return x


def leading_vectors(d: np.ndarray, e: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors (rows) by inverse iteration; those of close values are kept orthogonal to each other."""
    n = len(d)
    norm = max(np.abs(d).max(), np.abs(e).max(initial=0.0), np.finfo(float).tiny)
    out: list[np.ndarray] = []
    r = np.random.default_rng(3)
    for k, value in enumerate(values):
        close = [v for v, other in zip(out, values) if abs(other - value) <= 1e-3 * norm]
        moved = value - k * 2 * _EPS * norm if close else value  # equal values must not give one solution twice
        x = r.uniform(0.5, 1.0, n) * r.choice([-1.0, 1.0], n)
        for _ in range(6):
            x = _solve(d - moved, e, x / np.linalg.norm(x), _EPS * norm)
            for _ in range(2):
                for v in close:
                    x = x - v * (v @ x)
        out.append(x / np.linalg.norm(x))
    return np.array(out).reshape(len(values), n)


def leading(a: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``m`` largest eigenvalues of a symmetric matrix, falling, and their unit vectors as rows.

    The first entry of a vector that is largest in absolute value is positive.
    """
    m = min(m, len(a))
    d, e, mirrors = tridiagonal(a)
    values = leading_values(d, e, m)
    vectors = leading_vectors(d, e, values)
    for first, u in reversed(mirrors):
        vectors[:, first:] -= 2 * np.outer(vectors[:, first:] @ u, u)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    most = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(m), most])[:, None]


# --- sums over all vectors ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    """Fit of the vectors of one length: count, sums per dimension, mean, variances and components (rows)."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x less the mean, whose whole part is taken off in whole numbers."""
        whole = np.array([s // self.n for s in self.sums], np.int64)
        return (x - whole).astype(np.float64) - np.array([s % self.n for s in self.sums]) / self.n

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list:
        """Sum over the dimensions of (n x - sum)^2, exact; null where it is more than a long holds."""
        reach = max(int(x.max()), -int(x.min())) * self.n + max(map(abs, self.sums)) if x.size else 0
        kind = np.int64 if reach * reach * x.shape[1] < 1 << 63 and reach < 1 << 63 else object
        far = x.astype(kind) * kind(self.n) - np.array(self.sums, kind) if kind is np.int64 else x.astype(object) * self.n - np.array(self.sums, object)
        total = (far * far).sum(axis=1)
        return [int(t) if t < 1 << 63 else None for t in total]


def on_grid(vectors: DataFrame, column: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vectors`` with ``x``, floor(``scale`` * entry) as longs, in place of ``column``.

    Rows whose vector is null, or holds an entry that is null, not finite or beyond a long, are left out.
    """
    c: Column = F.col(column).cast("array<double>")
    fine = ~F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) * scale >= F.lit(float(_MOST))))
    kept = [k for k in vectors.columns if k not in (column, "x")]
    return vectors.where(F.col(column).isNotNull()).where(fine).select(*kept, F.transform(c, lambda v: F.floor(v * scale).cast("long")).alias("x"))


def _blocks(batches, column: str = "x"):
    """Batches of rows as (batch, int64 matrix) for each length of vector but 0."""
    for batch in batches:
        long = np.asarray(pc.list_value_length(batch.column(column)))
        for d in np.unique(long[long > 0]):
            own = np.flatnonzero(long == d)
            for at in range(0, len(own), _ROWS):
                part = batch.take(pa.array(own[at : at + _ROWS]))
                yield part, np.asarray(part.column(column).flatten(), dtype=np.int64).reshape(-1, d)


def _sums(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """For each length of vector the number of vectors and their sums, exact."""
    ddl = "d int, i int, n long, s decimal(38,0)"
    schema = arrow_schema(ddl)

    def run(batches):
        n, total = {}, {}
        for _, x in _blocks(batches):
            d = x.shape[1]
            safe = max(int(x.max()), -int(x.min())) * len(x) < 1 << 62
            s = x.sum(axis=0).astype(object) if safe else x.astype(object).sum(axis=0)
            n[d], total[d] = n.get(d, 0) + len(x), total.get(d, 0) + s
        for d, s in total.items():
            yield pa.RecordBatch.from_pydict({"d": [d] * d, "i": list(range(d)), "n": [n[d]] * d, "s": [Decimal(int(v)) for v in s]}, schema=schema)

    out: dict[int, tuple[int, list[int]]] = {}
    summed = map_arrow(fit, run, ddl).groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("s").cast("string").alias("s"))
    for row in summed.orderBy("d", "i").collect():  # a row for each dimension
        out.setdefault(row["d"], (row["n"], []))[1].append(int(row["s"]))
    return out


def _products(fit: DataFrame, of, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """For each length d of vector the sum of y' y over its rows y = ``of(d, x)``, with ``sizes[d]`` columns.

    Each task adds up its own rows; the partial matrices are then added row by row, so that a task holds rows of one matrix.
    """
    ddl = "d int, i int, row binary"
    schema = arrow_schema(ddl)

    def out(total):
        for (d, i), row in total.items():
            yield pa.RecordBatch.from_pydict({"d": [d], "i": [i], "row": [row.tobytes()]}, schema=schema)

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for _, x in _blocks(batches):
            y = of(x.shape[1], x)
            total[x.shape[1]] = total.get(x.shape[1], 0) + y.T @ y
        yield from out({(d, i): row for d, m in total.items() for i, row in enumerate(m)})

    def add(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, i, row in zip(*(batch.column(k).to_pylist() for k in ("d", "i", "row"))):
                total[d, i] = total.get((d, i), 0) + np.frombuffer(row)
        yield from out(total)

    matrices = {d: np.zeros((k, k)) for d, k in sizes.items()}
    for row in map_arrow(map_arrow(fit, run, ddl).repartition("d", "i"), add, ddl).collect():  # the size of a matrix
        matrices[row["d"]][row["i"]] = np.frombuffer(row["row"])
    return matrices


def fit(grid: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """Model of the different vectors ``x``, each taken once, for each length of vector; vectors of length 0 have none.

    Lengths are few: one, as a rule.  Components without variance are left out.
    """
    distinct = cut_lineage(grid.select("x").distinct())
    models = {d: Model(n, s, np.zeros(0), np.zeros((0, d)), 0.0, 0.0) for d, (n, s) in _sums(distinct).items()}
    products = _products(distinct, lambda d, x: models[d].centred(x), {d: d for d in models})
    for d, m in list(models.items()):
        cov = products[d] / m.n
        trace = float(np.trace(cov))
        values, vectors = leading((cov + cov.T) / 2, components)
        some = values > trace * d * _EPS
        models[d] = Model(m.n, m.sums, values[some], vectors[some], trace, 0.0)
    return _checked(distinct, models)


def _checked(distinct: DataFrame, models: dict[int, Model]) -> dict[int, Model]:
    """``models`` with the largest entry of the whitened vectors' covariance less the identity, measured on all vectors."""
    # a column of ones gives the sums of the others
    ones = lambda d, x: np.c_[np.ones(len(x)), models[d].whiten(x)]
    products = _products(distinct, ones, {d: len(m.values) + 1 for d, m in models.items()})
    out = {}
    for d, m in models.items():
        mean = products[d][0, 1:] / m.n
        off = products[d][1:, 1:] / m.n - np.outer(mean, mean) - np.eye(len(m.values))
        out[d] = Model(m.n, m.sums, m.values, m.vectors, m.trace, float(np.abs(off).max(initial=0.0)))
    return out


def whiten(grid: DataFrame, models: dict[int, Model], key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error): a row for each row of ``grid`` and component.

    Components are numbered from 1 by falling variance.  Rows that are repeated stay so; a row without a component, such
    as any row where all vectors are equal, gives no row.  ``deviation`` is null where a long does not hold it.
    """
    kind = grid.schema[key].dataType.simpleString()
    ddl = f"{key} {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    schema = arrow_schema(ddl)

    def run(batches):
        for part, x in _blocks(batches):
            m = models[x.shape[1]]
            k, rows = len(m.values), len(x)
            if not k:
                continue
            each = np.repeat(np.arange(rows), k)
            far = m.deviation(x)
            yield pa.RecordBatch.from_pydict({
                key: part.column(key).take(pa.array(each)), "component": np.tile(np.arange(1, k + 1, dtype=np.int32), rows),
                "n": np.full(rows * k, m.n), "deviation": [far[i] for i in each], "whitened": m.whiten(x).ravel(),
                "explained": np.tile(m.values / m.trace, rows), "identity_error": np.full(rows * k, m.error),
            }, schema=schema)

    return map_arrow(grid.select(key, "x"), run, ddl)
