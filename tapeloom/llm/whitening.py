"""Whitening of embeddings: distributed centred scatter, cyclic Jacobi rotations, a broadcast whitening matrix."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm.common import table
from tapeloom.storage import remove, shared_dir

SCALE = 256
COMPONENTS = 4

#: Sweeps of rotations at most; some ten are enough for thousands of dimensions.
MOST_SWEEPS = 60


def finite(column: str = "embedding") -> Column:
    """The vector is there, is not empty, and all its entries are finite numbers."""
    entry_ok = F.forall(column, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < F.lit(float("inf"))))
    return F.col(column).isNotNull() & (F.size(column) > 0) & F.coalesce(entry_ok, F.lit(False))


def usual_length(rows: DataFrame, column: str) -> int:
    """The most frequent length of the vectors of ``rows``, the longest of several; 0 without rows."""
    lengths = rows.groupBy(F.size(column).alias("length")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    return first.length if first else 0


def scaled(embeddings: DataFrame, scale: int = SCALE) -> tuple[DataFrame, int]:
    """(vec_id, x) of the usable rows, x whole numbers, and the vectors' length."""
    rows = embeddings.select("vec_id", "embedding").where(finite())
    d = usual_length(rows, "embedding")
    x = F.transform("embedding", lambda e: F.floor(e.cast("double") * scale).cast("long"))
    return rows.where(F.size("embedding") == d).select("vec_id", x.alias("x")), d


def _matrix(column, d: int):
    """An Arrow column of lists of ``d`` numbers as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _totals(rows: DataFrame, cells: int, add, kind: str) -> list:
    """The sums over all rows of the ``cells`` numbers that ``add`` gives for a batch; one set of them leaves a task."""

    def scan(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for b in batches:
            if b.num_rows:
                part = add(b.column(0))
                total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(cells, dtype=np.int32)), pa.array(total)], names=["cell", "value"])

    sums = rows.mapInArrow(scan, f"cell int, value {kind}").groupBy("cell").agg(F.sum("value").alias("value"))
    found = dict(map(tuple, sums.collect()))  # as many as cells, whatever the input
    return [found.get(k, 0) for k in range(cells)]


def jacobi(matrix):
    """(eigenvalues, eigenvectors as columns) of a symmetric matrix, the largest first.

    Cyclic Jacobi: each sweep turns every pair of axes once, in the order of a
    round robin, so the pairs of a round are disjoint and turned together. A
    pair is done when its entry is below the rounding error of its own two
    diagonal entries, not of the largest one: this keeps small eigenvalues of
    a positive matrix accurate. Of a vector and its negative, that with the
    larger first extreme entry is taken.
    """
    import numpy as np

    a, d = np.array(matrix, float), len(matrix)
    vectors, eps = np.eye(d), np.finfo(float).eps
    floor = eps * eps * np.abs(np.diag(a)).max(initial=0)
    seats = np.arange(d + d % 2)
    for _ in range(MOST_SWEEPS):
        turned = 0
        for _ in range(len(seats) - 1):
            p, q = seats[: len(seats) // 2], seats[len(seats) // 2 :][::-1]
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
            real = (p < d) & (q < d)
            p, q = p[real], q[real]
            off = a[p, q]
            far = np.abs(off) > np.maximum(eps * np.sqrt(np.abs(a[p, p] * a[q, q])), floor)
            p, q, off = p[far], q[far], off[far]
            turned += len(p)
            if not len(p):
                continue
            half = (a[q, q] - a[p, p]) / (2 * off)
            t = np.where(half >= 0, 1.0, -1.0) / (np.abs(half) + np.hypot(half, 1.0))
            c = 1 / np.hypot(t, 1.0)
            s = t * c
            for m in (a, a.T, vectors.T):  # rows, columns, and the columns of the vectors
                m[p], m[q] = c[:, None] * m[p] - s[:, None] * m[q], s[:, None] * m[p] + c[:, None] * m[q]
            a[p, q] = a[q, p] = 0.0
        if not turned:
            break
    values = np.diag(a)
    order = np.argsort(-values, kind="stable")
    vectors = vectors[:, order]
    extreme = vectors[np.abs(vectors).argmax(axis=0), np.arange(d)]
    return values[order], vectors * np.where(extreme < 0, -1.0, 1.0)


@dataclass
class Whitening:
    """What the fit found: the mean is sums / n; components are columns by falling eigenvalue."""

    n: int
    sums: list[int]
    values: object
    vectors: object
    trace: float

    @property
    def matrix(self):
        """The components over the roots of their eigenvalues; NaN where the data has no extent but rounding errors."""
        import numpy as np

        real = self.values > len(self.values) * np.finfo(float).eps * self.values.max(initial=0)
        return self.vectors / np.sqrt(np.where(real, self.values, np.nan))

    @property
    def mean(self):
        import numpy as np

        return np.array([s / self.n for s in self.sums])  # whole numbers: rounded once


def _weighed(points: DataFrame, d: int, mean, matrix):
    """The mean and the mean product of (x - mean) times ``matrix``, over ``points``; centred before multiplying."""
    import numpy as np

    k = d if matrix is None else matrix.shape[1]
    shared = points.sparkSession.sparkContext.broadcast((mean, matrix))

    def add(column):
        at, by = shared.value
        y = _matrix(column, d).astype(float) - at
        y = y if by is None else y @ by
        return np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y)[np.triu_indices(k)]])

    n, *rest = _totals(points, 1 + k + k * (k + 1) // 2, add, "double")
    product = np.zeros((k, k))
    product[np.triu_indices(k)] = rest[k:]
    product = product + np.triu(product, 1).T
    middle = np.array(rest[:k]) / max(n, 1)
    return product / max(n, 1) - np.outer(middle, middle)  # the middle is a rounding error


def fit(points: DataFrame, d: int) -> Whitening | None:
    """Fit over the rows of ``points`` (x), each once; None without rows."""
    import numpy as np

    n, *sums = _totals(points, d + 1, lambda column: np.concatenate([[len(column)], _matrix(column, d).sum(axis=0, dtype=np.int64)]), "long")
    if not n:
        return None
    mean = np.array([s / n for s in sums])
    covariance = _weighed(points, d, mean, None)
    values, vectors = jacobi(covariance)
    return Whitening(n, sums, values, vectors, float(np.trace(covariance)))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """Each usable row's whitened value along the first ``components`` components; see ``WHITENED`` for the columns.

    Needs columns vec_id and embedding; others are ignored. Rows whose vector
    is null, empty, holds a null, NaN or infinity, or has another length than
    the most frequent one are left out. A null vec_id and repeated rows are
    results of their own; the fit takes each distinct vector once. Equal
    eigenvalues are told apart by rounding alone. Where the vectors have no
    extent along a component (one distinct vector, or flat data), whitened is
    null there, and explained is null where they have none at all. A deviation
    beyond 64 bits is null. An empty table gives no rows.

    Only sums leave a task: as many numbers as the covariance has.
    """
    import numpy as np

    spark = embeddings.sparkSession
    rows, d = scaled(embeddings, scale)
    if not d:
        return spark.createDataFrame([], WHITENED)
    folder = f"{shared_dir(spark)}/whitening-{uuid.uuid4().hex}"
    rows.select("x").distinct().write.parquet(folder)
    points = spark.read.parquet(folder)
    found = fit(points, d)
    k = min(components, d)
    matrix = found.matrix[:, :k]
    real = ~np.isnan(matrix[0])
    error = None
    if real.any():
        error = float(np.abs(_weighed(points, d, found.mean, matrix[:, real]) - np.eye(int(real.sum()))).max())
    remove(spark, folder)  # nothing reads it any more
    explained = [float(v / found.trace) if found.trace > 0 else None for v in found.values[:k]]
    shared = spark.sparkContext.broadcast((found.n, np.array(found.sums), found.mean, matrix))

    def project(batches):
        import pyarrow as pa

        n, sums, mean, by = shared.value
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            x = _matrix(b.column(1), d)
            whitened = ((x - mean) @ by).ravel()
            rough = x.astype(float) * n - sums
            deviation = np.square(x * n - sums).sum(axis=1)  # wraps where it is masked
            deviation = pa.array(deviation, mask=np.square(rough).sum(axis=1) >= 9.2e18)
            each = pa.array(np.repeat(np.arange(m), k))
            yield pa.record_batch(
                [
                    b.column(0).take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviation.take(each),
                    pa.array(whitened, mask=np.isnan(whitened)), pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64()),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), "x").mapInArrow(project, WHITENED)


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
