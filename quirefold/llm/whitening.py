"""Whitening of embeddings by hierarchical merging of singular value decompositions.

A task centres the vectors that it reads and keeps all singular values and vectors of them beside their number and their
exact sums, which give the mean. Two such summaries become one by the decomposition of both scaled bases and one row
more, sqrt(a b / (a + b)) times the difference of the means: the rows have the same scatter as all vectors, so nothing is
lost and no covariance is formed, whose condition would be squared. Summaries merge in a tree of FAN children; a summary takes
d (d + 1) numbers, however many vectors it stands for.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.common import lean, store

#: Steps of an entry's whole number a unit.
STEPS = 256
COMPONENTS = 4
#: Summaries that one task merges; vectors that are decomposed at once.
FAN, ROWS = 8, 2048
SUMMARY = "node long, n long, sums array<decimal(38,0)>, singular array<double>, vectors array<double>"
#: Largest whole number whose products and sums below are held in 64 bits.
SAFE = 1 << 62


class Summary:
    """Vectors as their number, exact sums, and scaled right singular vectors of the centred rows (rank x d)."""

    def __init__(self, n: int, sums: np.ndarray, singular: np.ndarray, vectors: np.ndarray) -> None:
        self.n, self.sums, self.singular, self.vectors = n, sums, singular, vectors

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        sums = exact_sums(x)
        _, singular, vectors = np.linalg.svd(centred(x, len(x), sums), full_matrices=False)
        return cls(len(x), sums, singular, vectors)

    def with_(self, other: Summary) -> Summary:
        n = self.n + other.n
        apart = self.sums * other.n - other.sums * self.n  # whole numbers without bound
        correction = (apart / (self.n * other.n)).astype(float) * np.sqrt(self.n * other.n / n)
        rows = np.vstack([self.singular[:, None] * self.vectors, other.singular[:, None] * other.vectors, correction])
        _, singular, vectors = np.linalg.svd(rows, full_matrices=False)
        return Summary(n, self.sums + other.sums, singular, vectors)

    def batch(self, node: int) -> pa.RecordBatch:
        columns = [[node], [self.n], [[Decimal(int(s)) for s in self.sums]], [self.singular.tolist()], [self.vectors.ravel().tolist()]]
        types = [pa.int64(), pa.int64(), pa.list_(pa.decimal128(38, 0)), pa.list_(pa.float64()), pa.list_(pa.float64())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["node", "n", "sums", "singular", "vectors"])

    @classmethod
    def from_row(cls, row: dict) -> Summary:
        d = len(row["sums"])
        return cls(row["n"], np.array([int(s) for s in row["sums"]], object), np.array(row["singular"]), np.array(row["vectors"], float).reshape(-1, d))


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def exact_sums(x: np.ndarray) -> np.ndarray:
    """Sums of each column as Python integers."""
    if _most(x) * max(1, len(x)) < SAFE:
        return np.array([int(s) for s in x.sum(axis=0)], object)
    return x.astype(object).sum(axis=0)


def n_fold(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - sums, exactly: 64-bit numbers where they fit, else Python's."""
    if _most(x) * n < SAFE // 2 and max((abs(s) for s in sums), default=0) < SAFE // 2:
        return x * n - sums.astype(np.int64)
    return x.astype(object) * n - sums


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return n_fold(x, n, sums).astype(float) / n


def squares(far: np.ndarray) -> list[int | None]:
    """Sum of squares of each row, exactly; None where it isn't a long."""
    if _most(far) ** 2 * max(1, far.shape[1]) < SAFE:
        return (far.astype(np.int64) ** 2).sum(axis=1).tolist()
    return [v if v < 1 << 63 else None for v in (far.astype(object) ** 2).sum(axis=1)]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, d)


def whole(vector: Column) -> Column:
    """Entries as whole numbers, floor(256 c); Spark's floor ends at the ends of a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(STEPS))).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector and all its entries are there and finite."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    return vector.isNotNull() & F.coalesce(F.forall(vector, finite), F.lit(False))


def quantised(vectors: DataFrame, column: str, name: str = "_wh_x") -> tuple[DataFrame, int]:
    """The rows with usable vectors, with them as whole numbers, and the dimensions of the longest; shorter ones get zeros."""
    rows = vectors.filter(usable(F.col(column))).withColumn(name, whole(F.col(column)))
    least, most = rows.agg(F.min(F.size(name)), F.max(F.size(name))).first()
    if least != most:
        rows = rows.withColumn(name, F.concat(name, F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size(name))))
    return rows, most or 0


def summarised(d: int, rows: int = ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Summary | None = None
        for batch in batches:
            for i in range(0, batch.num_rows, rows):
                part = Summary.of(matrix(batch.column(0).slice(i, rows), d))
                now = part if now is None else now.with_(part)
        if now is not None:
            yield now.batch(TaskContext.get().partitionId())

    return run


def merged(table: pa.Table) -> pa.Table:
    """The summary of a group of summaries, in the order of their nodes."""
    rows = sorted(table.to_pylist(), key=lambda r: (r["child"], r["n"]))
    out = Summary.from_row(rows[0])
    for row in rows[1:]:
        out = out.with_(Summary.from_row(row))
    return pa.Table.from_batches([out.batch(rows[0]["node"])])


class Model:
    """What whitening needs: n, exact sums, and the first components with their variances."""

    def __init__(self, n: int, sums: np.ndarray, variances: np.ndarray, vectors: np.ndarray, components: int) -> None:
        self.n, self.sums, self.total = n, sums, float(variances.sum())
        self.components = min(components, len(sums))
        k = min(self.components, len(variances))
        self.variances = np.zeros(self.components)
        self.variances[:k] = variances[:k]
        # A component without variance has no direction of its own: its projections are no numbers.
        noise = (variances[0] if len(variances) else 0) * (len(sums) * np.finfo(float).eps) ** 2
        self.used = int((self.variances > noise).sum())
        self.axes = vectors[: self.used] / np.sqrt(self.variances[: self.used, None])

    def explained(self) -> list[float | None]:
        return [float(v / self.total) if self.total > 0 else None for v in self.variances]

    def project(self, far: np.ndarray) -> np.ndarray:
        """Whitened rows of n x - sums, on the components that have variance."""
        return (far.astype(float) / self.n) @ self.axes.T


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Model | None:
    """The model of a stored table of distinct vectors (one column of d whole numbers); None of an empty one."""
    parts = distinct.rdd.getNumPartitions()
    nodes = store(distinct.mapInArrow(lean(summarised(d)), SUMMARY), "whiten-nodes")
    while parts > 1:
        up = nodes.withColumn("child", F.col("node")).withColumn("node", F.floor(F.col("node") / FAN))
        nodes = up.groupBy("node").applyInArrow(merged, SUMMARY)
        parts = -(-parts // FAN)
    root = nodes.first()  # one summary: d (d + 1) numbers
    if root is None:
        return None
    s = Summary.from_row(root.asDict())
    return Model(s.n, s.sums, s.singular**2 / s.n, s.vectors, components)


def error(distinct: DataFrame, d: int, model: Model) -> float | None:
    """Largest entry, without sign, of the covariance of the whitened vectors minus the identity."""
    names = [f"w{i}" for i in range(model.used)]
    if not names:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = model.project(n_fold(matrix(batch.column(0), d), model.n, model.sums))
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in w.T], names)

    rows = distinct.mapInArrow(lean(run), ", ".join(f"{c} double" for c in names))
    entries = [F.abs(F.covar_pop(a, b) - float(a == b)) for i, a in enumerate(names) for b in names[i:]]
    return max(rows.agg(*[e.alias(f"e{i}") for i, e in enumerate(entries)]).first())


def whiten(vectors: DataFrame, column: str = "embedding", row_id: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """(row_id, component, n, deviation, whitened, explained, identity_error) of each usable row and component.

    Vectors that are null or hold null or non-finite entries are left out; a table without others gives an empty result.
    Shorter vectors than the longest are filled up with zeros. The model is that of the distinct vectors, so repeated
    ones count once; rows may repeat ids or have none, and each gets its own result rows. Components are as many as
    `components` and dimensions allow; those without variance have no whitened value and explain nothing (null where no
    component has variance). A deviation that isn't a long is null. Other columns, whatever their names, are left out.
    """
    spark = vectors.sparkSession
    id_type = vectors.schema[row_id].dataType
    rows, d = quantised(vectors.select(F.col(row_id).alias("_wh_id"), F.col(column).alias("_wh_v")), "_wh_v")
    out = f"{row_id} {id_type.simpleString()}, component int, n long, deviation long, whitened double, explained double"
    model = None
    if d:
        distinct = store(rows.select("_wh_x").distinct(), "whiten-fit")
        model = fit(distinct, d, components)
    if model is None:
        return spark.createDataFrame([], f"{out}, identity_error double")
    off = error(distinct, d, model)
    k, explained = model.components, model.explained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            far = n_fold(matrix(batch.column(1), d), model.n, model.sums)
            w = np.full((m, k), np.nan)
            w[:, : model.used] = model.project(far)
            columns = [
                batch.column(0).take(pa.array(np.repeat(np.arange(m), k))),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, model.n, np.int64)),
                pa.array([v for v in squares(far) for _ in range(k)], pa.int64()),
                pa.array(w.ravel(), mask=np.isnan(w.ravel())),
                pa.array(explained * m, pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [row_id, "component", "n", "deviation", "whitened", "explained"])

    found = rows.select("_wh_id", "_wh_x").mapInArrow(lean(run), out)
    return found.withColumn("identity_error", F.lit(off).cast("double"))
