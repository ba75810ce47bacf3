"""Whitening of embeddings by a covariance of two passes.

Entries are quantised to integers, so their sums and the mean are exact whatever the order of the rows. The second
pass sums outer products of centred vectors block by block (NumPy GEMM); `treeAggregate` merges the d x d parts, LAPACK's
symmetric solver gives the components on the driver, and d x k of them are broadcast for the projection. What the
driver and a broadcast hold depends on the dimension d alone.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_batches, written

_LOW = np.int64((1 << 32) - 1)


@dataclass
class Whitening:
    """n vectors with the sums `sums`; the first k components (columns, by falling variance) and what they explain."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    explained: np.ndarray
    identity_error: float | None = None

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def spans(self) -> np.ndarray:
        """Whether a component has any variance beyond rounding."""
        return self.variances > 0

    def project(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN on components without variance."""
        scale = np.where(self.spans, np.sqrt(np.where(self.spans, self.variances, 1)), np.nan)
        return ((x - self.mean) @ self.components) / scale


def quantised(rows: DataFrame, vector: str = "embedding", steps: int = 256) -> DataFrame:
    """rows whose vector is whole, with `x`: floor(steps * entry) as array<long>.

    Left out: null vectors, and vectors with a null, NaN or infinite entry.
    """
    c = F.col(vector).cast("array<double>")
    bad = F.exists(c, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return rows.where(c.isNotNull() & ~bad).withColumn("x", F.transform(c, lambda v: F.floor(v * steps).cast("long")))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.names.index("x")).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, d)


def _gathered(fit: DataFrame, part, merge):
    """part(batches) of every partition, merged along a tree; None if there is nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = part(b for b in batches if b.num_rows)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(out)], pa.binary())], ["part"])

    join = lambda a, b: a if b is None else b if a is None else merge(a, b)
    return fit.select("x").mapInArrow(run, "part binary").rdd.map(lambda r: pickle.loads(bytes(r[0]))).treeAggregate(None, join, join, 2)


def _sums(d: int):
    def part(batches):
        n, total = 0, [0] * d
        for b in batches:
            x = _matrix(b, d)
            n += len(x)
            # high and low halves apart: neither overflows, however large the entries
            total = [t + (int(h) << 32) + int(w) for t, h, w in zip(total, (x >> 32).sum(0), (x & _LOW).sum(0))]
        return (n, total) if n else None

    return part


def _products(d: int, mean: np.ndarray):
    def part(batches):
        out = None
        for b in batches:
            c = _matrix(b, d) - mean
            out = c.T @ c if out is None else out + c.T @ c
        return out

    return part


def _moments(d: int, model: Whitening):
    def part(batches):
        out = None
        for b in batches:
            y = model.project(_matrix(b, d))[:, model.spans]
            m = y.mean(0)
            new = (len(y), m, (y - m).T @ (y - m))
            out = new if out is None else _merged_moments(out, new)
        return out

    return part


def _merged_moments(a, b):
    """Counts, means and centred products of two sets of rows together."""
    n = a[0] + b[0]
    gap = b[1] - a[1]
    return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)


def fit(vectors: DataFrame, components: int) -> Whitening | None:
    """The whitening of the distinct vectors `x` (array<long>, all of one length); None if there are none.

    Components without variance (beyond rounding) have variance 0, and explained is 0 for all if all vectors are equal.
    """
    small_batches(vectors.sparkSession)
    rows = written(vectors.select("x").distinct(), "vectors")
    d = rows.select(F.size("x").alias("d")).limit(1).first()
    if d is None or not d[0]:
        return None
    d = d[0]
    n, sums = _gathered(rows, _sums(d), lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1])]))
    mean = np.array([s / n for s in sums])
    v = _gathered(rows, _products(d, mean), lambda a, b: a + b) / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1], q[:, ::-1]
    e = np.where(e > d * np.finfo(float).eps * max(e[0], 0), e, 0.0)
    k, trace = min(components, d), float(np.trace(v))
    model = Whitening(n, sums, np.ascontiguousarray(q[:, :k]), e[:k].copy(), e[:k] / trace if trace > 0 else np.zeros(k))
    seen = _gathered(rows, _moments(d, model), _merged_moments) if model.spans.any() else None
    if seen is not None:
        model.identity_error = float(np.abs(seen[2] / n - np.eye(int(model.spans.sum()))).max())
    return model


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """Sums of (n x - S)^2, exact: in 64 bits where they fit, else in Python's integers."""
    kind = pa.decimal128(38, 0)
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(abs(s) for s in sums)
    if most * most * x.shape[1] < 1 << 63:
        gap = x * n - np.array(sums, np.int64)
        return pa.array(np.einsum("ij,ij->i", gap, gap), pa.int64()).cast(kind)
    return pa.array([Decimal(sum((n * v - s) ** 2 for v, s in zip(row, sums))) for row in x.tolist()], kind)


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 4, steps: int = 256, key: str = "vec_id") -> tuple[DataFrame, Whitening | None]:
    """(table, model): per whole vector its key, deviation decimal(38,0) and whitened array<double>, one entry a component.

    Only `key` and `vector` are read, whatever other columns there are. Keys may be null or repeated: each row is its
    own. Vectors that are null, or have null or non-finite entries, are left out of fit and result; so are those
    shorter than the longest vector, since entries that aren't there count as null, and empty ones. Equal vectors count
    once in the fit. Without any vector the table is empty and the model None. A component without variance gives null.
    """
    spark = rows.sparkSession
    small_batches(spark)
    whole = quantised(rows.select(F.col(key).alias("key"), F.col(vector).alias("v")), "v", steps).select("key", "x")
    d = whole.agg(F.max(F.size("x"))).first()[0] or 0
    whole = whole.where(F.size("x") == d) if d else whole.where("false")
    kind = dict(rows.dtypes)[key]
    schema = f"{key} {kind}, deviation decimal(38,0), whitened array<double>"
    model = fit(whole, components) if d else None
    if model is None:
        return spark.createDataFrame([], schema), None
    held = spark.sparkContext.broadcast(model)  # d x k doubles and d integers

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch, d)
                y = held.value.project(x)
                flat = pa.array(y.ravel(), pa.float64(), mask=np.isnan(y).ravel())
                y = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * y.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0), _deviations(x, held.value.n, held.value.sums), y], [key, "deviation", "whitened"])

    return whole.mapInArrow(run, schema), model


def whitened_components(rows: DataFrame, components: int = 4) -> DataFrame:
    """A row per whole vector and component: vec_id, component (from 1), n, deviation, whitened, explained, identity_error.

    A deviation beyond a long is an error (whiten() keeps it as a decimal); identity_error is null if nothing varies.
    """
    table, model = whiten(rows, components=components)
    if model is None:
        n, explained, error = 0, F.array().cast("array<double>"), None
    else:
        n, explained, error = model.n, F.array(*[F.lit(float(v)) for v in model.explained]), model.identity_error
    each = table.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        F.get(explained, F.col("at")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
