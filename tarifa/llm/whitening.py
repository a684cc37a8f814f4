"""Whitening of embeddings: streaming covariance, symmetric QR eigen-solve, projection.

Entries become whole numbers ``x = floor(scale * c)``. The fit list is every distinct x vector once. Each task goes through
its vectors with Welford's rank-one updates (centred before multiplying, relative to its first vector, so that a large
common offset costs no digits) and gives one state: count, exact sums, mean and the d x d matrix of centred products. States are
merged by the parallel update formula in a tree of tasks, ``FAN`` at a time; the last ``FAN`` at most meet on the driver, so
what reaches it does not grow with the input. The covariance is brought to tridiagonal form by Householder reflections and then
diagonalised by QR steps with Wilkinson's shift. Its leading components go to the tasks in the closure: d x k numbers.

A state takes 8 d^2 bytes in a task; ``MAX_DIMENSION`` bounds d.

Edge cases: rows whose vector is null, or holds a null, NaN or infinite entry, are dropped. A shorter vector counts as filled
up with zeros to the longest one's length. ``floor`` saturates at the ends of a long. Repeated vectors are fitted once and all returned. A component
whose eigenvalue is zero (fewer distinct vectors than dimensions, constant dimensions) has null ``whitened`` and is not part of
``identity_error``; where the trace is zero ``explained`` is null. ``deviation`` is exact: a decimal of 38 digits, null beyond. An
empty table, or one of empty vectors, gives no rows. Columns other than the two named are not read.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StructField, StructType

from tarifa.llm.common import materialize, table

SCALE, COMPONENTS, FAN, MAX_DIMENSION = 256, 4, 16, 4096
#: Below this size differences and sums of longs can't overflow.
_SAFE = 1 << 61


@dataclass
class Moments:
    """``n`` vectors with exact ``sums``; their mean is ``base + shift``, ``products`` is the sum of centred outer products."""

    n: int
    sums: np.ndarray  # of Python integers
    base: np.ndarray  # whole numbers near the mean
    shift: np.ndarray
    products: np.ndarray

    @classmethod
    def empty(cls, d: int) -> Moments:
        return cls(0, np.zeros(d, object), np.zeros(d, np.int64), np.zeros(d), np.zeros((d, d)))

    def add(self, x: np.ndarray) -> None:
        """Welford's update with each row of ``x``, whole numbers."""
        if not len(x):
            return
        if not self.n:
            self.base = x[0].copy()
        small = max(abs(int(x.min())), abs(int(x.max()))) * len(x) < _SAFE
        self.sums = self.sums + (x.sum(axis=0) if small else x.astype(object).sum(axis=0)).astype(object)
        self.update(_minus(x, self.base))

    def update(self, rows: np.ndarray) -> None:
        """Welford's update with each row, relative to ``base``."""
        outer = np.empty_like(self.products)
        for y in rows:
            self.n += 1
            delta = y - self.shift
            self.shift += delta / self.n
            np.multiply.outer(delta, delta * ((self.n - 1) / self.n), out=outer)
            self.products += outer

    def merge(self, other: Moments) -> Moments:
        """The parallel update formula."""
        if not self.n or not other.n:
            return self if self.n else other
        n = self.n + other.n
        delta = _minus(other.base, self.base) + other.shift - self.shift
        products = self.products + other.products + np.multiply.outer(delta, delta) * (self.n * (other.n / n))
        return Moments(n, self.sums + other.sums, self.base, self.shift + delta * (other.n / n), products)


def _minus(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    """The difference of whole numbers, taken exactly, as doubles."""
    if not x.size or max(abs(int(x.min())), abs(int(x.max())), abs(int(base.min())), abs(int(base.max()))) < _SAFE:
        return (x - base).astype(float)
    return (x.astype(object) - base.astype(object)).astype(float)


def symmetric_qr(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of a symmetric matrix."""
    a, n = np.array(v, float), len(v)
    q = np.eye(n)
    for k in range(n - 2):  # Householder: zeros below the first subdiagonal
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        if size == 0 or not np.any(x[1:]):
            continue
        x[0] += math.copysign(size, x[0])
        x /= np.linalg.norm(x)
        a[k + 1 :, k:] -= 2 * np.outer(x, x @ a[k + 1 :, k:])
        a[k:, k + 1 :] -= 2 * np.outer(a[k:, k + 1 :] @ x, x)
        q[:, k + 1 :] -= 2 * np.outer(q[:, k + 1 :] @ x, x)
    d, e = np.diag(a).copy(), np.append(np.diag(a, -1), 0.0)
    tiny, q = np.finfo(float).eps, q.T.copy()  # rows of q are rotated: they lie together in memory
    hi = n - 1
    while hi > 0:
        if abs(e[hi - 1]) <= tiny * (abs(d[hi - 1]) + abs(d[hi])):
            e[hi - 1] = 0.0
            hi -= 1
            continue
        lo = hi - 1
        while lo > 0 and abs(e[lo - 1]) > tiny * (abs(d[lo - 1]) + abs(d[lo])):
            lo -= 1
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + math.copysign(math.hypot(half, e[hi - 1]), half))
        x, z = d[lo] - shift, e[lo]
        for k in range(lo, hi):  # the bulge is chased down
            r = math.hypot(x, z)
            c, s = (x / r, z / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, z = e[k], s * e[k + 1]
                e[k + 1] *= c
            q[k], q[k + 1] = c * q[k] + s * q[k + 1], c * q[k + 1] - s * q[k]
    order = np.argsort(-d, kind="stable")
    return d[order], q[order].T


@dataclass
class Model:
    n: int
    sums: list[int]
    trace: float
    eigenvalues: list[float]  # of the leading components
    components: np.ndarray  # d x k, unit columns
    identity_error: float | None = None

    @property
    def usable(self) -> list[bool]:
        """Of each component: whether its eigenvalue is more than rounding."""
        least = len(self.sums) * np.finfo(float).eps * max(self.eigenvalues, default=0.0)
        return [e > least for e in self.eigenvalues]

    def whiten(self, x: np.ndarray) -> tuple[np.ndarray, list[Decimal | None] | np.ndarray]:
        """Projections of the rows of ``x`` and their exact deviations."""
        most = max([1, *map(abs, self.sums)])
        big = max(abs(int(x.min())), abs(int(x.max()))) * self.n + most
        if big * big * x.shape[1] < 1 << 62:
            off = self.n * x - np.array(self.sums, np.int64)
            deviation = (off * off).sum(axis=1)
        else:
            off = self.n * x.astype(object) - np.array(self.sums, object)
            deviation = [Decimal(v) if v < 10**38 else None for v in (off * off).sum(axis=1)]
        scale = np.array([1 / math.sqrt(e) if ok else np.nan for e, ok in zip(self.eigenvalues, self.usable)])
        return off.astype(float) / self.n @ self.components * scale, deviation


def _matrix(x: pa.Array) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)


def _whole(df: DataFrame, column: str, scale: int) -> DataFrame:
    """The rows that remain, with their whole-number vector ``x``; all of one length."""
    rows = df.where(F.col(column).isNotNull() & F.expr(f"forall(`{column}`, e -> coalesce(abs(CAST(e AS double)) < double('inf'), false))"))
    sizes = rows.agg(F.max(F.size(column)).alias("most"), F.min(F.size(column)).alias("least")).first()
    if (sizes["most"] or 0) > MAX_DIMENSION:
        raise ValueError(f"vectors of {sizes['most']} entries; at most {MAX_DIMENSION}")
    x = F.expr(f"transform(`{column}`, e -> floor({scale} * CAST(e AS double)) + 0L)")
    if sizes["most"] != sizes["least"]:
        x = F.concat(x, F.array_repeat(F.lit(0).cast("long"), F.lit(sizes["most"]) - F.size(column)))
    return rows.withColumn("x", x)


def _moments(vectors: DataFrame, d: int, prepare) -> Moments:
    """Moments of all vectors ``x``; ``prepare`` turns a matrix of them into what is added up."""

    def one(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = Moments.empty(d)
        for batch in batches:
            x = prepare(_matrix(batch.column("x")))
            state.add(x) if x.dtype == np.int64 else state.update(x)
        if state.n:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "state": pa.array([pickle.dumps(state)])})

    def several(key, frame):
        state = Moments.empty(d)
        for part in frame.sort_values("part")["state"]:
            state = state.merge(pickle.loads(part))
        return frame.iloc[:1].assign(part=key[0], state=[pickle.dumps(state)])

    schema = "part int, state binary"
    states = materialize(vectors.select("x").mapInArrow(one, schema), "moments")
    while states.count() > FAN:
        states = materialize(states.groupBy((F.col("part") / FAN).cast("int").alias("up")).applyInPandas(several, schema), "moments")
    total = Moments.empty(d)
    for row in sorted(states.collect(), key=lambda r: r["part"]):
        total = total.merge(pickle.loads(row["state"]))
    return total


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of the distinct vectors ``x``; None without any, or any entries."""
    listed = materialize(vectors.select("x").distinct(), "fit-list")
    first = listed.first()
    if first is None or not first["x"]:
        return None
    d = len(first["x"])
    total = _moments(listed, d, lambda x: x)
    values, axes = symmetric_qr((total.products + total.products.T) / (2 * total.n))
    model = Model(total.n, [int(s) for s in total.sums], float(np.trace(total.products)) / total.n, [max(0.0, float(e)) for e in values[:components]], axes[:, :components])
    ok = np.array(model.usable, bool)
    if ok.any():  # measured on the fit list itself
        seen = _moments(listed, int(ok.sum()), lambda x: model.whiten(x)[0][:, ok])
        model.identity_error = float(np.abs(seen.products / seen.n - np.eye(int(ok.sum()))).max())
    return model


def whiten(df: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every remaining row and component up to ``components``."""
    rows = _whole(df.select(F.col(vec_id).alias("vec_id"), F.col(embedding).alias("embedding")), "embedding", scale).select("vec_id", "x")
    schema = StructType(
        [
            StructField("vec_id", rows.schema["vec_id"].dataType),
            StructField("component", IntegerType()),
            StructField("n", LongType()),
            StructField("deviation", DecimalType(38, 0)),
            StructField("whitened", DoubleType()),
            StructField("explained", DoubleType()),
            StructField("identity_error", DoubleType()),
        ]
    )
    model = fit(rows, components)
    if model is None:
        return df.sparkSession.createDataFrame([], schema)
    explained = [e / model.trace if model.trace else None for e in model.eigenvalues]

    def project(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(model.eigenvalues)
        for batch in batches:
            if not batch.num_rows:
                continue
            white, deviation = model.whiten(_matrix(batch.column("x")))
            again = np.repeat(np.arange(batch.num_rows), k)
            flat = white.reshape(-1)
            columns = [
                batch.column("vec_id").take(pa.array(again)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), batch.num_rows)),
                pa.array(np.full(len(again), model.n, np.int64)),
                (pa.array(deviation, pa.decimal128(38, 0)) if isinstance(deviation, list) else pa.array(deviation).cast(pa.decimal128(38, 0))).take(pa.array(again)),
                pa.array(flat, mask=np.isnan(flat)),
                pa.array(explained * batch.num_rows, pa.float64()),
                pa.array([model.identity_error] * len(again), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)


def op12_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))
