"""Least squares from sufficient statistics.

The rows never leave the executors: each task adds up its part of the Gram matrix (p x p numbers), the parts
are summed by a shuffle of p x p keys, and the driver solves a small dense system. Robust covariances take a
second pass of the same kind.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.functions.tails import chi2_upper, f_upper, normal_two_sided, t_quantile, t_two_sided
from tarifa.operators.design import DesignSpec


def _matrix(column: pa.Array, p: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)


def _summed(rows: DataFrame, partial, shape: tuple[int, int], by: Sequence[str] = ()) -> dict:
    """Sums of ``partial(batch) -> matrix`` over all rows; by group where ``by`` names leading columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict = {}
        for b in batches:
            code = np.zeros(b.num_rows, np.int64)
            for i in range(len(by)):
                own = b.column(i).dictionary_encode(null_encoding="encode")
                code = code * len(own.dictionary) + own.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(code, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                if by and not len(at):
                    continue
                key = tuple(b.column(i)[int(at[0])].as_py() for i in range(len(by)))
                m = partial(b.take(pa.array(at)) if by else b)
                total[key] = total[key] + m if key in total else m
        for key, m in total.items():
            i, j = np.indices(shape)
            columns = [pa.array([str(k)] * m.size) for k in key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(i.ravel().astype(np.int32)), pa.array(j.ravel().astype(np.int32)), pa.array(m.ravel())], [*[f"g{k}" for k in range(len(key))], "i", "j", "v"])

    groups = [f"g{k}" for k in range(len(by))]
    schema = ", ".join([*[f"{g} string" for g in groups], "i int", "j int", "v double"])
    found = rows.mapInArrow(run, schema).groupBy(*groups, "i", "j").agg(F.sum("v").alias("v")).toPandas()  # p x p rows per group
    out: dict = {}
    for key, part in found.groupby(groups) if groups else [((), found)]:
        m = np.zeros(shape)
        m[part.i, part.j] = part.v
        out[key if isinstance(key, tuple) else (key,)] = m
    return out


def gram(df: DataFrame, x: Column, y: Column, p: int) -> np.ndarray:
    """(p + 1) x (p + 1) products of the regressors and the target (last)."""
    rows = df.select(x.alias("x"), y.cast("double").alias("y")).where("y IS NOT NULL")

    def partial(b: pa.RecordBatch) -> np.ndarray:
        z = np.column_stack([_matrix(b.column(0), p), b.column(1).to_numpy(zero_copy_only=False)])
        return z.T @ z

    return _summed(rows, partial, (p + 1, p + 1)).get((), np.zeros((p + 1, p + 1)))


@dataclass
class OLS:
    """Fitted by :func:`ols`; covariance is that of the chosen kind."""

    spec: DesignSpec
    beta: np.ndarray
    covariance: np.ndarray
    inverse: np.ndarray
    n: int
    ssr: float
    tss: float
    kind: str

    @property
    def names(self) -> list[str]:
        return ["const", *self.spec.names]

    @property
    def df_resid(self) -> int:
        return self.n - np.linalg.matrix_rank(self.inverse)

    @property
    def r2(self) -> float:
        return 1 - self.ssr / self.tss

    @property
    def adj_r2(self) -> float:
        return 1 - (self.ssr / self.df_resid) / (self.tss / (self.n - 1))

    @property
    def log_likelihood(self) -> float:
        return -self.n / 2 * (math.log(2 * math.pi) + math.log(self.ssr / self.n) + 1)

    @property
    def aic(self) -> float:
        return 2 * len(self.beta) - 2 * self.log_likelihood

    @property
    def bic(self) -> float:
        return math.log(self.n) * len(self.beta) - 2 * self.log_likelihood

    def coefficients(self) -> pd.DataFrame:
        """feature, coefficient, std_err, p_value, pct_effect, largest first."""
        se = np.sqrt(np.maximum(np.diag(self.covariance), 0))
        dummy = [False] + [n not in self.spec.continuous for n in self.spec.names]
        rows = []
        for name, b, s, d in zip(self.names, self.beta, se, dummy):
            z = b / s if s > 0 else math.inf
            p = normal_two_sided(z) if self.kind != "nonrobust" else t_two_sided(z, self.df_resid)
            rows.append((name, b, s, p, None if name == "const" else math.expm1(b) * 100 if d else b * 100))
        out = pd.DataFrame(rows, columns=["feature", "coefficient", "std_err", "p_value", "pct_effect"])
        return out.sort_values("coefficient", key=lambda c: -c.abs(), kind="stable", ignore_index=True)

    def predict(self) -> Column:
        terms = [F.lit(float(b)) * c for b, c in zip(self.beta[1:], self.spec.columns())]
        return sum(terms, F.lit(float(self.beta[0])))

    def leverage(self) -> Column:
        x = [F.lit(1.0), *self.spec.columns()]
        total = F.lit(0.0)
        for i, row in enumerate(self.inverse):
            total = total + x[i] * sum((F.lit(float(v)) * c for v, c in zip(row, x)), F.lit(0.0))
        return total

    def interval(self, level: float = 0.95) -> Column:
        """Half width of the prediction interval."""
        s2 = self.ssr / self.df_resid
        return F.lit(t_quantile(0.5 + level / 2, self.df_resid)) * F.sqrt(F.lit(s2) * (1 + self.leverage()))


def ols(df: DataFrame, spec: DesignSpec, y: Column, kind: str = "HC3", cluster: str | None = None) -> OLS:
    """Least squares of ``y`` with constant; covariance nonrobust, HC3 or by cluster."""
    p = len(spec.names) + 1
    rows = df.select(spec.vector().alias("x"), y.cast("double").alias("y"), *([F.col(cluster).alias("c")] if cluster else [])).where("y IS NOT NULL")
    g = gram(rows, F.col("x"), F.col("y"), p)
    xx, xy, yy, n = g[:p, :p], g[:p, p], g[p, p], int(round(g[0, 0]))
    inverse = np.linalg.pinv(xx, hermitian=True)
    beta = inverse @ xy
    tss = float(yy - xy[0] ** 2 / n)
    rank = np.linalg.matrix_rank(xx)
    if cluster:
        resid = F.col("y") - sum((F.col("x")[i] * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        scores = rows.withColumn("e", resid).groupBy("c").agg(*[F.sum(F.col("x")[i] * F.col("e")).alias(f"s{i}") for i in range(p)], F.sum(F.col("e") * F.col("e")).alias("ee"))
        scores = scores.select(F.array(*[f"s{i}" for i in range(p)]).alias("s"), "ee")

        def meat(b: pa.RecordBatch) -> np.ndarray:
            s = _matrix(b.column(0), p)
            out = np.zeros((p + 1, p + 1))
            out[:p, :p], out[p, p], out[0, p] = s.T @ s, len(s), b.column(1).to_numpy(zero_copy_only=False).sum()
            return out

        m = _summed(scores, meat, (p + 1, p + 1))[()]
        groups, ssr = m[p, p], float(m[0, p])
        covariance = inverse @ m[:p, :p] @ inverse * (groups / (groups - 1) * (n - 1) / (n - rank))
    elif kind == "HC3":

        def meat(b: pa.RecordBatch) -> np.ndarray:
            x = _matrix(b.column(0), p)
            h = np.einsum("ij,jk,ik->i", x, inverse, x)
            e = b.column(1).to_numpy(zero_copy_only=False) - x @ beta
            w = np.column_stack([x * (e / np.maximum(1 - h, 1e-12))[:, None], e])
            return w.T @ w

        m = _summed(rows.select("x", "y"), meat, (p + 1, p + 1))[()]
        covariance, ssr = inverse @ m[:p, :p] @ inverse, float(m[p, p])
    else:
        fitted = sum((F.col("x")[i] * float(b) for i, b in enumerate(beta)), F.lit(0.0))
        ssr = float(rows.agg(F.sum((F.col("y") - fitted) * (F.col("y") - fitted))).first()[0] or 0.0)
        covariance = inverse * ssr / (n - rank)
    return OLS(spec, beta, covariance, inverse, n, ssr, tss, "cluster" if cluster else kind)


def chow(df: DataFrame, continuous: Sequence[str], group: str, y: Column) -> dict[str, float]:
    """Do slopes differ between groups? F test of the interactions, from two fits' sums of squares."""
    base = DesignSpec.fit(df, continuous, [group])
    crossed = df
    more = []
    for level in base.levels[group][1:]:
        for c in continuous:
            more.append(f"{c}_x_{level}")
            crossed = crossed.withColumn(more[-1], F.col(c) * (F.col(group) == level).cast("double"))
    small, large = ols(df, base, y, "nonrobust"), ols(crossed, DesignSpec.fit(crossed, [*continuous, *more], [group]), y, "nonrobust")
    q = small.df_resid - large.df_resid
    f = (small.ssr - large.ssr) / q / (large.ssr / large.df_resid)
    return {"f": f, "df_num": q, "df_den": large.df_resid, "p_value": f_upper(f, q, large.df_resid), "adj_r2_common": small.adj_r2, "adj_r2_separate": large.adj_r2}


def vif(df: DataFrame, spec: DesignSpec) -> pd.DataFrame:
    """Variance inflation: diagonal of the inverse correlation matrix, from the Gram matrix."""
    p = len(spec.names) + 1
    g = gram(df, spec.vector(), F.lit(0.0), p)[:p, :p]
    n = g[0, 0]
    cov = g[1:, 1:] / n - np.outer(g[0, 1:], g[0, 1:]) / n**2
    d = np.sqrt(np.maximum(np.diag(cov), 1e-300))
    values = np.diag(np.linalg.pinv(cov / np.outer(d, d), hermitian=True))
    return pd.DataFrame({"feature": spec.names, "vif": values}).sort_values("vif", ascending=False, ignore_index=True)


def white(df: DataFrame, model: OLS, y: Column) -> dict[str, float]:
    """White's test: n R2 of the squared residuals on regressors, squares and products."""
    p = len(model.spec.names) + 1
    places = [(i, j) for i in range(p) for j in range(i, p)]
    x = F.col("x")
    rows = df.select(model.spec.vector().alias("x"), (y - model.predict()).alias("e")).where("e IS NOT NULL")
    g = gram(rows, F.array(*[x[i] * x[j] for i, j in places]), F.col("e") * F.col("e"), len(places))
    k = len(places)
    xx, xy, yy, n = g[:k, :k], g[:k, k], g[k, k], g[0, 0]
    beta = np.linalg.pinv(xx, hermitian=True) @ xy
    r2 = 1 - (yy - beta @ xy) / (yy - xy[0] ** 2 / n)
    df_ = int(np.linalg.matrix_rank(xx)) - 1
    return {"lm": float(n * r2), "lm_p_value": chi2_upper(n * r2, df_), "f": float(r2 / df_ / ((1 - r2) / (n - df_ - 1))), "df": df_}


def cook(df: DataFrame, model: OLS, y: Column) -> DataFrame:
    """``df`` with residual, leverage, Cook's distance and whether it is influential (over 4 / n, or leverage 1)."""
    k, s2 = len(model.beta), model.ssr / model.df_resid
    rows = df.withColumns({"residual": y - model.predict(), "leverage": model.leverage()})
    left = 1 - F.col("leverage")
    distance = F.when(left > 1e-10, F.col("residual") * F.col("residual") * F.col("leverage") / (k * s2 * left * left))
    return rows.withColumn("cook", distance).withColumn("influential", F.coalesce(F.col("cook") > 4 / model.n, F.lit(True)))


ALPHAS = (0.001, 0.01, 0.1, 1.0, 10.0, 100.0, 500.0)


@dataclass
class Ridge:
    spec: DesignSpec
    alpha: float
    intercept: float
    coefficients: np.ndarray
    scores: dict[float, float]

    def predict(self) -> Column:
        return sum((F.lit(float(b)) * c for b, c in zip(self.coefficients, self.spec.columns())), F.lit(float(self.intercept)))


def _ridge(g: np.ndarray, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and slopes; regressors scaled by their population deviation, constant not penalised."""
    n, p = g[0, 0], len(g) - 2
    mean, y_mean = g[0, 1 : p + 1] / n, g[0, p + 1] / n
    xx = g[1 : p + 1, 1 : p + 1] - n * np.outer(mean, mean)
    xy = g[1 : p + 1, p + 1] - n * mean * y_mean
    sd = np.sqrt(np.maximum(np.diag(xx) / n, 0))
    sd[sd < 1e-12] = 1.0
    b = np.linalg.solve(xx / np.outer(sd, sd) + alpha * np.eye(p), xy / sd) / sd
    return float(y_mean - mean @ b), b


def fold_of(key: str, folds: int = 5) -> Column:
    """Fold of a key, by its MD5: the same on every run and in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long"), F.lit(folds))


def ridge(df: DataFrame, spec: DesignSpec, y: Column, group: str, folds: int = 5, alphas: Sequence[float] = ALPHAS) -> Ridge:
    """Ridge with alpha by grouped cross-validation: one pass for the Gram matrix of each fold serves all fits."""
    p = len(spec.names) + 1
    rows = df.select(fold_of(group, folds).cast("string").alias("f"), spec.vector().alias("x"), y.cast("double").alias("y")).where("y IS NOT NULL")

    def partial(b: pa.RecordBatch) -> np.ndarray:
        z = np.column_stack([_matrix(b.column(1), p), b.column(2).to_numpy(zero_copy_only=False)])
        return z.T @ z

    grams = _summed(rows, partial, (p + 1, p + 1), by=("f",))
    if len(grams) < 2:
        raise ValueError("cross-validation needs two groups or more")
    total = sum(grams.values())
    scores = {}
    for alpha in alphas:
        found = []
        for own in grams.values():
            a, b = _ridge(total - own, alpha)
            beta = np.append(a, b)
            sse = own[p, p] - 2 * beta @ own[:p, p] + beta @ own[:p, :p] @ beta
            sst = own[p, p] - own[0, p] ** 2 / own[0, 0]
            found.append(1 - sse / sst if sst > 0 else 0.0)
        scores[alpha] = float(np.mean(found))
    best = max(alphas, key=lambda a: (scores[a], -a))
    intercept, b = _ridge(total, best)
    return Ridge(spec, best, intercept, b, scores)


def price_index(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], period: str, y: Column, cluster: str) -> pd.DataFrame:
    """Quality-adjusted index: effect in percent of each period against the first, cluster-robust p-values."""
    spec = DesignSpec.fit(df, continuous, [*categorical, period])
    table = ols(df, spec, y, cluster=cluster).coefficients().set_index("feature")
    first = spec.levels[period][0]
    rows = [(first, True, 0.0, None)]
    rows += [(x, False, table.pct_effect[f"{period}_{x}"], table.p_value[f"{period}_{x}"]) for x in spec.levels[period][1:]]
    return pd.DataFrame(rows, columns=[period, "reference", "index_pct", "p_value"])
