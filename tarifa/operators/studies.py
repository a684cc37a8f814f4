"""Studies beside the reports: coefficients over periods, brand effects, pooling, duplicates, rank correlations, Ward's check."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions.specs import geo_mean
from tarifa.functions.tails import normal_two_sided
from tarifa.operators import clusters, regression
from tarifa.operators.design import DesignSpec
from tarifa.operators.panel import spearman
from tarifa.operators.ranks import quantiles
from tarifa.operators.segments import cluster_units, with_dummies
from tarifa.sources.scratch import written


def pct_effect_se(coefficient: float, se: float) -> float:
    """Standard error, in percent, of exp(b) - 1 by the delta method."""
    return float(np.exp(coefficient) * 100 * se)


def fits_by_group(df: DataFrame, group: str, features: Sequence[str], y, least_ratio: float = 0.0) -> pd.DataFrame:
    """Least squares with plain errors in each group, from one pass of sums: a row per group and term.

    group, n, fitted, adj_r2, feature, coefficient, std_err, pct_effect, pct_se. A group with fewer rows than ``least_ratio``
    per predictor, or none to spare, has one row with fitted false: the report of what was skipped. Predictors that
    don't vary in a group are left out there.
    """
    names, p = list(features), len(features)
    rows = df.select(F.col(group).cast("string").alias("g"), F.array(F.lit(1.0), *[F.col(f).cast("double") for f in names]).alias("x"), y.cast("double").alias("y")).where("y IS NOT NULL")

    def partial(b) -> np.ndarray:
        z = np.column_stack([b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1), b.column(2).to_numpy(zero_copy_only=False)])
        return z.T @ z

    out = []
    for (key,), g in sorted(regression._summed(rows, partial, (p + 2, p + 2), by=("g",)).items()):
        n = int(round(g[0, 0]))
        spread = np.diag(g)[1 : p + 1] - g[0, 1 : p + 1] ** 2 / n
        at = np.flatnonzero(spread > 1e-9 * np.maximum(np.diag(g)[1 : p + 1], 1))
        k = len(at) + 1
        if n < least_ratio * len(at) or n <= k:
            out.append((key, n, False, None, None, None, None, None, None))
            continue
        places = np.concatenate(([0], at + 1))
        inverse = np.linalg.pinv(g[np.ix_(places, places)], hermitian=True)
        xy, yy = g[places, p + 1], g[p + 1, p + 1]
        beta = inverse @ xy
        ssr, tss = max(float(yy - beta @ xy), 0.0), float(yy - g[0, p + 1] ** 2 / n)
        se = np.sqrt(np.diag(inverse) * ssr / (n - k))
        adjusted = 1 - ssr / (n - k) / (tss / (n - 1)) if tss > 0 else None
        for name, b, s in zip(["const", *(names[i] for i in at)], beta, se):
            out.append((key, n, True, adjusted, name, float(b), float(s), float(np.expm1(b) * 100), pct_effect_se(b, s)))
    return pd.DataFrame(out, columns=[group, "n", "fitted", "adj_r2", "feature", "coefficient", "std_err", "pct_effect", "pct_se"])


def brand_effects(df: DataFrame, continuous: Sequence[str], y, brand: str = "brand", least: int = 5, other: str = "Autre") -> pd.DataFrame:
    """Least squares with brand effects against the most frequent brand; brands of fewer than ``least`` rows are one. Plain errors."""
    counts = df.groupBy(brand).agg(F.count("*").alias("__n"))
    named = df.join(counts, brand).withColumn("__b", F.when(F.col("__n") >= least, F.col(brand)).otherwise(F.lit(other)))
    order = [r["__b"] for r in named.groupBy("__b").count().orderBy(F.desc("count"), "__b").collect()]  # a row per brand
    spec = DesignSpec(list(continuous), ["__b"], {"__b": order})
    model = regression.ols(named, spec, y, "nonrobust")
    se = np.sqrt(np.maximum(np.diag(model.covariance), 0))
    names = ["const", *continuous, *(f"{brand}_{b}" for b in order[1:])]
    return pd.DataFrame({"feature": names, "coefficient": model.beta, "std_err": se, "reference": order[0], "adj_r2": model.adj_r2})


def pooling_verdict(df: DataFrame, features: Sequence[str], y, period: str = "period", tolerance: float = 0.03) -> dict[str, float | str]:
    """Is one model with period effects as good as a model per period? Mean adjusted R2 of both, and the verdict."""
    separate = fits_by_group(df, period, features, y).drop_duplicates(period)
    mean = float((separate.adj_r2 * separate.n).sum() / separate.n.sum())
    pooled = regression.ols(df, DesignSpec.fit(df, features, [period]), y, "nonrobust").adj_r2
    return {"adj_r2_separate": mean, "adj_r2_pooled": float(pooled), "verdict": "pooled" if pooled >= mean - tolerance else "separate"}


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """a, b, n, rho of each pair of columns, over the rows that have both."""
    out = None
    for a, b in combinations(columns, 2):
        one = spearman(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "rho")
        out = one if out is None else out.union(one)
    return out


def duplicate_counts(df: DataFrame, *keys: Sequence[str]) -> DataFrame:
    """For each key: rows, distinct keys and rows beyond the first of their key."""
    out = None
    for key in keys:
        counts = df.groupBy(*key).agg(F.count("*").alias("c"))
        one = counts.agg(F.lit(", ".join(key)).alias("key"), F.sum("c").alias("n"), F.count("*").alias("n_distinct"), F.sum(F.col("c") - 1).alias("n_repeated"))
        out = one if out is None else out.union(one)
    return out


def qq_points(df: DataFrame, residual: str, probabilities: Sequence[float]) -> DataFrame:
    """Quantiles of the residuals against those of the normal distribution."""

    def normal(p: float) -> float:
        low, high = -10.0, 10.0
        for _ in range(200):
            mid = (low + high) / 2
            tail = normal_two_sided(mid) / 2
            low, high = (mid, high) if (1 - tail if mid > 0 else tail) < p else (low, mid)
        return (low + high) / 2

    found = quantiles(df, [], residual, probabilities)
    expected = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.lit(normal(p)).alias("expected")) for p in probabilities])
    return found.select(F.explode(F.arrays_zip(expected.alias("e"), F.col("q").alias("q"))).alias("z")).select("z.e.p", "z.e.expected", F.col("z.q").alias("observed"))


def ward(x: np.ndarray, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Labels of ``k`` clusters by agglomeration with Ward's criterion; a row of ``weight`` w stands for w equal ones.

    Along chains of nearest neighbours pairs that are each other's nearest are merged; in the order of their costs these are the
    merges that the greedy way makes.
    """
    n = len(x)
    centre, size = x.astype(float).copy(), np.ones(n) if weight is None else weight.astype(float).copy()
    alive, chain, merges = np.ones(n, bool), [], []
    while alive.sum() > 1:
        if not chain:
            chain = [int(alive.argmax())]
        a = chain[-1]
        cost = np.where(alive, size[a] * size / (size[a] + size) * ((centre - centre[a]) ** 2).sum(1), np.inf)
        cost[a] = np.inf
        b = int(cost.argmin())
        if len(chain) > 1 and cost[chain[-2]] <= cost[b]:
            b = chain[-2]
            merges.append((cost[b], a, b))
            centre[a] = (size[a] * centre[a] + size[b] * centre[b]) / (size[a] + size[b])
            size[a] += size[b]
            alive[b] = False
            chain = chain[:-2]
        else:
            chain.append(b)
    above = np.arange(n)

    def top(i: int) -> int:
        while above[i] != i:
            i = above[i]
        return i

    for _, a, b in sorted(merges, key=lambda m: m[0])[: max(0, n - k)]:
        above[top(b)] = top(a)
    return np.unique([top(i) for i in range(n)], return_inverse=True)[1]


#: Micro-clusters of a unit that Ward's criterion is applied to, and the widths of their cells that are tried (0: equal rows).
MAX_WARD, WIDTHS = 2000, (0.0, *(2.0**k for k in range(-8, 4)))


def ward_check(df: DataFrame, unit: Sequence[str], features: Sequence[str], least: int = 10, categorical: Sequence[str] = ()) -> DataFrame:
    """unit, n, k and the adjusted Rand index between K-means and Ward's clusters of each unit (null with one cluster).

    No row is left out: Ward's clusters are made of micro-clusters (number of rows and their mean), which are the rows with
    equal coordinates or, where these are more than ``MAX_WARD``, the rows of a cell of the smallest width that leaves no more of them.
    """
    labelled = cluster_units(df, unit, features, least, categorical).select("id", "cluster", "outcome")
    df, features = with_dummies(df, unit, features, categorical)
    keys, d = list(unit), len(features)
    value = [F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(f"v{i}") for i, c in enumerate(features)]
    rows = df.select("id", F.struct(*[F.col(k) for k in keys]).alias("u"), *value)
    stats = rows.groupBy("u").agg(F.count("*").alias("n"), *[f(f"v{i}").alias(f"{name}{i}") for i in range(d) for f, name in ((F.avg, "m"), (F.stddev_pop, "s"))])  # a row per unit
    scaled = [F.coalesce((F.col(f"v{i}") - F.col(f"m{i}")) / F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0), F.lit(0.0)) for i in range(d)]
    rows = written(rows.join(stats, "u").join(labelled, "id").where("outcome = 'clustered'").select("u", "cluster", F.array(*scaled).alias("x")), "ward-rows")
    cell = lambda w: F.col("x") if not w else F.transform("x", lambda v: F.floor(v / w).cast("double"))
    counts = rows.groupBy("u").agg(*[F.count_distinct(cell(w)).alias(f"c{i}") for i, w in enumerate(WIDTHS)])
    width = F.coalesce(*[F.when(F.col(f"c{i}") <= MAX_WARD, w) for i, w in enumerate(WIDTHS)], F.lit(WIDTHS[-1]))
    filed = rows.join(counts.select("u", width.alias("w")), "u")
    at = F.when(F.col("w") == 0, F.col("x")).otherwise(F.transform("x", lambda v: F.floor(v / F.nullif(F.col("w"), F.lit(0.0))).cast("double")))
    micro = filed.groupBy("u", at.alias("cell"), "cluster").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("x")[i]) for i in range(d)]).alias("sums"))
    kind = micro.schema["u"].dataType.simpleString()

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cells = frame["cell"].map(tuple)
        place = {c: i for i, c in enumerate(sorted(set(cells)))}
        own = cells.map(place).to_numpy()
        n, sums = np.bincount(own, frame["n"], len(place)), np.zeros((len(place), d))
        np.add.at(sums, own, np.stack(frame["sums"].to_numpy()))
        k = int(frame["cluster"].max()) + 1
        label = ward(sums / n[:, None], k, n)[own]
        table = np.zeros((k, label.max() + 1))
        np.add.at(table, (frame["cluster"].to_numpy(), label), frame["n"].to_numpy())
        return pd.DataFrame({"u": [frame["u"].iloc[0]], "k": [k], "ari": [clusters.rand_index(table)]})

    found = clusters.spread(micro, "u").groupBy("u").applyInPandas(run, f"u {kind}, k int, ari double")
    out = stats.select("u", F.col("n").cast("int").alias("n")).join(found, "u", "left")
    return out.select(*[F.col(f"u.{k}").alias(k) for k in keys], "n", F.coalesce("k", F.lit(1)).alias("k"), "ari")


def estimates(df: DataFrame, models: Mapping[str, str], *groups: str, real: str = "price") -> DataFrame:
    """A row per group and model: n, geometric means of real and estimated prices, the error of their means and the mean error, in percent.

    ``models`` names the column of each model's estimate.
    """
    pairs = ", ".join(f"'{m}', `{c}`" for m, c in models.items())
    long = df.selectExpr(*[f"`{g}`" for g in groups], f"`{real}` AS __real", f"stack({len(models)}, {pairs}) AS (model, __made)")
    r, m = geo_mean("__real"), geo_mean("__made")
    return long.groupBy(*groups, "model").agg(F.count("*").alias("n"), r.alias("real"), m.alias("estimated"), ((m - r) / r * 100).alias("error_pct"), F.avg(F.abs(F.col("__made") - F.col("__real")) / F.col("__real") * 100).alias("mape_pct"))


def cluster_estimates(df: DataFrame, groups: Sequence[str], models: Mapping[str, tuple[str, str]], real: str = "price") -> DataFrame:
    """A row per group: n, geometric mean of real prices, and for each model the estimated one, its error in percent and its source.

    ``models`` names the columns of each model's estimate and of where it came from; a group has one source.
    """
    r = geo_mean(real)
    aggregates = [F.count("*").alias("n"), r.alias("real")]
    for name, (made, source) in models.items():
        m = geo_mean(made)
        aggregates += [m.alias(f"estimated_{name}"), ((m - r) / r * 100).alias(f"error_{name}_pct"), F.min(source).alias(f"source_{name}")]
    return df.groupBy(*groups).agg(*aggregates)


def cluster_profile(df: DataFrame, cluster: str, specs: Sequence[str], price: str = "price") -> DataFrame:
    """n, median price and mean specifications of each cluster."""
    middle = quantiles(df, [cluster], price, (0.5,)).select(cluster, F.col("q")[0].alias("median_price"))
    return df.groupBy(cluster).agg(F.count("*").alias("n"), *[F.avg(s).alias(s) for s in specs]).join(middle, cluster, "left")


def raw_and_clean(raw: DataFrame, clean: DataFrame, *groups: str) -> DataFrame:
    """n_raw, n_clean and n_excluded (not under 0) by group, also where one side has none."""
    a, b = raw.groupBy(*groups).agg(F.count("*").alias("n_raw")), clean.groupBy(*groups).agg(F.count("*").alias("n_clean"))
    both = a.join(b, list(groups), "full_outer").fillna(0, ["n_raw", "n_clean"])
    return both.withColumn("n_excluded", F.greatest(F.col("n_raw") - F.col("n_clean"), F.lit(0)))


def unit_audit(units: DataFrame, stability: DataFrame, trace: DataFrame, unit: Sequence[str]) -> DataFrame:
    """Units with their stability and the silhouette of the k that was chosen; units without either stay."""
    chosen = trace.where("chosen").select(*unit, F.col("silhouette"))
    return units.join(stability, list(unit), "left").join(chosen, list(unit), "left")


def product_grid(df: DataFrame, period: str = "period", price: str = "price", *ties: str) -> DataFrame:
    """Latest period first, cheapest first."""
    return df.orderBy(F.desc(period), F.asc(price), *ties)


def cluster_weeks(estimated: DataFrame, cluster: str, value: object, period: str = "period") -> DataFrame:
    """The rows of one cluster in order of the period; names are compared as text."""
    return estimated.where(F.col(cluster).cast("string") == str(value)).orderBy(period)


def missing_price_by(df: DataFrame, by: str, price: str = "price") -> DataFrame:
    """n and missing prices, also in percent, by availability or the like."""
    gone = F.count_if(F.col(price).isNull())
    return df.groupBy(by).agg(F.count("*").alias("n"), gone.alias("n_missing"), (gone * 100.0 / F.count("*")).alias("missing_pct"))


def diverging(transitions: DataFrame, step: float = 1.0) -> DataFrame:
    """Transitions whose real and estimated changes have opposite signs, both beyond ``step`` percent."""
    return transitions.where((F.signum("real_pct") != F.signum("estimated_pct")) & (F.abs("real_pct") > step) & (F.abs("estimated_pct") > step))


def with_dates(df: DataFrame, dates: DataFrame, key: str, date: str) -> DataFrame:
    """``df`` with the date that a lookup table has for its key; null for unknown keys, the latest where it has several."""
    one = dates.groupBy(key).agg(F.max(date).alias(date))
    return df.join(one, key, "left")


def twin_gaps(products: DataFrame, block: str, features: Sequence[str], brand: str = "brand", price: str = "price") -> DataFrame:
    """Each product's nearest product of another brand and the gap of their prices in percent; its median is the brand's premium."""
    from tarifa.operators.ranks import nearest

    named = products.select(F.struct("id", F.col(brand).alias("brand"), F.col(price).alias("price")).alias("id"), block, *dict.fromkeys([*features, brand]))  # prices come with the ids: no join looks them up
    p, q = F.col("query_id.price"), F.col("id.price")
    return nearest(named, named, block, features, 1, brand).select(F.col("query_id.id").alias("query_id"), F.col("id.id").alias("id"), F.col("query_id.brand").alias(brand), ((p - q) / q * 100).alias("gap_pct"))


def models_by_condition(df: DataFrame, continuous: Sequence[str], conditions: Mapping[str, Sequence[str]], key: str = "product", families: Sequence[str] = ("hedonic", "ridge", "random_forest")) -> pd.DataFrame:
    """Test figures of each family under each condition: the further texts (none, a cluster) that join the specifications.

    ``df`` has y and a ``part`` column; the same products are held out everywhere.
    """
    from tarifa.operators import forest
    from tarifa.operators.panel import metrics

    train, test, out = df.where("part = 'train'"), df.where("part = 'test'"), []
    for condition, texts in conditions.items():
        spec = DesignSpec.fit(train, continuous, texts)
        for family in families:
            if family == "random_forest":
                names = [f"x{i}" for i in range(len(spec.names))]
                numbers = lambda rows: rows.withColumns(dict(zip(names, spec.columns())))  # noqa: B023, E731
                model = forest.fit(numbers(train), names, "y", key, trees=(50,), depths=(10,))
                scored = model.transform(forest.assembled(numbers(test), names)).withColumnRenamed("prediction", "__e")
            else:
                model = regression.ols(train, spec, F.col("y"), "nonrobust") if family == "hedonic" else regression.ridge(train, spec, F.col("y"), key)
                scored = test.withColumn("__e", model.predict())
            row = metrics(scored, "y", "__e").first()
            out.append((condition, family, row["n"], row["r2"], row["rmse"], row["mae"]))
    return pd.DataFrame(out, columns=["condition", "family", "n", "r2", "rmse", "mae"])
