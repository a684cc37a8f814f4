"""Clustering of units, stability, bootstrap and per-segment models.

A unit (a brand and tier, a segment) mostly has tens to a few thousand rows: up to ``MAX_UNIT`` rows it is clustered within one task. Larger
ones are clustered together by sums over all tasks (``clusters``), with the same results. Linear models of segments come from sums, so
segments may be of any size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.operators import clusters
from tarifa.operators.design import DesignSpec
from tarifa.operators.regression import ALPHAS, _ridge, _summed, fold_of
from tarifa.sources.scratch import written

#: Rows of a unit that one task takes.
MAX_UNIT = 20_000
MAX_K = clusters.MAX_K


def _by_size(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[tuple]]:
    """Rows of the units that one task takes, and the keys of the larger ones (of which there is one per ``MAX_UNIT`` rows at most)."""
    large = [tuple(r[k] for k in keys) for r in df.groupBy(*keys).count().where(F.col("count") > MAX_UNIT).collect()]
    if not large:
        return df, []
    names = df.sparkSession.createDataFrame(large, df.select(*keys).schema)
    return df.alias("r").join(F.broadcast(names).alias("n"), F.expr(" AND ".join(f"r.`{k}` <=> n.`{k}`" for k in keys)), "left_anti"), large


def scaled_vectors(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """``df`` with ``__x``: the features with their mean taken off, over their population deviation, as a vector."""
    from pyspark.ml.functions import array_to_vector

    stats = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    scaled = [(F.col(f).cast("double") - (stats[f"m{i}"] or 0.0)) / (stats[f"s{i}"] or 1.0) for i, f in enumerate(features)]
    return df.withColumn("__x", array_to_vector(F.array(*scaled)))


def distributed_kmeans(df: DataFrame, features: Sequence[str], ks: Sequence[int] = range(2, MAX_K + 1), seed: int = 42):
    """(model or None, trace): K-means of the valid k with the best silhouette over rows of any number; ``df`` has ``__x``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    n = df.count()
    least, best, best_s, trace = max(5, round(0.03 * n)), None, -1.0, []
    check = ClusteringEvaluator(featuresCol="__x", predictionCol="__c")
    for k in ks:
        model = KMeans(k=k, seed=seed, featuresCol="__x", predictionCol="__c", maxIter=50).fit(df)
        sizes = model.summary.clusterSizes
        found = sum(x > 0 for x in sizes)
        s = check.evaluate(model.transform(df)) if found > 1 else None
        valid = found == k and min(sizes) >= least
        trace.append((k, found, min(sizes) if found > 1 else 0, s, valid, float(model.summary.trainingCost)))
        if valid and s > best_s:
            best, best_s = model, s
    return best, trace


def _units(df: DataFrame, keys: list[str], features: Sequence[str], schema: str, small, large, replicates: int = 0) -> DataFrame:
    """Rows of ``schema`` for each unit: ``small(key, unit, x, h)`` for those that one task takes, ``large(units)`` for waves of the others."""

    def run(key: tuple, u: pd.DataFrame) -> pd.DataFrame:
        x, h = u[list(features)].to_numpy(float), u["__h"].to_numpy().view(np.uint64)
        return small(key, u, clusters.on_grid(x), h)

    rows = written(df.select("id", *keys, *features), "units")
    own, names = _by_size(rows, keys)
    out = clusters.spread(own.withColumn("__h", F.xxhash64("id")), *keys).groupBy(*keys).applyInPandas(run, schema)
    for at in range(0, len(names), clusters.WAVE):
        wave = df.sparkSession.createDataFrame([(*n, i) for i, n in enumerate(names[at : at + clusters.WAVE])], f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.select(*keys).schema)}, unit int")
        units = clusters.Large.of(rows, wave, keys, features, replicates)
        sizes = {r["unit"]: r["count"] for r in units.rows.groupBy("unit").count().collect()}  # a row per unit of the wave
        out = out.unionByName(large(units, wave, sizes))
    return out


def _kinds(df: DataFrame, names: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join(f"{c} {kinds[c]}" for c in names)


def with_dummies(df: DataFrame, unit: Sequence[str], features: Sequence[str], categorical: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """id, the unit and all coordinates: numbers, and a 0/1 column for each level of the texts."""
    if not categorical:
        return df, list(features)
    spec = DesignSpec.fit(df, features, categorical, drop_first=False)
    names = [f"__x{i}" for i in range(len(spec.names))]
    return df.select("id", *unit, *[c.alias(n) for c, n in zip(spec.columns(), names)]), names


def cluster_units(df: DataFrame, unit: Sequence[str], features: Sequence[str], least: int = 10, categorical: Sequence[str] = ()) -> DataFrame:
    """id, unit, cluster and outcome (clustered, no_structure, too_small) of every row; clusters in order of their centres.

    Rows lie where their numbers and the levels of their ``categorical`` columns put them.
    """
    df, features = with_dummies(df, unit, features, categorical)
    keys, d = list(unit), len(features)
    schema = f"{_kinds(df, ['id', *keys])}, cluster int, outcome string"

    def small(key: tuple, u: pd.DataFrame, x: np.ndarray, h: np.ndarray) -> pd.DataFrame:
        labels, outcome = np.zeros(len(u), int), "too_small"
        if len(u) >= least:
            _, _, centres = clusters.locally(clusters.choose(len(x), d), x, h)
            outcome = "no_structure" if centres is None else "clustered"
            labels = labels if centres is None else clusters.assign(x, centres)
        return u[["id", *keys]].assign(cluster=labels.astype("int32"), outcome=outcome)

    def large(units: clusters.Large, names: DataFrame, sizes: dict[int, int]) -> DataFrame:
        centres = {u: c for u, (_, _, c) in units.run({u: clusters.choose(n, d) for u, n in sizes.items()}).items()}

        @F.pandas_udf("int")
        def label(unit: pd.Series, x: pd.Series) -> pd.Series:
            out = pd.Series(np.zeros(len(unit), np.int32))
            for u in unit.unique():
                if centres[u] is not None:
                    at = (unit == u).to_numpy()
                    out[at] = clusters.assign(np.stack(x[at].to_numpy()), centres[u])
            return out

        plain = [u for u, c in centres.items() if c is None]
        rows = units.rows.select("id", "unit", label("unit", "x").alias("cluster"), F.when(F.col("unit").isin(plain), "no_structure").otherwise("clustered").alias("outcome"))
        return rows.join(F.broadcast(names), "unit").select("id", *keys, "cluster", "outcome")

    return _units(df, keys, features, schema, small, large)


def k_trace(df: DataFrame, unit: Sequence[str], features: Sequence[str], least: int = 10, categorical: Sequence[str] = ()) -> DataFrame:
    """A row per unit and k: clusters found, smallest size, silhouette, valid, inertia, chosen."""
    df, features = with_dummies(df, unit, features, categorical)
    keys, d = list(unit), len(features)
    columns = ["k", "n_clusters", "least_size", "silhouette", "valid", "inertia"]
    schema = f"{_kinds(df, keys)}, k int, n_clusters int, least_size int, silhouette double, valid boolean, inertia double, chosen boolean"

    def small(key: tuple, u: pd.DataFrame, x: np.ndarray, h: np.ndarray) -> pd.DataFrame:
        k, trace, _ = clusters.locally(clusters.choose(len(x), d), x, h) if len(u) >= least else (1, [], None)
        out = pd.DataFrame(trace, columns=columns)
        for name, value in zip(reversed(keys), reversed(key)):
            out.insert(0, name, value)
        return out.assign(chosen=out.k == k)

    def large(units: clusters.Large, names: DataFrame, sizes: dict[int, int]) -> DataFrame:
        found = units.run({u: clusters.choose(n, d) for u, n in sizes.items()})
        rows = df.sparkSession.createDataFrame([(u, *t, t[0] == k) for u, (k, trace, _) in found.items() for t in trace], "unit int, " + schema.removeprefix(_kinds(df, keys)).lstrip(", "))
        return rows.join(F.broadcast(names), "unit").select(*keys, *columns, "chosen")

    return _units(df, keys, features, schema, small, large)


def stability(df: DataFrame, unit: Sequence[str], features: Sequence[str], replicates: int = 100, least: int = 10, categorical: Sequence[str] = ()) -> DataFrame:
    """Mean and deviation of the adjusted Rand index between each unit's clusters and refits on bootstrap replicates of all its rows."""
    df, features = with_dummies(df, unit, features, categorical)
    keys, d = list(unit), len(features)
    schema = f"{_kinds(df, keys)}, n int, k int, ari_mean double, ari_sd double, n_valid int"

    def row(n: int, k: int, found: list[float]) -> tuple:
        return n, k, float(np.mean(found)) if found else None, float(np.std(found)) if found else None, len(found)

    def small(key: tuple, u: pd.DataFrame, x: np.ndarray, h: np.ndarray) -> pd.DataFrame:
        k, found = clusters.locally(clusters.judged(len(x), d, replicates), x, h) if len(u) >= least else (1, [])
        return pd.DataFrame([(*key, *row(len(u), k, found))], columns=[*keys, "n", "k", "ari_mean", "ari_sd", "n_valid"])

    def large(units: clusters.Large, names: DataFrame, sizes: dict[int, int]) -> DataFrame:
        found = units.run({u: clusters.judged(n, d, replicates) for u, n in sizes.items()})
        rows = df.sparkSession.createDataFrame([(u, *row(sizes[u], *r)) for u, r in found.items()], "unit int, n int, k int, ari_mean double, ari_sd double, n_valid int")
        return rows.join(F.broadcast(names), "unit").select(*keys, "n", "k", "ari_mean", "ari_sd", "n_valid")

    return _units(df, keys, features, schema, small, large, replicates)


#: Modulus of the hashes that weights are drawn from, and the shares of it below which a Poisson draw (mean 1) is 0, at most 1, ...
_PRIME = (1 << 31) - 1
POISSON = [int(sum(1 / math.factorial(i) for i in range(k + 1)) / math.e * _PRIME) for k in range(10)]


def sides(df: DataFrame, group: Sequence[str], period: str = "period") -> DataFrame:
    """Each row once for the change from its period to the group's next available one (side 0) and once for the change to its own (side 1).

    ``t`` is the earlier period of the change, whatever lies between; the first and the last period have one change each.
    """
    keys, rest = list(group), [c for c in df.columns if c not in (*group, period)]
    w = Window.partitionBy(*keys).orderBy(period)
    places = df.select(*keys, period).distinct().withColumns({"__next": F.lead(period).over(w), "__prior": F.lag(period).over(w)})  # a row per group and period
    same = F.expr(" AND ".join(f"r.`{c}` <=> p.`{c}`" for c in (*keys, period)))
    rows = df.alias("r").join(places.alias("p"), same).select(*[F.col(f"r.`{c}`") for c in (*keys, period, *rest)], "__next", "__prior")
    changes = F.array(F.when(F.col("__next").isNotNull(), F.struct(F.col(period).alias("t"), F.lit(0).alias("side"))), F.when(F.col("__prior").isNotNull(), F.struct(F.col("__prior").alias("t"), F.lit(1).alias("side"))))
    return rows.withColumn("__c", F.explode(F.array_compact(changes))).select(*keys, "__c.t", "__c.side", *rest)


def bootstrap_gap(df: DataFrame, group: Sequence[str], row: str, n_boot: int = 1000, ci: float = 0.95) -> DataFrame:
    """For columns ``side`` (0 before, 1 after), real and estimated price: interval and two-sided p-value of the gap between the real
    and the estimated change of the geometric mean.

    Every row counts in each replicate as often as a Poisson draw with mean 1 says, real and estimate together: in sum the
    same as drawing rows with replacement, but by one aggregation over rows of any number. The draw comes from the MD5 of group,
    side and ``row`` (which tells rows of a group's side apart) and the replicate's number. A replicate in which a side has no row
    is left out; a side with fewer than two rows gives nulls.
    """
    keys = list(group)
    bits = F.md5(F.concat_ws("|", F.lit("gap"), *[F.col(c).cast("string") for c in (*keys, "side", row)]))
    part = lambda at: F.conv(F.substring(bits, at, 8), 16, 10).cast("long")
    log = lambda c: F.ln(F.col(c).cast("double"))
    rows = df.select(*keys, "side", log("real").alias("__a"), log("estimated").alias("__b"), (part(1) % _PRIME).alias("__s1"), (part(9) % (_PRIME - 1) + 1).alias("__s2"))
    counts = rows.groupBy(*keys).agg(F.least(F.count_if(F.col("side") == 0), F.count_if(F.col("side") == 1)).alias("__least"))
    draws = rows.withColumn("__r", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1)))) if n_boot > 0 else rows.limit(0).withColumn("__r", F.lit(0))
    u = f"pmod(__s1 + __r * __s2, {_PRIME}L)"
    draws = draws.withColumn("__u", F.expr(u)).withColumn("__w", sum((F.when(F.col("__u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0)))
    mean = lambda c, side: F.sum(F.when(F.col("side") == side, F.col("__w") * F.col(c))) / F.nullif(F.sum(F.when(F.col("side") == side, F.col("__w"))), F.lit(0))
    change = lambda c: F.exp(mean(c, 1) - mean(c, 0))
    gaps = draws.where("__w > 0").groupBy(*keys, "__r").agg(((change("__a") - change("__b")) * 100).alias("__gap")).where("__gap IS NOT NULL")
    found = gaps.groupBy(*keys).agg(F.percentile("__gap", [(1 - ci) / 2, (1 + ci) / 2]).alias("__q"), F.avg((F.col("__gap") >= 0).cast("int")).alias("__above"))  # n_boot values a group
    same = F.expr(" AND ".join(f"c.`{k}` <=> f.`{k}`" for k in keys))
    out = counts.alias("c").join(found.alias("f"), same, "left").select(
        *[F.col(f"c.`{k}`") for k in keys],
        *[F.when(F.col("__least") >= 2, F.round(v, n)).alias(name) for name, v, n in (("low", F.col("__q")[0], 2), ("high", F.col("__q")[1], 2), ("p_value", F.least(F.lit(1.0), 2 * F.least("__above", 1 - F.col("__above"))), 4))],
    )
    significant = ((F.col("low") > 0) | (F.col("high") < 0)) & (F.col("p_value") < 0.05)
    return out.withColumn("significant", F.coalesce(significant, F.lit(False)))


#: Rows per predictor that a family of models needs.
MIN_RATIO = {"hedonic": 10, "ridge": 5, "random_forest": 5}
_MODEL = "n long, n_predictors int, fitted boolean, r2 double, r2_category double, kept boolean, intercept double, coefficients map<string,double>"


def _linear(grams: dict[str, np.ndarray], names: list[str], family: str) -> tuple[list[str], float | None, np.ndarray | None]:
    """Predictors that vary, intercept and slopes from the Gram matrix of each fold; None with too few rows."""
    total = sum(grams.values())
    n, p = total[0, 0], len(names)
    spread = np.diag(total)[1 : p + 1] - total[0, 1 : p + 1] ** 2 / n
    at = np.flatnonzero(spread > 1e-9 * np.maximum(np.diag(total)[1 : p + 1], 1))
    use = [names[i] for i in at]
    if not use or n < MIN_RATIO[family] * len(use):
        return use, None, None
    places = np.concatenate(([0], at + 1, [p + 1]))
    own = {f: g[np.ix_(places, places)] for f, g in grams.items()}
    whole, k = sum(own.values()), len(use)
    if family == "hedonic":
        beta = np.linalg.pinv(whole[: k + 1, : k + 1], hermitian=True) @ whole[: k + 1, k + 1]
        return use, float(beta[0]), beta[1:]

    def loss(alpha: float) -> float:
        out = 0.0
        for g in own.values():
            if (whole - g)[0, 0] < 1:
                continue
            beta = np.append(*_ridge(whole - g, alpha))
            out += g[k + 1, k + 1] - 2 * beta @ g[: k + 1, k + 1] + beta @ g[: k + 1, : k + 1] @ beta
        return out

    return use, *_ridge(whole, min(ALPHAS, key=loss))


def segment_models(df: DataFrame, segment: str, features: Sequence[str], target: str, estimate: str, key: str = "product", families: Sequence[str] = tuple(MIN_RATIO), grid: Sequence[tuple[int, int | None]] = ((100, 10),)) -> DataFrame:
    """Models per segment and family, kept if they beat the category model on the segment's test rows.

    ``df`` has a ``part`` column (train, test), the target in logs and the category model's ``estimate`` for it. One row per
    segment and family: n, predictors, whether it was fitted, R2 on test of both, kept, intercept and coefficients (a forest has
    importances instead). Linear families are solved from one pass of sums per segment and fold; only these reach the driver.
    """
    names, spark = list(features), df.sparkSession
    p = len(names)
    kind = df.schema[segment].dataType.simpleString()
    every = {r[segment]: r["n"] for r in df.groupBy(segment).agg(F.count("*").alias("n")).collect()}  # a row per segment
    label = F.coalesce(F.col(segment).cast("string"), F.lit("\0"))
    x = F.array(F.lit(1.0), *[F.col(f).cast("double") for f in names])
    # without a key rows are their own: equal ones share a fold
    fold = fold_of(key) if key in df.columns else F.pmod(F.xxhash64(*names, target), F.lit(5))
    train = df.where("part = 'train'").select(label.alias("s"), fold.cast("string").alias("f"), x.alias("x"), F.col(target).cast("double").alias("y")).where("y IS NOT NULL")

    def partial(b) -> np.ndarray:
        z = np.column_stack([b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, p + 1), b.column(3).to_numpy(zero_copy_only=False)])
        return z.T @ z

    grams: dict[str, dict[str, np.ndarray]] = {}
    for (s, f), g in _summed(train, partial, (p + 2, p + 2), by=("s", "f")).items():
        grams.setdefault(s, {})[f] = g
    rows = []
    for s, n in every.items():
        for family in [f for f in families if f != "random_forest"]:
            own = grams.get("\0" if s is None else str(s))
            use, a, b = _linear(own, names, family) if own else ([], None, None)
            rows.append((s, family, n, len(use), a is not None, a, dict(zip(use, map(float, b))) if b is not None else None))
    fitted = spark.createDataFrame(rows, f"{segment} {kind}, family string, n long, n_predictors int, fitted boolean, intercept double, coefficients map<string,double>")
    weight = lambda f: F.coalesce(F.try_element_at("m.coefficients", F.lit(f)), F.lit(0.0))
    made = sum((F.col(f"t.{f}").cast("double") * weight(f) for f in names), F.col("m.intercept"))
    test = df.where("part = 'test'").alias("t").join(fitted.where("fitted").alias("m"), F.col(f"t.{segment}").eqNullSafe(F.col(f"m.{segment}")))
    out = fitted.join(_r2(test.select(F.col(f"m.{segment}").alias("__s"), F.col("m.family").alias("__f"), F.col(f"t.{target}").alias("y"), made.alias("e"), F.col(f"t.{estimate}").alias("c"))), F.col(segment).eqNullSafe(F.col("__s")) & (F.col("family") == F.col("__f")), "left")
    out = out.withColumn("kept", F.coalesce(F.col("r2") > F.col("r2_category"), F.lit(False)))
    columns = [segment, "family", *(c.split()[0] for c in _MODEL.replace("map<string,double>", "map").split(", "))]
    out = out.select(*columns)
    return out.unionByName(segment_forests(df, segment, names, target, estimate, key, grid)[0].select(*columns)) if "random_forest" in families else out


def _r2(rows: DataFrame) -> DataFrame:
    """R2 of ``e`` and of ``c`` for ``y`` by ``__s`` and ``__f``; null without spread."""
    of = lambda v: F.sum((F.col("y") - F.col(v)) * (F.col("y") - F.col(v)))
    found = rows.groupBy("__s", "__f").agg(F.count("*").alias("k"), (F.var_pop("y") * F.count("*")).alias("t"), of("e").alias("a"), of("c").alias("b"))
    good = (F.col("k") > 1) & (F.col("t") > 1e-12)
    return found.select("__s", "__f", F.when(good, 1 - F.col("a") / F.col("t")).alias("r2"), F.when(good, 1 - F.col("b") / F.col("t")).alias("r2_category"))


def segment_forests(df: DataFrame, segment: str, features: Sequence[str], target: str, estimate: str, key: str = "product", grid: Sequence[tuple[int, int | None]] = ((100, 10),)) -> tuple[DataFrame, DataFrame]:
    """The random-forest rows of ``segment_models`` (importances in ``coefficients``), and the nodes of all forests that are kept.

    With more than one (trees, depth) in ``grid`` each segment takes the one with the best R2 over grouped folds; the forests of a grid are
    prefixes of one, so they are grown once a fold.
    """
    from tarifa.operators import forests

    names = list(features)
    rows = df.withColumn("__k", F.col(key).cast("string") if key in df.columns else F.xxhash64(*names, target).cast("string"))
    train = rows.where((F.col("part") == "train") & F.col(target).isNotNull())
    varies = [(F.min(f) != F.max(f)).cast("int") for f in names]
    counts = train.groupBy(segment).agg(F.count("*").alias("__n"), sum((F.coalesce(v, F.lit(0)) for v in varies), F.lit(0)).alias("n_predictors"))
    every = rows.groupBy(segment).agg(F.count("*").alias("n"))
    same = F.col(f"a.{segment}").eqNullSafe(F.col(f"b.{segment}"))
    found = every.alias("a").join(counts.alias("b"), same, "left").select(f"a.{segment}", "n", F.coalesce("n_predictors", F.lit(0)).alias("n_predictors"), F.coalesce((F.col("n_predictors") > 0) & (F.col("__n") >= MIN_RATIO["random_forest"] * F.col("n_predictors")), F.lit(False)).alias("fitted"))
    found = written(found, "forest-segments")
    train = train.alias("a").join(F.broadcast(found.where("fitted")).alias("b"), same, "left_semi")
    trees, depths = max(t for t, _ in grid), [d for _, d in grid]
    deepest = None if None in depths else max(depths)
    best = forests.choose(train, segment, names, target, "__k", grid) if len(grid) > 1 else None
    nodes = forests.fit(train, segment, names, target, "__k", trees, deepest)
    test = forests.estimate(rows.where("part = 'test'"), nodes, segment, names, "__e", grid)
    test = test.select(F.col(segment).alias("__s"), F.lit("random_forest").alias("__f"), F.col(target).alias("y"), "__e", F.col(estimate).alias("c"))
    if best is None:
        test = test.withColumn("e", F.col("__e")[0])
    else:
        test = test.alias("a").join(best.alias("b"), F.col("a.__s").eqNullSafe(F.col("b.segment")), "left").withColumn("e", F.get("__e", F.col("best")))
    judged = _r2(test.where("e IS NOT NULL"))
    out = found.join(judged, F.col(segment).eqNullSafe(F.col("__s")), "left").drop("__s", "__f")
    shares = forests.importances(nodes, names).withColumnRenamed("segment", "__s")
    out = out.join(shares, F.col(segment).eqNullSafe(F.col("__s")), "left").withColumns({"kept": F.coalesce(F.col("r2") > F.col("r2_category"), F.lit(False)), "family": F.lit("random_forest"), "intercept": F.lit(None).cast("double"), "coefficients": F.col("importances")})
    out = written(out.select(segment, "family", *(c.split()[0] for c in _MODEL.replace("map<string,double>", "map").split(", "))), "forest-models")
    kept = out.where("kept").select(F.col(segment).alias("__s"))
    nodes = nodes.join(kept, F.col("segment").eqNullSafe(F.col("__s")), "left_semi")
    if best is not None:  # only what the chosen point of the grid uses
        limits = F.create_map(*[F.lit(x) for i, (t, d) in enumerate(grid) for x in (i, F.struct(F.lit(t).alias("t"), F.lit(61 if d is None else d).alias("d")))])
        chosen = best.select(F.col("segment").alias("__s"), F.element_at(limits, F.col("best")).alias("__g"))
        level = F.length(F.conv(F.col("node").cast("string"), 10, 2)) - 1
        nodes = nodes.join(chosen, F.col("segment").eqNullSafe(F.col("__s"))).where((F.col("tree") <= F.col("__g.t")) & (level <= F.col("__g.d")))
        nodes = nodes.withColumn("feature", F.when(level < F.col("__g.d"), F.col("feature"))).drop("__s", "__g")
    return out, nodes


def score_cascade(
    df: DataFrame, fine: DataFrame, coarse: DataFrame, segment_fine: str, segment_coarse: str, features: Sequence[str], estimate: str, fine_nodes: DataFrame | None = None, coarse_nodes: DataFrame | None = None
) -> DataFrame:
    """``scored`` from the kept model of the fine segment, else of the coarse one, else the category's ``estimate``; and its ``source``.

    The models are of one family. Linear ones score by their coefficients, forests by their nodes (those of the kept ones).
    """
    from tarifa.operators import forests

    def with_model(rows: DataFrame, models: DataFrame, key: str, out: str, nodes: DataFrame | None) -> DataFrame:
        if nodes is not None:
            return forests.estimate(rows, nodes, key, features, out).withColumn(out, F.col(out)[0])
        kept = models.where("kept").select(F.col(key).alias(f"__{out}"), F.col("intercept").alias(f"__a{out}"), F.col("coefficients").alias(f"__b{out}"))
        joined = rows.join(kept, F.col(key) == F.col(f"__{out}"), "left")
        weight = lambda f: F.coalesce(F.try_element_at(f"__b{out}", F.lit(f)), F.lit(0.0))
        value = sum((F.col(f) * weight(f) for f in features), F.col(f"__a{out}"))
        return joined.withColumn(out, value).drop(f"__{out}", f"__a{out}", f"__b{out}")

    rows = with_model(with_model(df, fine, segment_fine, "p2", fine_nodes), coarse, segment_coarse, "p1", coarse_nodes)
    source = F.when(F.col("p2").isNotNull(), "n2").when(F.col("p1").isNotNull(), "n1").otherwise("categorie")
    return rows.withColumns({"scored": F.coalesce("p2", "p1", estimate), "source": source}).drop("p1", "p2")
