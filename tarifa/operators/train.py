"""Models of a category: fitted, judged on held-out products, persisted as tables, and loaded again for scoring.

What is persisted is small and readable: JSON documents for designs and clusterings, Parquet tables for coefficients, segment
models, metrics and labelled products, and the forest in MLlib's own format.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tarifa.functions.specs import safe_name
from tarifa.operators import forest, regression, segments
from tarifa.operators.design import DesignSpec
from tarifa.operators.panel import fallback_lookup, metrics, spearman, split, tier_ranges, tiers
from tarifa.operators.views import sign_agreement

FAMILIES = ("hedonic", "ridge", "random_forest")


class ArtifactsMissing(FileNotFoundError):
    """What a category's models are read from isn't there: train it first."""


# -- clustering of a category by its specifications ---------------------------------------------------------------------


@dataclass
class Clustering:
    """K-means on standardised specifications (all levels of texts as 0/1 columns), applied but never fitted again."""

    spec: DesignSpec
    mean: list[float]
    deviation: list[float]
    centres: list[list[float]]

    def check(self, df: DataFrame) -> None:
        """Typed errors for what can't be clustered: an absent column, a text where a number is due, a gap."""
        needed = [*self.spec.continuous, *self.spec.categorical]
        absent = [c for c in needed if c not in df.columns]
        if absent:
            raise KeyError(f"columns for clustering are absent: {', '.join(absent)}")
        texts = [c for c in self.spec.continuous if not isinstance(df.schema[c].dataType, NumericType)]
        if texts:
            raise TypeError(f"columns for clustering are no numbers: {', '.join(texts)}")
        gaps = df.agg(*[F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(c) for c in self.spec.continuous]).first().asDict() if self.spec.continuous else {}
        if any(gaps.values()):
            raise ValueError(f"gaps in columns for clustering: {', '.join(c for c, n in gaps.items() if n)}")

    def assign(self, df: DataFrame, out: str = "cluster", checked: bool = True) -> DataFrame:
        if checked:
            self.check(df)
        x = [(c - m) / (s or 1.0) for c, m, s in zip(self.spec.columns(), self.mean, self.deviation)]
        gaps = [F.struct(sum(((a - F.lit(float(b))) * (a - F.lit(float(b))) for a, b in zip(x, centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("c")) for i, centre in enumerate(self.centres)]
        return df.withColumn(out, F.least(*gaps)["c"] if len(gaps) > 1 else F.lit(0))

    def to_json(self) -> dict:
        return {"continuous": self.spec.continuous, "categorical": self.spec.categorical, "levels": self.spec.levels, "mean": self.mean, "deviation": self.deviation, "centres": self.centres}

    @classmethod
    def from_json(cls, d: dict) -> Clustering:
        return cls(DesignSpec(d["continuous"], d["categorical"], d["levels"], False), d["mean"], d["deviation"], d["centres"])


def fit_clustering(df: DataFrame, continuous: Sequence[str], categorical: Sequence[str]) -> Clustering:
    """The k of the best valid silhouette (one cluster if none is valid), over all rows of the category; prices and brands take no part."""
    spec = DesignSpec.fit(df, continuous, categorical, drop_first=False)
    columns = spec.columns()
    row = df.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    mean, deviation = [row[f"m{i}"] or 0.0 for i in range(len(columns))], [row[f"s{i}"] or 0.0 for i in range(len(columns))]
    vector = array_to_vector(F.array(*[(c - m) / (s or 1.0) for c, m, s in zip(columns, mean, deviation)]))
    rows = df.select(vector.alias("__x")).persist()
    model, _ = segments.distributed_kmeans(rows, columns)
    rows.unpersist()
    centres = sorted(tuple(map(float, c)) for c in model.clusterCenters()) if model else [(0.0,) * len(columns)]
    return Clustering(spec, mean, deviation, [list(c) for c in centres])


# -- fitting ---------------------------------------------------------------------------------------------------------


@dataclass
class CategoryModels:
    spec: DesignSpec
    hedonic: regression.OLS
    ridge: regression.Ridge
    forest: RandomForestRegressionModel | None
    metrics: DataFrame
    agreement: DataFrame | None
    clustering: Clustering
    segments: DataFrame
    ranges: DataFrame
    labelled: DataFrame


def log_price(df: DataFrame, price: str = "price", out: str = "y") -> DataFrame:
    """``out`` is ln(price), null where the price is not above 0; such rows are warned of."""
    bad = df.where(F.col(price) <= 0).count()
    if bad:
        warnings.warn(f"{bad} prices are 0 or less and have no logarithm", stacklevel=2)
    return df.withColumn(out, F.when(F.col(price) > 0, F.ln(price)))


def estimates_of(hedonic: regression.OLS, ridge: regression.Ridge) -> dict[str, Column]:
    return {"hedonic": hedonic.predict(), "ridge": ridge.predict()}


def agreement(hedonic: DataFrame, ridge: DataFrame, importances: DataFrame) -> tuple[DataFrame, dict[str, float | int | None]]:
    """Features of all models side by side; how many, the share of equal signs in percent, and the rank correlation of importance and size."""
    table = sign_agreement(hedonic, ridge, importances)
    row = table.agg(F.count("*").alias("n"), (F.avg(F.col("agree").cast("int")) * 100).alias("pct")).first()
    rho = spearman(table.withColumn("size", F.abs("ols")), "importance", "size").first()["rho"] if row["n"] > 1 else None
    return table, {"n_features": row["n"], "pct_signs_agree": row["pct"], "spearman": rho}


def fit_category(
    df: DataFrame, continuous: Sequence[str], categorical: Sequence[str], key: str = "product", brand: str = "brand", price: str = "price", families: Sequence[str] = FAMILIES,
    trees: Sequence[int] = (100, 200, 400), depths: Sequence[int] = (10, 20),
) -> CategoryModels:
    """All models of one category: by family on its training products, by cluster, and by brand, tier and cluster."""
    df = log_price(df.withColumn("id", F.monotonically_increasing_id()) if "id" not in df.columns else df, price).where("y IS NOT NULL")
    df = split(df, key)
    train = df.where("part = 'train'")
    spec = DesignSpec.fit(train, continuous, [*categorical, brand])
    hedonic, ridge = regression.ols(train, spec, F.col("y")), regression.ridge(train, spec, F.col("y"), key)
    made = {f: c for f, c in estimates_of(hedonic, ridge).items() if f in families}
    out = df.withColumns({f"estimate_{f}": c for f, c in made.items()})
    wood, table = None, None
    if "random_forest" in families:
        names = [f"x{i}" for i in range(len(spec.names))]
        as_numbers = lambda rows: rows.withColumns(dict(zip(names, spec.columns())))
        wood = forest.fit(as_numbers(train), names, "y", key, trees=trees, depths=depths)
        out = wood.transform(forest.assembled(as_numbers(out), names)).withColumnRenamed("prediction", "estimate_random_forest").drop("features", *names)
        spark = df.sparkSession
        named = spark.createDataFrame([(n, float(v)) for n, v in zip(spec.names, wood.featureImportances.toArray())], "feature string, importance double")
        lines = spark.createDataFrame([(n, float(b)) for n, b in zip(hedonic.names, hedonic.beta)], "feature string, coefficient double")
        ridges = spark.createDataFrame([(n, float(b)) for n, b in zip(spec.names, ridge.coefficients)], "feature string, coefficient double")
        table, _ = agreement(lines, ridges, named)
    found = None
    test = out.where("part = 'test'")
    for f in families:
        logs = metrics(test, "y", f"estimate_{f}").select(F.lit(f).alias("family"), "n", F.col("r2").alias("r2_log"), F.col("rmse").alias("rmse_log"), F.col("mae").alias("mae_log"))
        units = metrics(test.withColumn("__e", F.exp(f"estimate_{f}")), price, "__e").select(F.col("r2").alias("r2_price"), F.col("rmse").alias("rmse_price"), F.col("mae").alias("mae_price"))
        one = logs.join(F.broadcast(units))  # single rows
        found = one if found is None else found.union(one)
    clustering = fit_clustering(train, continuous, categorical)
    out = clustering.assign(out, "cluster_n1", checked=False)
    tiered = tiers(df.withColumnsRenamed({brand: "brand", price: "price"}) if (brand, price) != ("brand", "price") else df)
    units = segments.cluster_units(tiered.where("tier IS NOT NULL"), ["brand", "tier"], list(continuous), categorical=list(categorical))
    name = F.concat_ws("::", "brand", "tier", F.concat(F.lit("c"), F.col("cluster")))
    out = out.join(units.where("outcome <> 'too_small'").select("id", name.alias("cluster_n2")), "id", "left")
    models = None
    for level, column in (("n1", "cluster_n1"), ("n2", "cluster_n2")):
        rows = out.where(F.col(column).isNotNull()).withColumn("segment", F.col(column).cast("string"))
        for f in families:
            own = segments.segment_models(rows, "segment", list(continuous), "y", f"estimate_{f}", key, (f,)).withColumn("level", F.lit(level))
            models = own if models is None else models.unionByName(own)
    return CategoryModels(spec, hedonic, ridge, wood, found, table, clustering, models, tier_ranges(tiered), out)


# -- artifacts --------------------------------------------------------------------------------------------------------


def _write_json(spark: SparkSession, value: object, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _read(read, path: str):
    try:
        return read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        raise ArtifactsMissing(f"{path} is not there: train the category first") from e


def _read_json(spark: SparkSession, path: str):
    return json.loads(_read(lambda p: spark.read.text(p), path).first()[0])


def persist(models: CategoryModels, path: str) -> None:
    """Everything that scoring and the views need, under ``path``; what was there is replaced."""
    spark = models.labelled.sparkSession
    spec = models.spec
    _write_json(spark, {"continuous": spec.continuous, "categorical": spec.categorical, "levels": spec.levels, "columns": spec.names}, f"{path}/schema")
    _write_json(spark, models.clustering.to_json(), f"{path}/clustering")
    h = models.hedonic
    _write_json(spark, {"beta": h.beta.tolist(), "inverse": h.inverse.tolist(), "covariance": h.covariance.tolist(), "n": h.n, "ssr": h.ssr, "tss": h.tss, "kind": h.kind}, f"{path}/hedonic")
    _write_json(spark, {"alpha": models.ridge.alpha, "intercept": models.ridge.intercept, "coefficients": models.ridge.coefficients.tolist()}, f"{path}/ridge")
    spark.createDataFrame(h.coefficients().astype(object).where(h.coefficients().notna(), None), "feature string, coefficient double, std_err double, p_value double, pct_effect double").write.mode("overwrite").parquet(f"{path}/coefficients")
    tables = {"metrics": models.metrics, "segments": models.segments.withColumn("folder", safe_name("segment")), "ranges": models.ranges, "labelled": models.labelled}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    if models.agreement is not None:
        models.agreement.write.mode("overwrite").parquet(f"{path}/agreement")
    if models.forest is not None:
        models.forest.write().overwrite().save(f"{path}/forest")


@dataclass
class Loaded:
    """Artifacts of a category, read once."""

    spec: DesignSpec
    hedonic: regression.OLS
    ridge: regression.Ridge
    clustering: Clustering
    segments: DataFrame
    ranges: DataFrame
    labelled: DataFrame


def load(spark: SparkSession, path: str) -> Loaded:
    import numpy as np

    s, h, r = (_read_json(spark, f"{path}/{name}") for name in ("schema", "hedonic", "ridge"))
    spec = DesignSpec(s["continuous"], s["categorical"], s["levels"])
    hedonic = regression.OLS(spec, np.array(h["beta"]), np.array(h["covariance"]), np.array(h["inverse"]), h["n"], h["ssr"], h["tss"], h["kind"])
    ridge = regression.Ridge(spec, r["alpha"], r["intercept"], np.array(r["coefficients"]), {})
    table = lambda name: _read(lambda p: spark.read.parquet(p), f"{path}/{name}")
    return Loaded(spec, hedonic, ridge, Clustering.from_json(_read_json(spark, f"{path}/clustering")), table("segments"), table("ranges"), table("labelled"))


def available(spark: SparkSession, path: str) -> bool:
    """Whether segment models of the category are there."""
    try:
        spark.read.parquet(f"{path}/segments")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return False
    return True


def retained(models: DataFrame, level: str) -> DataFrame:
    """Segment models of a level that beat the category's."""
    return models.where((F.col("level") == level) & F.col("kept"))


def segment_detail(models: DataFrame, level: str, segment: object) -> DataFrame:
    """Every fitted model of one segment, kept or not, a row per family and coefficient."""
    rows = models.where((F.col("level") == level) & (F.col("segment") == str(segment)) & F.col("fitted"))
    return rows.select("family", "kept", "r2", "r2_category", "intercept", F.explode("coefficients").alias("feature", "coefficient"))


def segment_products(labelled: DataFrame, level: str, segment: object) -> DataFrame:
    """The products of one segment; none for an unknown one."""
    return labelled.where(F.col(f"cluster_{level}").cast("string") == str(segment))


# -- scoring -----------------------------------------------------------------------------------------------------------


def encode_row(columns: Sequence[str], continuous: Sequence[str], categorical: Sequence[str], values: Mapping[str, object]) -> dict[str, float]:
    """A hypothetical product as a row of the design: numbers as they are (absent: 0), texts as 0/1 by the longest name that fits."""
    out = {}
    for c in columns:
        if c in continuous or c in categorical:
            out[c] = float(values.get(c) or 0)
            continue
        own = max((n for n in categorical if c.startswith(f"{n}_")), key=len, default=None)
        out[c] = float(own is not None and str(values.get(own, "")) == c[len(own) + 1 :])
    return out


def _linear(rows: DataFrame, models: DataFrame, on: str, out: str, features: Sequence[str]) -> DataFrame:
    """``out``: the estimate by the model that ``on`` names, null without one."""
    own = models.select(F.col("segment").alias("__s"), F.col("intercept").alias("__a"), F.col("coefficients").alias("__b"))
    joined = rows.join(own, F.col(on) == F.col("__s"), "left")
    weight = lambda f: F.coalesce(F.try_element_at("__b", F.lit(f)), F.lit(0.0))
    value = sum((F.col(f).cast("double") * weight(f) for f in features), F.col("__a"))
    return joined.withColumn(out, value).drop("__s", "__a", "__b")


def predict_by_segment(rows: DataFrame, models: DataFrame, category: Column, continuous: Sequence[str], mode: str = "n2", family: str = "hedonic") -> DataFrame:
    """``estimate`` (in logs) and ``source`` of rows with brand, tier, cluster (of the unit) and cluster_n1.

    ``n1``: the cluster's model, else the category's. ``n2``: the model of brand, tier and cluster, else the first of brand and
    tier, else the first of the brand, else the category's; never a cluster's of the other kind. ``models`` are segment
    models; only those that were kept count. Forests have no coefficients: their segments fall to the category.
    """
    if mode not in ("n1", "n2"):
        raise ValueError("mode must be n1 or n2")
    kept = retained(models, mode).where(F.col("family") == family).where("intercept IS NOT NULL")
    if mode == "n1":
        out = _linear(rows.withColumn("__m", F.col("cluster_n1").cast("string")), kept, "__m", "__e", continuous)
        return out.withColumns({"source": F.when(F.col("__e").isNotNull(), "n1").otherwise("categorie"), "estimate": F.coalesce("__e", category)}).drop("__m", "__e")
    named = F.split("segment", "::")
    known = kept.select(named[0].alias("brand"), named[1].alias("tier"), named[2].alias("cluster"), F.col("segment").alias("model"))
    found = fallback_lookup(rows, known)
    out = _linear(found, kept, "model", "__e", continuous)
    return out.withColumns({"estimate": F.coalesce("__e", category), "source": F.col("level")}).drop("model", "level", "__e")


def score_labelled(labelled: DataFrame, models: DataFrame, continuous: Sequence[str], families: Sequence[str] = FAMILIES) -> DataFrame:
    """``scored_`` and ``source_`` of each family for labelled products: the model of the unit, else of the cluster, else the category's."""
    out = labelled
    for f in families:
        own = models.where(F.col("family") == f)
        fine, coarse = (own.where(F.col("level") == level).select(F.col("segment").alias(f"cluster_{level}"), "kept", "intercept", "coefficients").where("intercept IS NOT NULL") for level in ("n2", "n1"))
        rows = out.withColumn("__n1", F.col("cluster_n1")).withColumn("cluster_n1", F.col("cluster_n1").cast("string"))
        rows = segments.score_cascade(rows, fine, coarse, "cluster_n2", "cluster_n1", continuous, f"estimate_{f}")
        out = rows.withColumn("cluster_n1", F.col("__n1")).drop("__n1").withColumnsRenamed({"scored": f"scored_{f}", "source": f"source_{f}"})
    return out


def similar_in_week(query: DataFrame, products: DataFrame, features: list[str], k: int = 5, week: int | None = None, period: str = "period", block: str = "category") -> DataFrame:
    """The most similar products of one week; of all weeks where that week has none, or none is named."""
    from tarifa.operators.serve import similar

    own = products.where(F.col(period) == week) if week is not None else products
    return similar(query, products if own.isEmpty() else own, features, k, block)
