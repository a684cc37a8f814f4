"""Report views over transitions, segments and estimates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CAUSES = ("effectif", "aucune", "prix", "qualite", "prix_et_qualite")


def cause_shares(transitions: DataFrame, cause: str = "cause") -> DataFrame:
    """Percentage of each cause; a cause that never happens has 0."""
    counts = transitions.groupBy(cause).agg(F.count("*").alias("n"))
    every = transitions.sparkSession.createDataFrame([(c,) for c in CAUSES], f"{cause} string")
    rows = every.join(counts, cause, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row per cause
    return rows.withColumn("share_pct", F.coalesce(F.col("n") * 100.0 / F.nullif(total, F.lit(0)), F.lit(0.0)))


def transition_kpis(transitions: DataFrame) -> DataFrame:
    """One row: how many, how many with a change, flagged by the grid, confirmed."""
    moved = ~F.col("cause").isin("aucune", "effectif")
    return transitions.agg(
        F.count("*").alias("n"), F.count_if(moved).alias("n_moved"), F.count_if(F.col("cause") == "effectif").alias("n_composition"), F.count_if("limited").alias("n_limited"), (F.count_if(moved) * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("moved_pct")
    )


def notable(transitions: DataFrame, k: int = 15, significant: Column | None = None) -> DataFrame:
    """The k largest residual gaps, significant ones first."""
    first = significant if significant is not None else F.lit(False)
    return transitions.where("gap_pct IS NOT NULL").orderBy(first.desc(), F.abs("gap_pct").desc(), *[F.col(c) for c in transitions.columns if c not in ("gap_pct",)]).limit(k)


def overview(models: DataFrame, segment: str, families: Sequence[str]) -> DataFrame:
    """One row per segment, a status column per family: kept, not kept or not fitted."""
    status = F.when(F.col("kept"), "kept").when(F.col("fitted"), "not kept").otherwise("not fitted")
    return models.withColumn("status", status).groupBy(segment).pivot("family", list(families)).agg(F.first("status"))


def best_model(estimates: DataFrame, group: str, model: str = "model", error: str = "mape") -> DataFrame:
    """The model with the least error of the last period of each group; ties by name."""
    last = F.max("period").over(Window.partitionBy(group))
    return estimates.withColumn("__l", last).where("period = __l").groupBy(group).agg(F.min_by(model, F.struct(error, model)).alias("best"))


def verdict(price_pct: Column, index_pct: Column, p_value: Column, step: float = 0.5) -> Column:
    """Is a change of the mean price one of prices or of the mix?"""
    real = (p_value < 0.05) & (F.abs(index_pct) > step)
    return F.when(real & (F.abs(price_pct) > step), "prix").when(real, "prix masqué par le mix").when(F.abs(price_pct) > step, "mix").otherwise("stable")


def equation(coefficients: DataFrame, group: str, k: int = 5) -> DataFrame:
    """'a + b·x ...' with the k largest terms and how many are hidden."""
    term = F.concat(F.when(F.col("coefficient") < 0, " - ").otherwise(" + "), F.format_string("%.4f", F.abs("coefficient")), F.lit("·"), F.col("feature"))
    w = Window.partitionBy(group).orderBy(F.abs("coefficient").desc(), "feature")
    rows = coefficients.where("feature <> 'const'").withColumns({"__r": F.row_number().over(w), "__t": term})
    shown = F.array_sort(F.collect_list(F.when(F.col("__r") <= k, F.struct("__r", "__t"))))
    return rows.groupBy(group).agg(F.concat_ws("", F.transform(shown, lambda x: x["__t"])).alias("terms"), F.greatest(F.count("*") - k, F.lit(0)).alias("hidden"))


def sign_agreement(ols: DataFrame, ridge: DataFrame, forest: DataFrame) -> DataFrame:
    """Features of all three models with both coefficients, whether their signs agree, and the importance."""
    a = ols.where("feature <> 'const'").select("feature", F.col("coefficient").alias("ols"))
    joined = a.join(ridge.select("feature", F.col("coefficient").alias("ridge")), "feature").join(forest.select("feature", "importance"), "feature")
    return joined.withColumn("agree", F.signum("ols") == F.signum("ridge"))
