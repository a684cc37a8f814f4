"""Roles of columns and selection by their effect on the price."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tarifa.functions.tails import chi2_upper
from tarifa.operators.panel import average_rank
from tarifa.sources.scratch import written

# Least absolute rank correlation, largest p-value, least observations.
MIN_RHO, MAX_P, MIN_ROWS, MAX_CATEGORIES = 0.10, 0.05, 5, 6


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are null in every row; one pass."""
    filled = df.agg(*[F.count(c).alias(c) for c in df.columns]).first().asDict()
    return df.select(*[c for c in df.columns if filled[c]])


def roles(df: DataFrame, exclude: Sequence[str] = (), continuous: Sequence[str] = (), categorical: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Continuous and categorical columns: by the given names first, then numbers with more than six values are continuous."""
    names = [c for c in df.columns if c not in exclude]
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in names]).first().asDict() if names else {}
    kinds = {f.name: f.dataType for f in df.schema}
    con, cat = [], []
    for c in names:
        if counts[c] <= 1:
            continue
        number = isinstance(kinds[c], NumericType)
        (con if c in continuous or c not in categorical and number and counts[c] > MAX_CATEGORIES else cat).append(c)
    return con, cat


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """The columns with two levels or more, null being a level."""
    counts = df.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit("∅"))).alias(c) for c in columns]).first().asDict()
    return [c for c in columns if counts[c] > 1]


@dataclass
class Effect:
    column: str
    test: str
    n: int
    statistic: float
    p_value: float | None
    kept: bool
    reason: str


def _known(c: str):
    """The column as a number, null where it is missing."""
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def effect_table(df: DataFrame, target: str, continuous: Sequence[str], categorical: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """column, test, n, statistic, p_value, kept and reason of every column (in each group of ``by``), in one plan.

    Spearman against ln(1 + target) for numbers, Kruskal-Wallis with tie correction (over levels of two rows or more) for the others.
    Columns are melted to rows, so ranks, sums and ties are made for all of them at once. A column without any known row is not in
    the table, nor are rows without a group.
    """
    by, y = list(by), F.log1p(_known(target))
    cells = [F.struct(F.lit(c).alias("column"), F.lit("spearman").alias("test"), _known(c).alias("v"), F.lit(None).cast("string").alias("label")) for c in continuous]
    cells += [F.struct(F.lit(c).alias("column"), F.lit("kruskal").alias("test"), F.lit(None).cast("double").alias("v"), F.col(c).cast("string").alias("label")) for c in categorical]
    within = [*by, "column"]
    df = written(df.select(*dict.fromkeys([*by, target, *continuous, *categorical])), "effect-rows")  # what comes next passes over them several times
    long = df.select(*by, y.alias("y"), F.explode(F.array(*cells)).alias("e")).select(*by, "y", "e.*").where("y IS NOT NULL AND NOT isnan(y) AND (v IS NOT NULL OR label IS NOT NULL)")
    levels = long.where("test = 'kruskal'").groupBy(*within, "label").agg(F.count("*").alias("own"))
    large = long.join(levels.where("own > 1").drop("own"), [*within, "label"], "left_semi")
    ranked = written(average_rank(long.where("test = 'spearman'").unionByName(large), "y", "ry", *within), "effect-ranks")

    numbers = average_rank(ranked.where("test = 'spearman'").drop("label"), "v", "rv", *within).groupBy(*within).agg(F.count("*").alias("n"), F.corr("rv", "ry").alias("rho"))
    rho = F.coalesce(F.when(~F.isnan("rho"), F.col("rho")), F.lit(0.0))
    few = F.col("n") < MIN_ROWS
    kept = ~few & (F.abs(rho) >= MIN_RHO)
    numbers = numbers.select(*within, F.lit("spearman").alias("test"), "n", rho.alias("statistic"), F.lit(None).cast("double").alias("p_value"), kept.alias("kept"), F.when(few, "too few rows").when(kept, "kept").otherwise("no effect").alias("reason"))

    ranks = ranked.where("test = 'kruskal'")
    sums = ranks.groupBy(*within, "label").agg(F.sum("ry").alias("s"), F.count("*").alias("c")).withColumn("m", F.sum("c").over(Window.partitionBy(*within)).cast("double"))  # a row per label
    off = F.col("s") - F.col("c") * (F.col("m") + 1) / 2  # exact; the plain formula takes a number as large as m from one that is as large
    sums = sums.groupBy(*within, "m").agg(F.sum(off * off / F.col("c")).alias("ss"), (F.count("*") - 1).alias("df"))
    t = F.col("t")
    ties = ranks.groupBy(*within, "y").agg(F.count("*").cast("double").alias("t")).groupBy(*within).agg(F.sum(t * t * t - t).alias("ties"))
    m = F.col("m")
    h = F.try_divide(12.0 / (m * (m + 1)) * F.col("ss"), 1 - F.try_divide(F.col("ties"), m * m * m - m))
    labels = levels.groupBy(*within).agg(F.sum("own").alias("n")).join(sums, within, "left").join(ties, within, "left").withColumn("h", h)

    @F.pandas_udf("double")
    def upper(h: pd.Series, df: pd.Series) -> pd.Series:  # a value per group and column
        return pd.Series([chi2_upper(a, b) if a == a and b == b else None for a, b in zip(h, df)], dtype="float64")

    good = (F.col("df") >= 1) & (F.col("n") >= MIN_ROWS) & F.col("h").isNotNull()
    labels = labels.withColumn("p", F.when(F.coalesce(good, F.lit(False)), upper("h", F.col("df").cast("double"))))
    kept = F.coalesce(F.col("p") < MAX_P, F.lit(False))
    labels = labels.select(*within, F.lit("kruskal").alias("test"), "n", F.when(F.col("p").isNotNull(), F.col("h")).otherwise(0.0).alias("statistic"), F.col("p").alias("p_value"), kept.alias("kept"), F.when(kept, "kept").when(F.col("p").isNotNull(), "no effect").otherwise("too few rows").alias("reason"))
    return numbers.unionByName(labels)


def effects(df: DataFrame, target: str, continuous: Sequence[str], categorical: Sequence[str]) -> list[Effect]:
    """``effect_table`` of all rows, in the order of the columns."""
    names = {c: "spearman" for c in continuous} | {c: "kruskal" for c in categorical}
    if not names:
        return []
    found = {r["column"]: Effect(**r.asDict()) for r in effect_table(df, target, continuous, categorical).collect()}  # a row per column
    return [found.get(c) or Effect(c, test, 0, 0.0, None, False, "too few rows") for c, test in names.items()]


def select(df: DataFrame, target: str, always_drop: Sequence[str] = (), always_keep: Sequence[str] = (), force_keep: Sequence[str] = ()) -> tuple[list[str], list[Effect]]:
    """Columns to keep, and the report: constant and dropped ones go, kept and forced ones stay, the others need an effect."""
    candidates = [c for c in df.columns if c not in always_drop and c not in always_keep and c != target]
    con, cat = roles(df.select(*candidates)) if candidates else ([], [])
    report = effects(df, target, con, cat)
    chosen = {e.column for e in report if e.kept} | set(force_keep) | set(always_keep)
    return [c for c in df.columns if c in chosen], report
