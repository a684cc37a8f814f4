"""Random forest regression with grouped cross-validation, and permutation importance."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.sources.scratch import written


def assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df)


def fit(df: DataFrame, features: Sequence[str], target: str, group: str, trees: Sequence[int] = (100, 200, 400), depths: Sequence[int] = (10, 20), folds: int = 5, seed: int = 42) -> RandomForestRegressionModel:
    """The forest of the grid with the best mean R2; all rows of a group are in one fold."""
    rows = assembled(df, features).withColumn("fold", F.pmod(F.xxhash64(F.col(group)), F.lit(folds)).cast("int"))
    forest = RandomForestRegressor(featuresCol="features", labelCol=target, featureSubsetStrategy="all", seed=seed)
    grid = ParamGridBuilder().addGrid(forest.numTrees, list(trees)).addGrid(forest.maxDepth, list(depths)).build()
    if len(grid) == 1:
        return forest.fit(rows, grid[0])
    check = RegressionEvaluator(labelCol=target, metricName="r2")
    return CrossValidator(estimator=forest, estimatorParamMaps=grid, evaluator=check, foldCol="fold", numFolds=folds, parallelism=2).fit(rows).bestModel


def importances(model: RandomForestRegressionModel, features: Sequence[str]) -> pd.DataFrame:
    out = pd.DataFrame({"feature": list(features), "importance": model.featureImportances.toArray()})
    return out.sort_values(["importance", "feature"], ascending=[False, True], ignore_index=True)


def numbered(df: DataFrame, name: str = "__n") -> tuple[DataFrame, int]:
    """``df`` with its rows numbered from 0 on without gaps, and their number: partitions count theirs, one row each gives the offsets."""
    rows = written(df.withColumn("__m", F.monotonically_increasing_id()), "numbered")
    rows = rows.withColumns({"__p": F.shiftright("__m", 33), "__i": F.col("__m").bitwiseAND((1 << 33) - 1)})
    sizes = rows.groupBy("__p").agg(F.count("*").alias("__c"))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    placed = rows.join(F.broadcast(sizes.select("__p", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))), "__p")
    return placed.withColumn(name, F.col("__i") + F.col("__o")).select(*df.columns, name), sizes.agg(F.sum("__c")).first()[0] or 0


def shuffled_number(number: Column, n: int, key: int) -> Column:
    """A keyed bijection of 0 to ``n`` - 1: a Feistel network of four rounds on a rectangle that is a little larger, walked until inside."""
    wide = max(1, math.isqrt(max(n - 1, 0)) + 1)
    high = max(1, -(-n // wide))

    @F.pandas_udf("long")
    def shuffled(v: pd.Series) -> pd.Series:
        def hashed(x: np.ndarray, turn: int) -> np.ndarray:
            with np.errstate(over="ignore"):
                z = x.astype(np.uint64) + np.uint64((key * 4 + turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                return (z ^ (z >> np.uint64(31))) >> np.uint64(1)

        out = v.to_numpy(np.int64).copy()
        walking = np.ones(len(out), bool)
        while walking.any():
            a, b = np.divmod(out[walking], wide)
            for turn in (0, 2):
                a = (a + hashed(b, turn).astype(np.int64) % high) % high
                b = (b + hashed(a, turn + 1).astype(np.int64) % wide) % wide
            out[walking] = a * wide + b
            walking = out >= n
        return pd.Series(out)

    return shuffled(number)


def permuted(rows: DataFrame, n: int, column: str, key: int, name: str = "__n") -> DataFrame:
    """``rows``, numbered by ``name``, with the values of ``column`` in another order: every value stays, as often as it was."""
    values = rows.select(F.col(name).alias("__from"), F.col(column).alias("__value"))
    moved = rows.withColumn("__from", shuffled_number(F.col(name), n, key)).join(values, "__from")
    return moved.select(*[F.col("__value").alias(c) if c == column else F.col(c) for c in rows.columns])


def permutation_importance(model: RandomForestRegressionModel, df: DataFrame, features: Sequence[str], target: str, repeats: int = 10, seed: int = 42) -> pd.DataFrame:
    """Mean and deviation of the loss in R2 when a column is shuffled among the (test) rows."""
    rows, n = numbered(df.select(*features, target))
    check = RegressionEvaluator(labelCol=target, metricName="r2")
    base = check.evaluate(model.transform(assembled(rows, features)))
    out = []
    for i, f in enumerate(features):
        lost = pd.Series([base - check.evaluate(model.transform(assembled(permuted(rows, n, f, seed + i * repeats + r), features))) for r in range(repeats)])
        out.append((f, float(lost.mean()), float(lost.std(ddof=0))))
    return pd.DataFrame(out, columns=["feature", "importance_mean", "importance_std"]).sort_values("importance_mean", ascending=False, ignore_index=True)
