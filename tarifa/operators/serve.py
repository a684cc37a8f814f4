"""Price prediction for single products from fitted models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.operators.panel import assign_by_range, fallback_lookup, knn
from tarifa.operators.ranks import per_group
from tarifa.operators.regression import OLS


def week_factor(index: DataFrame, period: str = "period") -> DataFrame:
    """Factor of each period: 1 + (its index - the mean index) / 100."""
    w = Window.partitionBy(F.lit(0))  # a row per period
    return index.select(period, (1 + (F.col("index_pct") - F.avg("index_pct").over(w)) / 100).alias("factor"))


def predict(rows: DataFrame, model: OLS, factor: Column | float = 1.0) -> DataFrame:
    """``rows`` with price, low and high (95 % prediction interval); the model is for the logarithm."""
    y, half = model.predict(), model.interval()
    f = F.lit(factor) if isinstance(factor, float) else factor
    return rows.withColumns({"predicted": F.exp(y) * f, "low": F.exp(y - half) * f, "high": F.exp(y + half) * f})


def assign_cluster(rows: DataFrame, centres: list[list[float]], features: list[str]) -> DataFrame:
    """Nearest centre; ties to the smaller number. The centres are a fitted model's, a handful."""
    gaps = [F.struct(sum(((F.col(f) - c) * (F.col(f) - c) for f, c in zip(features, centre)), F.lit(0.0)).alias("d"), F.lit(i).alias("c")) for i, centre in enumerate(centres)]
    return rows.withColumn("cluster", F.least(*gaps)["c"] if len(gaps) > 1 else F.lit(0))


def assign_segment(rows: DataFrame, ranges: DataFrame, products: DataFrame, features: list[str]) -> DataFrame:
    """Two steps: the brand's tier by provisional price, then the cluster of the nearest product (raw specifications) of that tier."""
    tiered = rows.join(assign_by_range(rows.select("id", "brand", "price"), ranges).select("id", F.col("assigned").alias("tier")), "id")
    key = F.concat_ws("::", "brand", "tier")
    near = knn(tiered.withColumn("block", key), products.withColumn("block", key), "block", features, 1)
    found = near.join(products.select("id", "cluster"), "id").select(F.col("query_id").alias("id"), "cluster")
    return tiered.join(found, "id", "left")


def similar(query: DataFrame, products: DataFrame, features: list[str], k: int = 5, block: str = "category") -> DataFrame:
    """The k most similar products of the category on standardised specifications."""
    stats = products.groupBy(block).agg(*[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features])  # a row per group
    stats = per_group(stats, "similar-stats")  # once, so equal specifications stay equal: the order of a sum may change its last place
    scaled = lambda df: df.join(stats, block).select("id", block, *[((F.col(f) - F.col(f"m_{f}")) / F.when(F.col(f"s_{f}") > 0, F.col(f"s_{f}")).otherwise(1.0)).alias(f) for f in features])
    return knn(scaled(query), scaled(products), block, features, k)


__all__ = ["assign_cluster", "assign_segment", "fallback_lookup", "predict", "similar", "week_factor"]
