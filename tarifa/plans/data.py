"""The driver tables seen as a product panel, in Spark and as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.operators.clean import latest


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("product"), F.year("l_shipdate").cast("long").alias("period"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("quantity"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("flag"), "l_shipdate", "l_orderkey", "l_linenumber",
    )
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("product"), F.col("p_type").alias("category"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return items.join(parts, "product")


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation per product and period."""
    return latest(observations(spark, sf_dir), ["product", "period"], "l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate", "l_orderkey", "l_linenumber")


OBSERVATIONS = """observations AS (
  SELECT l_partkey AS product, year(l_shipdate) AS period, l_extendedprice AS price, l_quantity AS quantity, l_discount AS discount, l_tax AS tax,
         l_returnflag AS flag, l_shipdate, l_orderkey, l_linenumber, p_type AS category, p_brand AS brand, p_size AS size
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""
PANEL = (
    OBSERVATIONS
    + """, panel AS (
  SELECT product, period, price, quantity, discount, tax, flag, category, brand, size FROM (
    SELECT *, row_number() OVER (PARTITION BY product, period ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) AS rn FROM observations) x WHERE rn = 1)"""
)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_partkey").alias("product"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"), F.col("p_type").alias("category"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"),
    )


PARTS = "parts AS (SELECT p_partkey AS id, p_partkey AS product, p_name AS name, p_brand AS brand, p_type AS category, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part)"
