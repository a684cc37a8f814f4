"""Writers of tables, splits and reports."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.operators.panel import split


def clean_table(df: DataFrame, path: str, partitions: Sequence[str] = ("semaine", "categorie")) -> None:
    """Parquet by week and category; only partitions that the rows touch are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def csv_export(df: DataFrame, path: str, files: int = 1, mark: bool = True) -> None:
    """CSV with header in UTF-8, with a byte-order mark for spreadsheets; one file by default, for a filtered (small) table."""
    named = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark else df
    named.coalesce(files).write.mode("overwrite").option("header", True).csv(path)


def json_export(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def week_splits(df: DataFrame, path: str, key: str = "url", share: float = 0.2) -> dict[str, int]:
    """full, train and test tables; reruns give the same rows, and no key is on both sides."""
    parts = split(df, key, share, "categorie")
    both = parts.where("part = 'train'").select(key).intersect(parts.where("part = 'test'").select(key))
    if not both.isEmpty():
        raise AssertionError("a key is in train and test")
    df.write.mode("overwrite").parquet(f"{path}/full")
    out = {}
    for name in ("train", "test"):
        own = parts.where(F.col("part") == name).drop("part")
        own.write.mode("overwrite").parquet(f"{path}/{name}")
        out[name] = own.count()
    return out


def replace(df: DataFrame, path: str) -> None:
    """``df`` takes the place of the table under ``path``, which it may be made from.

    It is written beside the table first; then two renames swap them and the old one goes. Readers find one of the two whole; if
    the second rename fails the old table is put back.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{name}", f"{path.rstrip('/')}.old-{name}"
    df.write.parquet(new)
    of = spark._jvm.org.apache.hadoop.fs.Path
    files = of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    there = files.exists(of(path))
    if there and not files.rename(of(path), of(old)):
        files.delete(of(new), True)
        raise OSError(f"{path} could not be moved")
    if not files.rename(of(new), of(path)):
        if there:
            files.rename(of(old), of(path))
        raise OSError(f"{new} could not take the place of {path}")
    files.delete(of(old), True)


def label_files(segmented: DataFrame, prices: DataFrame, path: str, key: str = "product", columns: Sequence[str] = ()) -> None:
    """Each segmented product with its prices of all weeks, in the order of key and week, in place of the table under ``path``.

    Products without a price and prices without a segmented product are left out; the segmentation may be the table that is replaced.
    """
    joined = segmented.join(prices.select(key, "week", "price"), key)
    replace(joined.select(*(columns or joined.columns)).sort(key, "week"), path)


def reports(tables: Mapping[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
