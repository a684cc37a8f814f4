"""Tables between the jobs of one operator."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where driver and executors are one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tarifa.tables.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarifa-tables-")
        spark.conf.set("tarifa.tables.dir", where)
    return where.rstrip("/")


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """What tasks read a file of the shared folder with, and its path there."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    return pafs.FileSystem.from_uri(path)


def written_at(df: DataFrame, name: str, by: Sequence[str] = ()) -> tuple[str, DataFrame]:
    """Where ``df`` was written (a folder for each value of ``by``), and what is read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return path, spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: it is made once, and lost executors cost no earlier stage."""
    return written_at(df, name)[1]
