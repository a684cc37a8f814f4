"""Scans of raw products and clean tables."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType, StringType, StructField, StructType

from tarifa.operators.clean import RAW


def raw_products(spark: SparkSession, path: str) -> DataFrame:
    """JSON arrays of products anywhere under ``path``; files that can't be read give rows in ``_corrupt_record``."""
    schema = StructType([*RAW.fields, StructField("_corrupt_record", StringType())])
    return spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def readable(raw: DataFrame) -> DataFrame:
    return raw.where("_corrupt_record IS NULL").drop("_corrupt_record")


def unreadable(raw: DataFrame) -> DataFrame:
    """Companion of :func:`readable`: what was left out, by file."""
    return raw.where("_corrupt_record IS NOT NULL").groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))


def clean_csv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """CSV with header, UTF-8, a byte-order mark before the first name is dropped; types are inferred without a schema."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    first = df.columns[0] if df.columns else ""
    return df.withColumnRenamed(first, first.lstrip("﻿"))


def week_of(path_column: str = "_metadata.file_path"):
    """Week number in a path such as .../week_12/..."""
    return F.regexp_extract(F.col(path_column), r"week_(\d+)", 1).try_cast("int")


def weeks(spark: SparkSession, path: str) -> list[int]:
    """Weeks that have files, in numeric order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(week_of("path").alias("w")).where("w IS NOT NULL").distinct()
    return sorted(r["w"] for r in files.collect())


def pooled(spark: SparkSession, root: str, category: str, last: int | None = None) -> DataFrame:
    """One category over all weeks (or the ``last`` ones), with ``semaine``; columns are united by name."""
    found = weeks(spark, root)
    parts = []
    for w in found[-last:] if last else found:
        parts.append(clean_csv(spark, f"{root}/week_{w}/{category}_clean.csv").withColumn("semaine", F.lit(w)))
    if not parts:
        raise FileNotFoundError(f"no week under {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return reconcile(out)


def one_week(spark: SparkSession, root: str, week: int, categories: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """All categories of one week with ``categorie`` as the first column, and the names of those without a file (also warned of).

    Columns are united by name. A week without any file is an error.
    """
    parts, missing = [], []
    for c in categories:
        df = week_table(spark, root, c, week)
        if df.columns:
            parts.append(df.select(F.lit(c).alias("categorie"), *[x for x in df.columns if x != "categorie"]))
        else:
            missing.append(c)
            warnings.warn(f"week {week} has no file of {c}", stacklevel=2)
    if not parts:
        raise FileNotFoundError(f"no clean table of week {week} under {root}")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out, missing


def week_table(spark: SparkSession, root: str, category: str, week: int) -> DataFrame:
    """One category of one week; an empty frame without columns where there is no file."""
    path = f"{root}/week_{week}/{category}_clean.csv"
    try:
        return clean_csv(spark, path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in (e.getCondition() or ""):
            raise
        return spark.createDataFrame([], StructType([]))


def reconcile(df: DataFrame) -> DataFrame:
    """Gaps that pooling made: flags become 0, text 'Manquant'; a gap in a number is an error, found in one pass."""
    flags = [c for c in df.columns if c.startswith("has_")]
    texts = [f.name for f in df.schema if isinstance(f.dataType, StringType) and f.name != "url"]
    df = df.fillna(0, flags).fillna("Manquant", texts)
    numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in flags]
    if numbers:
        gaps = df.agg(*[F.count_if(F.col(c).isNull() | (F.isnan(c) if isinstance(df.schema[c].dataType, (DoubleType, FloatType)) else F.lit(False))).alias(c) for c in numbers]).first().asDict()
        bad = sorted(c for c, n in gaps.items() if n)
        if bad:
            raise ValueError(f"gaps in numbers after pooling: {', '.join(bad)}")
    return df


def last_periods(df: DataFrame, n: int, period: str = "semaine") -> DataFrame:
    """Rows of the last n periods that the table has."""
    latest = df.select(period).distinct().orderBy(F.desc(period)).limit(n)  # n rows
    return df.join(F.broadcast(latest), period, "left_semi")


def last_update(spark: SparkSession, path: str):
    """Latest modification time under a path, None without files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).agg(F.max("modificationTime")).first()[0]


def schema_drift(tables: dict[int, Sequence[str]]) -> dict[int, tuple[set[str], set[str]]]:
    """Columns that each week lacks, and has beyond, those all weeks share."""
    common = set.intersection(*map(set, tables.values())) if tables else set()
    everything = set().union(*tables.values())
    return {w: (everything - set(c), set(c) - common) for w, c in tables.items()}


