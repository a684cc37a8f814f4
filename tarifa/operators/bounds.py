"""Validity bounds of prices and specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarifa.operators.ranks import quantiles

# Fixed values: (low, high) by category; None where the quantity means nothing there.
BOUNDS = {
    "pc_bureau": {"price": (0.0, 12574.0), "ram": (0.0, 128.0), "storage": (0.0, 4096.0), "screen": None},
    "pc_portables": {"price": (0.0, 16500.0), "ram": (1.0, 128.0), "storage": (0.0, 4096.0), "screen": (9.0, 19.0)},
    "smartphones": {"price": (0.0, 10500.0), "ram": (1.0, 32.0), "storage": (0.0, 4096.0), "screen": (5.0, 7.5)},
    "telephones_portables": {"price": (0.0, 300.0), "ram": (0.0, 24.0), "storage": (0.0, 64.0), "screen": (0.8, 3.0)},
    "televiseurs": {"price": (0.0, 15000.0), "ram": None, "storage": None, "screen": (20.0, 130.0)},
}
DEFAULT = {"price": (0.0, 30000.0), "ram": (0.0, 256.0), "storage": (0.0, 16384.0), "screen": (1.0, 19.0)}


def bound(category: Column | str, what: str, side: int) -> Column:
    """Low (0) or high (1) bound of a quantity in the row's category; the table has a handful of rows, so it is a CASE."""
    c = F.col(category) if isinstance(category, str) else category
    out = None
    for name, limits in BOUNDS.items():
        value = F.lit(limits[what][side] if limits[what] else None).cast("double")
        out = F.when(c == name, value) if out is None else out.when(c == name, value)
    return out.otherwise(F.lit(DEFAULT[what][side]))


def out_of_range(value: Column, low: Column, high: Column) -> Column:
    """Absent values and absent bounds are never out of range."""
    return F.coalesce(~value.between(low, high), F.lit(False))


def suspicious(value: Column, category: Column | str, what: str) -> Column:
    return out_of_range(value, bound(category, what, 0), bound(category, what, 1))


def observed_bounds(df: DataFrame, group: str, value: str, pad: float = 0.5, least: int = 5, digits: int = 2) -> DataFrame:
    """Bounds from the 1st and 99th percentile of each group, widened by half their distance, low end not under 0."""
    rows = quantiles(df, [group], value, (0.01, 0.99)).where(F.col("n") >= least)
    span = F.col("q")[1] - F.col("q")[0]
    return rows.select(group, "n", F.round(F.greatest(F.col("q")[0] - pad * span, F.lit(0.0)), digits).alias("low"), F.round(F.col("q")[1] + pad * span, digits).alias("high"))
