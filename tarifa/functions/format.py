"""Numbers, prices and effects as French text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarifa.functions.specs import col


def number(c: Column | str, digits: int = 0) -> Column:
    """1 234,5: spaces between thousands, decimal comma; a dash for null."""
    text = F.translate(F.format_number(col(c).cast("double"), digits), ",.", " ,")
    return F.coalesce(text, F.lit("—"))


def price(c: Column | str) -> Column:
    return F.when(col(c).isNull(), "—").otherwise(F.concat(number(c, 0), F.lit(" TND")))


def percent(c: Column | str, digits: int = 1) -> Column:
    """With a sign."""
    v = col(c).cast("double")
    return F.when(v.isNull(), "—").otherwise(F.concat(F.when(v > 0, "+").otherwise(""), number(v, digits), F.lit(" %")))


def period_label(before: Column | str, after: Column | str) -> Column:
    return F.format_string("S%s→S%s", col(before).cast("string"), col(after).cast("string"))


def slider_step(c: Column | str) -> Column:
    """Aggregate: 1 where over 90 % of the values are whole, else 0.1."""
    return F.when(F.avg((col(c) % 1 == 0).cast("int")) > 0.9, 1.0).otherwise(0.1)
