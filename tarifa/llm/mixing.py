"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target / source size. The
whole part is given outright; the fraction is rounded by the pivotal method: two fractional
documents are paired and mass (words) moves from one to the other, in a random direction whose
odds keep both expectations, until one of them is integral. The words of the pair stay the same,
so only the last document of all leaves a rounding error, less than its own size; it is drawn with its fraction as odds, so
that every document keeps its expectation.

Distribution: the documents of a source are dealt into groups by a hash of their id. Each group is
rounded alone and leaves one fractional document at most; these residuals meet in groups of
``FAN`` on the next level, and so on up a tree until one group per source is left. A source with a
third of all rows is thus many groups. All randomness is hashed from the group's name, so reruns
agree whatever the partitioning.

Edge cases: a null text has size 0; the null source is a source of its own and comes last; sources
whose sizes add up to 0 have target 0; documents of size 0 take 0 words and get the whole part of
the copies; repeated rows are rounded one by one; a null doc_id is an id like others; empty tables give empty results; extra
columns stay as they are, but for names that begin with two underscores, which are the module's own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarifa.llm.common import WORD, materialize, table, text_or_empty

GROUP, FAN = 4096, 64
WEIGHTS = (1.0, 2.0, 3.0)
MAX_COPIES = 3


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """source, n, source_size, target of each source.

    ``sizes`` has a row (source, n, source_size) for each source. The i-th source by code point, null
    last, weighs ``weights[i mod len]``; all share the total of the sizes; a source gets ``most`` times its
    size at most and what it leaves is shared by weight among the others (water filling in closed form:
    with the sources in order of cap / weight, the capped ones are a prefix).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("weight", w).withColumn("cap", (most * F.col("source_size")).cast("double"))
    out = out.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rest / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    out = out.withColumn("level", level)
    first_open = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(everything)
    out = out.withColumn("open", first_open["level"])
    target = F.when(F.col("open").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("open") * F.col("weight")))
    return out.select("source", "n", "source_size", target.alias("target"))


def _round_group(size: np.ndarray, p: np.ndarray, rng: np.random.Generator, last: bool) -> np.ndarray:
    """Fractions after pairing: 0 or 1 but for one row at most; with ``last`` for none."""
    p = p.copy()
    held = -1
    draws = iter(rng.random(len(p)).tolist())
    for j in range(len(p)):
        if not 0.0 < p[j] < 1.0:
            continue
        if held < 0:
            held = j
            continue
        i, a, b = held, size[held], size[j]
        up = min((1 - p[i]) * a, p[j] * b)  # words that can move from j to i
        down = min(p[i] * a, (1 - p[j]) * b)
        if next(draws) * (up + down) < down:
            if (1 - p[i]) * a <= p[j] * b:
                p[j], p[i] = p[j] - up / b, 1.0
            else:
                p[i], p[j] = p[i] + up / a, 0.0
        else:
            if p[i] * a <= (1 - p[j]) * b:
                p[j], p[i] = p[j] + down / b, 0.0
            else:
                p[i], p[j] = p[i] - down / a, 1.0
        held = i if 0.0 < p[i] < 1.0 else j if 0.0 < p[j] < 1.0 else -1
    if last and held >= 0:
        p[held] = float(rng.random() < p[held])  # drawn, as expectations are to be kept; less than a document off
    return p


def plan(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, most: int = MAX_COPIES, seed: int = 0) -> DataFrame:
    """doc_id, source, th, size, source_size, target, copies, taken of every row; th is a hash of the text."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text_or_empty(text)).alias("th"),
    )
    rows = materialize(rows, "mix-sizes")
    sources = materialize(targets(rows.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), weights, most), "mix-targets")
    largest = sources.agg(F.max("n")).first()[0] or 0

    copies = F.least(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0), F.lit(float(most)))
    groups = F.ceil(F.col("n") / GROUP).cast("long")
    state = (
        rows.alias("r")
        .join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "th", F.col("r.source").alias("source"), "size", "source_size", "target", copies.alias("x"), F.pmod(F.xxhash64(F.lit(seed), "doc_id", "th"), groups).alias("grp"))
        .select("doc_id", "th", "source", "size", "source_size", "target", F.floor("x").alias("whole"), (F.col("x") - F.floor("x")).alias("p"), "grp")
    )
    state = state.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))

    def rounded(level: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["size", "doc_id", "th"], ascending=[False, True, True], kind="stable", ignore_index=True)
            name = f"{seed}|{level}|{pdf.source[0]!r}|{pdf.grp[0]}".encode()
            rng = np.random.default_rng(int.from_bytes(hashlib.sha256(name).digest()[:8], "little"))
            pdf["p"] = _round_group(pdf["size"].to_numpy(float), pdf.p.to_numpy(float), rng, last)
            return pdf

        return run

    levels = 1
    while GROUP * FAN ** (levels - 1) < largest:
        levels += 1
    done: DataFrame | None = None
    for level in range(levels):
        last = level == levels - 1
        if last:
            state = state.withColumn("grp", F.lit(0).cast("long"))
        state = state.groupBy("source", "grp").applyInPandas(rounded(level, last), state.schema)
        if not last:
            state = materialize(state, f"mix-level{level}")
        settled = state if last else state.where("p <= 0 OR p >= 1")
        done = settled if done is None else done.unionByName(settled)
        if not last:
            state = state.where("p > 0 AND p < 1").withColumn("grp", F.floor(F.col("grp") / FAN).cast("long"))
    out = done.withColumn("copies", (F.col("whole") + F.round("p")).cast("long"))
    return out.select("doc_id", "source", "th", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the plan says (not at all where that is 0).

    Rows are matched to the plan by id, source, size and a hash of the text; texts are only moved where Spark doesn't
    broadcast the plan, and those of repeated rows.
    """
    found = plan(docs, **options)
    doc_id, source, text = (options.get(k, k) for k in ("doc_id", "source", "text"))
    key = ["__id", "__source", "__size", "__th"]
    of = (F.col(doc_id), F.col(source).cast("string"), F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long"), F.xxhash64(text_or_empty(text)))
    # rows that agree in all of these are copies of each other: what they take together is dealt out among them
    found = found.groupBy(*[F.col(c).alias(k) for c, k in zip(("doc_id", "source", "size", "th"), key)]).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows"))
    found = materialize(found.where("__copies > 0"), "mix-copies")
    marked = docs.select("*", *[c.alias(f"__own{k}") for c, k in zip(of, key)])
    same = [F.col(f"__own{k}").eqNullSafe(F.col(k)) for k in key]
    joined = marked.join(found, same[0] & same[1] & same[2] & same[3])
    if not found.where("__rows > 1").isEmpty():
        nth = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))) - 1
        twice = joined.where("__rows > 1").withColumn("__nth", nth)
        share = F.floor(F.col("__copies") / F.col("__rows")) + F.when(F.col("__nth") < F.col("__copies") % F.col("__rows"), 1).otherwise(0)
        joined = joined.where("__rows = 1").unionByName(twice.withColumn("__copies", share.cast("long")).drop("__nth").where("__copies > 0"))
    joined = joined.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return joined.select(*[joined[f"`{c}`"] for c in docs.columns])


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    found = plan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", "copies")
