"""Relational operators over a product panel.

A panel has one row per (product, period) with its category, brand, price and specifications. Column names are
parameters with the defaults ``product``, ``period``, ``category``, ``brand`` and ``price``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.functions.specs import direction, geo_mean, pct_change
from tarifa.operators.ranks import first_by_hash, nearest, per_group, quantiles, sum_before


def by_period(df: DataFrame, *groups: str, price: str = "price") -> DataFrame:
    """n, geometric mean, mean, median, min, max and deviation of the price by group."""
    p = F.col(price)
    return df.groupBy(*groups).agg(
        F.count("*").alias("n"), geo_mean(p).alias("geo_price"), F.avg(p).alias("mean_price"), F.median(p).alias("median_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.stddev_samp(p).alias("sd_price")
    )


def zero_filled_counts(df: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Counts for every key of ``dimension``, 0 where ``df`` has none."""
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    return dimension.select(key).distinct().join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """The k most frequent values; ties by value."""
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(k)


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """bin (1..bins), low edge and count of equal-width bins between the extremes."""
    ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))  # one row
    rows = df.select(F.col(column).cast("double").alias("v")).where("v IS NOT NULL").join(F.broadcast(ends))
    step = (F.col("hi") - F.col("lo")) / bins
    place = F.when(F.col("hi") == F.col("lo"), 1).otherwise(F.least(F.floor((F.col("v") - F.col("lo")) / step) + 1, F.lit(bins))).cast("int")
    return rows.groupBy(place.alias("bin")).agg(F.min(F.col("lo") + (place - 1) * step).alias("low"), F.count("*").alias("n"))


def box(df: DataFrame, group: str, value: str) -> DataFrame:
    return quantiles(df, [group], value, (0.25, 0.5, 0.75)).select(group, "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))


def shares(df: DataFrame, within: Sequence[str], of: str) -> DataFrame:
    """Count of each value and its share, in percent, of its group."""
    counts = df.groupBy(*within, of).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0)))
    return counts.withColumn("share_pct", F.col("n") * 100.0 / total)


def pivot_periods(df: DataFrame, group: str, value: Column, periods: Sequence[int]) -> DataFrame:
    """One column per period and the change in percent between the first and the last."""
    wide = df.groupBy(group).pivot("period", list(periods)).agg(value)
    names = [f"p{p}" for p in periods]
    wide = wide.toDF(group, *names)
    return wide.withColumn("change_pct", pct_change(names[0], names[-1]))


def crosstab(df: DataFrame, a: str, b: str, values: Sequence[str]) -> DataFrame:
    """Counts of b by a, in columns, with row percentages."""
    wide = df.groupBy(a).pivot(b, list(values)).count().fillna(0)
    total = sum((F.col(v) for v in values), F.lit(0))
    return wide.select(a, *[F.col(v).alias(f"n_{v}") for v in values], *[(F.col(v) * 100.0 / total).alias(f"pct_{v}") for v in values])


def weighted_mean(value: str, weight: str) -> Column:
    """Aggregate that leaves out rows without a value."""
    return F.sum(F.col(value) * F.col(weight)) / F.sum(F.when(F.col(value).isNotNull(), F.col(weight)))


def present_in_all(df: DataFrame, key: str, period: str = "period") -> DataFrame:
    """Keys seen in every period of the table."""
    total = df.agg(F.count_distinct(period).alias("total"))  # one row
    seen = df.groupBy(key).agg(F.count_distinct(period).alias("seen"))
    return seen.join(F.broadcast(total), F.col("seen") == F.col("total"), "left_semi").select(key)


def churn(df: DataFrame, product: str = "product", period: str = "period") -> DataFrame:
    """entering, leaving and matched products between each period and the next available one."""
    keys = df.select(product, period).distinct()
    periods = keys.select(period).distinct()
    w = Window.orderBy(period)
    steps = periods.select(period, F.lead(period).over(w).alias("next")).where("next IS NOT NULL")
    before = keys.join(F.broadcast(steps), period).select(product, F.col(period).alias("t"), "next", F.lit(1).alias("b"))
    after = keys.withColumnRenamed(period, "next").join(F.broadcast(steps.withColumnRenamed(period, "t")), "next").select(product, "t", "next", F.lit(1).alias("a"))
    both = before.join(after, [product, "t", "next"], "full_outer")
    return both.groupBy("t", "next").agg(F.count_if(F.col("b").isNull()).alias("entering"), F.count_if(F.col("a").isNull()).alias("leaving"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"))


def base_index(df: DataFrame, period: str = "period", price: str = "price") -> DataFrame:
    """Median price by period as an index, 100 in the first period, for all products and for the matched panel; the difference is the mix effect."""
    always = present_in_all(df, "product", period)
    middle = lambda rows, name: quantiles(rows, [period], price, (0.5,)).select(period, F.col("q")[0].alias(name))
    everything, matched = middle(df, "median_all"), middle(df.join(always, "product", "left_semi"), "median_matched")
    w = Window.partitionBy(F.lit(0)).orderBy(period).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row per period
    rows = everything.join(matched, period, "left")
    for name in ("all", "matched"):
        rows = rows.withColumn(f"index_{name}", F.col(f"median_{name}") * 100.0 / F.first(f"median_{name}").over(w))
    return rows.withColumn("mix_effect", F.col("index_all") - F.col("index_matched"))


def matched_deltas(df: DataFrame, step: float = 0.5) -> DataFrame:
    """Median price change of products seen in a period and the next, with shares of rises, falls and the rest."""
    steps = df.select("period").distinct().select("period", F.lead("period").over(Window.orderBy("period")).alias("next")).where("next IS NOT NULL")
    before = df.select("product", "period", F.col("price").alias("p0")).join(F.broadcast(steps), "period")
    after = df.select("product", F.col("period").alias("next"), F.col("price").alias("p1"))
    rows = before.join(after, ["product", "next"]).withColumn("d", pct_change("p0", "p1"))
    share = lambda c: F.avg(c.cast("int")) * 100
    middle = quantiles(rows, ["period", "next"], "d", (0.5,)).select("period", "next", F.col("q")[0].alias("median_pct"))
    shares = rows.groupBy("period", "next").agg(F.count("*").alias("n"), share(F.col("d") > step).alias("up_pct"), share(F.col("d") < -step).alias("down_pct"), share(F.col("d").between(-step, step)).alias("stable_pct"))
    return shares.join(middle, ["period", "next"], "left").select("period", "next", "n", "median_pct", "up_pct", "down_pct", "stable_pct")


def first_last(df: DataFrame, group: str, value: str, period: str = "period") -> DataFrame:
    rows = df.groupBy(group).agg(F.min_by(value, period).alias("first"), F.max_by(value, period).alias("last"))
    return rows.withColumn("change_pct", pct_change("first", "last"))


def lagged_change(df: DataFrame, group: Sequence[str], value: str, period: str = "period") -> DataFrame:
    w = Window.partitionBy(*group).orderBy(period)
    return df.withColumn("change_pct", pct_change(F.lag(value).over(w), value))


def transitions(df: DataFrame, group: Sequence[str], real: str, estimated: str, n: str, step: float = 3.0, reliable: int = 3) -> DataFrame:
    """Changes between each period and the next available one: both directions, their pair, the residual gap and reliability.

    Values are taken as they are (reports round them before); directions are strict at ``step`` percent. A change in the
    number of products is the first cause, before any reading of price or quality.
    """
    w = Window.partitionBy(*group).orderBy("period")
    rows = df.select(*group, F.col("period").alias("t"), F.lead("period").over(w).alias("t1"), pct_change(real, F.lead(real).over(w)).alias("real_pct"), pct_change(estimated, F.lead(estimated).over(w)).alias("estimated_pct"), F.col(n).alias("n_t"), F.lead(n).over(w).alias("n_t1"))
    rows = rows.where("t1 IS NOT NULL").withColumn("gap_pct", F.col("real_pct") - F.col("estimated_pct"))
    rows = rows.withColumn("label", F.concat_ws("/", direction("real_pct", step), direction("estimated_pct", step)))
    real, estimate = direction("real_pct", step), direction("estimated_pct", step)
    moves = ("hausse", "baisse")
    cause = (
        F.when(F.col("n_t") != F.col("n_t1"), "effectif")
        .when((real == "indéterminé") | (estimate == "indéterminé"), None)
        .when(real.isin(*moves) & estimate.isin(*moves) & (real != estimate), "prix_et_qualite")
        .when(estimate.isin(*moves), "qualite")
        .when(real.isin(*moves), "prix")
        .otherwise("aucune")
    )
    return rows.withColumns({"cause": cause, "limited": (F.col("n_t") < reliable) | (F.col("n_t1") < reliable)})


def tiers(df: DataFrame, brand: str = "brand", price: str = "price", least: int = 5) -> DataFrame:
    """Price tiers within each brand of ``least`` rows or more: three from 15 rows, two from 10, else one.

    Edges are exact quantiles, equal edges are merged, bins are closed on the right (the lowest on both sides);
    labels go from low to high over the bins that are left. Adds n_brand, tiers_planned, tiers_found and tier.
    """
    p = F.col(price).cast("double")
    found = quantiles(df.select(brand, price), [brand], price, (0.0, 1 / 3, 0.5, 2 / 3, 1.0))
    q = lambda *places: F.array(*[F.col("q")[i] for i in places])
    counts = df.groupBy(brand).agg(F.count("*").alias("n_brand")).where(F.col("n_brand") >= least)
    edges = counts.join(found.select(brand, q(0, 1, 3, 4).alias("__q3"), q(0, 2, 4).alias("__q2")), brand, "left")  # a row per brand
    rows = df.join(edges, brand)
    planned = F.when(F.col("n_brand") >= 15, 3).when(F.col("n_brand") >= 10, 2).otherwise(1)
    edges = F.array_distinct(F.when(planned == 3, F.col("__q3")).when(planned == 2, F.col("__q2")).otherwise(F.array(F.element_at("__q2", 1), F.element_at("__q2", 3))))
    rows = rows.withColumns({"tiers_planned": planned, "__e": edges}).withColumn("tiers_found", F.size("__e") - 1)
    place = F.greatest(F.size(F.filter("__e", lambda e: e < p)), F.lit(1))
    names = F.when(F.col("tiers_planned") == 3, F.array(*map(F.lit, ("Économique", "Milieu de gamme", "Premium")))).when(F.col("tiers_planned") == 2, F.array(*map(F.lit, ("Économique", "Premium")))).otherwise(F.array(F.lit("Gamme unique")))
    tier = F.when(F.col("tiers_planned") == 1, "Gamme unique").when(F.col("tiers_found") >= 1, F.get(names, place - 1))
    return rows.withColumn("tier", tier).drop("__q3", "__q2", "__e")


def tier_ranges(df: DataFrame) -> DataFrame:
    return df.where("tier IS NOT NULL").groupBy("brand", "tier").agg(F.min("price").alias("low"), F.max("price").alias("high"))


def assign_by_range(rows: DataFrame, ranges: DataFrame, price: str = "price") -> DataFrame:
    """The tier of the brand whose range holds the price, else the one with the nearest end; ties by low end, then name.

    A brand has a few ranges, so this is an equi-join on the brand and a pick within each row; rows of unknown brands keep a null.
    """
    each = ranges.groupBy("brand").agg(F.collect_list(F.struct("low", "high", "tier")).alias("__r"))  # a few ranges
    joined = rows.join(each, "brand", "left")
    off = lambda r: F.greatest(r["low"] - F.col(price), F.col(price) - r["high"], F.lit(0.0))
    best = F.array_min(F.transform("__r", lambda r: F.struct(off(r).alias("o"), r["low"].alias("l"), r["tier"].alias("t"))))
    return joined.select(*rows.columns, best["t"].alias("assigned"))


def fallback_lookup(rows: DataFrame, models: DataFrame) -> DataFrame:
    """Model of (brand, tier, cluster), else the first of (brand, tier), else the first of the brand, else none.

    Adds ``model`` and the ``level`` it came from.
    """
    exact = models.select("brand", "tier", "cluster", F.col("model").alias("m1"))
    tier = models.groupBy("brand", "tier").agg(F.min("model").alias("m2"))
    brand = models.groupBy("brand").agg(F.min("model").alias("m3"))
    joined = rows.join(exact, ["brand", "tier", "cluster"], "left").join(tier, ["brand", "tier"], "left").join(brand, "brand", "left")
    level = F.when(F.col("m1").isNotNull(), "n2").when(F.col("m2").isNotNull(), "n2_marque_gamme").when(F.col("m3").isNotNull(), "n2_marque").otherwise("categorie")
    return joined.select(*rows.columns, F.coalesce("m1", "m2", "m3").alias("model"), level.alias("level"))


def propagate_labels(panel: DataFrame, labels: DataFrame, key: str = "product") -> DataFrame:
    """Labels of a reference period on all rows of the product; the first label by name where a product has several."""
    one = labels.groupBy(key).agg(F.min("label").alias("label"))
    return panel.join(one, key, "left")


def knn(queries: DataFrame, rows: DataFrame, block: str, features: Sequence[str], k: int, different: str | None = None) -> DataFrame:
    """The k nearest rows of the same block for each query (Euclidean; ties by id), other than itself.

    Both have id, ``block`` and the features; ``different`` names a column that must differ. Distances are only made
    between neighbouring cells of a block (see ``ranks.nearest``).
    """
    return nearest(queries, rows, block, features, k, different)


def average_rank(df: DataFrame, value: str, out: str, *within: str) -> DataFrame:
    """Ranks with ties averaged: one aggregate by value and one running sum over distinct values."""
    keys = [*within, value]
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("__c"))
    ranked = sum_before(counts, within, value, "__c", "__before").select(*keys, (F.col("__before") + (F.col("__c") + 1) / 2.0).alias(out))
    return df.join(ranked, keys)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n and rank correlation of the rows where both are there."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).alias("a"), F.col(b).alias("b"))
    rows = average_rank(average_rank(rows, "a", "ra"), "b", "rb")
    return rows.agg(F.count("*").alias("n"), F.corr("ra", "rb").alias("rho"))


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """H statistic with tie correction over groups of two rows or more, and its degrees of freedom."""
    rows = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).alias("v"))
    big = rows.groupBy("g").count().where("count >= 2").select("g")
    rows = rows.join(big, "g", "left_semi")
    ranked = average_rank(rows, "v", "r")
    sums = ranked.groupBy("g").agg(F.sum("r").alias("s"), F.count("*").alias("n"))
    total = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.sum("n").alias("n"), F.count("*").alias("k"))
    ties = rows.groupBy("v").agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    n = F.col("n").cast("double")
    h = (12.0 / (n * (n + 1)) * F.col("ss") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    return total.join(F.broadcast(ties)).select((F.col("k") - 1).alias("df"), h.alias("h"))


def rand_index(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2.0)
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    both = cells.agg(pairs("n").alias("cells"), F.sum("n").alias("total"))
    left = cells.groupBy("a").agg(F.sum("n").alias("n")).agg(pairs("n").alias("rows"))
    right = cells.groupBy("b").agg(F.sum("n").alias("n")).agg(pairs("n").alias("cols"))
    one = both.join(F.broadcast(left)).join(F.broadcast(right))  # single rows
    chance = F.col("rows") * F.col("cols") / (F.col("total") * (F.col("total") - 1) / 2.0)
    best = (F.col("rows") + F.col("cols")) / 2.0
    return one.select(F.when(best == chance, 1.0).otherwise((F.col("cells") - chance) / (best - chance)).alias("ari"))


def iqr_outliers(df: DataFrame, group: str, value: str, k: float = 1.5, fitted_on: DataFrame | None = None) -> DataFrame:
    """Rows outside the Tukey fences of their group, found on ``fitted_on`` (training rows) or on all; a group without spread has none.

    Rows of a group that ``fitted_on`` has not are left out.
    """
    fences = quantiles(df if fitted_on is None else fitted_on, [group], value, (0.25, 0.75)).select(group, F.col("q").alias("__q"))
    spread = F.col("__q")[1] - F.col("__q")[0]
    inside = F.col(value).between(F.col("__q")[0] - k * spread, F.col("__q")[1] + k * spread)
    return df.join(per_group(fences, "fences"), group).withColumn("outlier", F.when(spread > 0, ~inside).otherwise(F.lit(False))).drop("__q")


def metrics(df: DataFrame, truth: str, estimate: str, *groups: str) -> DataFrame:
    """n, R2, RMSE and MAE."""
    y, e = F.col(truth), F.col(truth) - F.col(estimate)
    total = F.sum(y * y) - F.sum(y) * F.sum(y) / F.count(y)
    return df.groupBy(*groups).agg(F.count("*").alias("n"), (1 - F.sum(e * e) / total).alias("r2"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"))


def split(df: DataFrame, key: str, share: float = 0.2, *strata: str, salt: str = "42") -> DataFrame:
    """``part``: test for the first ceil(share n) keys of each stratum by the MD5 of salt and key, else train.

    The split goes by key, so all rows of a key are on one side.
    """
    keys = first_by_hash(df.select(key, *strata).distinct(), key, strata, salt)
    part = F.when(F.col("place") <= F.ceil(F.col("size") * share), "test").otherwise("train")
    return df.join(keys.select(key, *strata, part.alias("part")), [key, *strata])


def one_hot(df: DataFrame, column: str, levels: Sequence[str], missing: str = "Manquant") -> DataFrame:
    """0/1 columns of all sorted levels but the first; null is a level of its own."""
    c = F.coalesce(F.col(column), F.lit(missing))
    return df.withColumns({f"{column}_{x}": (c == x).cast("int") for x in sorted(levels)[1:]})


def label_codes(df: DataFrame, column: str, fitted: DataFrame, missing: str = "Manquant") -> DataFrame:
    """Place of the value among the sorted levels of ``fitted``, -1 for one it has not."""
    levels = fitted.select(F.coalesce(F.col(column), F.lit(missing)).alias("__l")).distinct()
    codes = levels.withColumn("code", F.row_number().over(Window.orderBy("__l")) - 1)  # a row per level
    joined = df.join(codes, F.coalesce(F.col(column), F.lit(missing)) == F.col("__l"), "left")
    return joined.withColumn("code", F.coalesce("code", F.lit(-1))).drop("__l")


def interactions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Products of all pairs, no squares."""
    from itertools import combinations

    return df.withColumns({f"{a}_{b}": F.col(a) * F.col(b) for a, b in combinations(columns, 2)})


def impute_median(df: DataFrame, column: str, *groups: str) -> DataFrame:
    """Nulls become the median of the group; a group without a value stays null."""
    middle = quantiles(df, groups, column, (0.5,)).select(*groups, F.col("q")[0].alias("__m"))
    joined = df.join(middle, list(groups), "left") if groups else df.join(F.broadcast(middle), how="left")
    return joined.withColumn(column, F.coalesce(F.col(column), F.col("__m"))).drop("__m")


def impute_knn(df: DataFrame, target: str, features: Sequence[str], block: str, k: int = 5, categorical: bool = False) -> DataFrame:
    """Nulls become the mean (or the most frequent value, ties to the smallest) of the k nearest rows that have one."""
    missing = df.where(F.col(target).isNull())
    donors = df.where(F.col(target).isNotNull())
    near = knn(missing, donors, block, features, k).join(donors.select("id", F.col(target).alias("__t")), "id")
    value = F.mode("__t", True) if categorical else F.avg("__t")
    filled = near.groupBy(F.col("query_id").alias("id")).agg(value.alias("__v"))
    return df.join(filled, "id", "left").withColumn(target, F.coalesce(F.col(target), F.col("__v"))).drop("__v")
