"""Ranks, quantiles and neighbours that no single task has to see whole."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarifa.sources.scratch import written

#: Ranges that a group's values are cut into for running sums.
RANGES = 256


#: Rows of a table with a row per group that is sent to all tasks; of more, rows go to the tasks of their groups.
SENT = 10_000


def per_group(df: DataFrame, name: str) -> DataFrame:
    """A table with a row per group, to be joined to rows: few groups would else be few tasks, each with all rows of one."""
    out = written(df, name)
    return F.broadcast(out) if out.count() <= SENT else out


def sum_before(rows: DataFrame, within: Sequence[str], order: str, amount: str, out: str) -> DataFrame:
    """``rows`` (one per group and number ``order``) with the sum of ``amount`` over smaller numbers of the group.

    Approximate quantiles cut each group into ranges; a task sums up a range, and one row per range gives its base.
    """
    within = list(within)
    cuts = rows.groupBy(*within).agg(F.percentile_approx(order, [i / RANGES for i in range(1, RANGES)], 10 * RANGES).alias("__cuts"))  # a row per group
    cut = rows.join(per_group(cuts, "rank-cuts"), within) if within else rows.join(F.broadcast(cuts))
    steps = ", ".join(str(RANGES >> k) for k in range(1, RANGES.bit_length()))  # how many cuts are below, by halves
    below = f"aggregate(array({steps}), 0, (lo, s) -> CASE WHEN lo + s <= size(__cuts) AND get(__cuts, lo + s - 1) < `{order}` THEN lo + s ELSE lo END)"
    cut = cut.withColumn("__range", F.expr(below)).drop("__cuts")
    inside = Window.partitionBy(*within, "__range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*within).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = cut.groupBy(*within, "__range").agg(F.sum(amount).alias("__all")).withColumn("__base", F.coalesce(F.sum("__all").over(before), F.lit(0))).drop("__all")
    cut = cut.withColumn("__in", F.coalesce(F.sum(amount).over(inside), F.lit(0)))
    return cut.join(base, [*within, "__range"]).withColumn(out, F.col("__in") + F.col("__base")).drop("__range", "__in", "__base")


#: Of the approximate ranks that exact quantiles are looked for around.
ACCURACY = 10_000


def quantiles(df: DataFrame, groups: Sequence[str], value: str, probabilities: Sequence[float]) -> DataFrame:
    """Exact quantiles, interpolated, of each group: the group's columns, n and an array ``q``.

    Approximate quantiles a little below and above each probability enclose the values that count; what lies below and the next values on
    either side are aggregates, and only the few values between (about eight in ``ACCURACY``) are counted each for itself.
    """
    groups = list(groups)
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("__v"))
    off = 4 / ACCURACY
    marks = [min(1.0, max(0.0, p + side)) for p in probabilities for side in (-off, off)]
    cuts = rows.groupBy(*groups).agg(F.percentile_approx("__v", marks, ACCURACY).alias("__cuts"), F.count("*").alias("n"))  # a row per group
    cuts = per_group(cuts, "quantile-cuts")
    marked = rows.join(cuts, groups) if groups else rows.join(F.broadcast(cuts))
    low, high = lambda k: F.col("__cuts")[2 * k], lambda k: F.col("__cuts")[2 * k + 1]
    ks = range(len(probabilities))
    around = [c for k in ks for c in (F.count_if(F.col("__v") < low(k)).alias(f"__b{k}"), F.max(F.when(F.col("__v") < low(k), F.col("__v"))).alias(f"__p{k}"), F.min(F.when(F.col("__v") > high(k), F.col("__v"))).alias(f"__a{k}"))]
    around = marked.groupBy(*groups, "n").agg(*around)
    within = marked.select(*groups, "__v", F.explode(F.array_compact(F.array(*[F.when(F.col("__v").between(low(k), high(k)), k) for k in ks]))).alias("__k"))
    within = within.groupBy(*groups, "__k", "__v").agg(F.count("*").alias("__c"))
    within = within.groupBy(*groups).agg(*[F.collect_list(F.when(F.col("__k") == k, F.struct("__v", "__c"))).alias(f"__i{k}") for k in ks])
    found = around.join(within, groups) if groups else around.join(F.broadcast(within))

    def at(k: int, place) -> Column:
        """The value of the given rank, counted from 0."""
        start = F.struct(F.col(f"__b{k}").alias("before"), F.lit(None).cast("double").alias("value"))
        step = lambda a, e: F.struct((a["before"] + e["__c"]).alias("before"), F.coalesce(a["value"], F.when(place < a["before"] + e["__c"], e["__v"])).alias("value"))
        return F.when(place < F.col(f"__b{k}"), F.col(f"__p{k}")).otherwise(F.coalesce(F.aggregate(F.sort_array(f"__i{k}"), start, step)["value"], f"__a{k}"))

    out = []
    for k, p in enumerate(probabilities):
        place = (F.col("n") - 1) * p
        a, b = at(k, F.floor(place)), at(k, F.ceil(place))
        out.append(F.when(a == b, a).otherwise((F.ceil(place) - place) * a + (place - F.floor(place)) * b))
    return found.select(*groups, "n", F.array(*out).alias("q"))


def first_by_hash(keys: DataFrame, key: str, strata: Sequence[str], salt: str) -> DataFrame:
    """``keys`` (distinct) with the place of each in its stratum in order of the MD5 of salt and key, and the stratum's size."""
    strata = list(strata)
    hashed = keys.withColumn("__h", F.md5(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")))).withColumn("__b", F.substring("__h", 1, 3))
    before = Window.partitionBy(*strata).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(*strata)
    # at most 4096 rows per stratum
    base = hashed.groupBy(*strata, "__b").agg(F.count("*").alias("__c")).select(*strata, "__b", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__base"), F.sum("__c").over(every).alias("size"))
    own = F.row_number().over(Window.partitionBy(*strata, "__b").orderBy("__h", key))
    same = F.expr(" AND ".join(f"r.`{c}` <=> b.`{c}`" for c in [*strata, "__b"]))
    placed = hashed.withColumn("__own", own).alias("r").join(base.alias("b"), same)
    return placed.select(*[F.col(f"r.`{c}`") for c in keys.columns], (F.col("r.__own") + F.col("b.__base")).alias("place"), F.col("b.size").alias("size"))


#: Tasks that equal vectors are dealt to before the first of them are taken.
_SALT = 64
#: Rows of a cell on the average, and the queries that are left in a cell; where there are more it is cut up.
CELL, CROWDED = 3, 32
#: Of a cell's width, what counts as seen to all sides: cells are found by rounded divisions.
SEEN = 1 - 1e-9


def _first(rows: DataFrame, within: Sequence[str], k: int, different: bool) -> DataFrame:
    """Of the rows (distance, id, other) of each ``within`` the first ``k``; with ``different`` those that are among the first ``k`` when one ``other`` is left out.

    A row that is so has at most ``k - 1`` rows before it of its own and of further ``other`` values, and one value more may be left out.
    """
    if not different:
        w = Window.partitionBy(*within).orderBy("distance", "id")
        return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k).drop("__r")
    own = Window.partitionBy(*within, "other")
    rows = rows.withColumn("__r", F.row_number().over(own.orderBy("distance", "id"))).where(F.col("__r") <= k).drop("__r")
    rows = rows.withColumn("__first", F.min(F.struct("distance", "id")).over(own))
    return rows.withColumn("__r", F.dense_rank().over(Window.partitionBy(*within).orderBy("__first", "other"))).where(F.col("__r") <= k + 1).drop("__r", "__first")


def _enough(found: Column, k: int, different: bool) -> Column:
    """Are ``k`` in the array, whichever ``other`` is left out? Then no ``other`` has more than all but ``k``: sorted, none is as many places on again."""
    size = F.size(found)
    if not different:
        return size >= k
    names = F.sort_array(F.transform(found, lambda e: e["other"]))
    return functools.reduce(lambda a, i: a & (F.get(names, F.lit(i)) != F.get(names, size - k + i)), range(k), size >= k)


def nearest(queries: DataFrame, rows: DataFrame, block: str, features: Sequence[str], k: int, different: str | None = None) -> DataFrame:
    """query_id, id, rank, distance: the ``k`` nearest rows of the same block (Euclidean, ties by id), other than itself.

    Both tables have id, ``block`` and the features; ``different`` names a column that must differ. Rows with a null feature
    have no distance and are left out. Equal vectors are one, with the smallest ids that could matter; one that has enough of them is done. The
    others are put into a grid whose cells hold a few rows each, and a query looks into its own and the next cells; it is done when as many
    neighbours as asked are nearer than a cell is wide, else it goes on with cells as wide as its last neighbour is far, or four times as
    wide where too few were met, until a cell holds the block. Cells with many queries are cut up first, so a row meets a bounded number
    of queries in each grid. No neighbour is missed.
    """
    features, d, apart = list(features), len(features), different is not None
    other = F.coalesce(F.concat(F.lit("v"), F.col(different).cast("string")), F.lit("n")) if apart else F.lit(None).cast("string")
    known = F.expr(" AND ".join(f"`{f}` IS NOT NULL" for f in [block, *features]))
    shape = lambda df: df.where(known).select("id", F.col(block).alias("__block"), F.array(*[F.col(f).cast("double") for f in features]).alias("__x"), other.alias("other"))
    asked = written(shape(queries), "knn-asked")  # answers are joined by vector below: made a second time, sums of doubles could differ in a last place
    donors = asked if queries is rows else shape(rows)
    n = k if apart and queries is rows else k + 1  # a row itself is among its own, or left out with its ``other``
    donors = donors.repartition("__block", "__x", F.pmod(F.xxhash64("id"), F.lit(_SALT)))  # few files would be few tasks that sort all rows, and so would very many equal vectors
    kept = _first(donors.withColumn("distance", F.lit(0.0)), ["__block", "__x"], n, apart).select("__block", "__x", F.struct("id", "other").alias("__row"))
    both = kept.withColumn("__asked", F.lit(False)).unionByName(asked.select("__block", "__x").distinct().select("*", F.lit(None).cast(kept.schema["__row"].dataType).alias("__row"), F.lit(True).alias("__asked")))
    vectors = both.groupBy("__block", "__x").agg(F.collect_list("__row").alias("__own"), F.max("__asked").alias("__asked"))
    vectors = vectors.withColumns({"__v": F.monotonically_increasing_id(), "__open": F.col("__asked") & ~_enough(F.col("__own"), n, apart)})
    vectors = written(vectors, "knn-vectors")

    extents = F.sort_array(F.array(*[F.col(f"hi{i}") - F.col(f"lo{i}") for i in range(d)]), asc=False)
    blocks = vectors.groupBy("__block").agg(
        F.sum(F.size("__own")).alias("__n"), F.max("__open").alias("__some"), *[f(F.col("__x")[i]).alias(f"{name}{i}") for i in range(d) for f, name in ((F.min, "lo"), (F.max, "hi"))],
        F.min(F.array_min(F.transform("__own", lambda e: e["other"]))).alias("__one"), F.max(F.array_max(F.transform("__own", lambda e: e["other"]))).alias("__two"),
    ).where("__some AND __n > 0" + " AND __one <> __two" * apart)
    # the width at which the box of the block has as many cells as the rows ask for; sides that are shorter than a cell don't count
    rate = F.log(F.greatest(F.col("__n") / float(CELL), F.lit(1.0)))
    widths = [F.exp((sum((F.log(F.col("__e")[j]) for j in range(i + 1)), F.lit(0.0)) - rate) / (i + 1)) for i in range(d)]
    blocks = blocks.withColumn("__e", extents).withColumn("__side", F.coalesce(F.greatest(*widths, F.lit(None)), F.lit(1.0)))
    blocks = per_group(blocks.select("__block", "__side", F.col("__e")[0].alias("__extent"), *[f"{name}{i}" for i in range(d) for name in ("lo", "hi")]), "knn-blocks")  # a row per block
    side = F.col("__side") * F.pow(F.lit(2.0), F.col("__level"))
    cells = [f"__c{i}" for i in range(d)]
    cell = lambda i, x="__x": F.floor((F.col(x)[i] - F.col(f"lo{i}")) / side)

    left, level, placed = vectors.where("__open").select("__v", "__block", "__x"), 0, None
    while True:
        filed = left.withColumn("__level", F.lit(level)).join(blocks, "__block").select("__v", "__block", "__x", "__level", (F.col("__extent") / side).alias("__across"), *[cell(i).alias(c) for i, c in enumerate(cells)])
        crowded = written(filed.where(F.col("__across") < 2.0**50).groupBy("__block", *cells).count().where(F.col("count") > CROWDED).drop("count"), "knn-crowded")
        last = crowded.isEmpty()
        here = (filed if last else filed.join(crowded, ["__block", *cells], "left_anti")).select("__v", "__block", "__x", "__level")
        placed = here if placed is None else placed.union(here)
        if last:
            break
        left, level = written(filed.join(crowded, ["__block", *cells], "left_semi").select("__v", "__block", "__x"), "knn-cut"), level - 2

    left, done, wider = written(placed, "knn-left"), None, 2
    while few := left.count():
        used = per_group(left.select("__block", "__level").distinct(), "knn-levels")
        filed = vectors.where(F.size("__own") > 0).select("__block", F.col("__x").alias("__y"), "__own").join(used, "__block").join(blocks, "__block")
        filed = filed.select("__block", "__level", *[cell(i, "__y").alias(c) for i, c in enumerate(cells)], "__y", "__own")
        looking = left.join(blocks, "__block")
        for i, c in enumerate(cells):  # the next cells too, but none beyond the block
            looking = looking.withColumn(c, F.explode(F.sequence(F.greatest(cell(i) - 1, F.lit(0)), F.least(cell(i) + 1, F.floor((F.col(f"hi{i}") - F.col(f"lo{i}")) / side)))))
        looking = looking.select("__v", "__x", "__block", "__level", *cells)
        near = (F.broadcast(looking) if few * 3**d <= 10 * SENT else looking).join(filed, ["__block", "__level", *cells])
        distance = F.sqrt(sum(((F.col("__x")[i] - F.col("__y")[i]) * (F.col("__x")[i] - F.col("__y")[i]) for i in range(d)), F.lit(0.0)))
        near = near.select("__v", distance.alias("distance"), F.inline("__own"))
        near = _first(near, ["__v"], n, apart).groupBy("__v").agg(F.collect_list(F.struct("distance", "id", "other")).alias("__found"))
        near = left.join(near, "__v", "left").join(blocks, "__block")
        seen = side * SEEN
        settled = (side >= F.col("__extent")) | F.coalesce(_enough(F.filter("__found", lambda e: e["distance"] <= seen), n, apart), F.lit(False))  # noqa: B023
        far = F.array_max(F.transform("__found", lambda e: e["distance"]))
        further = F.when(_enough(F.col("__found"), n, apart), F.greatest(F.ceil(F.log2(far / seen)), F.lit(1))).otherwise(wider)
        near = written(near.select("__v", "__block", "__x", (F.col("__level") + F.coalesce(further, F.lit(wider))).cast("int").alias("__next"), "__found", settled.alias("__settled")), "knn-near")
        own = near.where("__settled").select("__v", "__found")
        done = own if done is None else done.union(own)
        left, wider = near.where("NOT __settled").select("__v", "__block", "__x", F.col("__next").alias("__level")), 4

    at_once = F.transform("__own", lambda e: F.struct(F.lit(0.0).alias("distance"), e["id"].alias("id"), e["other"].alias("other")))
    answers = vectors.where("__asked AND NOT __open").select("__block", "__x", at_once.alias("__found"))
    if done is not None:
        answers = answers.union(vectors.where("__open").join(done, "__v").select("__block", "__x", "__found"))
    pairs = asked.select(F.col("id").alias("query_id"), "__block", "__x", F.col("other").alias("__other")).join(answers.withColumn("__found", F.array_sort("__found")), ["__block", "__x"])
    right = lambda e: (e["id"] != F.col("query_id")) & ((e["other"] != F.col("__other")) if apart else F.lit(True))
    pairs = pairs.select("query_id", F.posexplode(F.slice(F.filter("__found", right), 1, k)).alias("__p", "__e"))
    return pairs.select("query_id", F.col("__e.id").alias("id"), (F.col("__p") + 1).alias("rank"), F.col("__e.distance").alias("distance"))
