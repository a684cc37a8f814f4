"""Regression forests of all segments at once, grown level by level.

Trees are rows of a table of nodes (segment, tree, node, feature, threshold, mean, n), node 1 the root, 2i and 2i + 1 the children of i. A level
is one aggregation for all segments and trees: weight and sum of the target by (segment, tree, node, feature, bin), running sums over the
bins of a node, and the bin after which the squared loss falls most. Rows of a segment whose features all lie in the same bins go the same way, so
they are added up first, once for all levels: what moves to the children are these sums, and those of finished nodes drop out. A segment may be
of any size and a dominant one is as many cells as any other.

Bins end at exact quantiles of the segment's training rows. Each tree weighs rows by Poisson draws from the
MD5 of the row's key: a bootstrap. Every node keeps its mean, so the forests of a whole grid are prefixes of one: the first trees, cut at a depth.

Edge cases: a null target takes no part; a null feature lies in the lowest bin; equal gains go to the first feature and the lower threshold;
a null segment is a segment; a segment without rows has no forest and no estimates.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from tarifa.operators.ranks import sum_before
from tarifa.operators.segments import _PRIME, POISSON
from tarifa.sources.scratch import written

TREES, DEPTH, BINS, LEAST_GAIN = 100, 10, 32, 1e-9
#: Nodes that are sent to all tasks for estimates; of more, rows meet their nodes level by level.
HELD_NODES = 1_000_000
_KEY = ["segment", "tree", "node"]


def _values(features: Sequence[str]) -> Column:
    return F.array(*[F.coalesce(F.col(f).cast("double"), F.lit(float("-inf"))) for f in features])


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    return F.expr(" AND ".join(f"{a}.`{k}` <=> {b}.`{k}`" for k in keys))


def cuts(rows: DataFrame, p: int, bins: int) -> DataFrame:
    """segment, cuts: for each feature the values that bins end at, ascending: those of ranks n / bins, 2 n / bins, ... (rounded up)."""
    counts = rows.select(F.struct("segment").alias("u"), F.posexplode("x").alias("f", "v")).groupBy("u", "f", "v").agg(F.count("*").alias("c"))
    counts = written(counts, "forest-values")
    totals = counts.groupBy("u", "f").agg(F.sum("c").alias("n"))  # a row per segment and feature
    placed = sum_before(counts, ["u", "f"], "v", "c", "b").join(totals, ["u", "f"])
    ends = F.expr(f"exists(sequence(1, {bins - 1}), i -> greatest(1, ceil(n * i / {bins}D)) > b AND greatest(1, ceil(n * i / {bins}D)) <= b + c)") if bins > 1 else F.lit(False)
    found = placed.groupBy("u", "f").agg(F.array_sort(F.collect_list(F.when(ends, F.col("v")))).alias("cuts"))  # fewer than ``bins`` values
    by_feature = F.transform(F.array_sort(F.collect_list(F.struct("f", "cuts"))), lambda e: e["cuts"])
    return found.groupBy("u").agg(by_feature.alias("cuts")).select("u.segment", "cuts")


def _cells(rows: DataFrame, trees: int) -> DataFrame:
    """segment, tree, b, w, wy: weight and sum of the target of the rows that lie in the same bins; ``rows`` has ``own``, its (segment, b)."""
    hashed = F.md5(F.concat_ws("|", F.lit("forest"), "key"))
    part = lambda at: F.conv(F.substring(hashed, at, 8), 16, 10).cast("long")
    draws = rows.select("own", "y", (part(1) % _PRIME).alias("s1"), (part(9) % (_PRIME - 1) + 1).alias("s2")).withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees))))
    draws = draws.withColumn("u", F.expr(f"pmod(s1 + tree * s2, {_PRIME}L)")).withColumn("w", sum((F.when(F.col("u") >= c, 1).otherwise(0) for c in POISSON), F.lit(0)))
    sums = draws.where("w > 0").groupBy("own", "tree").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("wy"))
    return sums.select("tree", "w", "wy", F.explode("own").alias("own")).select("own.segment", "tree", "own.b", "w", "wy").groupBy("segment", "tree", "b").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))


def fit(df: DataFrame, segment: str, features: Sequence[str], target: str, key: str, trees: int = TREES, depth: int | None = DEPTH, bins: int = BINS) -> DataFrame:
    """The table of nodes. ``depth`` None grows until no split lowers the loss (nodes are numbered in 63 bits: at most 61 levels).

    Where ``segment`` is an array, a row takes part in the forests of all segments in it, with the same weights.
    """
    spark, p = df.sparkSession, len(features)
    several = isinstance(df.schema[segment].dataType, ArrayType)
    of = F.col(segment) if several else F.array(segment)
    rows = df.where(F.col(target).isNotNull()).select(of.alias("of"), F.col(key).cast("string").alias("key"), _values(features).alias("x"), F.col(target).cast("double").alias("y"))
    rows = written(rows, "forest-rows")
    edges = written(cuts(rows.select(F.explode("of").alias("segment"), "x"), p, bins), "forest-cuts")
    # what a row needs of each of its segments: the rows with the same list of them share the edges
    lists = rows.select("of").distinct().select("of", F.posexplode("of").alias("i", "segment")).alias("l").join(edges.alias("e"), _same(["segment"], "l", "e"))
    lists = lists.groupBy("l.of").agg(F.array_sort(F.collect_list(F.struct("i", "l.segment", "cuts"))).alias("ends"))
    own = F.expr("transform(ends, e -> struct(e.segment AS segment, transform(x, (v, i) -> CAST(size(filter(e.cuts[i], c -> c < v)) AS smallint)) AS b))")
    state = _cells(rows.alias("r").join(lists.alias("l"), _same(["of"], "r", "l")).select(own.alias("own"), "key", "y"), trees).withColumn("node", F.lit(1).cast("long"))
    levels = []
    for level in range(min(61 if depth is None else depth, 61) + 1):
        state = written(state, "forest-cells")
        cells = state.select(*_KEY, "w", "wy", F.posexplode("b").alias("feature", "bin")).groupBy(*_KEY, "feature", "bin").agg(F.sum("w").alias("w"), F.sum("wy").alias("wy"))
        of_node = Window.partitionBy(*_KEY, "feature")
        so_far = of_node.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        sums = cells.select(*_KEY, "feature", "bin", F.sum("w").over(so_far).alias("lw"), F.sum("wy").over(so_far).alias("ly"), F.sum("w").over(of_node).alias("w"), F.sum("wy").over(of_node).alias("wy"))
        rw, ry = F.col("w") - F.col("lw"), F.col("wy") - F.col("ly")
        gain = F.when(rw > 0, F.round(F.col("ly") * F.col("ly") / F.col("lw") + ry * ry / F.nullif(rw, F.lit(0)) - F.col("wy") * F.col("wy") / F.col("w"), 9))
        split = F.max_by(F.struct("feature", "bin", gain.alias("gain")), F.struct(gain.alias("gain"), (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b")))
        found = sums.groupBy(*_KEY).agg(F.first("w").alias("n"), (F.first("wy") / F.first("w")).alias("mean"), split.alias("s"))
        last = depth is not None and level == depth
        usable = F.lit(False) if last else F.col("s.gain") > LEAST_GAIN
        found = found.select(*_KEY, "n", "mean", *[F.when(usable, F.col(f"s.{c}")).alias(c) for c in ("feature", "bin", "gain")])
        levels.append(written(found, "forest-level"))
        splits = levels[-1].where("feature IS NOT NULL").select(*_KEY, F.col("feature").alias("f"), F.col("bin").alias("c"))
        if last or splits.isEmpty():
            break
        joined = state.alias("r").join(splits.alias("s"), _same(_KEY, "r", "s"))
        state = joined.select("r.segment", "r.tree", (F.col("r.node") * 2 + F.when(F.col("b")[F.col("f")] > F.col("c"), 1).otherwise(0)).alias("node"), "w", "wy", "b")
    nodes = reduce(DataFrame.unionByName, levels).alias("n").join(F.broadcast(edges).alias("e") if edges.count() * p * bins <= HELD_NODES else edges.alias("e"), _same(["segment"], "n", "e"))
    return written(nodes.select("n.segment", "tree", "node", "feature", F.expr("get(get(cuts, feature), bin)").alias("threshold"), "mean", "n", "gain"), "forest-nodes") if levels else spark.createDataFrame([], "segment string")


def choose(df: DataFrame, segment: str, features: Sequence[str], target: str, key: str, grid: Sequence[tuple[int, int | None]], folds: int = 5, bins: int = BINS) -> DataFrame:
    """segment, best: the place in ``grid`` with the best mean R2 over folds of whole keys, the first of equal ones.

    The forests of all folds are grown at once, as segments of their own, and once for all of the grid.
    """
    label = F.coalesce(F.concat(F.lit("v"), F.col(segment).cast("string")), F.lit("n"))
    rows = df.select("*", label.alias("__s"), F.pmod(F.xxhash64(key), F.lit(folds)).cast("int").alias("__f"))
    others = F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda f: f != F.col("__f"))
    train = rows.withColumn("__u", F.transform(others, lambda o: F.concat_ws("|", o, "__s")))
    depths = [d for _, d in grid]
    nodes = fit(train, "__u", features, target, key, max(t for t, _ in grid), None if None in depths else max(depths), bins)
    held = estimate(rows.where(F.col(target).isNotNull()).withColumn("__u", F.concat_ws("|", "__f", "__s")), nodes, "__u", features, "__e", grid).where("__e IS NOT NULL")
    long = held.select(F.col(segment).alias("segment"), "__f", F.col(target).alias("y"), F.posexplode("__e").alias("g", "e"))
    loss, spread = F.sum((F.col("y") - F.col("e")) * (F.col("y") - F.col("e"))), F.var_pop("y") * F.count("*")
    r2 = long.groupBy("segment", "__f", "g").agg(loss.alias("l"), spread.alias("t")).where("t > 1e-12").groupBy("segment", "g").agg(F.avg(1 - F.col("l") / F.col("t")).alias("r2"))
    return written(r2.groupBy("segment").agg(F.max_by("g", F.struct("r2", -F.col("g"))).alias("best")), "forest-grid")


def importances(nodes: DataFrame, features: Sequence[str]) -> DataFrame:
    """segment, importances: each feature's share of what a tree's splits take off the loss, on average over the trees."""
    by_tree = nodes.groupBy("segment", "tree", "feature").agg(F.sum("gain").alias("g"))
    share = F.col("g") / F.nullif(F.sum("g").over(Window.partitionBy("segment", "tree")), F.lit(0.0))  # a row per feature
    trees = nodes.groupBy("segment").agg(F.count_distinct("tree").alias("trees"))
    sums = by_tree.withColumn("g", share).where("feature IS NOT NULL").groupBy("segment", "feature").agg(F.sum("g").alias("g"))
    shares = sums.alias("s").join(trees.alias("t"), _same(["segment"], "s", "t")).select("s.segment", F.get(F.array(*map(F.lit, features)), F.col("feature")).alias("name"), (F.col("g") / F.col("trees")).alias("g"))
    return shares.groupBy("segment").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "g")))).alias("importances"))


def estimate(df: DataFrame, nodes: DataFrame, segment: str, features: Sequence[str], out: str, grid: Sequence[tuple[int, int | None]] = ((1 << 30, None),)) -> DataFrame:
    """``df`` with ``out``: for each (trees, depth) of ``grid`` the mean over the first trees of the deepest node reached; null without a forest."""
    rows = df.withColumns({"__s": F.coalesce(F.concat(F.lit("v"), F.col(segment).cast("string")), F.lit("n")), "__x": _values(features)})
    named = nodes.select(F.coalesce(F.concat(F.lit("v"), F.col("segment").cast("string")), F.lit("n")).alias("s"), "tree", "node", "feature", "threshold", "mean")
    if named.count() > HELD_NODES:
        return _by_levels(rows, named, out, grid).drop("__s", "__x")
    forests = {s: _Forest(g) for s, g in named.toPandas().groupby("s")}  # at most HELD_NODES rows

    @F.pandas_udf("array<double>")
    def walk(s: pd.Series, x: pd.Series) -> pd.Series:
        found = np.full((len(s), len(grid)), np.nan)
        for name in s.unique():
            if name in forests:
                at = np.flatnonzero((s == name).to_numpy())
                found[at] = forests[name].walk(np.stack(x.iloc[at].to_numpy()), grid)
        return pd.Series([None if np.isnan(r).any() else r for r in found])

    return rows.withColumn(out, walk("__s", "__x")).drop("__s", "__x")


class _Forest:
    """The nodes of a segment's trees as arrays."""

    def __init__(self, nodes: pd.DataFrame):
        nodes = nodes.sort_values(["tree", "node"], ignore_index=True)
        place = {k: i for i, k in enumerate(zip(nodes["tree"], nodes["node"]))}
        self.feature = nodes["feature"].fillna(-1).to_numpy(int)
        self.threshold, self.mean = nodes["threshold"].to_numpy(float), nodes["mean"].to_numpy(float)
        self.left = np.array([place.get((t, 2 * n), 0) for t, n in zip(nodes["tree"], nodes["node"])])
        self.right = np.array([place.get((t, 2 * n + 1), 0) for t, n in zip(nodes["tree"], nodes["node"])])
        roots = nodes.index[nodes["node"] == 1].to_numpy()
        self.roots = roots[np.argsort(nodes["tree"].to_numpy()[roots])]
        self.numbers = np.sort(nodes["tree"].to_numpy()[roots])

    def walk(self, x: np.ndarray, grid: Sequence[tuple[int, int | None]]) -> np.ndarray:
        total, count, rows = np.zeros((len(x), len(grid))), np.zeros(len(grid)), np.arange(len(x))
        for number, root in zip(self.numbers, self.roots):
            at, level = np.full(len(x), root), 0
            open_ = [g for g, (trees, _) in enumerate(grid) if number <= trees]
            count[open_] += 1
            while True:
                f = self.feature[at]
                ended = not (f >= 0).any()
                for g in [g for g in open_ if ended or grid[g][1] == level]:
                    total[:, g] += self.mean[at]
                    open_.remove(g)
                if not open_:
                    break
                low = x[rows, np.maximum(f, 0)] <= self.threshold[at]
                at, level = np.where(f < 0, at, np.where(low, self.left[at], self.right[at])), level + 1
        return total / np.maximum(count, 1)


def _by_levels(rows: DataFrame, nodes: DataFrame, out: str, grid: Sequence[tuple[int, int | None]]) -> DataFrame:
    """``estimate`` by joins: the distinct vectors of a segment stand at a node of each tree."""
    vectors = written(rows.select("__s", "__x").distinct(), "forest-vectors")
    roots = nodes.where("node = 1").select("s", "tree").distinct()
    state = vectors.join(roots, vectors["__s"] == roots["s"]).select("s", F.col("__x").alias("x"), "tree", F.lit(1).cast("long").alias("node"))
    found, level = None, 0
    while True:
        here = written(state.join(nodes, ["s", "tree", "node"]), "forest-walk")
        due = [F.when((F.col("tree") <= trees) & (F.col("feature").isNull() if depth is None else F.col("feature").isNull() | F.lit(level == depth)) & F.lit(depth is None or level <= depth), F.col("mean")).alias(f"g{g}") for g, (trees, depth) in enumerate(grid)]
        part = here.select("s", "x", *due)
        found = part if found is None else found.unionByName(part)
        here = here.where("feature IS NOT NULL")
        if here.isEmpty():
            break
        state = here.select("s", "x", "tree", (F.col("node") * 2 + F.when(F.expr("x[feature]") <= F.col("threshold"), 0).otherwise(1)).alias("node"))
        level += 1
    means = found.groupBy("s", "x").agg(F.array(*[F.avg(f"g{g}") for g in range(len(grid))]).alias(out))
    return rows.join(means, (F.col("__s") == F.col("s")) & (F.col("__x") == F.col("x")), "left").drop("s", "x")
