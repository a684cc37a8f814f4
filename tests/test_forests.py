"""Forests of segments: against a plain tree, ways of estimating, grid, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.operators import forests, segments


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    out = [(i, ["a", "b", None][i % 3], float(rng.integers(0, 20)), float(rng.integers(0, 20))) for i in range(450)]
    out = [(*r, (r[2] > 10) * 3.0 + (r[3] if r[1] == "a" else 0) * 0.1 + float(rng.normal(0, 0.1))) for r in out]
    return spark.createDataFrame(out, "id long, g string, a double, b double, y double")


def plain_tree(x, y, w, cuts, depth, node=1, out=None):
    """Nodes of one weighted tree by looking at every feature and every cut."""
    out = {} if out is None else out
    n, total = w.sum(), (w * y).sum()
    best = (1e-9, None, None)
    for f in range(x.shape[1]):
        for b, c in enumerate(cuts[f]):
            low = x[:, f] <= c
            ln, ly = w[low].sum(), (w * y)[low].sum()
            if 0 < ln < n:
                gain = round(ly**2 / ln + (total - ly) ** 2 / (n - ln) - total**2 / n, 9)
                if gain > best[0]:
                    best = (gain, f, b)
    split = best[1] is not None and depth > 0
    out[node] = (n, total / n, best[1] if split else None, cuts[best[1]][best[2]] if split else None)
    if split:
        low = x[:, best[1]] <= cuts[best[1]][best[2]]
        for side, at in ((0, low), (1, ~low)):
            plain_tree(x[at], y[at], w[at], cuts, depth - 1, 2 * node + side, out)
    return out


def test_trees_like_plain_ones(spark, rows):
    import hashlib

    nodes = forests.fit(rows, "g", ["a", "b"], "y", "id", trees=4, depth=3, bins=8).toPandas()
    assert set(nodes["segment"].fillna("none")) == {"a", "b", "none"} and set(nodes.tree) == {1, 2, 3, 4}
    for g, own in rows.toPandas().groupby(rows.toPandas().g.fillna("none")):
        x, y = own[["a", "b"]].to_numpy(), own.y.to_numpy()
        cuts = [sorted({np.sort(x[:, f])[max(1, int(np.ceil(len(x) * i / 8))) - 1] for i in range(1, 8)}) for f in range(2)]
        for tree in (1, 4):
            w = []
            for i in own.id:
                h = hashlib.md5(f"forest|{i}".encode()).hexdigest()
                u = (int(h[:8], 16) % segments._PRIME + tree * (int(h[8:16], 16) % (segments._PRIME - 1) + 1)) % segments._PRIME
                w.append(sum(u >= c for c in segments.POISSON))
            w = np.array(w, float)
            want = plain_tree(x[w > 0], y[w > 0], w[w > 0], cuts, 3)
            got = nodes[(nodes["segment"].fillna("none") == g) & (nodes.tree == tree)]
            assert set(got.node) == set(want) and 0.85 < w.mean() < 1.15
            for r in got.itertuples():
                n, mean, f, c = want[r.node]
                assert r.n == n and r.mean == pytest.approx(mean) and (f is None) == (r.feature != r.feature) and (f is None or (r.feature, r.threshold) == (f, c))


def test_estimates_by_both_ways(spark, rows, monkeypatch):
    nodes = forests.fit(rows, "g", ["a", "b"], "y", "id", trees=12, depth=None)
    grid = [(12, None), (5, 2), (12, 0), (1, None)]
    asked = rows.union(spark.createDataFrame([(1000, "unknown", 1.0, 1.0, 0.0), (1001, "a", None, 3.0, 0.0)], rows.schema))
    one = {r["id"]: r["e"] for r in forests.estimate(asked, nodes, "g", ["a", "b"], "e", grid).collect()}
    monkeypatch.setattr(forests, "HELD_NODES", 10)
    two = {r["id"]: r["e"] for r in forests.estimate(asked, nodes, "g", ["a", "b"], "e", grid).collect()}
    assert one[1000] is None and two[1000] is None and len(one) == len(two) == 452
    for i in one:
        if i != 1000:
            assert one[i] == pytest.approx(two[i])
    p = rows.toPandas().set_index("id")
    off = np.array([one[i][0] for i in p.index]) - p.y
    assert 1 - (off**2).sum() / ((p.y - p.y.mean()) ** 2).sum() > 0.99
    assert all(s["a"] > 0.5 for s in (r["importances"] for r in forests.importances(nodes, ["a", "b"]).collect()))


def test_grid_takes_what_predicts_best(spark, rows):
    best = {r["segment"]: r["best"] for r in forests.choose(rows, "g", ["a", "b"], "y", "id", [(2, 0), (12, 5), (12, 1)]).collect()}
    assert best["a"] == 1 and set(best) == {"a", "b", None} and 0 not in best.values()


def test_segments_and_scoring(spark, rows):
    df = rows.withColumns({"part": F.when(F.col("id") % 5 == 0, "test").otherwise("train"), "estimate": F.lit(1.0), "c": F.lit("all")})
    df = df.union(spark.createDataFrame([(2000 + i, "tiny", 1.0 * i, 2.0, 1.0, "train", 1.0, "all") for i in range(3)], df.schema))
    models, nodes = segments.segment_forests(df, "g", ["a", "b"], "y", "estimate", "id", ((10, 4), (10, 1)))
    got = {r["g"]: r for r in models.collect()}
    assert got["a"]["kept"] and got[None]["kept"] and not got["tiny"]["fitted"] and not got["tiny"]["kept"] and got["a"]["r2"] > got["a"]["r2_category"]
    assert {r["segment"] for r in nodes.select("segment").distinct().collect()} == {"a", "b", None}
    coarse, coarse_nodes = segments.segment_forests(df, "c", ["a", "b"], "y", "estimate", "id", ((10, 4),))
    scored = segments.score_cascade(df, models, coarse, "g", "c", ["a", "b"], "estimate", nodes, coarse_nodes)
    assert {(r["g"], r["source"]) for r in scored.select("g", "source").distinct().collect()} == {("a", "n2"), ("b", "n2"), (None, "n2"), ("tiny", "n1")}


def test_nothing_to_learn_from(spark, rows):
    same = rows.withColumn("y", F.lit(2.0))
    nodes = forests.fit(same, "g", ["a", "b"], "y", "id", trees=2, depth=4)
    assert nodes.where("feature IS NOT NULL OR mean <> 2.0").isEmpty() and nodes.count() == 6
    none = forests.fit(rows.limit(0), "g", ["a", "b"], "y", "id", trees=2, depth=4)
    assert none.count() == 0 and forests.estimate(rows.limit(3), none, "g", ["a", "b"], "e").where("e IS NOT NULL").isEmpty()


def test_bins_of_many_distinct_values_end_at_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    x = rng.permutation(60_000) / 7.0
    rows = spark.createDataFrame(list(zip(["s"] * len(x), [[float(v)] for v in x])), "segment string, x array<double>").repartition(8)
    found = forests.cuts(rows, 1, 32).first()["cuts"][0]
    assert found == [float(np.sort(x)[int(np.ceil(len(x) * i / 32)) - 1]) for i in range(1, 32)]


def test_levels_work_on_sums_of_equal_bins(spark, monkeypatch):
    """However many rows there are, a tree's cells are no more than the combinations of its bins."""
    kept = {}
    write = forests.written
    monkeypatch.setattr(forests, "written", lambda df, name: kept.setdefault((name, len(kept)), write(df, name)))
    rows = spark.range(20_000).selectExpr("id", "'s' AS g", "CAST(id % 3 AS DOUBLE) AS a", "CAST(id % 4 AS DOUBLE) AS b", "CAST(id % 12 AS DOUBLE) AS y")
    forests.fit(rows, "g", ["a", "b"], "y", "id", trees=5, depth=2)
    cells = [df.count() for (name, _), df in kept.items() if name == "forest-cells"]
    assert cells and max(cells) <= 5 * 12


def test_folds_of_a_grid_are_forests_of_the_other_rows(spark, rows):
    several = rows.withColumn("u", F.expr("array(concat('x', id % 2), 'all')"))
    nodes = forests.fit(several, "u", ["a", "b"], "y", "id", trees=3, depth=3).drop("gain").toPandas().sort_values(["segment", "tree", "node"], ignore_index=True)
    for name, own in (("x1", rows.where("id % 2 = 1")), ("all", rows)):
        want = forests.fit(own.withColumn("u", F.lit(name)), "u", ["a", "b"], "y", "id", trees=3, depth=3).toPandas().sort_values(["segment", "tree", "node"], ignore_index=True)
        got = nodes[nodes.segment == name].reset_index(drop=True)
        assert list(zip(got.tree, got.node, got.n, got.feature.fillna(-1), got.threshold.fillna(-1))) == list(zip(want.tree, want.node, want.n, want.feature.fillna(-1), want.threshold.fillna(-1)))
        assert np.allclose(got["mean"], want["mean"])
