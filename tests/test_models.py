import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarifa.functions.tails import chi2_upper, f_upper, t_quantile
from tarifa.operators import clusters, forest, panel, regression, segments, serve
from tarifa.operators.design import CircularityError, DesignSpec


@pytest.fixture(scope="module")
def sample():
    rng = np.random.default_rng(0)
    n = 300
    p = pd.DataFrame({"id": range(n), "a": rng.normal(size=n), "b": rng.normal(size=n) * 3, "g": rng.choice(["x", "y", "z"], n), "c": rng.integers(0, 40, n)})
    p["y"] = 1 + 0.5 * p.a - 0.2 * p.b + (p.g == "y") * 0.3 + rng.normal(size=n) * (0.1 + 0.2 * abs(p.a))
    return p


def design(p):
    return np.column_stack([np.ones(len(p)), p.a, p.b, p.g == "y", p.g == "z"]).astype(float)


def test_ols_covariances(spark, sample):
    df = spark.createDataFrame(sample).repartition(3)
    spec = DesignSpec.fit(df, ["a", "b"], ["g"])
    x, y = design(sample), sample.y.to_numpy()
    inv = np.linalg.inv(x.T @ x)
    beta = inv @ x.T @ y
    e, h = y - x @ beta, np.einsum("ij,jk,ik->i", x, inv, x)
    m = regression.ols(df, spec, F.col("y"))
    assert m.names == ["const", "a", "b", "g_y", "g_z"] and np.allclose(m.beta, beta)
    hc3 = inv @ (x.T * (e / (1 - h)) ** 2) @ x @ inv
    assert np.allclose(m.covariance, hc3)
    s2 = e @ e / (len(y) - 5)
    assert np.allclose(regression.ols(df, spec, F.col("y"), "nonrobust").covariance, inv * s2)
    scores = np.array([x[sample.c == c].T @ e[sample.c == c] for c in sorted(set(sample.c))])
    groups, n = len(scores), len(y)
    want = inv @ scores.T @ scores @ inv * groups / (groups - 1) * (n - 1) / (n - 5)
    assert np.allclose(regression.ols(df, spec, F.col("y"), cluster="c").covariance, want)
    assert m.r2 == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    cook = regression.cook(df, m, F.col("y")).orderBy("id").toPandas()
    assert np.allclose(cook.leverage, h) and np.allclose(cook.cook, e**2 * h / (5 * s2 * (1 - h) ** 2))
    pred = df.select(m.predict().alias("p"), m.interval().alias("w")).orderBy("p").toPandas()
    assert np.allclose(pred.p, np.sort(x @ beta)) and (pred.w > 0).all()


def test_diagnostics(spark, sample):
    df = spark.createDataFrame(sample)
    x = design(sample)
    spec = DesignSpec.fit(df, ["a", "b"], ["g"])
    want = {}
    for j, name in enumerate(spec.names, 1):
        o = np.delete(x, j, 1)
        r = x[:, j] - o @ np.linalg.lstsq(o, x[:, j], rcond=None)[0]
        want[name] = ((x[:, j] - x[:, j].mean()) ** 2).sum() / (r @ r)
    got = regression.vif(df, spec).set_index("feature").vif
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    two = DesignSpec.fit(df, ["a", "b"], [])
    m = regression.ols(df, two, F.col("y"))
    z = np.column_stack([np.ones(len(sample)), sample.a, sample.b, sample.a**2, sample.a * sample.b, sample.b**2])
    e2 = (sample.y - x[:, :3] @ m.beta).to_numpy() ** 2
    r = e2 - z @ np.linalg.lstsq(z, e2, rcond=None)[0]
    assert regression.white(df, m, F.col("y"))["lm"] == pytest.approx(len(e2) * (1 - r @ r / ((e2 - e2.mean()) ** 2).sum()))
    chow = regression.chow(df, ["a", "b"], "g", F.col("y"))
    assert chow["df_num"] == 4 and 0 <= chow["p_value"] <= 1


def test_ridge_closed_form(spark, sample):
    df = spark.createDataFrame(sample)
    m = regression.ridge(df, DesignSpec.fit(df, ["a", "b"], ["g"]), F.col("y"), "c")
    x, y = design(sample)[:, 1:], sample.y.to_numpy()
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + m.alpha * np.eye(4), z.T @ (y - y.mean())) / x.std(0)
    assert m.alpha in regression.ALPHAS and np.allclose(m.coefficients, want)
    with pytest.raises(ValueError):
        regression.ridge(df.where("c = 1"), DesignSpec.fit(df, ["a"], []), F.col("y"), "c")


def test_circularity():
    for names in (["prix_tnd"], ["gamme_prix_Premium"], ["cluster_id"]):
        with pytest.raises(CircularityError):
            DesignSpec(names, []).__class__.fit(None, names, [])


def test_circularity_by_lineage(spark):
    """A price under another name is refused, through whatever it went; columns beside it are not."""
    df = spark.createDataFrame([(1, 10.0, 2.0, "a"), (2, 20.0, 3.0, "b")], "id long, price double, size double, kind string")
    renamed = df.withColumnRenamed("price", "x").select("id", "size", "kind", F.col("x").alias("z"))
    through = df.select("id", "size", "kind", F.explode(F.array("price", F.lit(1.0))).alias("z"))
    grouped = df.groupBy("kind").agg(F.avg("price").alias("z"), F.avg("size").alias("size"))
    joined = df.select("id", "size", "kind").join(df.select(F.col("id").alias("other"), F.log("price").alias("z")), F.col("id") == F.col("other"))
    union = df.select("id", "size", "kind", F.lit(0.0).alias("z")).union(df.select("id", "size", "kind", F.col("price") * 2))
    window = df.withColumn("z", F.rank().over(Window.orderBy("price"))).drop("price")
    for rows in (renamed, through, grouped, joined, union, window):
        assert DesignSpec.fit(rows, ["size"], ["kind"]).names == ["size", *(f"kind_{k}" for k in "b")]
        with pytest.raises(CircularityError, match="z \\(from price\\)"):
            DesignSpec.fit(rows, ["size", "z"], [])


def test_tails():
    assert chi2_upper(3.841458820694124, 1) == pytest.approx(0.05) and f_upper(4.102821015, 2, 10) == pytest.approx(0.05) and t_quantile(0.975, 10) == pytest.approx(2.2281388519649385)


def test_forest(spark, sample):
    df = spark.createDataFrame(sample)
    m = forest.fit(df, ["a", "b"], "y", "c", trees=(10,), depths=(4,))
    assert forest.importances(m, ["a", "b"]).importance.sum() == pytest.approx(1)
    lost = forest.permutation_importance(m, df, ["a", "b"], "y", repeats=2)
    assert (lost.importance_mean > 0).all()


def test_clusters_and_stability(spark):
    rng = np.random.default_rng(1)
    rows = [(i, "B", "T", float(x), float(y)) for i, (x, y) in enumerate(np.vstack([rng.normal(0, 0.1, (20, 2)), rng.normal(5, 0.1, (20, 2))]))] + [(100 + i, "S", "T", 1.0 * i, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, brand string, tier string, x double, y double")
    out = segments.cluster_units(df, ["brand", "tier"], ["x", "y"]).toPandas()
    big = out[out.brand == "B"].sort_values("id")
    assert big.outcome.eq("clustered").all() and big.cluster.tolist() == [0] * 20 + [1] * 20
    assert out[out.brand == "S"].outcome.eq("too_small").all()
    trace = segments.k_trace(df, ["brand", "tier"], ["x", "y"]).toPandas()
    assert trace[trace.chosen].k.tolist() == [2]
    s = segments.stability(df, ["brand", "tier"], ["x", "y"], replicates=5).toPandas().set_index("brand")
    assert s.ari_mean["B"] == pytest.approx(1) and pd.isna(s.ari_mean["S"])


def test_large_units_give_the_same_clusters(spark, monkeypatch):
    """With a lowered bound all units are clustered by sums over tasks, in waves: clusters, traces and stability stay the same."""
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for brand, spots in (("A", [(0, 0), (4, 0), (0, 5)]), ("B", [(0, 0)]), (None, [(0, 0), (9, 9)]), ("D", [(1, 1), (2, 7), (7, 2), (8, 8)])):
        for x, y in spots:
            for _ in range(60 if len(spots) > 1 else 90):
                rows.append((at, brand, "T", float(np.round(x + rng.normal(0, 0.6), 1)), float(np.round(y + rng.normal(0, 0.6), 1)) if at % 50 else None))
                at += 1
    rows += [(at + i, "S", "T", 1.0 * i, 0.0) for i in range(6)]
    df = spark.createDataFrame(rows, "id long, brand string, tier string, x double, y double").repartition(7)
    get = lambda t, *by: t.orderBy(*by).toPandas()
    every = lambda: (get(segments.cluster_units(df, ["brand", "tier"], ["x", "y"]), "id"), get(segments.k_trace(df, ["brand", "tier"], ["x", "y"]), "brand", "k"), get(segments.stability(df, ["brand", "tier"], ["x", "y"], replicates=12), "brand"))
    one = every()
    monkeypatch.setattr(segments, "MAX_UNIT", 20)
    monkeypatch.setattr(clusters, "WAVE", 3)
    monkeypatch.setattr(clusters, "TILE", 40)
    for a, b in zip(one, every()):
        pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)
    assert one[0].groupby("brand").cluster.nunique().to_dict() == {"A": 3, "B": one[0][one[0].brand == "B"].cluster.nunique(), "D": 4, "S": 1} and one[2].set_index("brand").ari_mean["D"] > 0.9


def test_silhouette_like_its_definition():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(70, 2))
    centres = np.array([[-1.0, 0.0], [1.0, 0.0], [0.0, 9.0], [0.0, 2.0]])
    label = ((x[:, None] - centres) ** 2).sum(2).argmin(1)
    d, total = np.sqrt(((x[:, None] - x) ** 2).sum(2)), 0.0
    for i in range(70):
        same = (label == label[i]) & (np.arange(70) != i)
        if same.any():
            a, b = d[i, same].mean(), min(d[i, label == j].mean() for j in set(label) - {label[i]})
            total += (b - a) / max(a, b)
    assert clusters.Silhouettes({4: centres}).answer(x, np.zeros(70, np.uint64))[4] == pytest.approx(total)


def test_starts_are_drawn_by_squared_distance():
    """The second centre is drawn in proportion to the squared distance from the first."""
    x = np.array([[0.0], [1.0], [2.0]])
    drawn = np.zeros(3)
    for seed in range(4000):
        _, rows = clusters.Pick([(0, -1)], np.array([[[0.0]]])).answer(x, np.random.default_rng(seed).integers(0, 1 << 63, 3).astype(np.uint64))
        drawn[int(rows[0, 0])] += 1
    assert drawn[0] == 0 and abs(drawn[2] / 4000 - 0.8) < 0.03


def test_bootstrap(spark):
    rows = [("same", s, i, 10.0 + i, 10.0 + i) for s in (0, 1) for i in range(20)] + [("up", s, i, (10.0 + i) * (1 + s), 10.0 + i) for s in (0, 1) for i in range(25)]
    rows += [("one", 0, 1, 1.0, 1.0), ("one", 1, 1, 1.0, 1.0), ("gone", 0, 1, 1.0, 1.0), ("gone", 0, 2, 1.0, 1.0), (None, 0, 1, 2.0, 1.0), (None, 0, 2, 2.0, 1.0), (None, 1, 1, 4.0, 1.0), (None, 1, 2, 4.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, side int, id int, real double, estimated double")
    out = segments.bootstrap_gap(df, ["k"], "id", 300).toPandas()
    assert out[out.k.isna()].low.item() == out[out.k.isna()].high.item() == 100  # constant sides: every replicate that has both gives the same
    out = out.set_index("k")
    assert out[out.index.notna()].significant.to_dict() == {"same": False, "up": True, "one": False, "gone": False}
    assert out.low["up"] > 0 and pd.isna(out.low["one"]) and pd.isna(out.low["gone"])
    assert segments.bootstrap_gap(df, ["k"], "id", 0).toPandas().low.isna().all()
    assert segments.bootstrap_gap(df.limit(0), ["k"], "id").count() == 0


def test_bootstrap_agrees_with_drawing_rows(spark):
    """The interval is the one that drawing rows with replacement gives, up to the noise of 2,000 replicates."""
    rng = np.random.default_rng(7)
    x = {s: np.column_stack([rng.lognormal(3 + 0.1 * s, 0.3, 150), rng.lognormal(3, 0.2, 150)]) for s in (0, 1)}
    df = spark.createDataFrame([("k", s, i, float(a), float(b)) for s in (0, 1) for i, (a, b) in enumerate(x[s])], "k string, side int, id int, real double, estimated double")
    got = segments.bootstrap_gap(df, ["k"], "id", 2000).first()
    means = [np.exp(np.log(x[s])[rng.integers(0, 150, (4000, 150))].mean(1)) for s in (0, 1)]
    change = means[1] / means[0] * 100
    low, high = np.quantile(change[:, 0] - change[:, 1], [0.025, 0.975])
    assert abs(got["low"] - low) < 0.1 * (high - low) and abs(got["high"] - high) < 0.1 * (high - low)


def test_sides_pair_available_periods(spark):
    df = spark.createDataFrame([("a", 1, "p"), ("a", 3, "q"), ("a", 7, "r"), ("b", 3, "s"), (None, 1, "t"), (None, 2, "u")], "k string, period int, product string")
    got = sorted((r["k"] or "", r["t"], r["side"], r["product"]) for r in segments.sides(df, ["k"]).collect())
    assert got == [("", 1, 0, "t"), ("", 1, 1, "u"), ("a", 1, 0, "p"), ("a", 1, 1, "q"), ("a", 3, 0, "q"), ("a", 3, 1, "r")]


def test_permutations_keep_every_value(spark):
    for n in (1, 2, 3, 17, 400):
        rows, size = forest.numbered(spark.range(n, numPartitions=5).select((F.col("id") % 7).alias("v"), "id"))
        assert size == n and sorted(r["__n"] for r in rows.collect()) == list(range(n))
        made = [[(r["id"], r["v"]) for r in forest.permuted(rows, n, "v", key).orderBy("id").collect()] for key in (1, 2)]
        for m in made:
            assert [i for i, _ in m] == list(range(n)) and sorted(v for _, v in m) == sorted(i % 7 for i in range(n))
    assert made[0] != made[1] and sum(v == i % 7 for i, v in made[0]) < 120  # about a seventh stays by chance
    assert forest.numbered(spark.range(0).select("id"))[1] == 0


def test_segments_keep_what_beats_the_category(spark, sample):
    p = sample.assign(s=np.where(sample.id < 6, "tiny", np.where(sample.id % 2, "odd", "even")), part=np.where(sample.id % 5 == 0, "test", "train"))
    p["y"] = np.where(p.s == "odd", 2 * p.a, -p.a)
    df = spark.createDataFrame(p).withColumn("estimate", F.lit(0.0))
    out = segments.segment_models(df, "s", ["a"], "y", "estimate")
    got = {(r["s"], r["family"]): r for r in out.collect()}
    assert got["odd", "hedonic"]["kept"] and got["odd", "hedonic"]["coefficients"]["a"] == pytest.approx(2)
    assert not got["tiny", "hedonic"]["fitted"]
    scored = segments.score_cascade(df, out.where("family = 'hedonic'"), segments.segment_models(df, "g", ["a"], "y", "estimate").where("1 = 0"), "s", "g", ["a"], "estimate")
    assert {(r["s"], r["source"]) for r in scored.select("s", "source").distinct().collect()} == {("odd", "n2"), ("even", "n2"), ("tiny", "categorie")}


def test_tiers(spark):
    rows = [("a", float(i)) for i in range(20)] + [("b", float(i)) for i in range(12)] + [("c", float(i)) for i in range(6)] + [("d", 1.0)] * 3 + [("e", 7.0)] * 16
    out = panel.tiers(spark.createDataFrame(rows, "brand string, price double")).toPandas()
    assert out.groupby("brand").tier.nunique().to_dict() == {"a": 3, "b": 2, "c": 1, "e": 0} and "d" not in set(out.brand)
    want = pd.qcut(pd.Series(range(20), dtype=float), 3, labels=["Économique", "Milieu de gamme", "Premium"]).astype(str).tolist()
    assert out[out.brand == "a"].sort_values("price").tier.tolist() == want


def test_rank_statistics(spark, sample):
    df = spark.createDataFrame(sample.assign(a=sample.a.round(1)))
    want = sample.a.round(1).rank().corr(sample.y.rank())
    assert panel.spearman(df, "a", "y").first()["rho"] == pytest.approx(want)
    r = sample.a.round(1).rank()
    n = len(r)
    h = 12 / (n * (n + 1)) * sum(v.sum() ** 2 / len(v) for _, v in r.groupby(sample.g)) - 3 * (n + 1)
    t = sample.a.round(1).value_counts()
    assert panel.kruskal(df, "g", "a").first()["h"] == pytest.approx(h / (1 - (t**3 - t).sum() / (n**3 - n)))


def test_serving(spark):
    products = spark.createDataFrame([(1, "A", "k", 10.0, 1.0, 0), (2, "A", "k", 20.0, 2.0, 1), (3, "A", "k", 90.0, 9.0, 2)], "id long, brand string, category string, price double, size double, cluster int").withColumn("tier", F.when(F.col("price") < 50, "low").otherwise("high"))
    new = spark.createDataFrame([(9, "A", "k", 19.0, 1.9)], "id long, brand string, category string, price double, size double")
    assert serve.assign_segment(new, panel.tier_ranges(products), products, ["size"]).first()["cluster"] == 1
    assert [r["id"] for r in serve.similar(new, products, ["size", "price"], 2).orderBy("rank").collect()] == [2, 1]
    assert serve.assign_cluster(new, [[0.0], [2.0]], ["size"]).first()["cluster"] == 1
    f = {r["period"]: r["factor"] for r in serve.week_factor(spark.createDataFrame([(1, 0.0), (2, 2.0)], "period int, index_pct double")).collect()}
    assert f == {1: 0.99, 2: 1.01}


def test_equal_rows_are_one_point():
    """Silhouettes and steps work on distinct coordinates: many copies cost no more pairs, with the same results."""
    from tarifa.operators import clusters

    rng = np.random.default_rng(5)
    few = clusters.on_grid(rng.integers(0, 4, (400, 2)).astype(float))
    many, h = np.repeat(few, 250, 0), rng.integers(0, 1 << 63, 100_000).astype(np.uint64)
    held = clusters.Rows(many, h)
    assert len(held.points) == 16 and held.weights(-1).sum() == len(many) and held.weights(3).sum() == clusters.weights(h, 3).sum()
    centres = np.array([[-1.0, 0.0], [1.0, 0.0], [0.0, 1.0]])
    counts, sums, loss = clusters.Step({3: ([-1, 3], np.stack([centres, centres]))}).answer(many, h)[3]
    label = clusters.assign(many, centres)
    for row, w in enumerate((clusters.weights(h, -1), clusters.weights(h, 3))):
        assert (counts[row] == np.bincount(label, w, 3)).all() and (sums[row, :, 0] == np.bincount(label, w * many[:, 0], 3)).all()
        assert loss[row] == pytest.approx((w * ((many - centres[label]) ** 2).sum(1)).sum())
    s = clusters.Silhouettes({3: centres}).answer(many, h)[3]  # 10^10 pairs of rows
    plain = clusters.Silhouettes({3: centres}).of(few, np.full(400, 250.0), [(few, np.full(400, 250.0))])[3]
    assert s == pytest.approx(plain)


def test_groups_are_spread_over_tasks(spark):
    from tarifa.operators import clusters

    rows = spark.range(400).selectExpr("id % 40 AS u", "id")
    found = clusters.spread(rows, "u").groupBy("u").applyInPandas(lambda f: f.assign(task=__import__("pyspark").TaskContext.get().partitionId()).head(1), "u long, id long, task long")
    assert found.select("task").distinct().count() > 1
