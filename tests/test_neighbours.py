"""Neighbours with gaps against all pairs in plain Python."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tarifa.operators import prepare


def plain_numbers(rows, targets, use, k=5, least=10):
    """rows: (id, group, {column: value or None})."""
    out = {}
    for g in {r[1] for r in rows}:
        own = [dict(r[2], id=r[0]) for r in rows if r[1] == g]
        known = {c: sorted(r[c] for r in own if r[c] is not None) for c in targets}
        near = [c for c in targets if least <= len(known[c]) < len(own)]
        kk = min(k, max(1, min(len(known[c]) for c in near) - 1)) if near else k
        filled = []
        for r in own:
            f = dict(r)
            for c in targets:
                v = known[c]
                if f[c] is None and len(v) < least and v:
                    f[c] = (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2
            filled.append(f)
        for f in filled:
            done = dict(f)
            for c in targets:
                if f[c] is None and known[c]:
                    order = []
                    for x in filled:
                        both = [u for u in use if f[u] is not None and x[u] is not None]
                        if x[c] is not None and both:
                            d = math.sqrt(sum((f[u] - x[u]) ** 2 for u in use if u in both) * len(use) / len(both))
                            order.append((d, [(x[u] is None, x[u] or 0) for u in use], x[c]))
                    best = [v for *_, v in sorted(order)[:kk]]
                    done[c] = sum(best) / len(best) if best else sum(known[c]) / len(known[c])
            out[f["id"]] = done
    return out


def made(n, seed, groups=("a", "b", None)):
    rng = random.Random(seed)
    value = lambda p, top: None if rng.random() < p else float(rng.randrange(top))
    return [(i, rng.choice(groups), {"x": value(0.3, 12), "y": value(0.4, 40), "z": value(0.2, 9)}) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_numbers_equal_all_pairs(spark, seed):
    rows = made(240, seed)
    rows += [(1000 + i, "few", {"x": 1.0 if i < 4 else None, "y": None, "z": float(i)}) for i in range(12)]  # few known x, no known y
    rows += [(2000 + i, "alone", {"x": None if i == 0 else 3.0 + i % 2, "y": None, "z": 1.0 if i else None}) for i in range(15)]  # shares nothing with a donor
    df = spark.createDataFrame([(i, g, v["x"], v["y"], v["z"]) for i, g, v in rows], "id long, g string, x double, y double, z double")
    got = {r["id"]: r for r in prepare.impute_numbers(df, ["x", "y"], ["x", "y", "z"], "g").collect()}
    want = plain_numbers(rows, ["x", "y"], ["x", "y", "z"])
    assert len(got) == len(rows)
    for i, w in want.items():
        for c in ("x", "y"):
            assert (got[i][c] is None) == (w[c] is None) and (w[c] is None or got[i][c] == pytest.approx(w[c])), (i, c)


def test_labels_equal_all_pairs(spark):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", None]), float(rng.randrange(30)), float(rng.randrange(5)), rng.choice(["l0", "l1", "l2", None])) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, g string, x double, y double, label string")
    got = {r["id"]: r["label"] for r in prepare.impute_labels(df, ["label"], ["x", "y"], "g").collect()}
    for i, g, x, y, label in rows:
        if label is None:
            near = sorted(((x - a) ** 2 + (y - b) ** 2, a, b, name) for _, h, a, b, name in rows if h == g and name)[:5]
            votes = Counter(name for *_, name in near)
            label = min(votes, key=lambda v: (-votes[v], v))
        assert got[i] == label


def test_no_join_without_a_cell(spark):
    """Of many distinct vectors in one group only those of near cells are paired: work grows with the rows."""
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.rand(1)).alias("x"), F.when(F.col("id") % 5 > 0, F.rand(2)).alias("y"), F.rand(3).alias("z"))
    out = prepare.impute_numbers(df, ["x", "y"], ["x", "y", "z"])
    assert "CartesianProduct" not in out._jdf.queryExecution().toString()
    assert out.where("x IS NULL OR y IS NULL").isEmpty() and out.count() == 3000


def test_nothing_to_fill(spark):
    schema = "id long, g string, x double, y double"
    assert prepare.impute_numbers(spark.createDataFrame([], schema), ["x"], ["x", "y"], "g").count() == 0
    assert prepare.impute_labels(spark.createDataFrame([], "id long, g string, x double, l string"), ["l"], ["x"], "g").count() == 0
    full = spark.createDataFrame([(1, "a", 1.0, 2.0), (2, None, 3.0, None)], schema)
    assert sorted(map(tuple, prepare.impute_numbers(full, ["x"], ["x", "y"], "g").collect()), key=str) == [(1, "a", 1.0, 2.0), (2, None, 3.0, None)]


def test_quantiles_equal_sorting(spark):
    import numpy as np

    from tarifa.operators.ranks import quantiles

    rng = np.random.default_rng(1)
    groups = {"many": rng.normal(size=60_000), "ties": rng.integers(0, 4, 30_000).astype(float), "few": np.array([3.0, 1.0]), "one": np.array([7.0]), "heavy": np.append(np.zeros(40_000), rng.exponential(size=20_000))}
    import pandas as pd

    df = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups.items()])).repartition(6)
    ps = [0.0, 0.25, 1 / 3, 0.5, 2 / 3, 0.9, 1.0]
    for r in quantiles(df.withColumn("n", F.lit("clash")).drop("n"), ["g"], "v", ps).collect():
        assert r["n"] == len(groups[r["g"]]) and r["q"] == pytest.approx(np.quantile(groups[r["g"]], ps).tolist())
    whole = quantiles(df, [], "v", ps).first()
    assert whole["q"] == pytest.approx(np.quantile(np.concatenate(list(groups.values())), ps).tolist())
    assert quantiles(df.limit(0), ["g"], "v", ps).count() == 0


def test_fences_of_few_groups_are_sent_to_the_rows(spark):
    """Three groups of many rows are not three tasks: no shuffle moves the rows to their group."""
    from pyspark.sql import functions as F

    from tarifa.operators import panel

    x = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("p"))
    found = panel.iqr_outliers(x, "g", "p")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
    assert found.count() == 1000 and found.where("outlier").isEmpty()


def near_like_brute_force(df, rows, k, different):
    from tarifa.operators import ranks

    got = {}
    for r in ranks.nearest(df, df, "block", ["x", "y"], k, different).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["distance"]))
    for i, b, x, y, m in rows:
        near = sorted((math.sqrt((x - p) * (x - p) + (y - q) * (y - q)), j) for j, c, p, q, n in rows if c == b and j != i and not (different and n == m))[:k]
        assert sorted(got.get(i, [])) == [(r + 1, j, d) for r, (d, j) in enumerate(near)], (i, b, x, y, m)


def test_a_vector_with_enough_rows_looks_nowhere(spark, monkeypatch):
    """Copies are each other's neighbours: no grid is made for them."""
    from tarifa.operators import ranks

    names = []
    monkeypatch.setattr(ranks, "written", lambda df, name, write=ranks.written: names.append(name) or write(df, name))
    rows = [(i, "b", float(i % 20), float(i % 20 // 4), f"m{i % 3}") for i in range(80)]
    near_like_brute_force(spark.createDataFrame(rows, "id long, block string, x double, y double, maker string"), rows, 3, None)
    assert "knn-vectors" in names and "knn-near" not in names


def test_few_rows_of_a_vector_and_few_pairs_of_a_crowd(spark, monkeypatch):
    """Of 30 makers at a vector two rows are kept; vectors that lie close together, far from one other, don't all meet."""
    from tarifa.operators import ranks

    tables = {}

    def kept(df, name, write=ranks.written):
        tables.setdefault(name, []).append(write(df, name))
        return tables[name][-1]

    monkeypatch.setattr(ranks, "written", kept)
    rng = random.Random(8)
    rows = [(i, "crowd", rng.random() / 50, rng.random() / 50, f"m{i % 2}") for i in range(400)] + [(900, "crowd", 40.0, 3.0, "m1")]
    rows += [(1000 + i, "same", float(i % 3), 0.0, f"m{i % 30}") for i in range(180)] + [(2000 + i, "one maker", float(i), 0.0, "m1") for i in range(50)]
    df = spark.createDataFrame(rows, "id long, block string, x double, y double, maker string")
    near_like_brute_force(df, rows, 1, "maker")
    vectors = tables["knn-vectors"][0]
    assert vectors.agg(F.max(F.size("__own"))).first()[0] == 2
    first = tables["knn-left"][0].groupBy("__block").agg(F.count("*"), F.min("__level")).collect()
    assert [(b, n) for b, n, _ in first] == [("crowd", 401)] and first[0][2] < 0  # a single maker has nobody to find


def test_twin_gaps_look_nothing_up_and_hold_no_brand(spark):
    """Prices come with the neighbours, and no task has all gaps of a brand for their median."""
    from tarifa import registry
    from tarifa.operators import studies

    plan = registry.QUERIES["twin_gaps"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "median(" not in plan and "percentile(" not in plan
    rng = random.Random(2)
    rows = [(i, f"b{i % 2}", f"m{rng.randrange(4)}", float(rng.randrange(1, 60))) for i in range(150)]
    gaps = studies.twin_gaps(spark.createDataFrame(rows, "id long, block string, brand string, price double"), "block", ["price"])
    assert not [line for line in gaps._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line and "query_id" in line]
    want = []
    for i, b, m, p in rows:
        q, j = min((abs(p - q), j, q) for j, c, n, q in rows if c == b and n != m)[2:0:-1]
        want.append((i, j, m, (p - q) / q * 100))
    assert sorted(map(tuple, gaps.select("query_id", "id", "brand", "gap_pct").collect())) == want


def test_queries_that_are_made_anew_differently_are_all_answered(spark):
    """A vector whose last places change with each evaluation still finds its answer."""
    from tarifa.operators import ranks

    noise = F.udf(lambda: random.random() / 1e9, "double").asNondeterministic()  # noqa: S311
    rows = spark.range(50).select("id", F.lit("b").alias("block"), F.col("id").cast("double").alias("x"))
    asked = rows.withColumn("x", F.col("x") + 0.25 + noise())
    got = {(r["query_id"], r["id"]) for r in ranks.nearest(asked, rows, "block", ["x"], 1).collect()}
    assert got == {(i, i + 1 if i < 49 else 48) for i in range(50)}
