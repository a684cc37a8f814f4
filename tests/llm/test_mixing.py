import numpy as np

from tarifa.llm import mixing as M


def filled(sizes, weights):
    cap, t, capped = 3 * sizes, np.zeros(len(sizes)), np.zeros(len(sizes), bool)
    while True:
        rest = sizes.sum() - cap[capped].sum()
        t = np.where(capped, cap, rest * weights / max(weights[~capped].sum(), 1e-300))
        new = (t > cap) & ~capped
        if not new.any():
            return t
        capped |= new


def test_targets_fill_like_water(spark):
    sizes = np.array([1000.0, 10.0, 5.0, 400.0, 0.0, 77.0])
    df = spark.createDataFrame([(f"s{i}" if i < 5 else None, 3, int(x)) for i, x in enumerate(sizes)], "source string, n long, source_size long")
    got = {r["source"]: r["target"] for r in M.targets(df).collect()}
    want = filled(sizes, np.array([1.0, 2, 3, 1, 2, 3]))
    assert np.allclose([got[f"s{i}" if i < 5 else None] for i in range(6)], want)


def test_plan_meets_targets_and_reruns(spark, monkeypatch):
    monkeypatch.setattr(M, "GROUP", 16)
    monkeypatch.setattr(M, "FAN", 2)
    rng = np.random.default_rng(0)
    rows = [(i, ["a", "b", "c", None][i % 4 if i % 3 else 0], "w " * int(rng.integers(0, 50))) for i in range(400)] + [(7, "a", "w w"), (401, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    one, two = M.plan(df).toPandas(), M.plan(df.repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert one.sort_values(key)[key].values.tolist() == two.sort_values(key)[key].values.tolist()
    assert len(one) == len(rows) and (one.taken <= 3 * one["size"]).all()
    g = one.fillna({"source": "-"}).groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), most=("size", "max"))
    assert (abs(g.taken - g.target) <= g.most).all()
    mixed = M.mix(df.where("doc_id <> 7"))
    assert mixed.columns == df.columns
    plan = M.plan(df.where("doc_id <> 7")).toPandas()
    assert mixed.count() == plan.copies.sum()


def test_pairs_keep_expectation():
    p = np.full(2000, 0.37)
    size = np.ones(2000)
    out = M._round_group(size, p, np.random.default_rng(1), True)
    assert set(out) <= {0.0, 1.0} and abs(out.sum() - p.sum()) <= 1


def test_every_document_keeps_its_expectation():
    p, size = np.array([0.2, 0.9, 0.35, 0.6, 0.15]), np.array([7.0, 3, 11, 2, 5])
    drawn = np.array([M._round_group(size, p, np.random.default_rng(i), True) for i in range(20_000)])
    assert abs(drawn.mean(0) - p).max() < 0.02 and set(drawn.ravel()) == {0.0, 1.0}


def test_repeated_rows_and_clashing_names(spark):
    rows = [(1, "a", "w w", "p")] * 3 + [(1, "a", "v v", "q"), (None, "b", "x y z", "r"), (None, "b", "x y z", "r"), (None, None, None, "s"), (2, "b", "u " * 50_000, "t")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, copies string")
    plan, mixed = M.plan(df).toPandas(), M.mix(df)
    assert mixed.columns == df.columns and len(plan) == len(rows)
    want = plan[plan.copies > 0].groupby("th").copies.sum()
    assert sorted(mixed.toPandas().groupby("copies").size()) == sorted(want)
    assert M.mix(df.limit(0)).count() == 0


def test_empty(spark):
    assert M.plan(spark.createDataFrame([], "doc_id long, source string, text string")).count() == 0
