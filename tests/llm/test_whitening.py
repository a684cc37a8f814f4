"""Whitening against plain numpy on exact integers, the eigen-solver against LAPACK's, edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.llm import whitening

SF = "/root/testdata/sf0.001"


def plain(rows: dict, components: int = 4):
    x = {}
    for i, v in rows.items():
        if v is not None and all(c is not None and np.isfinite(c) for c in v):
            x[i] = tuple(int(np.floor(256 * float(c))) for c in v)
    fit = np.array(sorted(set(x.values())), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    v = np.cov((n * fit - sums).astype(float).T / n, bias=True)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    off = {i: n * np.array(c, dtype=object) - sums for i, c in x.items()}
    return n, {i: int((o**2).sum()) for i, o in off.items()}, {i: (o / n).astype(float) @ q / np.sqrt(e) for i, o in off.items()}, e / np.trace(v)


def test_whole_table(spark):
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    n, deviation, white, explained = plain(rows)
    got = whitening.op12_whitening(spark, SF).toPandas()
    assert len(got) == 4 * len(white) and (got.n == n).all() and got.identity_error.max() < 1e-10
    assert all(deviation[i] == d for i, d in zip(got.vec_id, got.deviation))
    table = got.pivot(index="vec_id", columns="component", values="whitened")
    want = np.array([white[i] for i in table.index])
    for k in range(4):
        sign = np.sign(want[0, k] * table[k + 1].iloc[0])
        np.testing.assert_allclose(sign * table[k + 1], want[:, k], atol=1e-9)
    np.testing.assert_allclose(got.groupby("component").explained.first(), explained, rtol=1e-9)


@pytest.mark.parametrize("d", [1, 2, 3, 7, 40])
def test_symmetric_qr(d):
    a = np.random.default_rng(d).normal(size=(d, d))
    for v in (a @ a.T, a + a.T, np.ones((d, d)), np.zeros((d, d)), np.diag(np.arange(d, dtype=float))):
        e, q = whitening.symmetric_qr(v)
        np.testing.assert_allclose(e, np.linalg.eigvalsh(v)[::-1], atol=1e-12 * max(1, np.abs(v).max() * d))
        np.testing.assert_allclose(q @ np.diag(e) @ q.T, v, atol=1e-12 * max(1, np.abs(v).max() * d))
        np.testing.assert_allclose(q.T @ q, np.eye(d), atol=1e-12)


def test_states_merge_to_the_whole():
    """A large common offset costs no digits, sums beyond 64 bits stay exact, and any split of the rows gives the same moments."""
    x = np.random.default_rng(1).integers(-1000, 1000, (500, 5)) + (1 << 59)
    whole = whitening.Moments.empty(5)
    for part in np.split(x, [3, 100, 101, 480]):
        one = whitening.Moments.empty(5)
        one.add(part)
        whole = whole.merge(one)
    assert whole.n == 500 and list(whole.sums) == [sum(map(int, x[:, k])) for k in range(5)]
    np.testing.assert_allclose(whole.products / 500, np.cov((x - (1 << 59)).astype(float).T, bias=True), rtol=1e-10)


def test_rows_of_every_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.5]), (4, None), (5, [None, 1.0]), (6, [nan, 1.0]), (7, [-inf, 1.0]), (None, [0.0, 4.0]), (8, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("x", F.lit("clash")).withColumn("n", F.lit(0))
    got = whitening.whiten(df).toPandas()
    assert len(got) == 2 * 6 and (got.n == 4).all() and got.identity_error.max() < 1e-12  # (1, 2), (3, -1), (0.5, 0), (0, 4)
    want = plain({0: [1.0, 2.0], 2: [3.0, -1.0], 3: [0.5, 0.0], 9: [0.0, 4.0]})
    assert set(got[got.vec_id == 3].deviation.astype(int)) == {want[1][3]} and set(got[got.vec_id.isna()].deviation.astype(int)) == {want[1][9]}


def test_without_spread_and_without_rows(spark):
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<float>")).toPandas()
    assert len(same) == 4 and same.whitened.isna().all() and same.explained.isna().all() and (same.n == 1).all() and (same.deviation == 0).all()
    line = whitening.whiten(spark.createDataFrame([(k, [float(k), 0.0, 1.0]) for k in range(5)], "vec_id long, embedding array<double>")).toPandas()
    assert line[line.component == 1].whitened.notna().all() and line[line.component > 1].whitened.isna().all() and line.identity_error.max() < 1e-12
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).count() == 0
    wide = whitening.whiten(spark.createDataFrame([(1, [1e10, 0.0]), (2, [-1e10, 1.0])], "vec_id long, embedding array<double>")).toPandas()
    assert set(wide.deviation.astype(object).map(int)) == {(2 * 256 * 10**10) ** 2 + 256**2}  # more than a long
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>")).toPandas()
    assert huge.deviation.isna().all() and huge[huge.component == 1].whitened.notna().all()  # saturated entries, more than 38 digits
