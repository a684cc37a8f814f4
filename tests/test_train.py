"""Training, artifacts, scoring, reports and the server of one category."""

import json
import random
import threading
import urllib.error
import urllib.request

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarifa.operators import reports, serving
from tarifa.operators import train as T


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    out = []
    for i in range(420):
        ram, size, brand = float(rng.choice([4, 8, 16, 32])), float(rng.choice([11, 13, 15])), "AB"[i % 2]
        price = float(np.exp(4 + 0.05 * ram + 0.02 * size + 0.3 * (brand == "B") + rng.normal(0, 0.1)))
        for period in (1, 2, 3):
            out.append((f"p{i}", period, brand, price * (1 + 0.01 * period), ram, size, "win" if i % 3 else "mac"))
    return spark.createDataFrame(out, "product string, period int, brand string, price double, ram double, size double, system string")


@pytest.fixture(scope="module")
def trained(rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("models"))
    models = T.fit_category(rows, ["ram", "size"], ["system"], trees=(10,), depths=(5,))
    T.persist(models, path)
    return models, path


def test_models_are_judged_and_come_back(spark, trained):
    models, path = trained
    got = {r["family"]: r for r in models.metrics.collect()}
    assert set(got) == set(T.FAMILIES) and all(r["r2_log"] > 0.8 for r in got.values()) and got["hedonic"]["n"] == 84 * 3
    loaded = T.load(spark, path)
    one = spark.createDataFrame([(8.0, 13.0, "win", "B")], "ram double, size double, system string, brand string")
    want = one.select(models.hedonic.predict().alias("a"), models.ridge.predict().alias("b")).first()
    assert tuple(one.select(loaded.hedonic.predict().alias("a"), loaded.ridge.predict().alias("b")).first()) == pytest.approx(tuple(want))
    assert T.available(spark, path) and not T.available(spark, path + "/none")
    with pytest.raises(T.ArtifactsMissing):
        T.load(spark, path + "/none")
    table, row = T.agreement(*[spark.createDataFrame(x, "feature string, " + n) for x, n in (([("a", 1.0), ("b", -2.0)], "coefficient double"), ([("a", 0.5), ("b", 1.0)], "coefficient double"), ([("a", 0.1), ("b", 0.9)], "importance double"))])
    assert row == {"n_features": 2, "pct_signs_agree": 50.0, "spearman": 1.0} and table.count() == 2


def test_clusters_are_applied_with_typed_errors(spark, trained):
    clustering = T.load(spark, trained[1]).clustering
    df = spark.createDataFrame([(4.0, 11.0, "win"), (32.0, 15.0, "new")], "ram double, size double, system string")
    assert clustering.assign(df).count() == 2
    with pytest.raises(KeyError):
        clustering.assign(df.drop("ram"))
    with pytest.raises(TypeError):
        clustering.assign(df.withColumn("ram", F.lit("4")))
    with pytest.raises(ValueError):
        clustering.assign(df.withColumn("ram", F.lit(None).cast("double")))


def test_rows_of_the_design():
    columns = ["ram", "os_win", "os_version_11", "has_x", "other_y"]
    assert T.encode_row(columns, ["ram"], ["os", "os_version", "has_x"], {"ram": 8, "os": "win", "os_version": "11", "has_x": 1}) == {"ram": 8.0, "os_win": 1.0, "os_version_11": 1.0, "has_x": 1.0, "other_y": 0.0}


def test_scoring_falls_back_by_level(spark):
    schema = "level string, segment string, family string, kept boolean, fitted boolean, r2 double, r2_category double, intercept double, coefficients map<string,double>"
    models = spark.createDataFrame([("n2", "A::low::c0", "hedonic", True, True, 0.9, 0.5, 10.0, {"ram": 1.0}), ("n2", "A::high::c1", "hedonic", True, True, 0.9, 0.5, 20.0, {}), ("n2", "B::low::c0", "hedonic", False, True, 0.1, 0.5, 30.0, {}), ("n1", "1", "hedonic", True, True, 0.9, 0.5, 40.0, {"ram": 2.0})], schema)
    rows = spark.createDataFrame([(1, "A", "low", "c0", 1, 2.0), (2, "A", "high", "c9", 0, 2.0), (3, "A", "mid", "c0", 0, 2.0), (4, "B", "low", "c0", 1, 2.0)], "id int, brand string, tier string, cluster string, cluster_n1 int, ram double")
    got = {r["id"]: (r["source"], r["estimate"]) for r in T.predict_by_segment(rows, models, F.lit(1.0), ["ram"]).collect()}
    assert got == {1: ("n2", 12.0), 2: ("n2_marque_gamme", 20.0), 3: ("n2_marque", 20.0), 4: ("categorie", 1.0)}
    got = {r["id"]: (r["source"], r["estimate"]) for r in T.predict_by_segment(rows, models, F.lit(1.0), ["ram"], "n1").collect()}
    assert got[1] == ("n1", 44.0) and got[2] == ("categorie", 1.0)
    assert {r["feature"] for r in T.segment_detail(models, "n1", 1).collect()} == {"ram"}
    with pytest.raises(ValueError):
        T.predict_by_segment(rows, models, F.lit(1.0), ["ram"], "n3")


def test_similar_products_of_a_week(spark):
    df = spark.createDataFrame([(i, "c", 1 + i % 2, float(i)) for i in range(10)], "id long, category string, period int, ram double")
    ids = lambda week: [r["id"] for r in T.similar_in_week(df.where("id = 4"), df, ["ram"], 2, week).orderBy("rank").collect()]
    assert ids(None) == [3, 5] == ids(9) and ids(1) == [2, 6]


def test_similar_products_are_scaled_once(spark):
    """Mean and deviation that differ from one evaluation to the next, as sums of doubles in another order do: no query is lost, equal products have no distance."""
    noise = F.udf(lambda: random.random(), "double").asNondeterministic()  # noqa: S311
    price = F.when(F.col("id") < 40, F.floor(F.col("id") / 2)).otherwise(noise())
    df = spark.range(60).select("id", F.lit("c").alias("category"), F.lit(1).alias("period"), price.cast("double").alias("price"))
    found = T.similar_in_week(df.where("id < 40"), df, ["price"], 1, 1)
    assert sorted((r["query_id"], r["id"], r["distance"]) for r in found.collect()) == [(i, i ^ 1, 0.0) for i in range(40)]


def test_ten_reports(trained):
    models, _ = trained
    found = reports.weekly_reports(models.labelled, models.segments, ["ram", "size"], replicates=5, n_boot=50)
    assert len(found) == 10
    counts = {name: df.count() for name, df in found.items()}
    assert counts["composition"] == counts["price_index"] == counts["coverage"] == 3 and counts["estimates"] == 9 and all(counts.values())
    first = found["n2_estimates"].first()
    assert first["source_hedonic"] in ("n1", "n2", "categorie") and abs(first["error_hedonic_pct"]) < 20


def test_downloads(spark, trained):
    s = serving.server(spark, trained[1], 0)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    get = lambda p: urllib.request.urlopen(f"http://127.0.0.1:{s.server_address[1]}{p}").read().decode("utf-8")  # noqa: E731, S310
    assert json.loads(get("/healthz")) == {"status": "ok", "models": True}
    text = get("/labelled.csv?brand=A&period=2")
    assert text.startswith("﻿") and text.count("\n") == 211
    assert len(json.loads(get("/metrics.json"))) == 3
    with pytest.raises(urllib.error.HTTPError):
        get("/unknown.csv")
    s.shutdown()
