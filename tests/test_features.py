"""The fitted transform of final features, and functions in a session's SQL."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tarifa.functions import sql
from tarifa.operators import segments
from tarifa.operators.features import PriceFeatures, PriceFeaturesModel


@pytest.fixture(scope="module")
def products(spark):
    rows = [(i, 100.0 + i, float(4 << (i % 3)), float(128 << (i % 3)), "a" if i % 2 else "b", "n") for i in range(90)]
    return spark.createDataFrame(rows, "id long, prix_tnd double, ram double, disk double, kind string, nom string")


def test_fit_once_save_load_apply(spark, products, tmp_path):
    model = PriceFeatures(features=["ram", "disk"], categorical=["kind"]).fit(products)
    out = model.transform(products)
    assert out.columns == ["id", "ram", "disk", "kind", "nom", "cluster", "ram_disk", "log_prix"]
    row = out.where("id = 4").first()
    assert row["ram_disk"] == 8 * 256 and row["log_prix"] == pytest.approx(4.6443908991413725) and out.select("cluster").distinct().count() > 1
    model.write().overwrite().save(f"file://{tmp_path}/m")
    again = PriceFeaturesModel.load(f"file://{tmp_path}/m")
    later = products.withColumn("prix_tnd", F.col("prix_tnd") * 2).limit(7)
    assert again.transform(later).orderBy("id").collect() == model.transform(later).orderBy("id").collect()
    assert again.transform(products.drop("prix_tnd")).columns == ["id", "ram", "disk", "kind", "nom", "cluster", "ram_disk"]
    whole = Pipeline(stages=[PriceFeatures(features=["ram", "disk"], degree=1)]).fit(products)
    whole.write().overwrite().save(f"file://{tmp_path}/p")
    assert PipelineModel.load(f"file://{tmp_path}/p").transform(products).columns == ["id", "ram", "disk", "kind", "nom", "cluster", "log_prix"]


def test_errors_have_types(products):
    model = PriceFeatures(features=["ram", "disk"]).fit(products)
    with pytest.raises(KeyError, match="disk"):
        model.transform(products.drop("disk"))
    with pytest.raises(TypeError, match="disk"):
        model.transform(products.withColumn("disk", F.lit("big")))
    with pytest.raises(ValueError, match="ram"):
        model.transform(products.withColumn("ram", F.when(F.col("id") > 3, F.col("ram"))))
    with pytest.warns(UserWarning, match="1 prices"):
        out = model.transform(products.withColumn("prix_tnd", F.when(F.col("id") > 0, F.col("prix_tnd")).otherwise(0.0)))
    assert out.where("log_prix IS NULL").count() == 1


def test_scalars_in_sql(spark):
    assert "k_trace" in sql.register(spark) and "pct_change" in sql.register(spark)
    got = spark.sql("SELECT pct_change(200D, 150D) a, pct_change(0D, 1D) b, direction(4D, 3D) c, direction(NULL, 3D) d, effect_pct(0.5D, false) e, safe_name('a b/c') f, file_size(2048) g, french_number(1234.56D) h, french_percent(2D) i, period_label('1', '2') j, french_price(NULL) k").first()
    assert tuple(got) == (-25.0, None, "hausse", "indéterminé", 50.0, "a_b_c", "2.0 Ko", "1 234,6", "+2,0 %", "S1→S2", "—")
    plan = spark.range(3).selectExpr("pct_change(id, id + 1)")._jdf.queryExecution().toString()
    assert "Python" not in plan


def test_trace_as_table_function(spark):
    sql.register(spark)
    rows = [(i, "B" if i < 60 else "S", float(i % 2 * 5 + i % 7 / 10), None if i == 3 else 1.0 * (i % 2)) for i in range(66)]
    df = spark.createDataFrame(rows, "id long, brand string, x double, y double")
    df.createOrReplaceTempView("rows_of_units")
    got = spark.sql("SELECT * FROM k_trace(TABLE(SELECT brand, xxhash64(id) AS h, array(x, y) AS features FROM rows_of_units) PARTITION BY brand)").orderBy("k")
    want = segments.k_trace(df, ["brand"], ["x", "y"]).orderBy("k").drop("brand")
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] and got.where("chosen").first()["k"] == 2


def test_kruskal_of_ranks_keeps_its_digits(spark):
    """H of many rows is a small number beside their ranks; it must not be the difference of two large ones."""
    from fractions import Fraction

    from tarifa.operators import selection

    n = 50_000
    rows = spark.range(n).selectExpr("id * 1.5 + 1 AS price", "concat('l', cast(id * 7919 % 50021 % 3 AS string)) AS label")
    got = selection.effect_table(rows, "price", [], ["label"]).first()
    ranks = {}
    for i in range(n):
        ranks.setdefault(i * 7919 % 50021 % 3, []).append(i + 1)
    want = Fraction(12, n * (n + 1)) * sum(Fraction(sum(r)) ** 2 / len(r) for r in ranks.values()) - 3 * (n + 1)
    assert got["n"] == n and abs(got["statistic"] - float(want)) <= 1e-13 * max(1.0, float(want))


def test_panel_is_made_once(spark, monkeypatch):
    """Queries of fits read rows that were written, not the join and window of the tables again for each pass."""
    from tarifa.plans import model_queries, week_queries

    plan = model_queries._rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    assert "Join" not in model_queries._segmented(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()


def test_sums_by_group_of_many_groups(spark):
    import numpy as np

    from tarifa.operators import regression

    rows = spark.range(3000).selectExpr("CASE WHEN id % 40 > 0 THEN concat('s', id % 40) END AS s", "CAST(id % 5 AS STRING) AS f", "CAST(id AS DOUBLE) AS v")
    found = regression._summed(rows, lambda b: b.column(2).to_numpy().sum().reshape(1, 1), (1, 1), by=("s", "f"))
    assert len(found) == 40 and found["s7", "2"][0, 0] == sum(i for i in range(3000) if i % 40 == 7 and i % 5 == 2) and found["None", "0"][0, 0] == sum(range(0, 3000, 40))
    assert regression._summed(rows.limit(0), lambda b: b.column(2).to_numpy().sum().reshape(1, 1), (1, 1)).get((), np.zeros((1, 1)))[0, 0] == 0
