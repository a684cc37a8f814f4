from pyspark.sql import functions as F

from tarifa.functions import format as fmt
from tarifa.functions import specs as S
from tarifa.operators import panel as P
from tarifa.operators import selection, views
from tarifa.sources.fetch import crawl, fetch


def test_selection(spark):
    rows = [(i, float(i), float((i * 7) % 11), "ab"[i > 20], None, 1) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, price double, noise double, grade string, hole string, fixed int")
    assert "hole" not in selection.drop_empty_columns(df).columns
    con, cat = selection.roles(df.drop("hole"))
    assert con == ["id", "price", "noise"] and cat == ["grade"]
    kept, report = selection.select(df.drop("hole"), "price", always_drop=["id"], force_keep=["noise"])
    assert kept == ["noise", "grade"] and {e.column: e.test for e in report} == {"noise": "spearman", "grade": "kruskal"}
    assert selection.varying(df, ["fixed", "grade"]) == ["grade"]


def test_directions_and_causes(spark):
    rows = [("a", 1, 100.0, 100.0, 5), ("a", 2, 104.0, 100.0, 5), ("a", 3, 104.0, 110.0, 5), ("a", 4, 90.0, 120.0, 5), ("a", 6, 90.0, 120.0, 5), ("a", 7, 99.0, 132.0, 4)]
    out = P.transitions(spark.createDataFrame(rows, "k string, period int, r double, e double, n int"), ["k"], "r", "e", "n").orderBy("t").collect()
    assert [r["cause"] for r in out] == ["prix", "qualite", "prix_et_qualite", "aucune", "effectif"]
    assert [r["label"] for r in out][:2] == ["hausse/stable", "stable/hausse"] and out[3]["t1"] == 6
    one = spark.range(1).select(S.direction(F.lit(3.0)).alias("a"), S.direction(F.lit(None).cast("double")).alias("b"), S.direction(F.lit(-3.1)).alias("c")).first()
    assert tuple(one) == ("stable", "indéterminé", "baisse")


def test_geometric_mean_and_change(spark):
    df = spark.createDataFrame([(4.0,), (9.0,), (-1.0,), (None,)], "v double")
    assert abs(df.agg(S.geo_mean("v").alias("g")).first()["g"] - 6.0) < 1e-12
    assert df.where("v < 0").agg(S.geo_mean("v").alias("g")).first()["g"] is None
    assert spark.range(1).select(S.pct_change(F.lit(0.0), F.lit(1.0)).alias("x")).first()["x"] is None


def test_text(spark):
    r = spark.range(1).select(fmt.number(F.lit(1234567.5), 1).alias("n"), fmt.price(F.lit(1500)).alias("p"), fmt.percent(F.lit(2.25)).alias("q"), fmt.percent(F.lit(None).cast("double")).alias("z"), S.file_size(F.lit(2048)).alias("f")).first()
    assert (r["n"], r["p"], r["z"], r["f"]) == ("1 234 567,5", "1 500 TND", "—", "2.0 Ko") and r["q"].startswith("+2,")
    c = spark.createDataFrame([("m", "const", 1.0), ("m", "x", -2.0), ("m", "y", 0.5), ("m", "z", 0.1)], "m string, feature string, coefficient double")
    e = views.equation(c, "m", 2).first()
    assert e["terms"] == " - 2.0000·x + 0.5000·y" and e["hidden"] == 1
    v = spark.createDataFrame([(5.0, 2.0, 0.01), (5.0, 0.1, 0.9), (0.1, 2.0, 0.01), (0.0, 0.0, 1.0)], "a double, b double, p double")
    assert [r[0] for r in v.select(views.verdict(F.col("a"), F.col("b"), F.col("p"))).collect()] == ["prix", "mix", "prix masqué par le mix", "stable"]


def test_fetching():
    tried = []

    def flaky(url):
        tried.append(url)
        if len(tried) < 3:
            raise OSError
        return 200, "page"

    assert fetch(flaky, "u", sleep=lambda s: None) == "page" and len(tried) == 3
    assert fetch(lambda u: (404, ""), "u", sleep=lambda s: None) is None
    pages = {"b": "1 2", "b?p=2": "2 3", "b?p=3": "3"}
    assert list(crawl(lambda u: (200, pages.get(u, "")), "b", str.split, sleep=lambda s: None)) == ["1", "2", "3"]


def test_knn_imputation_takes_the_mode(spark):
    rows = [(1, "b", 1.0, "x"), (2, "b", 1.1, "y"), (3, "b", 1.2, "y"), (4, "b", 9.0, "z"), (5, "b", 1.15, None), (6, "c", 1.0, None)]
    df = spark.createDataFrame(rows, "id long, g string, f double, t string")
    out = {r["id"]: r["t"] for r in P.impute_knn(df, "t", ["f"], "g", 3, categorical=True).collect()}
    assert out[5] == "y" and out[6] is None and out[1] == "x"
