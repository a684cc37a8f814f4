import json

import pytest
from pyspark.sql import functions as F

from tarifa.functions import specs as S
from tarifa.operators.clean import RAW, add_features, clean_products, latest, quality_summary
from tarifa.sources import ingest, sinks


def raw(spark, *products):
    base = {f.name: None for f in RAW.fields}
    return spark.createDataFrame([tuple((base | p).values()) for p in products], RAW)


LAPTOP = {"url": "u1", "nom": "Portable A", "marque": "ASUS", "prix_tnd": 1500.0, "ram_go": 8.0, "categorie": "pc_portables", "semaine": 1, "date_collecte": "2026-01-05 10:00:00", "taille_ecran": 15.6}


def test_laptops_one_behaviour_each(spark):
    rows = [
        LAPTOP | {"connectivite": "Wi-Fi 6, Bluetooth", "processeur": "Intel Core i5", "specs_brutes": {"Référence Processeur": "Intel® Core™ i5-13420H"}},
        LAPTOP | {"url": "u2", "ram_go": None, "specs_brutes": {"Mémoire Cache": "4 Mo", "Mémoire RAM": "16 Go"}},
        LAPTOP | {"url": "u3", "prix_tnd": -50.0},
        LAPTOP | {"url": "u4", "ram_go": 0.0039, "nom": "Portable 8Go RAM"},
        LAPTOP | {"url": "u5", "marque": "asus", "os": "Windows 11", "taille_ecran": 14.0, "nom": 'X 15.6"'},
    ]
    out = {r["url"]: r for r in add_features(clean_products(raw(spark, *rows))).collect()}
    assert out["u1"]["cpu_gen"] == 13 and out["u1"]["cpu_serie"] == 5 and out["u1"]["has_wifi6"] == 1 and out["u1"]["has_wifi"] == 0
    assert out["u2"]["ram_go"] == 16 and out["u2"]["has_bluetooth"] == 0
    assert out["u3"]["prix_tnd"] is None and out["u3"]["prix_suspect"]
    assert out["u4"]["ram_go"] == 8 and out["u5"]["marque"] == "ASUS" and len(out) == 5


def test_phone_memory_cascade(spark):
    phone = LAPTOP | {"categorie": "smartphones", "ram_go": None, "taille_ecran": None}
    rows = [
        phone | {"url": "a", "specs_brutes": {"Mémoire": "128Go", "Stockage": "128 Go", "Processeur": "2,5 GHz- RAM : 8Go"}},
        phone | {"url": "b", "specs_brutes": {"Mémoire": "2 Go", "Stockage": "32 Go"}},
        phone | {"url": "c", "nom": "Téléphone 8Go 128Go", "specs_brutes": {}},
        phone | {"url": "d", "nom": "Téléphone 8 Go RAM 128Go", "specs_brutes": None},
        phone | {"url": "e", "categorie": "telephones_portables", "ram_go": 0.03125},
    ]
    out = {r["url"]: r["ram_go"] for r in clean_products(raw(spark, *rows)).collect()}
    assert out == {"a": 8.0, "b": 2.0, "c": None, "d": 8.0, "e": 0.03125}


def test_screens(spark):
    rows = [
        LAPTOP | {"url": "a", "categorie": "pc_bureau", "taille_ecran": 1260.0},
        LAPTOP | {"url": "b", "taille_ecran": None, "specs_brutes": {"Taille de l'écran": '15,6 "'}},
        LAPTOP | {"url": "c", "taille_ecran": 99.0, "nom": "PC 14 pouces"},
        LAPTOP | {"url": "d", "taille_ecran": None, "nom": "PC C3 \"", "specs_brutes": {"Taille ecran": "Sans Ecran 3"}},
    ]
    assert {r["url"]: r["taille_ecran"] for r in clean_products(raw(spark, *rows)).collect()} == {"a": None, "b": 15.6, "c": 14.0, "d": None}


def test_storage_and_televisions(spark):
    tv = {"url": "t", "nom": "TV 55 pouces HDR", "categorie": "televiseurs", "semaine": 1, "specs_brutes": {"Compatible HDR": "Non", "Luminosité": "300 - Taux de rafraîchissement : 60 Hz"}}
    rows = [
        tv,
        LAPTOP | {"url": "s1", "stockage_go": 9999.0, "nom": "PC 512Go SSD", "specs_brutes": {"Disque Dur": "1 To HDD"}},
        LAPTOP | {"url": "s2", "stockage_go": 512.0, "nom": "PC 512Go SSD"},
    ]
    out = {r["url"]: r for r in clean_products(raw(spark, *rows)).collect()}
    assert out["t"]["hdr"] is False and out["t"]["taux_rafraichissement"] == 60
    assert (out["s1"]["stockage_go"], out["s1"]["type_stockage"], out["s1"]["stockage_incoherent_nom_vs_specs"]) == (1024, "HDD", True)
    assert (out["s2"]["stockage_go"], out["s2"]["stockage_incoherent_nom_vs_specs"]) == (512, False)


def test_latest_wins(spark):
    rows = [LAPTOP | {"prix_tnd": 1.0, "date_collecte": "2026-01-05 10:00:00"}, LAPTOP | {"prix_tnd": 2.0, "date_collecte": "2026-01-06 10:00:00"}, LAPTOP | {"prix_tnd": 3.0, "date_collecte": "bad"}, LAPTOP | {"prix_tnd": 4.0, "semaine": 2}]
    out = clean_products(raw(spark, *rows))
    assert sorted(r["prix_tnd"] for r in out.collect()) == [2.0, 4.0] and len(out.columns) == 27
    df = spark.createDataFrame([(1, None, "x"), (1, 5, "y")], "k int, d int, v string")
    assert latest(df, ["k"], "d", undated_wins=True).first()["v"] == "x" and latest(df, ["k"], "d").first()["v"] == "y"
    assert {r["column_name"]: r["n_null"] for r in quality_summary(df).collect()}["d"] == 1


def test_lookup_order(spark):
    x = spark.createDataFrame([({"Mémoire Cache": "4 Mo", "Mémoire": "8 Go", "RAM max": "64 Go"},)], "m map<string,string>")
    get = lambda c: x.select(c.alias("v")).first()["v"]
    assert get(S.find_spec("m", "ram", "memoire")) == "8 Go"
    assert get(S.find_spec("m", "memoire c", exclude=["cache"])) is None
    assert get(S.find_spec("m", "RAM")) == "64 Go" and get(S.find_spec("m", "none")) is None


@pytest.mark.parametrize(("text", "value"), [("1 299,000 TND", 1299.0), ("1299.000", 1299.0), ("1.299,50", 1299.5), ("prix", None), (None, None)])
def test_prices(spark, text, value):
    assert spark.createDataFrame([(text,)], "t string").select(S.price("t").alias("p")).first()["p"] == value


def test_json_csv_round_trip(spark, tmp_path):
    (tmp_path / "raw" / "week_1").mkdir(parents=True)
    (tmp_path / "raw" / "week_1" / "a.json").write_text(json.dumps([{k: v for k, v in LAPTOP.items()}, LAPTOP | {"url": "u9", "specs_brutes": {"a": "b"}}]))
    (tmp_path / "raw" / "week_1" / "b.json").write_text("{not json")
    found = ingest.raw_products(spark, str(tmp_path / "raw")).cache()
    assert ingest.readable(found).count() == 2 and ingest.unreadable(found).count() == 1
    for w in (2, 10):
        (tmp_path / "clean" / f"week_{w}").mkdir(parents=True)
    (tmp_path / "clean" / "week_2" / "tv_clean.csv").write_text("url,prix_tnd,marque\nu2,2.5,\n", encoding="utf-8-sig")
    (tmp_path / "clean" / "week_10" / "tv_clean.csv").write_text("url,prix_tnd,marque,has_4g\nu10,10.5,X,1\n", encoding="utf-8-sig")
    assert ingest.weeks(spark, str(tmp_path / "clean")) == [2, 10]
    out = {r["url"]: r for r in ingest.pooled(spark, str(tmp_path / "clean"), "tv").collect()}
    assert out["u2"]["has_4g"] == 0 and out["u2"]["marque"] == "Manquant" and out["u10"]["semaine"] == 10
    df = spark.createDataFrame([("u1", 1), ("u2", 2)], "url string, semaine int")
    assert [r["url"] for r in ingest.last_periods(df, 1).collect()] == ["u2"]
    counts = sinks.week_splits(spark.range(50).select(F.col("id").cast("string").alias("url"), F.lit("c").alias("categorie")), str(tmp_path / "s"))
    assert counts == {"train": 40, "test": 10}


def test_label_files_replace_their_inputs(spark, tmp_path):
    """The table that is joined from is replaced as a whole, again and again, and nothing is left beside it."""
    path = f"file://{tmp_path}/segments"
    spark.createDataFrame([("b", "s1"), ("a", "s2"), ("c", "s3")], "product string, segment string").write.parquet(path)
    prices = spark.createDataFrame([("a", 2, 11.0), ("a", 1, 10.0), ("b", 1, 5.0), ("x", 1, 1.0)], "product string, week int, price double")
    sinks.label_files(spark.read.parquet(path), prices, path)
    want = [("a", "s2", 1, 10.0), ("a", "s2", 2, 11.0), ("b", "s1", 1, 5.0)]
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == want
    sinks.replace(spark.read.parquet(path).where("week = 1").drop("week"), path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [("a", "s2", 10.0), ("b", "s1", 5.0)]
    sinks.replace(spark.range(2), f"file://{tmp_path}/fresh")
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["fresh", "segments"]
