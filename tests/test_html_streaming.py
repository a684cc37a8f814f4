from pyspark.sql import functions as F

from tarifa import cli
from tarifa.operators import html as H
from tarifa.streaming import events as E

PAGE = """<html><head><meta property="product:price:amount" content="1500"/><meta property="og:description" content="Marque: ACME - Processeur: Intel Core i5-1235U - Mémoire RAM: 8 Go - Disque Dur: 512 Go SSD - Taille de l'écran: 15,6 &quot;"/></head>
<body><h1 class="page-title"><span>Portable ACME X</span></h1><table><tr><th>Système</th><td>Windows 11</td></tr><tr><th>Marque</th><td>Other</td></tr><tr><th>Wi-Fi</th><td>Wi-Fi 6</td></tr></table>
<a href="/p/1.html">1</a><a href="https://x.example/2">2</a><a href="/p/1.html">again</a><span class="price">9,000</span></body></html>"""


def test_product_page(spark):
    pages = spark.createDataFrame([("u1", PAGE), ("u2", "<h1> </h1>"), ("u3", "<h1>TV SAMSUNG 55 pouces 4K QLED</h1><span class='price'>1 299,000 TND</span>"), ("u4", None)], "url string, html string")
    r = H.parse_products(pages, "pc_portables", 2).where("url = 'u1'").first()
    assert (r["nom"], r["marque"], r["prix_tnd"], r["ram_go"], r["stockage_go"], r["type_stockage"], r["taille_ecran"], r["os"], r["semaine"]) == ("Portable ACME X", "ACME", 1500.0, 8.0, 512.0, "SSD", 15.6, "Windows 11", 2)
    assert r["processeur"] == "Intel Core i5-1235U" and "Wi-Fi" in r["connectivite"]
    tv = H.parse_products(pages, "televiseurs", 1, ["Samsung"]).where("url = 'u3'").first()
    assert (tv["marque"], tv["prix_tnd"], tv["resolution_affichage"], tv["technologie_dalle"], tv["hdr"], tv["taille_ecran"]) == ("Samsung", 1299.0, "4K", "QLED", False, 55.0)
    assert H.parse_products(pages, "televiseurs", 1).count() == 2
    links = pages.where("url = 'u1'").select(H.product_links("html", "https://shop.example/").alias("l")).first()["l"]
    assert links == ["https://shop.example/p/1.html", "https://x.example/2"]
    assert spark.range(1).select(H.page_url(F.lit("b"), 3).alias("u")).first()["u"] == "b?p=3"


def test_batch_and_stream_agree(spark, tmp_path):
    rows = spark.range(60).select((F.col("id") % 7).alias("k"), F.timestamp_seconds(F.col("id") * 1000).alias("ts"), F.col("id").cast("double").alias("value"))
    for i in range(3):
        rows.where(f"value % 3 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    E.upsert_latest(stream, f"{tmp_path}/t", ["k"], "ts", checkpoint=f"{tmp_path}/c").awaitTermination()
    got = sorted(map(tuple, E.current(spark, f"{tmp_path}/t").select("k", "ts", "value").collect()))
    want = sorted(map(tuple, rows.groupBy("k").agg(F.max("ts").alias("ts"), F.max("value").alias("value")).collect()))
    assert got == want and len(E._versions(spark, f"{tmp_path}/t")) == 3
    out = E.drained(E.tumbling(stream, "ts", "k", width="1 hour"), "complete")
    assert out.agg(F.sum("n")).first()[0] == 60
    assert E.drained(E.first_within(stream, "ts", ["k"], "30 days"), "append").count() == 7


def test_command_line(spark, tmp_path):
    import json

    from tests.test_clean import LAPTOP

    (tmp_path / "raw").mkdir()
    products = [LAPTOP | {"url": f"u{i}", "prix_tnd": 1000.0 + 10 * i, "semaine": 1 + i % 2, "marque": "ab"[i % 4 // 2] * 2} for i in range(40)]
    (tmp_path / "raw" / "x.json").write_text(json.dumps(products))
    cli.main(["clean", "--raw", str(tmp_path / "raw"), "--out", str(tmp_path / "clean")])
    cli.main(["reports", "--clean", str(tmp_path / "clean"), "--out", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out" / "composition")).count() == 2
    assert spark.read.parquet(str(tmp_path / "out" / "churn")).first()["entering"] == 20
