"""Queries over the product panel, each with SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.functions import specs as S
from tarifa.operators import panel as P
from tarifa.operators.bounds import observed_bounds
from tarifa.operators.clean import canonical_brands, correct, latest, quality_summary
from tarifa.operators.ranks import quantiles
from tarifa.plans.data import OBSERVATIONS, PANEL, PARTS, observations, panel, parts, table

ALL: dict[str, tuple[Callable, str | None]] = {}
PERIODS = list(range(1995, 2002))


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        ALL[f.__name__] = (f, sql)
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    """Computed columns to so many digits; a negative zero becomes zero."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + F.lit(0.0) for c in columns})


@query(f"WITH {OBSERVATIONS} SELECT category, period, round(exp(avg(CASE WHEN price > 0 THEN ln(price) END)), 4) AS geo_price, count(*) AS n FROM observations GROUP BY 1, 2")
def geo_mean_by_category_period(spark, d):
    return rounded(P.by_period(observations(spark, d), "category", "period").select("category", "period", "geo_price", "n"), "geo_price")


@query(f"WITH {PANEL} SELECT product, period, price, quantity, flag FROM panel")
def dedup_latest(spark, d):
    return panel(spark, d).select("product", "period", "price", "quantity", "flag")


@query("SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN 'gtin:' || l_partkey ELSE 'url:/p/' || l_partkey END || '|semaine:' || year(l_shipdate) AS dedup_key FROM lineitem")
def dedup_key_build(spark, d):
    x = table(spark, d, "lineitem").select("l_partkey", F.year("l_shipdate").alias("week"))
    gtin = F.when(F.col("l_partkey") % 3 == 0, F.col("l_partkey").cast("string"))
    return x.select(S.dedup_key(gtin, F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")), "week").alias("dedup_key")).distinct()


@query(
    """WITH x AS (SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN upper(p_brand) WHEN p_partkey % 5 = 1 THEN lower(p_brand) ELSE p_brand END AS b FROM part),
       c AS (SELECT lower(b) AS k, b, row_number() OVER (PARTITION BY lower(b) ORDER BY count(*) DESC, b) AS r FROM x GROUP BY lower(b), b)
       SELECT p_partkey, c.b AS brand FROM x JOIN c ON lower(x.b) = c.k AND c.r = 1"""
)
def brand_canonical(spark, d):
    k = F.col("p_partkey") % 5
    x = table(spark, d, "part").select("p_partkey", F.when(k == 0, F.upper("p_brand")).when(k == 1, F.lower("p_brand")).otherwise(F.col("p_brand")).alias("brand"))
    return canonical_brands(x, "brand")


@query(
    """WITH q AS (SELECT p_type AS category, count(*) AS n, quantile_cont(p_retailprice, 0.01) AS a, quantile_cont(p_retailprice, 0.99) AS b FROM part GROUP BY 1)
       SELECT category, n, round(greatest(a - 0.5 * (b - a), 0), 4) AS low, round(b + 0.5 * (b - a), 4) AS high FROM q WHERE n >= 5"""
)
def bounds_quantiles(spark, d):
    return observed_bounds(parts(spark, d), "category", "price", digits=4)


@query(
    """SELECT flag, suspect, count(*) AS n, count(kept) AS n_kept FROM (
         SELECT l_returnflag AS flag, NOT (l_extendedprice BETWEEN 1000 AND 60000) AS suspect, CASE WHEN l_extendedprice BETWEEN 1000 AND 60000 THEN l_extendedprice END AS kept FROM lineitem) x
       GROUP BY 1, 2"""
)
def bounds_flags_reject(spark, d):
    from tarifa.operators.bounds import out_of_range

    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("p"))
    x = x.withColumn("suspect", out_of_range(F.col("p"), F.lit(1000.0), F.lit(60000.0)))
    return x.groupBy("flag", "suspect").agg(F.count("*").alias("n"), F.count(F.when(~F.col("suspect"), F.col("p"))).alias("n_kept"))


_GAPS = "CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size END"


@query(
    f"""WITH x AS (SELECT p_partkey, p_brand, {_GAPS} AS p_size FROM part)
        SELECT 'p_partkey' AS column_name, count(*) - count(p_partkey) AS n_null, round((count(*) - count(p_partkey)) * 100.0 / count(*), 4) AS pct_null FROM x
        UNION ALL SELECT 'p_brand', count(*) - count(p_brand), round((count(*) - count(p_brand)) * 100.0 / count(*), 4) FROM x
        UNION ALL SELECT 'p_size', count(*) - count(p_size), round((count(*) - count(p_size)) * 100.0 / count(*), 4) FROM x"""
)
def quality_counts(spark, d):
    return quality_summary(table(spark, d, "part").select("p_partkey", "p_brand", F.expr(_GAPS).alias("p_size"))).withColumn("pct_null", F.col("pct_null").cast("double"))


@query(f"SELECT p_type AS category, round(avg(CASE WHEN ({_GAPS}) IS NULL THEN 1.0 ELSE 0.0 END) * 100, 4) AS size_missing_pct, round(avg(CASE WHEN p_brand IS NULL THEN 1.0 ELSE 0.0 END) * 100, 4) AS brand_missing_pct FROM part GROUP BY 1")
def missing_matrix(spark, d):
    x = table(spark, d, "part").select(F.col("p_type").alias("category"), F.expr(_GAPS).alias("size"), F.col("p_brand").alias("brand"))
    share = lambda c: (F.avg(F.col(c).isNull().cast("int")) * 100).alias(f"{c}_missing_pct")
    return rounded(x.groupBy("category").agg(share("size"), share("brand")), "size_missing_pct", "brand_missing_pct")


@query("SELECT p_partkey AS url, CASE WHEN p_partkey IN (1, 5, 10) THEN 99.0 ELSE p_retailprice END AS price FROM part")
def known_corrections(spark, d):
    x = table(spark, d, "part").select(F.col("p_partkey").alias("url"), F.col("p_retailprice").alias("price"))
    return correct(x, spark.createDataFrame([(1, 99.0), (5, 99.0), (10, 99.0)], "url long, price double"))


@query("SELECT p_partkey, p_brand AS brand, CAST(p_size AS DOUBLE) AS ram, CASE WHEN p_partkey % 2 = 0 THEN 'SSD' ELSE 'HDD' END AS kind, CAST(p_size * 1024 AS DOUBLE) AS storage, 3 AS n_labels FROM part")
def spec_parse_lookup(spark, d):
    from tarifa.operators.html import spec_map

    text = F.concat(F.lit("Marque : "), F.col("p_brand"), F.lit(" - Mémoire RAM: "), F.col("p_size"), F.lit(" Go - Disque Dur: "), F.col("p_size"), F.lit(" To "), F.when(F.col("p_partkey") % 2 == 0, "SSD").otherwise("HDD"))
    x = table(spark, d, "part").select("p_partkey", spec_map(text).alias("m"))
    disk = S.find_spec("m", "Disque Dur", "Stockage")
    return x.select("p_partkey", S.find_spec("m", "marque").alias("brand"), S.capacity_gb(S.find_spec("m", "Memoire", exclude=["cache"])).alias("ram"), S.storage_type(disk).alias("kind"), S.storage_gb(disk).alias("storage"), F.size("m").alias("n_labels"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size / 1024.0 WHEN p_partkey % 3 = 1 THEN CAST(p_size AS DOUBLE) END AS gb FROM part")
def capacity_parse(spark, d):
    k = F.col("p_partkey") % 3
    text = F.when(k == 0, F.concat(F.col("p_size"), F.lit(" Mo"))).when(k == 1, F.concat(F.lit("env. "), F.col("p_size"), F.lit("Go DDR4"))).otherwise(F.lit("sans"))
    return table(spark, d, "part").select("p_partkey", S.capacity_gb(text).alias("gb"))


@query("SELECT p_partkey, p_retailprice * 1.0 AS price, round(p_retailprice, 0) AS whole FROM part")
def price_parse(spark, d):
    text = F.concat(F.format_string("%.2f", "p_retailprice"), F.lit(" TND"))
    french = F.concat(F.lit("1 "), F.lpad(F.format_string("%.0f", F.round("p_retailprice", 0)), 12, " "), F.lit(",000 DT"))
    x = table(spark, d, "part")
    return x.select("p_partkey", S.price(text).alias("price"), (S.price(F.substring(french, 3, 100))).alias("whole"))


_CPU = """CASE p_size % 6 WHEN 0 THEN 'Intel Core i5-' || p_partkey WHEN 1 THEN 'AMD Ryzen 7 Octa Core' WHEN 2 THEN 'Qualcomm SNAPDRAGON 8' WHEN 3 THEN 'MediaTek Helio G85' WHEN 4 THEN 'intel Core 5 120U' ELSE 'Unisoc T606' END"""
_REF = "CASE p_size % 6 WHEN 0 THEN 'Intel® Core™ i5-' || (p_partkey + 9000) || 'H' WHEN 1 THEN 'AMD Ryzen™ 7 ' || (p_partkey % 7 + 1) || '700U' ELSE '' END"


@query(
    """SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'Intel' WHEN 1 THEN 'AMD' WHEN 2 THEN 'Qualcomm' WHEN 3 THEN 'MediaTek' WHEN 4 THEN 'Intel' ELSE 'Autre' END AS brand,
              CAST(CASE p_size % 6 WHEN 0 THEN 5 WHEN 1 THEN 7 WHEN 4 THEN 5 END AS INTEGER) AS tier,
              CAST(CASE WHEN p_size % 6 = 0 AND p_partkey + 9000 >= 10000 THEN (p_partkey + 9000) // 1000 WHEN p_size % 6 = 0 THEN (p_partkey + 9000) // 100
                        WHEN p_size % 6 = 1 THEN p_partkey % 7 + 1 END AS INTEGER) AS generation FROM part"""
)
def cpu_parse(spark, d):
    x = table(spark, d, "part").select("p_partkey", F.expr(_CPU).alias("cpu"), F.expr(_REF).alias("ref"))
    return x.select("p_partkey", S.cpu_brand("cpu").alias("brand"), S.cpu_tier("cpu").alias("tier"), S.cpu_generation("cpu", "ref").alias("generation"))


@query(
    """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Android' WHEN 1 THEN 'iOS' WHEN 2 THEN 'Autre' WHEN 3 THEN 'Android' ELSE 'Inconnu' END AS phone,
              CASE p_size % 5 WHEN 0 THEN 'Android TV' WHEN 1 THEN 'Autre' WHEN 2 THEN 'Tizen' WHEN 3 THEN 'Google TV' ELSE 'Inconnu' END AS tv FROM part"""
)
def os_platform(spark, d):
    system = F.expr("CASE p_size % 5 WHEN 0 THEN 'Android 15, XOS 15.1' WHEN 1 THEN 'iPhone OS' WHEN 2 THEN 'TIZEN 7' WHEN 3 THEN 'Google TV (Android 11)' END")
    x = table(spark, d, "part").select("p_partkey", system.alias("s"))
    return x.select("p_partkey", S.os_platform(F.lit("smartphones"), "s").alias("phone"), S.os_platform(F.lit("televiseurs"), "s").alias("tv"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 ELSE 0 END AS has_4g, CASE WHEN p_size % 4 = 2 THEN 1 ELSE 0 END AS has_5g, CASE WHEN p_size % 4 IN (0, 1) THEN 1 ELSE 0 END AS has_wifi,
              CASE WHEN p_size % 4 = 2 THEN 1 ELSE 0 END AS has_wifi6, CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS has_bluetooth, CASE WHEN p_size % 4 = 2 THEN 1 ELSE 0 END AS has_nfc,
              CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS has_ethernet FROM part"""
)
def connectivity_flags(spark, d):
    text = F.expr("CASE p_size % 4 WHEN 0 THEN '4G; Wi-Fi' WHEN 1 THEN 'RJ45; Wi-Fi 2.4G/5G, Bluetooth 5.4' WHEN 2 THEN 'WiFi 6, NFC, 5g' END")
    x = table(spark, d, "part").select("p_partkey", text.alias("c"))
    return x.select("p_partkey", *[v.alias(k) for k, v in S.connectivity_flags("c").items()])


@query("SELECT doc_id, md5(strip_accents(lower(text))) AS folded FROM documents")
def text_normalise(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(S.norm("text")).alias("folded"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query(f"WITH {PANEL}, w AS (SELECT DISTINCT period FROM panel) SELECT w.period, count(p.product) AS n FROM w LEFT JOIN (SELECT * FROM panel WHERE category = 'NO SUCH' OR period < 1998) p ON w.period = p.period GROUP BY 1")
def period_counts(spark, d):
    x = panel(spark, d)
    return P.zero_filled_counts(x.where("period < 1998"), x.select("period"), "period")


@query(
    f"WITH {PANEL} SELECT category, count(*) AS n, round(avg(price), 4) AS mean_price, round(median(price), 4) AS median_price, round(stddev_samp(price), 4) AS sd_price, min(price) AS min_price, max(price) AS max_price FROM panel GROUP BY 1"
)
def price_summary(spark, d):
    x = P.by_period(panel(spark, d), "category").drop("geo_price")
    return rounded(x, "mean_price", "median_price", "sd_price")


@query(f"WITH {PARTS} SELECT brand, count(*) AS n, round(median(price), 4) AS median_price, min(price) AS min_price, max(price) AS max_price FROM parts GROUP BY 1")
def brand_table(spark, d):
    x = P.by_period(parts(spark, d), "brand").select("brand", "n", "median_price", "min_price", "max_price").orderBy(F.desc("n"), "brand")
    return rounded(x, "median_price")


@query(f"WITH {PANEL} SELECT category, period, round(avg(size), 4) AS size, round(avg(quantity), 4) AS quantity, round(exp(avg(ln(price))), 4) AS geo_price, count(*) AS n FROM panel GROUP BY 1, 2")
def composition(spark, d):
    x = panel(spark, d).groupBy("category", "period").agg(F.avg("size").alias("size"), F.avg("quantity").alias("quantity"), S.geo_mean("price").alias("geo_price"), F.count("*").alias("n"))
    return rounded(x, "size", "quantity", "geo_price")


@query(f"WITH {PARTS} SELECT brand, count(*) AS n FROM parts GROUP BY 1 ORDER BY n DESC, brand LIMIT 10")
def top_brands(spark, d):
    return P.top_values(parts(spark, d), "brand", 10)


@query(
    """WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
       SELECT CAST(least(floor((p_retailprice - lo) / ((hi - lo) / 20)) + 1, 20) AS INTEGER) AS bin, count(*) AS n FROM part, e GROUP BY 1"""
)
def price_histogram(spark, d):
    return P.histogram(parts(spark, d), "price", 20).select("bin", "n")


@query(f"WITH {PARTS} SELECT brand, count(price) AS n, round(quantile_cont(price, 0.25), 4) AS q1, round(quantile_cont(price, 0.5), 4) AS q2, round(quantile_cont(price, 0.75), 4) AS q3 FROM parts GROUP BY 1")
def box_stats(spark, d):
    return rounded(P.box(parts(spark, d), "brand", "price"), "q1", "q2", "q3")


@query(f"WITH {PARTS} SELECT category, round(quantile_cont(size, 0.01), 4) AS low, round(quantile_cont(size, 0.99), 4) AS high, round(median(size), 4) AS middle, count(DISTINCT brand) AS n_brands FROM parts GROUP BY 1")
def feature_ranges(spark, d):
    x = parts(spark, d)
    x = x.groupBy("category").agg(F.count_distinct("brand").alias("n_brands")).join(quantiles(x, ["category"], "size", (0.01, 0.99, 0.5)), "category", "left")
    return rounded(x.select("category", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), F.col("q")[2].alias("middle"), "n_brands"), "low", "high", "middle")


@query(
    f"""WITH {PANEL} SELECT period, count(*) AS n_pooled, count(CASE WHEN product % 10 <> 0 THEN 1 END) AS n_kept, round(count(CASE WHEN product % 10 <> 0 THEN 1 END) * 100.0 / count(*), 4) AS kept_pct,
         count(CASE WHEN product % 10 IN (1, 2, 3) THEN 1 END) AS n_clustered FROM panel GROUP BY 1"""
)
def coverage_by_period(spark, d):
    x = panel(spark, d)
    labels = x.select("product").distinct().where("product % 10 <> 0").select("product", F.when(F.col("product") % 10 <= 3, F.lit("c")).alias("label"), F.lit(1).alias("kept"))
    x = x.join(labels, "product", "left")
    kept = F.count("kept")
    return rounded(x.groupBy("period").agg(F.count("*").alias("n_pooled"), kept.alias("n_kept"), (kept * 100.0 / F.count("*")).alias("kept_pct"), F.count("label").alias("n_clustered")), "kept_pct")


@query(
    f"""WITH {PANEL} SELECT 'n1' AS approach, category AS cluster, period, count(*) AS n, round(exp(avg(ln(price))), 4) AS geo_price FROM panel GROUP BY 2, 3
        UNION ALL SELECT 'n2', category || '::' || flag, period, count(*), round(exp(avg(ln(price))), 4) FROM panel GROUP BY category || '::' || flag, period"""
)
def cluster_geo_means_union(spark, d):
    x = panel(spark, d).withColumn("fine", F.concat_ws("::", "category", "flag"))
    one = lambda name, c: x.groupBy(F.col(c).alias("cluster"), "period").agg(F.count("*").alias("n"), S.geo_mean("price").alias("geo_price")).select(F.lit(name).alias("approach"), "*")
    return rounded(one("n1", "category").unionByName(one("n2", "fine")), "geo_price")


@query(
    f"""WITH {PANEL}, g AS (SELECT category, period, exp(avg(ln(price))) AS p FROM panel GROUP BY 1, 2), w AS (SELECT category, {", ".join(f"max(CASE WHEN period = {y} THEN p END) AS p{y}" for y in PERIODS)} FROM g GROUP BY 1)
        SELECT category, {", ".join(f"round(p{y}, 4) AS p{y}" for y in PERIODS)}, round((p{PERIODS[-1]} - p{PERIODS[0]}) / p{PERIODS[0]} * 100, 4) AS change_pct FROM w"""
)
def pivot_periods(spark, d):
    return rounded(P.pivot_periods(panel(spark, d), "category", S.geo_mean("price"), PERIODS), *[f"p{y}" for y in PERIODS], "change_pct")


@query(
    """SELECT o_orderpriority AS priority, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS "n_F", count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS "n_O", count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS "n_P",
              round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) * 100.0 / count(*), 4) AS "pct_F", round(count(CASE WHEN o_orderstatus = 'O' THEN 1 END) * 100.0 / count(*), 4) AS "pct_O",
              round(count(CASE WHEN o_orderstatus = 'P' THEN 1 END) * 100.0 / count(*), 4) AS "pct_P" FROM orders GROUP BY 1"""
)
def crosstab_pct(spark, d):
    x = table(spark, d, "orders").select(F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    return rounded(P.crosstab(x, "priority", "status", ["F", "O", "P"]), "pct_F", "pct_O", "pct_P")


@query(f"WITH {PANEL}, c AS (SELECT period, brand, count(*) AS n FROM panel GROUP BY 1, 2) SELECT period, brand, n, round(n * 100.0 / sum(n) OVER (PARTITION BY period), 4) AS share_pct FROM c")
def brand_share(spark, d):
    return rounded(P.shares(panel(spark, d), ["period"], "brand"), "share_pct")


@query(f"WITH {PANEL} SELECT category, round(sum(v * quantity) / sum(CASE WHEN v IS NOT NULL THEN quantity END), 4) AS mean_size FROM (SELECT *, CASE WHEN product % 7 = 0 THEN NULL ELSE size END AS v FROM panel) x GROUP BY 1")
def weighted_mean(spark, d):
    x = panel(spark, d).withColumn("v", F.when(F.col("product") % 7 != 0, F.col("size")))
    return rounded(x.groupBy("category").agg(P.weighted_mean("v", "quantity").alias("mean_size")), "mean_size")


@query(f"WITH {PANEL} SELECT product FROM panel GROUP BY 1 HAVING count(DISTINCT period) = (SELECT count(DISTINCT period) FROM panel)")
def present_in_all_periods(spark, d):
    return P.present_in_all(panel(spark, d), "product")


_TIERS = f"""{PARTS}, q AS (SELECT brand, count(*) AS n, quantile_cont(price, 1/3.0) AS a, quantile_cont(price, 2/3.0) AS b, quantile_cont(price, 0.5) AS m FROM parts GROUP BY 1 HAVING count(*) >= 5),
  tiered AS (SELECT p.*, n AS n_brand, CASE WHEN n >= 15 THEN CASE WHEN price <= a THEN 'Économique' WHEN price <= b THEN 'Milieu de gamme' ELSE 'Premium' END
     WHEN n >= 10 THEN CASE WHEN price <= m THEN 'Économique' ELSE 'Premium' END ELSE 'Gamme unique' END AS tier FROM parts p JOIN q ON p.brand = q.brand)"""


@query(f"WITH {_TIERS} SELECT brand, tier, count(*) AS n, min(price) AS low, max(price) AS high FROM tiered GROUP BY 1, 2")
def price_tiers(spark, d):
    x = P.tiers(parts(spark, d))
    return x.groupBy("brand", "tier").agg(F.count("*").alias("n"), F.min("price").alias("low"), F.max("price").alias("high"))


@query(f"WITH {_TIERS} SELECT brand, n_brand AS n, CASE WHEN n_brand >= 15 THEN 3 WHEN n_brand >= 10 THEN 2 ELSE 1 END AS planned, count(DISTINCT tier) AS found FROM tiered GROUP BY 1, 2")
def brand_plan(spark, d):
    x = P.tiers(parts(spark, d))
    return x.groupBy("brand", F.col("n_brand").alias("n"), F.col("tiers_planned").alias("planned")).agg(F.max("tiers_found").cast("long").alias("found"))


@query(
    f"""WITH {_TIERS}, r AS (SELECT brand, tier, min(price) AS low, max(price) AS high FROM tiered GROUP BY 1, 2),
        c AS (SELECT p.product, p.brand, p.price * 1.01 AS price, r.tier, row_number() OVER (PARTITION BY p.product ORDER BY greatest(low - p.price * 1.01, p.price * 1.01 - high, 0), low, r.tier) AS k
              FROM parts p LEFT JOIN r ON p.brand = r.brand) SELECT product, tier AS assigned FROM c WHERE k = 1"""
)
def range_tier_assign(spark, d):
    rows = parts(spark, d).select("product", "brand", (F.col("price") * 1.01).alias("price"))
    return P.assign_by_range(rows, P.tier_ranges(P.tiers(parts(spark, d)))).select("product", "assigned")


@query(
    """WITH m AS (SELECT DISTINCT p_brand AS brand, 't' || p_size % 3 AS tier, 'c' || p_size % 4 AS cluster FROM part WHERE p_partkey % 3 = 0 AND p_brand < 'Brand#5'),
       k AS (SELECT *, brand || '::' || tier || '::' || cluster AS model FROM m),
       r AS (SELECT p_partkey AS id, p_brand AS brand, 't' || p_partkey % 4 AS tier, 'c' || p_partkey % 5 AS cluster FROM part)
       SELECT r.id, coalesce(a.model, b.model, c.model) AS model, CASE WHEN a.model IS NOT NULL THEN 'n2' WHEN b.model IS NOT NULL THEN 'n2_marque_gamme' WHEN c.model IS NOT NULL THEN 'n2_marque' ELSE 'categorie' END AS level
       FROM r LEFT JOIN k a ON r.brand = a.brand AND r.tier = a.tier AND r.cluster = a.cluster
       LEFT JOIN (SELECT brand, tier, min(model) AS model FROM k GROUP BY 1, 2) b ON r.brand = b.brand AND r.tier = b.tier LEFT JOIN (SELECT brand, min(model) AS model FROM k GROUP BY 1) c ON r.brand = c.brand"""
)
def hierarchical_fallback(spark, d):
    x = table(spark, d, "part")
    tag = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    models = x.where("p_partkey % 3 = 0 AND p_brand < 'Brand#5'").select(F.col("p_brand").alias("brand"), tag("t", F.col("p_size") % 3).alias("tier"), tag("c", F.col("p_size") % 4).alias("cluster")).distinct()
    models = models.withColumn("model", F.concat_ws("::", "brand", "tier", "cluster"))
    rows = x.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("brand"), tag("t", F.col("p_partkey") % 4).alias("tier"), tag("c", F.col("p_partkey") % 5).alias("cluster"))
    return P.fallback_lookup(rows, models).select("id", "model", "level")


@query(
    f"""WITH {PANEL}, l AS (SELECT product, min(flag) AS label FROM panel WHERE period = (SELECT min(period) FROM panel) GROUP BY 1)
        SELECT period, coalesce(label, 'marque_negligeable') AS label, count(*) AS n FROM panel LEFT JOIN l ON panel.product = l.product GROUP BY 1, 2"""
)
def label_propagation(spark, d):
    x = panel(spark, d)
    first = x.agg(F.min("period").alias("period"))
    labels = x.join(F.broadcast(first), "period", "left_semi").select("product", F.col("flag").alias("label"))
    return P.propagate_labels(x, labels).groupBy("period", F.coalesce("label", F.lit("marque_negligeable")).alias("label")).agg(F.count("*").alias("n"))


@query(
    f"""WITH {PANEL}, w AS (SELECT period AS t, lead(period) OVER (ORDER BY period) AS next FROM (SELECT DISTINCT period FROM panel) x),
        a AS (SELECT w.t, w.next, p.product FROM w JOIN panel p ON p.period = w.t WHERE next IS NOT NULL), b AS (SELECT w.t, w.next, p.product FROM w JOIN panel p ON p.period = w.next)
        SELECT coalesce(a.t, b.t) AS t, coalesce(a.next, b.next) AS next, count(CASE WHEN a.product IS NULL THEN 1 END) AS entering, count(CASE WHEN b.product IS NULL THEN 1 END) AS leaving,
               count(CASE WHEN a.product IS NOT NULL AND b.product IS NOT NULL THEN 1 END) AS matched
        FROM a FULL OUTER JOIN b ON a.t = b.t AND a.next = b.next AND a.product = b.product GROUP BY 1, 2"""
)
def product_churn(spark, d):
    return P.churn(panel(spark, d))


@query(
    f"""WITH {PANEL}, m AS (SELECT product FROM panel GROUP BY 1 HAVING count(DISTINCT period) = (SELECT count(DISTINCT period) FROM panel)),
        a AS (SELECT period, median(price) AS p FROM panel GROUP BY 1), b AS (SELECT period, median(price) AS p FROM panel WHERE product IN (SELECT product FROM m) GROUP BY 1),
        i AS (SELECT a.period, a.p AS pa, b.p AS pb, a.p * 100.0 / first_value(a.p) OVER (ORDER BY a.period) AS ia, b.p * 100.0 / first_value(b.p) OVER (ORDER BY a.period) AS ib FROM a LEFT JOIN b ON a.period = b.period)
        SELECT period, round(pa, 4) AS median_all, round(pb, 4) AS median_matched, round(ia, 4) AS index_all, round(ib, 4) AS index_matched, round(ia - ib, 4) + 0.0 AS mix_effect FROM i"""
)
def matched_panel_index(spark, d):
    return rounded(P.base_index(panel(spark, d)), "median_all", "median_matched", "index_all", "index_matched", "mix_effect")


@query(
    f"""WITH {PANEL}, w AS (SELECT period, lead(period) OVER (ORDER BY period) AS next FROM (SELECT DISTINCT period FROM panel) x),
        x AS (SELECT a.period, w.next, (b.price - a.price) / a.price * 100 AS d FROM panel a JOIN w ON a.period = w.period JOIN panel b ON b.product = a.product AND b.period = w.next)
        SELECT period, next, count(*) AS n, round(median(d), 4) AS median_pct, round(avg(CASE WHEN d > 0.5 THEN 100.0 ELSE 0 END), 4) AS up_pct, round(avg(CASE WHEN d < -0.5 THEN 100.0 ELSE 0 END), 4) AS down_pct,
               round(avg(CASE WHEN d BETWEEN -0.5 AND 0.5 THEN 100.0 ELSE 0 END), 4) AS stable_pct FROM x GROUP BY 1, 2"""
)
def matched_deltas(spark, d):
    return rounded(P.matched_deltas(panel(spark, d)), "median_pct", "up_pct", "down_pct", "stable_pct")


@query(
    f"""WITH {PANEL}, g AS (SELECT category, period, round(exp(avg(ln(price))), 2) AS r, round(avg(price), 2) AS e, count(*) AS n FROM panel GROUP BY 1, 2),
        x AS (SELECT category, period AS t, lead(period) OVER w AS t1, (lead(r) OVER w - r) / r * 100 AS real_pct, (lead(e) OVER w - e) / e * 100 AS est_pct, n AS n_t, lead(n) OVER w AS n_t1 FROM g WINDOW w AS (PARTITION BY category ORDER BY period)),
        y AS (SELECT *, CASE WHEN real_pct > 3 THEN 'hausse' WHEN real_pct < -3 THEN 'baisse' ELSE 'stable' END AS a, CASE WHEN est_pct > 3 THEN 'hausse' WHEN est_pct < -3 THEN 'baisse' ELSE 'stable' END AS b FROM x WHERE t1 IS NOT NULL)
        SELECT category, t, t1, round(real_pct, 4) + 0.0 AS real_pct, round(est_pct, 4) + 0.0 AS estimated_pct, round(real_pct - est_pct, 4) + 0.0 AS gap_pct, a || '/' || b AS label,
               CASE WHEN n_t <> n_t1 THEN 'effectif' WHEN a <> 'stable' AND b <> 'stable' AND a <> b THEN 'prix_et_qualite' WHEN b <> 'stable' THEN 'qualite' WHEN a <> 'stable' THEN 'prix' ELSE 'aucune' END AS cause, n_t < 3 OR n_t1 < 3 AS limited FROM y"""
)
def transitions_classify(spark, d):
    g = panel(spark, d).groupBy("category", "period").agg(F.round(S.geo_mean("price"), 2).alias("r"), F.round(F.avg("price"), 2).alias("e"), F.count("*").alias("n"))
    return rounded(P.transitions(g, ["category"], "r", "e", "n"), "real_pct", "estimated_pct", "gap_pct").drop("n_t", "n_t1")


@query(f"WITH {PANEL}, g AS (SELECT category, period, avg(price) AS p FROM panel GROUP BY 1, 2) SELECT category, period, round((p - lag(p) OVER w) / lag(p) OVER w * 100, 4) + 0.0 AS change_pct FROM g WINDOW w AS (PARTITION BY category ORDER BY period)")
def period_pct_change(spark, d):
    g = panel(spark, d).groupBy("category", "period").agg(F.avg("price").alias("p"))
    return rounded(P.lagged_change(g, ["category"], "p"), "change_pct").drop("p")


@query(f"WITH {PANEL}, g AS (SELECT category, period, avg(price) AS p FROM panel GROUP BY 1, 2) SELECT category, round(arg_min(p, period), 4) AS first, round(arg_max(p, period), 4) AS last, round((arg_max(p, period) - arg_min(p, period)) / arg_min(p, period) * 100, 4) AS change_pct FROM g GROUP BY 1")
def first_last_change(spark, d):
    g = panel(spark, d).groupBy("category", "period").agg(F.avg("price").alias("p"))
    return rounded(P.first_last(g, "category", "p"), "first", "last", "change_pct")


@query(
    """WITH a AS (SELECT p_brand AS feature, avg(p_retailprice) AS x FROM part WHERE p_size < 25 AND p_brand < 'Brand#4' GROUP BY 1), b AS (SELECT p_brand AS feature, avg(p_size) AS y FROM part WHERE p_brand > 'Brand#2' GROUP BY 1)
       SELECT coalesce(a.feature, b.feature) AS feature, round(x, 4) AS x, round(y, 4) AS y FROM a FULL OUTER JOIN b ON a.feature = b.feature"""
)
def importance_compare(spark, d):
    p = table(spark, d, "part").withColumnRenamed("p_brand", "feature")
    a = p.where("p_size < 25 AND feature < 'Brand#4'").groupBy("feature").agg(F.avg("p_retailprice").alias("x"))
    b = p.where("feature > 'Brand#2'").groupBy("feature").agg(F.avg("p_size").alias("y"))
    return rounded(a.join(b, "feature", "full_outer"), "x", "y")


@query(
    f"""WITH {PARTS}, c AS (SELECT q.id AS query_id, p.id, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((p.size - q.size) * (p.size - q.size) + (p.price - q.price) * (p.price - q.price)), p.id) AS rank,
         sqrt((p.size - q.size) * (p.size - q.size) + (p.price - q.price) * (p.price - q.price)) AS dist FROM parts q JOIN parts p ON p.brand = q.brand AND p.id <> q.id)
        SELECT query_id, id, CAST(rank AS INTEGER) AS rank, round(dist, 4) AS distance FROM c WHERE rank <= 3"""
)
def knn_similar(spark, d):
    x = parts(spark, d)
    return rounded(P.knn(x, x, "brand", ["size", "price"], 3), "distance")


@query(
    f"""WITH {PARTS}, c AS (SELECT q.id AS query_id, p.id, abs(p.price - q.price) AS dist, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((p.price - q.price) * (p.price - q.price)), p.id) AS rank
          FROM parts q JOIN parts p ON p.size = q.size AND p.brand <> q.brand AND p.id <> q.id) SELECT query_id, id, round(dist, 4) AS distance FROM c WHERE rank = 1"""
)
def cross_brand_twin(spark, d):
    x = parts(spark, d)
    return rounded(P.knn(x, x, "size", ["price"], 1, different="brand").drop("rank"), "distance")


_HOLES = "CASE WHEN id % 7 = 0 THEN NULL ELSE size END"


@query(f"WITH {PARTS}, x AS (SELECT id, category, {_HOLES} AS v FROM parts), m AS (SELECT category, median(v) AS m FROM x GROUP BY 1) SELECT id, coalesce(v, m) AS v FROM x JOIN m ON x.category = m.category")
def impute_median(spark, d):
    return P.impute_median(parts(spark, d).select("id", "category", F.expr(_HOLES).alias("v")), "v", "category").select("id", "v")


@query(
    f"""WITH {PARTS}, x AS (SELECT id, brand, price, {_HOLES} AS v FROM parts),
        c AS (SELECT q.id, p.v, row_number() OVER (PARTITION BY q.id ORDER BY sqrt((p.price - q.price) * (p.price - q.price)), p.id) AS rank FROM x q JOIN x p ON p.brand = q.brand AND p.id <> q.id WHERE q.v IS NULL AND p.v IS NOT NULL),
        m AS (SELECT id, avg(v) AS v FROM c WHERE rank <= 5 GROUP BY 1) SELECT x.id, round(coalesce(x.v, m.v), 4) AS v FROM x LEFT JOIN m ON x.id = m.id"""
)
def impute_knn(spark, d):
    return rounded(P.impute_knn(parts(spark, d).select("id", "brand", "price", F.expr(_HOLES).alias("v")), "v", ["price"], "brand").select("id", "v"), "v")


@query(
    """WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem)
       SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r"""
)
def spearman_effect(spark, d):
    return rounded(P.spearman(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice"), "rho", digits=6)


@query(
    f"""WITH {PARTS}, r AS (SELECT brand, price, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2.0 AS r FROM parts), g AS (SELECT sum(r) AS s, count(*) AS n FROM r GROUP BY brand),
        t AS (SELECT sum(CAST(c AS DOUBLE) * c * c - c) AS ties FROM (SELECT count(*) AS c FROM parts GROUP BY price) x), a AS (SELECT sum(s * s / n) AS ss, CAST(sum(n) AS DOUBLE) AS n, count(*) AS k FROM g)
        SELECT k - 1 AS df, round((12.0 / (n * (n + 1)) * ss - 3 * (n + 1)) / (1 - ties / (n * n * n - n)), 4) AS h FROM a, t"""
)
def kruskal_h(spark, d):
    return rounded(P.kruskal(parts(spark, d), "brand", "price"), "h")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS \"s_O\", CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS \"s_P\" FROM orders")
def onehot_dropfirst(spark, d):
    x = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("s"))
    return P.one_hot(x, "s", ["F", "O", "P"]).drop("s")


@query("WITH l AS (SELECT b, CAST(row_number() OVER (ORDER BY b) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand AS b FROM part WHERE p_size > 40) x) SELECT p_partkey, coalesce(code, -1) AS code FROM part LEFT JOIN l ON p_brand = b")
def label_codes(spark, d):
    x = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    return P.label_codes(x, "p_brand", x.where("p_size > 40")).select("p_partkey", "code")


@query(f"WITH {PANEL} SELECT product, period, round(size * quantity, 4) AS size_quantity, round(size * discount, 4) AS size_discount, round(quantity * discount, 4) AS quantity_discount FROM panel")
def interaction_features(spark, d):
    x = P.interactions(panel(spark, d).select("product", "period", "size", "quantity", "discount"), ["size", "quantity", "discount"]).drop("size", "quantity", "discount")
    return rounded(x, "size_quantity", "size_discount", "quantity_discount")


@query(
    f"""WITH {PARTS}, r AS (SELECT id, category, row_number() OVER (PARTITION BY category ORDER BY md5('42|' || id), id) AS k, count(*) OVER (PARTITION BY category) AS n FROM parts)
        SELECT id, category, CASE WHEN k <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part FROM r"""
)
def stratified_split(spark, d):
    return P.split(parts(spark, d).select("id", "category"), "id", 0.2, "category").select("id", "category", "part")


@query(
    f"""WITH {PANEL}, k AS (SELECT product, row_number() OVER (ORDER BY md5('42|' || product), product) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT product FROM panel) x)
        SELECT period, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM panel JOIN k ON panel.product = k.product GROUP BY 1, 2"""
)
def grouped_split(spark, d):
    return P.split(panel(spark, d), "product").groupBy("period", "part").agg(F.count("*").alias("n"))


@query(
    """WITH q AS (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75) AS b FROM lineitem GROUP BY 1)
       SELECT l_returnflag AS flag, count(*) AS n, count(CASE WHEN b > a AND (l_extendedprice < a - 1.5 * (b - a) OR l_extendedprice > b + 1.5 * (b - a)) THEN 1 END) AS n_out FROM lineitem JOIN q ON l_returnflag = f GROUP BY 1"""
)
def iqr_outliers(spark, d):
    x = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_extendedprice").alias("p"))
    return P.iqr_outliers(x, "flag", "p").groupBy("flag").agg(F.count("*").alias("n"), F.count_if("outlier").alias("n_out"))


@query(f"WITH {PANEL} SELECT brand, count(*) AS n, round(regr_slope(ln(price), quantity), 6) AS slope, round(regr_intercept(ln(price), quantity), 6) AS intercept, round(regr_r2(ln(price), quantity), 6) AS r2 FROM panel GROUP BY 1")
def ols_by_brand(spark, d):
    y, x = F.ln("price"), F.col("quantity")
    rows = panel(spark, d).groupBy("brand").agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))
    return rounded(rows, "slope", "intercept", "r2", digits=6)


@query(
    f"""WITH {PANEL}, x AS (SELECT period, ln(price) AS y, avg(ln(price)) OVER (PARTITION BY category) AS e FROM panel)
        SELECT period, count(*) AS n, round(1 - sum((y - e) * (y - e)) / (sum(y * y) - sum(y) * sum(y) / count(*)), 4) AS r2, round(sqrt(avg((y - e) * (y - e))), 4) AS rmse, round(avg(abs(y - e)), 4) AS mae FROM x GROUP BY 1"""
)
def metrics_r2_rmse_mae(spark, d):
    from pyspark.sql import Window

    x = panel(spark, d).withColumn("y", F.ln("price")).withColumn("e", F.avg("y").over(Window.partitionBy("category")))
    return rounded(P.metrics(x, "y", "e", "period"), "r2", "rmse", "mae")


@query(
    """WITH x AS (SELECT vec_id, label AS a, CAST(vec_id % 5 AS INTEGER) AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY 1, 2), t AS (SELECT sum(n * (n - 1) / 2.0) AS s, sum(n) AS n FROM c),
       r AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY a) y), k AS (SELECT sum(n * (n - 1) / 2.0) AS s FROM (SELECT sum(n) AS n FROM c GROUP BY b) y)
       SELECT round((t.s - r.s * k.s / (t.n * (t.n - 1) / 2.0)) / ((r.s + k.s) / 2.0 - r.s * k.s / (t.n * (t.n - 1) / 2.0)), 6) AS ari FROM t, r, k"""
)
def ari_contingency(spark, d):
    x = table(spark, d, "embeddings").select("label", (F.col("vec_id") % 5).alias("b"))
    return rounded(P.rand_index(x, "label", "b"), "ari", digits=6)


@query(f"WITH {PANEL} SELECT category, label, count(*) AS n FROM (SELECT category, 'Cluster ' || period % 3 AS label FROM panel) x GROUP BY 1, 2")
def cluster_labels(spark, d):
    names = spark.createDataFrame([("NO SUCH", 0, "x")], "category string, cluster int, label string")
    x = panel(spark, d).select("category", (F.col("period") % 3).alias("cluster")).join(names, ["category", "cluster"], "left")
    return x.groupBy("category", F.coalesce("label", F.concat(F.lit("Cluster "), F.col("cluster").cast("string"))).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS week, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_week(spark, d):
    x = table(spark, d, "events").groupBy(F.to_date(F.date_trunc("week", "ts")).cast("string").alias("week"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return rounded(x, "total")


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id) AS r FROM events) x WHERE r = 1")
def events_latest_wins(spark, d):
    return latest(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")
