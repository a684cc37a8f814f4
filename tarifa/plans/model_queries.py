"""Queries over fitted models. Those that SQL can express have an oracle; tests hold the others against NumPy."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.functions import sql
from tarifa.functions.specs import geo_mean
from tarifa.operators import forest, forests, regression, segments
from tarifa.operators.design import DesignSpec
from tarifa.operators.features import PriceFeatures, PriceFeaturesModel
from tarifa.operators.panel import interactions, split, tiers
from tarifa.plans import linear_sql as L
from tarifa.plans.data import PANEL, PARTS, panel, parts, table
from tarifa.sources.scratch import shared_dir, written

ALL: dict[str, tuple[Callable, str | None]] = {}
FEATURES = ["size", "quantity", "discount"]

# The levels that the generated tables have, for the SQL of designs; the operators find them in the data.
CATEGORIES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
FLAGS, PERIODS = ["A", "N", "R"], list(range(1995, 2002))
BRANDS = sorted(f"Brand#{i}" for i in range(1, 26))
_X = [(f, f) for f in FEATURES]
_CATEGORY, _FLAG, _PERIOD, _BRAND = L.dummies("category", CATEGORIES), L.dummies("flag", FLAGS), L.dummies("period", PERIODS), L.dummies("brand", BRANDS)
_NAMES = lambda terms: {n for n, _ in terms}
_R2 = lambda tag, k: f"(1 - ({tag}.ssr / ({tag}.n - {k})) / (({tag}.syy - {tag}.sy * {tag}.sy / {tag}.n) / ({tag}.n - 1)))"


def query(oracle: str | None = None):
    def add(f: Callable) -> Callable:
        ALL[f.__name__] = (f, oracle)
        return f

    return add


def _frame(spark, pdf: pd.DataFrame, schema: str) -> DataFrame:
    """A small driver-side result table."""
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), schema)


def _rows(spark, d) -> DataFrame:
    """The panel with its log price, written once: fits pass over it several times."""
    return written(panel(spark, d).withColumn("y", F.ln("price")), "panel")


def _coefficients(spark, model) -> DataFrame:
    rows = _frame(spark, model.coefficients(), "feature string, coefficient double, std_err double, p_value double, pct_effect double")
    return rows.select("feature", *[F.round(c, k).alias(c) for c, k in (("coefficient", 6), ("std_err", 6), ("p_value", 4), ("pct_effect", 4))])


_ROBUST = [*_X, *_CATEGORY, *_FLAG]


@query(f"WITH {PANEL}, {L.fit('o', 'panel', _ROBUST, 'ln(price)')}, {L.hc3('o', 11)}, {L.coefficients('o', _ROBUST, _NAMES(_CATEGORY + _FLAG))}")
def ols_robust(spark, d):
    x = _rows(spark, d)
    return _coefficients(spark, regression.ols(x, DesignSpec.fit(x, FEATURES, ["category", "flag"]), F.col("y")))


@query(
    f"""WITH {PANEL}, m AS (SELECT regr_slope(ln(price), quantity) AS b, regr_intercept(ln(price), quantity) AS a, regr_r2(ln(price), quantity) AS r2, count(*) AS n FROM panel)
        SELECT 'const' AS feature, round(a, 6) AS coefficient, round(r2, 6) AS r2, n FROM m UNION ALL SELECT 'quantity', round(b, 6), round(r2, 6), n FROM m"""
)
def ols_gram(spark, d):
    x = _rows(spark, d)
    m = regression.ols(x, DesignSpec.fit(x, ["quantity"], []), F.col("y"), "nonrobust")
    rows = [(n, round(float(b), 6), round(m.r2, 6), m.n) for n, b in zip(m.names, m.beta)]
    return spark.createDataFrame(rows, "feature string, coefficient double, r2 double, n long")


_POOLED = [*_X, *_CATEGORY, *_PERIOD]
#: Small-sample factor of the clustered covariance.
_FEW = lambda p: f"groups / (groups - 1.0) * (n - 1.0) / (n - {p})"


@query(f"WITH {PANEL}, {L.fit('o', 'panel', _POOLED, 'ln(price)')}, {L.clustered('o', 15, 'product')}, {L.coefficients('o', _POOLED, _NAMES(_CATEGORY + _PERIOD), _FEW(15))}")
def ols_clustered(spark, d):
    x = _rows(spark, d)
    return _coefficients(spark, regression.ols(x, DesignSpec.fit(x, FEATURES, ["category", "period"]), F.col("y"), cluster="product"))


_SMALL = [("size", "size"), ("quantity", "quantity"), *_FLAG]
_LARGE = [*_SMALL, *[(f"{c}_x_{v}", f"{c} * CASE WHEN flag = '{v}' THEN 1.0 ELSE 0.0 END") for v in FLAGS[1:] for c in ("size", "quantity")]]


@query(
    f"""WITH {PANEL}, {L.fit('a', 'panel', _SMALL, 'ln(price)')}, {L.fit('b', 'panel', _LARGE, 'ln(price)')}
        SELECT round((a.ssr - b.ssr) / 4 / (b.ssr / (b.n - 9)), 4) AS f, CAST(4 AS BIGINT) AS df_num, b.n - 9 AS df_den, round({_R2('a', 5)}, 6) AS adj_r2_common, round({_R2('b', 9)}, 6) AS adj_r2_separate FROM a, b"""
)
def chow_test(spark, d):
    found = regression.chow(_rows(spark, d), ["size", "quantity"], "flag", F.col("y"))
    rows = _frame(spark, pd.DataFrame([found]), "f double, df_num long, df_den long, p_value double, adj_r2_common double, adj_r2_separate double")
    return rows.select(F.round("f", 4).alias("f"), "df_num", "df_den", F.round("adj_r2_common", 6).alias("adj_r2_common"), F.round("adj_r2_separate", 6).alias("adj_r2_separate"))


_VIF = [*_X, *_FLAG]


@query(
    f"""WITH {PANEL}, {L.fit('o', 'panel', _VIF, '0.0')}, t AS (SELECT [{', '.join(f'sum(x[{i}] * x[{i}]) - sum(x[{i}]) * sum(x[{i}]) / count(*)' for i in range(2, 7))}] AS tss FROM o_x)
        SELECT unnest([{', '.join(repr(n) for n, _ in _VIF)}]) AS feature, round(unnest(list_transform(tss, lambda v, i: v * inv[i + 1][i + 1])), 6) AS vif FROM o, t"""
)
def vif_table(spark, d):
    x = _rows(spark, d)
    return _frame(spark, regression.vif(x, DesignSpec.fit(x, FEATURES, ["flag"])), "feature string, vif double").select("feature", F.round("vif", 6).alias("vif"))


_OLS = L.fit("o", "panel", _X, "ln(price)")
_AUX = L.fit("w", "(SELECT size, quantity, discount, y - list_dot_product(x, beta) AS e FROM o, o_x) z", L.products(_X), "e * e")


@query(
    f"""WITH {PANEL}, {_OLS}, {_AUX}, r AS (SELECT n, 1 - ssr / (syy - sy * sy / n) AS r2 FROM w)
        SELECT round(n * r2, 4) AS lm, round(r2 / 9 / ((1 - r2) / (n - 10)), 5) AS f, CAST(9 AS BIGINT) AS df FROM r"""
)
def white_test(spark, d):
    x = _rows(spark, d)
    m = regression.ols(x, DesignSpec.fit(x, FEATURES, []), F.col("y"))
    rows = _frame(spark, pd.DataFrame([regression.white(x, m, F.col("y"))]), "lm double, lm_p_value double, f double, df long")
    return rows.select(F.round("lm", 4).alias("lm"), F.round("f", 5).alias("f"), "df")


@query(
    f"""WITH {PANEL}, {_OLS}, r AS (SELECT product, period, o.n, ssr / (o.n - 4) AS s2, y - list_dot_product(x, beta) AS e, list_dot_product(x, list_transform(inv, lambda r: list_dot_product(r, x))) AS h FROM o, o_x)
        SELECT product, period, round(e * e * h / (4 * s2 * (1 - h) * (1 - h)), 8) AS cook, e * e * h / (4 * s2 * (1 - h) * (1 - h)) > 4.0 / n AS influential FROM r"""
)
def cook_influence(spark, d):
    x = _rows(spark, d)
    m = regression.ols(x, DesignSpec.fit(x, FEATURES, []), F.col("y"))
    return regression.cook(x, m, F.col("y")).select("product", "period", F.round("cook", 8).alias("cook"), "influential")


_CROSSED = [*_X, ("size_quantity", "size * quantity"), ("size_discount", "size * discount"), ("quantity_discount", "quantity * discount")]


@query(
    f"""WITH {PANEL}, {L.ridge('r', 'panel', _CROSSED, 'ln(price)', 'product', regression.ALPHAS)}
        SELECT unnest([{', '.join(repr(n) for n, _ in _CROSSED)}]) AS feature, round(unnest(b), 6) AS coefficient, alpha FROM r"""
)
def ridge_cv(spark, d):
    x = interactions(_rows(spark, d), FEATURES)
    spec = DesignSpec.fit(x, [*FEATURES, "size_quantity", "size_discount", "quantity_discount"], [])
    m = regression.ridge(x, spec, F.col("y"), "product")
    return spark.createDataFrame([(n, round(float(b), 6), m.alpha) for n, b in zip(spec.names, m.coefficients)], "feature string, coefficient double, alpha double")


@query()
def forest_importance(spark, d):
    x = _rows(spark, d).select("product", *FEATURES, "y")
    m = forest.fit(x, FEATURES, "y", "product", trees=(20,), depths=(5,))
    return _frame(spark, forest.importances(m, FEATURES), "feature string, importance double")


_INDEX = [("quantity", "quantity"), *_CATEGORY, *_PERIOD]
_INDEX_SQL = f"""WITH {PANEL}, {L.fit('o', 'panel', _INDEX, 'ln(price)')}, {L.clustered('o', 13, 'product')},
  i AS (SELECT unnest(['period_1995', {', '.join(repr(n) for n, _ in _PERIOD)}]) AS f, unnest([0.0, {', '.join(f'beta[{8 + k}]' for k in range(6))}]) AS b, unnest([NULL, {', '.join(f'sqrt(var[{8 + k}] * {_FEW(13)})' for k in range(6))}]) AS se FROM o, o_v)
SELECT f[8:] AS period, se IS NULL AS reference, round((exp(b) - 1) * 100, 6) AS index_pct, round({L.normal_tail('b / se')}, 4) AS p_value FROM i"""


@query(_INDEX_SQL)
def price_index(spark, d):
    t = regression.price_index(_rows(spark, d), ["quantity"], ["category"], "period", F.col("y"), "product")
    rows = _frame(spark, t, "period string, reference boolean, index_pct double, p_value double")
    return rows.select("period", "reference", F.round("index_pct", 6).alias("index_pct"), F.round("p_value", 4).alias("p_value"))


_TIERS = """q AS (SELECT brand, count(*) AS k, quantile_cont(price, 1 / 3) AS a, quantile_cont(price, 2 / 3) AS b, quantile_cont(price, 0.5) AS h, min(price) AS lo, max(price) AS hi FROM parts GROUP BY brand),
t AS (SELECT p.*, CASE WHEN k >= 15 THEN CASE WHEN price <= a THEN 'Économique' WHEN price <= b THEN 'Milieu de gamme' ELSE 'Premium' END
        WHEN k >= 10 THEN CASE WHEN price <= h THEN 'Économique' ELSE 'Premium' END ELSE 'Gamme unique' END AS tier FROM parts p JOIN q USING (brand) WHERE k >= 5)"""


@query(
    f"""WITH {PARTS}, {_TIERS}, {L.fit('o', 't', [('size', 'size'), *_BRAND], 'ln(price)')},
        e AS (SELECT brand, avg(CASE WHEN tier = 'Économique' THEN exp(list_dot_product(x, beta)) END) AS low, avg(CASE WHEN tier = 'Milieu de gamme' THEN exp(list_dot_product(x, beta)) END) AS middle,
              avg(CASE WHEN tier = 'Premium' THEN exp(list_dot_product(x, beta)) END) AS high FROM o, o_x GROUP BY brand)
        SELECT brand, round(low, 4) AS low, round(middle, 4) AS middle, round(high, 4) AS high, coalesce(low <= middle, true) AND coalesce(middle <= high, true) AND coalesce(low <= high, true) AS monotone FROM e"""
)
def tier_monotonicity(spark, d):
    x = tiers(parts(spark, d)).withColumn("y", F.ln("price"))
    m = regression.ols(x, DesignSpec.fit(x, ["size"], ["brand"]), F.col("y"))
    means = x.groupBy("brand").pivot("tier", ["Économique", "Milieu de gamme", "Premium"]).agg(F.avg(F.exp(m.predict()))).toDF("brand", "low", "middle", "high")
    rises = F.coalesce(F.col("low") <= F.col("middle"), F.lit(True)) & F.coalesce(F.col("middle") <= F.col("high"), F.lit(True)) & F.coalesce(F.col("low") <= F.col("high"), F.lit(True))
    return means.withColumn("monotone", rises).select("brand", *[F.round(c, 4).alias(c) for c in ("low", "middle", "high")], "monotone")


@query()
def cluster_units(spark, d):
    return segments.cluster_units(tiers(parts(spark, d)), ["brand", "tier"], ["size"], categorical=["category"])


@query()
def k_justification(spark, d):
    """The numbers of clusters tried for each brand and tier (n2) and for each category as a whole (n1)."""
    x = tiers(parts(spark, d))
    fine = segments.k_trace(x, ["brand", "tier"], ["size"], categorical=["category"]).select(F.lit("n2").alias("level"), F.concat_ws("::", "brand", "tier").alias("unit"), "k", "n_clusters", "least_size", "silhouette", "valid", "inertia", "chosen")
    coarse = segments.k_trace(x, ["category"], ["size"]).select(F.lit("n1").alias("level"), F.col("category").alias("unit"), "k", "n_clusters", "least_size", "silhouette", "valid", "inertia", "chosen")
    return fine.union(coarse)


@query()
def k_trace_in_sql(spark, d):
    """The trace as a table function of the session's SQL."""
    sql.register(spark)
    tiers(parts(spark, d)).createOrReplaceTempView("units_of_parts")
    return spark.sql("SELECT * FROM k_trace(TABLE(SELECT brand, tier, xxhash64(id) AS h, array(size) AS features FROM units_of_parts) PARTITION BY (brand, tier))")


@query(
    """SELECT l_orderkey, l_linenumber, round((l_extendedprice - l_quantity) / nullif(l_quantity, 0) * 100, 4) AS change, CASE WHEN l_discount * 100 > 5 THEN 'hausse' WHEN l_discount * 100 < -5 THEN 'baisse' ELSE 'stable' END AS way,
         round((exp(l_discount) - 1) * 100, 6) AS effect, regexp_replace(l_returnflag || ' ' || l_linestatus, '[^a-zA-Z0-9_-]+', '_', 'g') AS name FROM lineitem"""
)
def sql_functions(spark, d):
    """The scalar builders as SQL functions of the session."""
    sql.register(spark)
    table(spark, d, "lineitem").createOrReplaceTempView("lineitem_of_functions")
    return spark.sql(
        """SELECT l_orderkey, l_linenumber, round(pct_change(l_quantity, l_extendedprice), 4) AS change, direction(l_discount * 100, 5D) AS way,
             round(effect_pct(l_discount, true), 6) AS effect, safe_name(concat(l_returnflag, ' ', l_linestatus)) AS name FROM lineitem_of_functions"""
    )


@query(f"""WITH {PANEL} SELECT product, period, round(ln(price), 6) AS log_price, round(size * quantity, 4) AS size_quantity, true AS same_cluster FROM panel""")
def final_features(spark, d):
    """The fitted transform, saved and loaded again: log price, interactions, and whether its clusters are still the same."""
    x = written(panel(spark, d).select("product", "period", "price", "size", "quantity"), "panel")
    model = PriceFeatures(features=["size", "quantity"], price="price", logPrice="log_price").fit(x)
    path = f"{shared_dir(spark)}/features-{uuid.uuid4().hex}"
    model.write().save(path)
    again = PriceFeaturesModel.load(path).transform(model.transform(x).withColumnRenamed("cluster", "before").withColumn("price", F.exp("log_price")).drop("size_quantity", "log_price"))
    return again.select("product", "period", F.round("log_price", 6).alias("log_price"), F.round("size_quantity", 4).alias("size_quantity"), (F.col("cluster") == F.col("before")).alias("same_cluster"))


@query()
def cluster_stability(spark, d):
    return segments.stability(tiers(parts(spark, d)), ["brand", "tier"], ["size"], categorical=["category"])


#: Replicates of the query; the operator's default is 1,000.
_DRAWS = 200
_WEIGHT = f"""(SELECT *, {' + '.join(f'CAST((s1 + r * s2) % 2147483647 >= {c} AS INTEGER)' for c in segments.POISSON)} AS w FROM s, (SELECT unnest(range({_DRAWS})) AS r))"""


@query(
    f"""WITH {PANEL}, {L.fit('o', 'panel', [('quantity', 'quantity')], 'ln(price)')},
        e AS (SELECT category, period, product, price AS real, exp(list_dot_product(x, beta)) AS estimated FROM o, o_x),
        n AS (SELECT category, period, lead(period) OVER w AS next, lag(period) OVER w AS prior FROM (SELECT DISTINCT category, period FROM panel) WINDOW w AS (PARTITION BY category ORDER BY period)),
        b AS (SELECT e.category, e.period AS t, 0 AS side, product, real, estimated FROM e JOIN n USING (category, period) WHERE next IS NOT NULL
              UNION ALL SELECT e.category, prior, 1, product, real, estimated FROM e JOIN n USING (category, period) WHERE prior IS NOT NULL),
        h AS (SELECT *, md5(concat_ws('|', 'gap', CAST(category AS VARCHAR), CAST(t AS VARCHAR), CAST(side AS VARCHAR), CAST(product AS VARCHAR))) AS h FROM b),
        s AS (SELECT *, CAST('0x' || h[:8] AS BIGINT) % 2147483647 AS s1, 1 + CAST('0x' || h[9:16] AS BIGINT) % 2147483646 AS s2 FROM h),
        m AS (SELECT category, t, side, r, sum(w * ln(real)) / nullif(sum(w), 0) AS a, sum(w * ln(estimated)) / nullif(sum(w), 0) AS b FROM {_WEIGHT} GROUP BY 1, 2, 3, 4),
        g AS (SELECT x.category, x.t, (exp(y.a - x.a) - exp(y.b - x.b)) * 100 AS gap FROM m x JOIN m y ON x.category = y.category AND x.t = y.t AND x.r = y.r AND x.side = 0 AND y.side = 1),
        k AS (SELECT category, t, least(count_if(side = 0), count_if(side = 1)) AS least_n FROM b GROUP BY 1, 2),
        q AS (SELECT category, t, quantile_cont(gap, 0.025) AS low, quantile_cont(gap, 0.975) AS high, avg(CAST(gap >= 0 AS INTEGER)) AS above FROM g GROUP BY 1, 2),
        v AS (SELECT k.category, k.t, CASE WHEN least_n >= 2 THEN round(low, 2) END AS low, CASE WHEN least_n >= 2 THEN round(high, 2) END AS high,
              CASE WHEN least_n >= 2 THEN round(least(1.0, 2 * least(above, 1 - above)), 4) END AS p_value FROM k LEFT JOIN q ON k.category = q.category AND k.t = q.t)
        SELECT *, coalesce((low > 0 OR high < 0) AND p_value < 0.05, false) AS significant FROM v"""
)
def bootstrap_gap(spark, d):
    x = _rows(spark, d)
    m = regression.ols(x, DesignSpec.fit(x, ["quantity"], []), F.col("y"))
    rows = x.select("category", "period", "product", F.col("price").alias("real"), F.exp(m.predict()).alias("estimated"))
    return segments.bootstrap_gap(segments.sides(rows, ["category"]), ["category", "t"], "product", _DRAWS)


def _segmented(spark, d):
    x = written(split(_rows(spark, d).select("product", "brand", "category", "quantity", "size", "y"), "product"), "segmented")
    m = regression.ols(x.where("part = 'train'"), DesignSpec.fit(x, ["quantity"], []), F.col("y"))
    return x.withColumn("estimate", m.predict())


_SPLIT = """k AS (SELECT DISTINCT product FROM panel), o AS (SELECT product, row_number() OVER (ORDER BY md5('42|' || product), product) AS place, count(*) OVER () AS size FROM k),
s AS (SELECT panel.*, CASE WHEN place <= ceil(o.size * 0.2) THEN 'test' ELSE 'train' END AS part FROM panel JOIN o USING (product))"""
_BOTH = [("quantity", "quantity"), ("size", "size")]


@query(
    f"""WITH {PANEL}, {_SPLIT}, tr AS (SELECT * FROM s WHERE part = 'train'), {L.fit('c', 'tr', [('quantity', 'quantity')], 'ln(price)')}, {L.fit('b', 'tr', _BOTH, 'ln(price)', 'brand')},
        t AS (SELECT s.brand, ln(price) AS y, list_dot_product([1.0, quantity, size]::DOUBLE[], b.beta) AS e, list_dot_product([1.0, quantity]::DOUBLE[], c.beta) AS g FROM s JOIN b ON s.brand = b.brand, c WHERE part = 'test'),
        r AS (SELECT brand, 1 - sum((y - e) * (y - e)) / (var_pop(y) * count(*)) AS r2, 1 - sum((y - g) * (y - g)) / (var_pop(y) * count(*)) AS r2_category FROM t GROUP BY brand HAVING count(*) > 1 AND var_pop(y) * count(*) > 1e-12)
        SELECT b.brand, m.n, round(beta[2], 6) AS quantity, round(beta[3], 6) AS size, round(r2, 6) AS r2, round(r2_category, 6) AS r2_category, coalesce(r2 > r2_category, false) AS kept FROM b LEFT JOIN r ON b.brand = r.brand
          JOIN (SELECT brand, count(*) AS n FROM panel GROUP BY brand) m ON b.brand = m.brand WHERE b.n >= 20"""
)
def segment_hedonic(spark, d):
    found = segments.segment_models(_segmented(spark, d), "brand", ["quantity", "size"], "y", "estimate", families=("hedonic",)).where("fitted")
    slopes = [F.round(F.col("coefficients")[c], 6).alias(c) for c in ("quantity", "size")]
    return found.select("brand", "n", *slopes, F.round("r2", 6).alias("r2"), F.round("r2_category", 6).alias("r2_category"), "kept")


@query()
def segment_models(spark, d):
    return segments.segment_models(_segmented(spark, d), "brand", ["quantity", "size"], "y", "estimate", families=("hedonic", "ridge")).drop("coefficients", "intercept")


#: The forests whose growth SQL repeats: trees, depth, bins.
_SMALL = (6, 3, 8)


def _forest_sql() -> str:
    """Tables ending in ``f_n``: the nodes of small forests of the brands' training rows, a level after the other."""
    trees, depth, bins = _SMALL
    weight = " + ".join(f"CAST(u >= {c} AS INTEGER)" for c in segments.POISSON)
    out = f"""tr AS (SELECT brand, product, quantity, CAST(size AS DOUBLE) AS size, ln(price) AS y, md5('forest|' || product) AS h FROM s WHERE part = 'train'),
      f_v AS (SELECT brand, unnest([0, 1]) AS f, unnest([quantity, size]) AS v FROM tr), f_o AS (SELECT *, row_number() OVER (PARTITION BY brand, f ORDER BY v) AS place, count(*) OVER (PARTITION BY brand, f) AS n FROM f_v),
      f_c AS (SELECT brand, f, list_sort(list_distinct(list(v))) AS cuts FROM f_o, (SELECT unnest(range(1, {bins})) AS i) WHERE place = greatest(1, ceil(n * i / {bins}.0)) GROUP BY brand, f),
      f_b AS (SELECT tr.brand, y, len(list_filter(a.cuts, lambda c: c < quantity)) AS b0, len(list_filter(b.cuts, lambda c: c < size)) AS b1, CAST('0x' || h[:8] AS BIGINT) % 2147483647 AS s1, 1 + CAST('0x' || h[9:16] AS BIGINT) % 2147483646 AS s2
        FROM tr JOIN f_c a ON a.brand = tr.brand AND a.f = 0 JOIN f_c b ON b.brand = tr.brand AND b.f = 1),
      f_u AS (SELECT brand, y, b0, b1, tree, (s1 + tree * s2) % 2147483647 AS u FROM f_b, (SELECT unnest(range(1, {trees + 1})) AS tree)),
      s0 AS (SELECT * FROM (SELECT brand, tree, 1 AS node, {weight} AS w, y, b0, b1 FROM f_u) WHERE w > 0)"""
    for k in range(depth + 1):
        split = "gain > 1e-9" if k < depth else "false"
        out += f""", c{k} AS (SELECT brand, tree, node, f, bin, sum(w) AS w, sum(wy) AS wy FROM (SELECT brand, tree, node, w, w * y AS wy, unnest([0, 1]) AS f, unnest([b0, b1]) AS bin FROM s{k}) GROUP BY brand, tree, node, f, bin),
          a{k} AS (SELECT brand, tree, node, f, bin, sum(w) OVER q AS lw, sum(wy) OVER q AS ly, sum(w) OVER z AS w, sum(wy) OVER z AS wy FROM c{k} WINDOW z AS (PARTITION BY brand, tree, node, f), q AS (PARTITION BY brand, tree, node, f ORDER BY bin ROWS UNBOUNDED PRECEDING)),
          g{k} AS (SELECT *, CASE WHEN w > lw THEN round(ly * ly / lw + (wy - ly) * (wy - ly) / nullif(w - lw, 0) - wy * wy / w, 9) END AS gain FROM a{k}),
          p{k} AS (SELECT brand, tree, node, w AS n, wy / w AS mean, CASE WHEN {split} THEN f END AS f, CASE WHEN {split} THEN bin END AS bin FROM (SELECT *, row_number() OVER (PARTITION BY brand, tree, node ORDER BY gain DESC NULLS LAST, f, bin) AS r FROM g{k}) WHERE r = 1),
          s{k + 1} AS (SELECT x.brand, x.tree, x.node * 2 + CAST(CASE WHEN f = 0 THEN b0 ELSE b1 END > bin AS INTEGER) AS node, w, y, b0, b1 FROM s{k} x JOIN p{k} USING (brand, tree, node) WHERE f IS NOT NULL)"""
    every = " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(depth + 1))
    return out + f", f_n AS (SELECT p.brand, tree, node, n, mean, p.f, cuts[bin + 1] AS threshold FROM ({every}) p LEFT JOIN f_c ON f_c.brand = p.brand AND f_c.f = p.f)"


def _walk_sql() -> str:
    """``f_e``: what the trees say on average of each test row."""
    steps = "w0 AS (SELECT s.brand, product, s.quantity, CAST(size AS DOUBLE) AS size, ln(price) AS y, id, tree, 1 AS node FROM (SELECT *, row_number() OVER () AS id FROM s WHERE part = 'test') s JOIN (SELECT DISTINCT brand, tree FROM f_n) t ON s.brand = t.brand)"
    for k in range(_SMALL[1]):
        steps += f", w{k + 1} AS (SELECT w.* EXCLUDE (node), CASE WHEN f IS NULL THEN w.node ELSE 2 * w.node + CAST(CASE WHEN f = 0 THEN quantity ELSE size END > threshold AS INTEGER) END AS node FROM w{k} w JOIN f_n USING (brand, tree, node))"
    return steps + f", f_e AS (SELECT w.id, w.brand, any_value(y) AS y, avg(mean) AS e FROM w{_SMALL[1]} w JOIN f_n USING (brand, tree, node) GROUP BY w.id, w.brand)"


def _small_forest(spark, d):
    x = _segmented(spark, d)
    return x, forests.fit(x.where("part = 'train'"), "brand", ["quantity", "size"], "y", "product", *_SMALL)


@query(f"WITH {PANEL}, {_SPLIT}, {_forest_sql()} SELECT brand, tree, node, CAST(n AS BIGINT) AS n, CAST(f AS INTEGER) AS feature, round(threshold, 6) AS threshold, round(mean, 6) AS mean FROM f_n")
def forest_nodes(spark, d):
    """Forests of all brands, grown a level at a time."""
    _, nodes = _small_forest(spark, d)
    return nodes.select(F.col("segment").alias("brand"), "tree", "node", "n", "feature", F.round("threshold", 6).alias("threshold"), F.round("mean", 6).alias("mean"))


@query(f"WITH {PANEL}, {_SPLIT}, {_forest_sql()}, {_walk_sql()} SELECT brand, count(*) AS n, round(avg(abs(y - e)), 6) AS mae, round(sum(e), 4) AS total FROM f_e GROUP BY brand")
def forest_scores(spark, d):
    """Test rows scored by the retained nodes."""
    x, nodes = _small_forest(spark, d)
    scored = forests.estimate(x.where("part = 'test'"), nodes, "brand", ["quantity", "size"], "e").withColumn("e", F.col("e")[0]).where("e IS NOT NULL")
    return scored.groupBy("brand").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("e"))), 6).alias("mae"), F.round(F.sum("e"), 4).alias("total"))


@query()
def segment_forests(spark, d):
    return segments.segment_models(_segmented(spark, d), "brand", ["quantity", "size"], "y", "estimate", families=("random_forest",)).drop("coefficients", "intercept")


@query()
def segment_forest_grid(spark, d):
    """Each brand's forest of the grid by grouped folds; the grid's forests are prefixes of one."""
    grid = tuple((t, k) for t in (20, 50) for k in (3, 6))
    return segments.segment_forests(_segmented(spark, d), "brand", ["quantity", "size"], "y", "estimate", grid=grid)[0].drop("coefficients", "intercept")


@query()
def scoring_cascade(spark, d):
    """Each family's cascade: kept models of the brand, else of the category, else the category's own estimate."""
    x = _segmented(spark, d)
    out = None
    for family in ("hedonic", "ridge", "random_forest"):
        if family == "random_forest":
            (fine, fine_nodes), (coarse, coarse_nodes) = (segments.segment_forests(x, s, ["quantity", "size"], "y", "estimate") for s in ("brand", "category"))
        else:
            fine, coarse = (segments.segment_models(x, s, ["quantity", "size"], "y", "estimate", families=(family,)) for s in ("brand", "category"))
            fine_nodes = coarse_nodes = None
        scored = segments.score_cascade(x, fine, coarse, "brand", "category", ["quantity", "size"], "estimate", fine_nodes, coarse_nodes)
        part = scored.groupBy("source").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("scored"))), 6).alias("mae")).withColumn("family", F.lit(family))
        out = part if out is None else out.unionByName(part)
    return out


_WEEKLY = [*_X, *_CATEGORY]


@query(
    f"""WITH {PANEL}, {L.fit('o', 'panel', _WEEKLY, 'ln(price)')}, e AS (SELECT category, period, price, exp(list_dot_product(x, beta)) AS estimate FROM o, o_x),
        w AS (SELECT category, period, count(*) AS n, exp(avg(ln(price))) AS r, exp(avg(ln(estimate))) AS m, avg(abs(estimate - price) / price * 100) AS mape FROM e GROUP BY category, period)
        SELECT category, period, n, round(r, 4) AS real, round(m, 4) AS estimated, round((m - r) / r * 100, 4) AS error_pct, round(mape, 4) AS mape_pct FROM w"""
)
def weekly_estimates(spark, d):
    x = _rows(spark, d)
    m = regression.ols(x, DesignSpec.fit(x, FEATURES, ["category"]), F.col("y"))
    x = x.withColumn("estimate", F.exp(m.predict()))
    real, made = geo_mean("price"), geo_mean("estimate")
    off = F.avg(F.abs(F.col("estimate") - F.col("price")) / F.col("price") * 100)
    return x.groupBy("category", "period").agg(F.count("*").alias("n"), F.round(real, 4).alias("real"), F.round(made, 4).alias("estimated"), F.round((made - real) / real * 100, 4).alias("error_pct"), F.round(off, 4).alias("mape_pct"))


@query(
    f"""WITH {PANEL}, {PARTS}, {L.fit('o', 'panel', _WEEKLY, 'ln(price)')},
        w AS (SELECT product, CAST([1.0, size, 10.0, 0.05, {', '.join(e for _, e in _CATEGORY)}] AS DOUBLE[]) AS x FROM parts),
        i AS (SELECT product, list_dot_product(x, beta) AS y, {L.t_quantile_975('(n - 9)')} * sqrt(ssr / (n - 9) * (1 + list_dot_product(x, list_transform(inv, lambda r: list_dot_product(r, x))))) AS half FROM o, w)
        SELECT product, round(exp(y), 1) AS price, round(exp(y - half), 1) AS low, round(exp(y + half), 1) AS high FROM i"""
)
def predict_interval(spark, d):
    x = _rows(spark, d)
    m = regression.ols(x, DesignSpec.fit(x, FEATURES, ["category"]), F.col("y"))
    new = parts(spark, d).select("product", "category", "size", F.lit(10.0).alias("quantity"), F.lit(0.05).alias("discount"))
    y, half = m.predict(), m.interval()
    return new.select("product", F.round(F.exp(y), 1).alias("price"), F.round(F.exp(y - half), 1).alias("low"), F.round(F.exp(y + half), 1).alias("high"))


@query(
    """WITH e AS (SELECT vec_id, embedding[1] AS x, embedding[2] AS y FROM embeddings), c AS (SELECT 0 AS c, 0.1 AS a, 0.1 AS b UNION ALL SELECT 1, -0.1, 0.1 UNION ALL SELECT 2, 0.0, -0.1)
       SELECT vec_id, CAST(c AS INTEGER) AS cluster FROM (SELECT vec_id, c, row_number() OVER (PARTITION BY vec_id ORDER BY (x - a) * (x - a) + (y - b) * (y - b), c) AS r FROM e, c) z WHERE r = 1"""
)
def kmeans_assign(spark, d):
    centres = [(0.1, 0.1), (-0.1, 0.1), (0.0, -0.1)]
    e = F.transform("embedding", lambda v: v.cast("double"))
    gaps = [F.struct((F.pow(e[0] - a, F.lit(2.0)) + F.pow(e[1] - b, F.lit(2.0))).alias("d"), F.lit(i).alias("c")) for i, (a, b) in enumerate(centres)]
    return table(spark, d, "embeddings").select("vec_id", F.least(*gaps)["c"].alias("cluster"))


@query()
def pca_projection(spark, d):
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = table(spark, d, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    p = PCA(k=2, inputCol="v", outputCol="p").fit(x).transform(x).withColumn("a", vector_to_array("p"))
    return p.select("vec_id", F.round(F.abs(F.col("a")[0]), 6).alias("first"), F.round(F.abs(F.col("a")[1]), 6).alias("second"))
