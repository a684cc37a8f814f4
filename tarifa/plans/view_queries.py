"""Queries of report views and selection."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from tarifa.functions import format as fmt
from tarifa.functions import specs as S
from tarifa.operators import panel as P
from tarifa.operators import selection, views
from tarifa.plans.data import PANEL, PARTS, panel, parts, table
from tarifa.plans.panel_queries import rounded

ALL: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        ALL[f.__name__] = (f, sql)
        return f

    return add


_T = f"""{PANEL}, g AS (SELECT category, period, round(exp(avg(ln(price))), 2) AS r, round(avg(price), 2) AS e, count(*) AS n FROM panel GROUP BY 1, 2),
  x AS (SELECT category, period AS t, lead(period) OVER w AS t1, (lead(r) OVER w - r) / r * 100 AS a, (lead(e) OVER w - e) / e * 100 AS b, n AS n0, lead(n) OVER w AS n1 FROM g WINDOW w AS (PARTITION BY category ORDER BY period)),
  y AS (SELECT *, CASE WHEN n0 <> n1 THEN 'effectif' WHEN abs(a) > 3 AND abs(b) > 3 AND a * b < 0 THEN 'prix_et_qualite' WHEN abs(b) > 3 THEN 'qualite' WHEN abs(a) > 3 THEN 'prix' ELSE 'aucune' END AS cause FROM x WHERE t1 IS NOT NULL)"""


def _transitions(spark, d):
    g = panel(spark, d).groupBy("category", "period").agg(F.round(S.geo_mean("price"), 2).alias("r"), F.round(F.avg("price"), 2).alias("e"), F.count("*").alias("n"))
    return P.transitions(g, ["category"], "r", "e", "n")


@query(
    f"""WITH {_T}, c AS (SELECT 'effectif' AS cause UNION ALL SELECT 'aucune' UNION ALL SELECT 'prix' UNION ALL SELECT 'qualite' UNION ALL SELECT 'prix_et_qualite'),
        k AS (SELECT c.cause, count(y.cause) AS n FROM c LEFT JOIN y ON c.cause = y.cause GROUP BY 1) SELECT cause, n, round(n * 100.0 / (SELECT count(*) FROM y), 4) AS share_pct FROM k"""
)
def cause_shares(spark, d):
    return rounded(views.cause_shares(_transitions(spark, d)), "share_pct")


@query(f"WITH {_T} SELECT count(*) AS n, count(CASE WHEN cause NOT IN ('aucune', 'effectif') THEN 1 END) AS n_moved, count(CASE WHEN cause = 'effectif' THEN 1 END) AS n_composition, count(CASE WHEN n0 < 3 OR n1 < 3 THEN 1 END) AS n_limited, round(count(CASE WHEN cause NOT IN ('aucune', 'effectif') THEN 1 END) * 100.0 / count(*), 4) AS moved_pct FROM y")
def transition_kpis(spark, d):
    return rounded(views.transition_kpis(_transitions(spark, d)), "moved_pct")


@query(f"WITH {_T} SELECT category, t, round(a - b, 4) + 0.0 AS gap_pct FROM y ORDER BY abs(a - b) DESC, category, t LIMIT 15")
def notable_cases(spark, d):
    return rounded(views.notable(_transitions(spark, d)).select("category", "t", "gap_pct"), "gap_pct")


@query(
    f"""WITH {PANEL}, e AS (SELECT category, period, 'mean' AS model, avg(abs(price - 30000) / price) AS mape FROM panel GROUP BY 1, 2 UNION ALL SELECT category, period, 'flat', avg(abs(price - 20000) / price) FROM panel GROUP BY 1, 2)
        SELECT category, arg_min(model, mape) AS best FROM e WHERE period = (SELECT max(period) FROM panel) GROUP BY 1"""
)
def best_model(spark, d):
    error = lambda x, name, v: x.groupBy("category", "period").agg(F.avg(F.abs(F.col("price") - v) / F.col("price")).alias("mape")).withColumn("model", F.lit(name))
    x = panel(spark, d)
    return views.best_model(error(x, "mean", 30000).unionByName(error(x, "flat", 20000)), "category")


@query("SELECT p_partkey, round(p_retailprice, 0) > 0 AS positive, element FROM (SELECT p_partkey, p_retailprice, 'c' || p_size % 3 AS element FROM part) x")
def segment_suffix(spark, d):
    key = F.concat_ws("::", "p_brand", "p_type", F.concat(F.lit("c"), (F.col("p_size") % 3).cast("string")))
    return table(spark, d, "part").select("p_partkey", (F.round("p_retailprice", 0) > 0).alias("positive"), F.element_at(F.split(key, "::"), -1).alias("element"))


@query("SELECT p_partkey, replace(p_size || ',5', '-', '') || ' %' AS pct, 'S' || p_size || '→S' || (p_size + 1) AS label FROM part")
def french_format(spark, d):
    x = table(spark, d, "part")
    return x.select("p_partkey", F.replace(fmt.percent(F.col("p_size") + 0.5), F.lit("+"), F.lit("")).alias("pct"), fmt.period_label("p_size", F.col("p_size") + 1).alias("label"))


@query(f"WITH {PARTS} SELECT category, CASE WHEN avg(CASE WHEN price = floor(price) THEN 1.0 ELSE 0.0 END) > 0.9 THEN 1.0 ELSE 0.1 END AS price_step, 1.0 AS size_step FROM parts GROUP BY 1")
def slider_steps(spark, d):
    return parts(spark, d).groupBy("category").agg(fmt.slider_step("price").alias("price_step"), fmt.slider_step("size").alias("size_step"))


_CON, _CAT = ["size", "quantity", "discount"], ["flag", "brand"]


def _effects_sql(source: str, by: list[str], con: list[str], cat: list[str]) -> str:
    """Tables ending in ``w``: by, column, test, n, statistic, p_value, kept, reason; the chi-squared tail by its series."""
    b = "".join(f"{c}, " for c in by)
    group = f'{b}"column"'
    union = [f"SELECT {b}'{c}' AS \"column\", 'spearman' AS test, CAST({c} AS DOUBLE) AS v, CAST(NULL AS VARCHAR) AS label, ln(1 + price) AS y FROM {source} WHERE {c} IS NOT NULL AND price IS NOT NULL" for c in con]
    union += [f"SELECT {b}'{c}', 'kruskal', NULL, CAST({c} AS VARCHAR), ln(1 + price) FROM {source} WHERE {c} IS NOT NULL AND price IS NOT NULL" for c in cat]
    rank = lambda v: f"rank() OVER (PARTITION BY {group} ORDER BY {v}) + (count(*) OVER (PARTITION BY {group}, {v}) - 1) / 2.0"
    return f"""e_l AS ({' UNION ALL '.join(union)}),
      e_k AS (SELECT *, count(*) OVER (PARTITION BY {group}, test, label) AS own, count(*) OVER (PARTITION BY {group}) AS n FROM e_l),
      e_r AS (SELECT *, {rank('y')} AS ry, {rank('v')} AS rv FROM e_k WHERE test = 'spearman' OR own > 1),
      e_s AS (SELECT {group}, 'spearman' AS test, count(*) AS n, coalesce(CASE WHEN NOT isnan(corr(rv, ry)) THEN corr(rv, ry) END, 0) AS statistic, CAST(NULL AS DOUBLE) AS p FROM e_r WHERE test = 'spearman' GROUP BY {group}),
      e_g AS (SELECT {group}, label, sum(ry) AS s, CAST(count(*) AS DOUBLE) AS c FROM e_r WHERE test = 'kruskal' GROUP BY {group}, label),
      e_t AS (SELECT {group}, sum(c * c * c - c) AS ties FROM (SELECT {group}, y, CAST(count(*) AS DOUBLE) AS c FROM e_r WHERE test = 'kruskal' GROUP BY {group}, y) z GROUP BY {group}),
      e_h AS (SELECT {group}, sum(s * s / c) AS ss, sum(c) AS m, count(*) - 1 AS df FROM e_g GROUP BY {group}),
      e_x AS (SELECT {group}, n, df, (12.0 / (m * (m + 1)) * ss - 3 * (m + 1)) / nullif(1 - ties / nullif(m * m * m - m, 0), 0) AS h FROM (SELECT {group}, count(*) AS n FROM e_l WHERE test = 'kruskal' GROUP BY {group}) z LEFT JOIN e_h USING ({group}) LEFT JOIN e_t USING ({group})),
      e_p AS (SELECT {group}, 'kruskal' AS test, n, h, CASE WHEN df >= 1 AND n >= 5 AND h IS NOT NULL THEN CASE WHEN h <= 0 THEN 1.0 WHEN h > 900 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 900), lambda i: exp(-h / 2 + (df / 2.0 + i) * ln(h / 2) - lgamma(df / 2.0 + i + 1))))) END END AS p FROM e_x),
      w AS (SELECT {group}, test, n, statistic, p AS p_value, n >= 5 AND abs(statistic) >= 0.1 AS kept, CASE WHEN n < 5 THEN 'too few rows' WHEN abs(statistic) >= 0.1 THEN 'kept' ELSE 'no effect' END AS reason FROM e_s
        UNION ALL SELECT {group}, test, n, CASE WHEN p IS NULL THEN 0 ELSE h END, p, coalesce(p < 0.05, false), CASE WHEN p < 0.05 THEN 'kept' WHEN p IS NOT NULL THEN 'no effect' ELSE 'too few rows' END FROM e_p)"""


@query(f"""WITH {PANEL}, {_effects_sql('panel', [], _CON, [*_CAT, 'category'])} SELECT "column", test, n, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, kept, reason FROM w""")
def effect_report(spark, d):
    x = panel(spark, d).select("price", "size", "quantity", "discount", "flag", "brand", "category")
    return rounded(selection.effect_table(x, "price", _CON, [*_CAT, "category"]), "statistic", "p_value", digits=6)


@query(f"""WITH {PANEL}, {_effects_sql('panel', ['category'], _CON, _CAT)} SELECT category, "column", test, n, round(statistic, 6) AS statistic, round(p_value, 6) AS p_value, kept, reason FROM w""")
def effects_by_category(spark, d):
    """The effects of all columns in all categories, in one plan."""
    return rounded(selection.effect_table(panel(spark, d), "price", _CON, _CAT, ["category"]), "statistic", "p_value", digits=6)


@query(
    f"""WITH {PANEL}, {_effects_sql('panel', ['category'], _CON, _CAT)}
        SELECT category, CASE WHEN "column" = 'brand' THEN 'marque' ELSE "column" END AS "column", test, n, round(statistic, 6) AS statistic, kept OR "column" = 'brand' AS selected FROM w"""
)
def stable_selection(spark, d):
    """Columns that the preparation of each category keeps: those with an effect on the price, and the brand whatever its effect."""
    from tarifa.operators import prepare

    rows = panel(spark, d).select(F.col("category").alias("categorie"), F.col("price").alias("prix_tnd"), *_CON, "flag", F.col("brand").alias("marque"))
    found = prepare.stable_selection(rows)
    out = [(c, e.column, e.test, e.n, round(float(e.statistic), 6), e.column in kept) for c, (kept, report) in found.items() for e in report]
    return spark.createDataFrame(out, "category string, column string, test string, n long, statistic double, selected boolean")


@query(f"WITH {PANEL} SELECT period, round(covar_pop(ln(price), quantity) / var_pop(quantity), 6) AS slope, count(*) AS n FROM panel GROUP BY 1")
def slope_by_period(spark, d):
    y, x = F.ln("price"), F.col("quantity")
    return rounded(panel(spark, d).groupBy("period").agg(F.regr_slope(y, x).alias("slope"), F.count("*").alias("n")), "slope", digits=6)


@query("SELECT l.quality, l.toxic, count(*) AS n FROM labels l GROUP BY 1, 2")
def label_contingency(spark, d):
    return table(spark, d, "labels").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


_TITLE = "split_part(split_part(html, '<h1>', 2), '</h1>', 1)"
for _code, _char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _TITLE = f"replace({_TITLE}, '{_code}', '{_char}')"


@query(f"SELECT page_id, CASE WHEN strpos(html, '<h1>') > 0 THEN trim({_TITLE}) END AS title FROM pages")
def html_title(spark, d):
    from tarifa.operators.html import product_name

    return table(spark, d, "pages").select("page_id", product_name("html").alias("title"))


@query("SELECT page_id, len(list_distinct(regexp_extract_all(html, '<a href=\"([^\"#]+)\"', 1))) AS n_links FROM pages")
def html_links(spark, d):
    from tarifa.operators.html import product_links

    return table(spark, d, "pages").select("page_id", F.size(product_links("html", "https://site.example")).cast("long").alias("n_links"))
