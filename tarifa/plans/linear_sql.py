"""Least squares in DuckDB SQL: the oracle of the regression queries.

The Gram matrix is a row of sums; it is inverted by Gauss-Jordan elimination, a common table expression per pivot. Terms
are given as (name, SQL expression) and the constant is added as the first.
"""

from __future__ import annotations

from collections.abc import Sequence

Term = tuple[str, str]


def dummies(column: str, levels: Sequence[object]) -> list[Term]:
    """0/1 terms of all levels but the first."""
    text = lambda v: f"'{v}'" if isinstance(v, str) else str(v)
    return [(f"{column}_{v}", f"CASE WHEN {column} = {text(v)} THEN 1.0 ELSE 0.0 END") for v in levels[1:]]


def products(terms: Sequence[Term]) -> list[Term]:
    """All squares and products of the terms and the constant but for the constant itself."""
    every = [("const", "1.0"), *terms]
    return [(f"{a}*{b}", f"({x}) * ({y})") for i, (a, x) in enumerate(every) for b, y in every[i:]][1:]


def fit(tag: str, source: str, terms: Sequence[Term], y: str, by: str = "") -> str:
    """CTEs ``{tag}_x`` (the rows with x and y), ``{tag}`` (n, sy, syy, xy, inv, beta, ssr; a row per value of ``by``)."""
    p = len(terms) + 1
    key, group = (f"{by}, ", f" GROUP BY {by}") if by else ("", "")
    x = ", ".join(["1.0", *(e for _, e in terms)])
    gram = ", ".join("[" + ", ".join([f"sum(x[{i}] * x[{j}])" for j in range(1, p + 1)] + ["1.0" if i == j else "0.0" for j in range(1, p + 1)]) + "]" for i in range(1, p + 1))
    out = [
        f"{tag}_x AS (SELECT *, CAST([{x}] AS DOUBLE[]) AS x, CAST({y} AS DOUBLE) AS y FROM {source})",
        f"{tag}_0 AS (SELECT {key}count(*) AS n, sum(y) AS sy, sum(y * y) AS syy, [{', '.join(f'sum(x[{i}] * y)' for i in range(1, p + 1))}] AS xy, CAST([{gram}] AS DOUBLE[][]) AS m FROM {tag}_x{group})",
    ]
    for k in range(1, p + 1):
        swept = f"list_transform(m, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / m[{k}][{k}]) ELSE list_transform(r, lambda v, j: v - r[{k}] * m[{k}][j] / m[{k}][{k}]) END)"
        # a term that is zero in all rows has no pivot and keeps a coefficient of zero
        out.append(f"{tag}_{k} AS (SELECT {key}n, sy, syy, xy, CASE WHEN abs(m[{k}][{k}]) < 1e-9 THEN m ELSE {swept} END AS m FROM {tag}_{k - 1})")
    out.append(f"{tag}_i AS (SELECT {key}n, sy, syy, xy, list_transform(m, lambda r: r[{p + 1}:]) AS inv FROM {tag}_{p})")
    out.append(f"{tag}_b AS (SELECT *, list_transform(inv, lambda r: list_dot_product(r, xy)) AS beta FROM {tag}_i)")
    on = f" JOIN {tag}_x USING ({by})" if by else f", {tag}_x"
    out.append(f"{tag}_s AS (SELECT {key}sum((y - list_dot_product(x, beta)) * (y - list_dot_product(x, beta))) AS ssr FROM {tag}_b{on}{group})")
    out.append(f"{tag} AS (SELECT * FROM {tag}_b{f' JOIN {tag}_s USING ({by})' if by else f', {tag}_s'})")
    return ",\n".join(out)


def _sandwich(tag: str, p: int, scores: str) -> str:
    """CTE ``{tag}_v``: variances of the coefficients for summed scores ``s`` of the table ``scores``."""
    meat = ", ".join("[" + ", ".join(f"sum(s[{i}] * s[{j}])" for j in range(1, p + 1)) + "]" for i in range(1, p + 1))
    return (
        f"{tag}_m AS (SELECT count(*) AS groups, CAST([{meat}] AS DOUBLE[][]) AS meat FROM {scores}),\n"
        f"{tag}_v AS (SELECT groups, list_transform(inv, lambda r: list_dot_product(r, list_transform(meat, lambda c: list_dot_product(c, r)))) AS var FROM {tag}, {tag}_m)"
    )


def hc3(tag: str, p: int) -> str:
    h = "list_dot_product(x, list_transform(inv, lambda r: list_dot_product(r, x)))"
    return f"{tag}_w AS (SELECT list_transform(x, lambda v: v * (y - list_dot_product(x, beta)) / (1 - {h})) AS s FROM {tag}, {tag}_x),\n" + _sandwich(tag, p, f"{tag}_w")


def clustered(tag: str, p: int, cluster: str) -> str:
    sums = ", ".join(f"sum(x[{i}] * e)" for i in range(1, p + 1))
    return (
        f"{tag}_e AS (SELECT {cluster}, x, y - list_dot_product(x, beta) AS e FROM {tag}, {tag}_x),\n"
        f"{tag}_w AS (SELECT [{sums}] AS s FROM {tag}_e GROUP BY {cluster}),\n" + _sandwich(tag, p, f"{tag}_w")
    )


#: Two-sided tail of the normal distribution (Abramowitz and Stegun 7.1.26, fixed values), to seven digits.
def normal_tail(z: str) -> str:
    t = f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))"
    return f"({t} * (0.254829592 + {t} * (-0.284496736 + {t} * (1.421413741 + {t} * (-1.453152027 + {t} * 1.061405429)))) * exp(-({z}) * ({z}) / 2))"


def coefficients(tag: str, terms: Sequence[Term], dummy: set[str], factor: str = "1.0") -> str:
    """SELECT of feature, coefficient, std_err, p_value and pct_effect from ``{tag}`` and ``{tag}_v``."""
    names = ["const", *(n for n, _ in terms)]
    listed = ", ".join(f"'{n}'" for n in names)
    kinds = ", ".join("0" if n == "const" else "1" if n in dummy else "2" for n in names)
    return f"""{tag}_f AS (SELECT unnest([{listed}]) AS feature, unnest([{kinds}]) AS kind, unnest(beta) AS b, unnest(list_transform(var, lambda v: sqrt(v * {factor}))) AS se FROM {tag}, {tag}_v)
SELECT feature, round(b, 6) AS coefficient, round(se, 6) AS std_err, round({normal_tail('b / se')}, 4) AS p_value,
  round(CASE kind WHEN 1 THEN (exp(b) - 1) * 100 WHEN 2 THEN b * 100 END, 4) AS pct_effect FROM {tag}_f"""


def t_quantile_975(df: str) -> str:
    """0.975 quantile of Student's t for large df, by its expansion around the normal quantile (fixed value)."""
    z = 1.959963984540054
    a, b, c = (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384
    return f"({z} + {a} / {df} + {b} / ({df} * {df}) + {c} / ({df} * {df} * {df}))"


def ridge(tag: str, source: str, terms: Sequence[Term], y: str, key: str, alphas: Sequence[float], folds: int = 5) -> str:
    """CTEs ``{tag}_best`` (alpha) and ``{tag}`` (intercept, b): ridge on scaled terms, the alpha by cross-validation over keys."""
    p = len(terms)
    d = p + 2  # constant, terms, target
    gram = ", ".join("[" + ", ".join(f"sum(z[{i}] * z[{j}])" for j in range(1, d + 1)) + "]" for i in range(1, d + 1))
    added = ", ".join("[" + ", ".join(f"sum(g[{i}][{j}])" for j in range(1, d + 1)) + "]" for i in range(1, d + 1))
    less = "list_transform(t.g, lambda r, i: list_transform(r, lambda v, j: v - o.g[i][j]))"
    solve = []

    def solved(name: str, start: str) -> list[str]:
        """From rows (…, m: Gram matrix, alpha) to intercept and slopes."""
        scale = f"list_transform(range(2, {p + 2}), lambda i: CASE WHEN (m[i][i] - m[1][i] * m[1][i] / m[1][1]) / m[1][1] < 1e-24 THEN 1.0 ELSE sqrt((m[i][i] - m[1][i] * m[1][i] / m[1][1]) / m[1][1]) END)"
        cell = "(m[i + 1][j + 1] - m[1][i + 1] * m[1][j + 1] / m[1][1]) / sd[i]"
        rows = f"list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 2}), lambda j: CASE WHEN j <= {p} THEN {cell} / sd[j] + CASE WHEN i = j THEN alpha ELSE 0 END ELSE {cell} END))"
        out = [f"{name}_s AS (SELECT *, {scale} AS sd FROM {start})", f"{name}_0 AS (SELECT *, CAST({rows} AS DOUBLE[][]) AS a FROM {name}_s)"]
        for k in range(1, p + 1):
            swept = f"list_transform(a, lambda r, i: CASE WHEN i = {k} THEN list_transform(r, lambda v: v / a[{k}][{k}]) ELSE list_transform(r, lambda v, j: v - r[{k}] * a[{k}][j] / a[{k}][{k}]) END)"
            out.append(f"{name}_{k} AS (SELECT * EXCLUDE (a), {swept} AS a FROM {name}_{k - 1})")
        out.append(f"{name}_b AS (SELECT *, list_transform(a, lambda r, i: r[{p + 1}] / sd[i]) AS b FROM {name}_{p})")
        out.append(f"{name} AS (SELECT *, m[1][{d}] / m[1][1] - list_dot_product(list_transform(m[1][2:{p + 1}], lambda v: v / m[1][1]), b) AS intercept FROM {name}_b)")
        return out

    solve += [
        f"{tag}_z AS (SELECT ('0x' || substr(md5(CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {folds} AS f, CAST([1.0, {', '.join(e for _, e in terms)}, {y}] AS DOUBLE[]) AS z FROM {source})",
        f"{tag}_g AS (SELECT f, CAST([{gram}] AS DOUBLE[][]) AS g FROM {tag}_z GROUP BY f)",
        f"{tag}_t AS (SELECT CAST([{added}] AS DOUBLE[][]) AS g FROM {tag}_g)",
        f"{tag}_a AS (SELECT unnest([{', '.join(map(str, map(float, alphas)))}]::DOUBLE[]) AS alpha)",
        f"{tag}_c AS (SELECT f, alpha, o.g AS own, {less} AS m FROM {tag}_g o, {tag}_t t, {tag}_a)",
        *solved(f"{tag}_v", f"{tag}_c"),
        f"{tag}_e AS (SELECT *, list_concat([intercept], b) AS w FROM {tag}_v)",
        f"{tag}_r AS (SELECT alpha, avg(1 - (own[{d}][{d}] - 2 * list_dot_product(own[{d}][1:{p + 1}], w) + list_dot_product(w, list_transform(own[1:{p + 1}], lambda r: list_dot_product(r[1:{p + 1}], w)))) / (own[{d}][{d}] - own[1][{d}] * own[1][{d}] / own[1][1])) AS score FROM {tag}_e GROUP BY alpha)",
        f"{tag}_best AS (SELECT alpha FROM {tag}_r ORDER BY score DESC, alpha LIMIT 1)",
        f"{tag}_f AS (SELECT alpha, g AS m FROM {tag}_t, {tag}_best)",
        *solved(tag, f"{tag}_f"),
    ]
    return ",\n".join(solve)
