"""From clean rows to modelling tables: imputation, selection and encoding by category, the same for one week and for all.

Neighbours are looked for among distinct vectors with their number of rows, in a grid (``ranks.nearest``): vectors with gaps are filed
once for each set of columns that they may share with those that ask, so no category is ever compared with itself.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from tarifa.operators.bounds import BOUNDS
from tarifa.operators.design import DesignSpec
from tarifa.operators.ranks import nearest
from tarifa.operators.selection import MAX_CATEGORIES, Effect, effect_table, select
from tarifa.sources.scratch import written

NEIGHBOURS, LEAST_KNOWN = 5, 10
# Column of each bounded quantity; what only television sets have.
COLUMN_OF = {"ram": "ram_go", "storage": "stockage_go", "screen": "taille_ecran"}
TV = "televiseurs"
TV_NUMBERS, TV_TEXTS, TV_FLAGS = ("taux_rafraichissement",), ("resolution_affichage", "technologie_dalle"), ("hdr", "smart_tv")
NO_TIER = ("cpu_serie", "cpu_gen")


def numeric_targets(category: str) -> list[str]:
    """Numbers that mean something in the category: those with bounds there."""
    bounds = BOUNDS.get(category, {})
    return [c for q, c in COLUMN_OF.items() if bounds.get(q)] + list(TV_NUMBERS if category == TV else ())


def irrelevant(category: str) -> list[str]:
    """Numbers that mean nothing in the category: without bounds there."""
    bounds = BOUNDS.get(category, {})
    return [c for q, c in COLUMN_OF.items() if not bounds.get(q)]


def forced(category: str) -> set[str]:
    """Columns that stay whatever their effect."""
    return {"marque", *numeric_targets(category)} | (set(TV_TEXTS + TV_FLAGS) if category == TV else set())


def _missing(c: str) -> Column:
    return F.col(c).isNull() | F.isnan(F.col(c).cast("double"))


def _same(names: Sequence[str], right: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"`{a}` <=> `{b}`" for a, b in zip(names, right)))


def _with_group(rows: DataFrame, found: DataFrame, group: Sequence[str]) -> DataFrame:
    """``rows`` with the columns of their group (null is a group too)."""
    if not group:
        return rows.join(F.broadcast(found))  # one row
    found = found.withColumnsRenamed({g: f"__of_{g}" for g in group})
    return rows.join(found, _same(group, [f"__of_{g}" for g in group])).drop(*[f"__of_{g}" for g in group])


def _block(group: Sequence[str], *more: Column) -> Column:
    """A string for each group (null ones too) and whatever else keeps vectors apart."""
    parts = [F.coalesce(F.concat(F.lit("v"), F.col(g).cast("string")), F.lit("n")) for g in group]
    return F.concat_ws("|", F.lit(""), *parts, *[m.cast("string") for m in more])


def near_with_gaps(asked: DataFrame, donors: DataFrame, group: Sequence[str], use: Sequence[str], k: int) -> DataFrame:
    """``asked`` vectors with their ``k`` nearest ``donors`` for each set of known columns, by the columns both know: the asked columns,
    ``__d_`` columns of the donor and its number of rows ``__w``. The ``k`` nearest of all are among them.

    Both have the group's columns and ``use``; donors have ``__rows``. Of equally near donors the smaller vectors are taken, nulls
    last. Pairs of masks of known columns are blocks of their own: within one, the columns that count are the same for all pairs, so a grid serves.
    """
    mask = sum((F.when(F.col(u).isNotNull(), 1 << i).otherwise(0) for i, u in enumerate(use)), F.lit(0))
    asked, donors = asked.withColumn("__q", mask), donors.withColumn("__m", mask)
    masks = asked.select(_block(group).alias("__g"), "__q").distinct().join(donors.select(_block(group).alias("__g"), "__m").distinct(), "__g").where(F.col("__q").bitwiseAND(F.col("__m")) != 0)

    def filed(rows: DataFrame, own: str, weight: Column, other: str) -> DataFrame:
        pairs = rows.withColumn("__g", _block(group)).join(masks, ["__g", own])
        places = [x for u in use for x in (F.col(u).isNull().alias(f"n_{u}"), F.col(u).alias(f"v_{u}"))]
        name = F.struct(*[F.col(g).alias(f"g_{g}") for g in group], *places, weight.cast("long").alias("rows"), F.col(other).alias("mask"))
        shared = F.col("__q").bitwiseAND(F.col("__m"))
        return pairs.select(name.alias("id"), F.concat_ws("|", "__g", "__q", "__m").alias("block"), *[F.when(shared.bitwiseAND(1 << i) != 0, F.col(u)).otherwise(0.0).alias(f"f{i}") for i, u in enumerate(use)])

    near = nearest(filed(asked, "__q", F.lit(0), "__m"), filed(donors, "__m", F.col("__rows"), "__q"), "block", [f"f{i}" for i in range(len(use))], k)
    return near.select(*[F.col(f"query_id.g_{g}").alias(g) for g in group], *[F.col(f"query_id.v_{u}").alias(u) for u in use], *[F.col(f"id.v_{u}").alias(f"__d_{u}") for u in use], F.col("id.rows").alias("__w"))


def impute_numbers(df: DataFrame, targets: Sequence[str], neighbours: Sequence[str], within: str | None = None, k: int = NEIGHBOURS, least: int = LEAST_KNOWN) -> DataFrame:
    """Gaps in numbers: the median of the group where fewer than ``least`` values are known, else the mean over the nearest rows.

    Distances are Euclidean over the columns that both rows have, scaled up by the share of those that are there; of equally near
    rows those of the smaller vector count first. ``k`` is lowered to one less than the known values of the sparsest
    target. A column without any value stays; a row that shares no column with any donor gets the column's mean.
    """
    targets = [c for c in targets if c in df.columns]
    if not targets:
        return df
    group = [within] if within else []
    rows = df.withColumns({c: F.when(~_missing(c), F.col(c).cast("double")) for c in {*targets, *(n for n in neighbours if n in df.columns)}})
    known = rows.groupBy(*group).agg(F.count("*").alias("__n"), *[F.count(c).alias(f"__k_{c}") for c in targets], *[F.median(c).alias(f"__m_{c}") for c in targets], *[F.avg(c).alias(f"__a_{c}") for c in targets])
    by_knn = lambda c: (F.col(f"__k_{c}") >= least) & (F.col(f"__k_{c}") < F.col("__n"))
    sparsest = F.least(*[F.when(by_knn(c), F.col(f"__k_{c}")) for c in targets], F.lit(1 << 60).cast("long"))
    known = known.withColumn("__kk", F.least(F.lit(k).cast("long"), F.greatest(F.lit(1).cast("long"), sparsest - 1)))
    rows = _with_group(rows, known, group)
    use = list(dict.fromkeys([*targets, *(n for n in neighbours if n in df.columns)]))
    out = rows
    for c in targets:
        out = out.withColumn(c, F.when(F.col(c).isNull() & (F.col(f"__k_{c}") < least), F.col(f"__m_{c}")).otherwise(F.col(c)))
    # columns filled by the median take part as they are afterwards, as do complete ones
    vectors = out.groupBy(*group, *use).agg(F.count("*").alias("__rows"), *[F.first(f"__a_{c}").alias(f"__a_{c}") for c in targets], F.first("__kk").alias("__kk"))
    vectors = written(vectors, "impute-vectors")
    each = lambda rows: functools.reduce(DataFrame.unionByName, [rows(c).withColumn("__t", F.lit(c)) for c in targets])
    donors = each(lambda c: vectors.where(F.col(c).isNotNull()).select(*group, *use, "__rows"))
    asked = each(lambda c: vectors.where(F.col(c).isNull() & F.col(f"__a_{c}").isNotNull()).select(*group, *use, F.col(f"__a_{c}").alias("__mean"), "__kk"))
    own = [*group, *use, "__t"]
    found = near_with_gaps(asked.select(*own), donors, [*group, "__t"], use, k)  # all targets in one search
    found = found.select(*[F.col(x).alias(f"__f_{x}") for x in own], *[f"__d_{u}" for u in use], "__w")
    near = asked.join(found, _same(own, [f"__f_{x}" for x in own]), "left").drop(*[f"__f_{x}" for x in own])
    both = {u: F.col(u).isNotNull() & F.col(f"__d_{u}").isNotNull() for u in use}
    gaps = sum((F.when(both[u], (F.col(u) - F.col(f"__d_{u}")) * (F.col(u) - F.col(f"__d_{u}"))).otherwise(0.0) for u in use), F.lit(0.0))
    shared = sum((F.when(both[u], 1).otherwise(0) for u in use), F.lit(0))
    near = near.withColumn("__dist", F.when(shared > 0, F.sqrt(gaps * float(len(use)) / shared)))
    order = [F.col("__dist").asc_nulls_last(), *[F.col(f"__d_{u}").asc_nulls_last() for u in use]]
    w = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    near = near.withColumn("__before", F.coalesce(F.sum("__w").over(w), F.lit(0))).where("__before < __kk")
    weight = F.when(F.col("__dist").isNotNull(), F.least(F.col("__w"), F.col("__kk") - F.col("__before")))
    given = functools.reduce(lambda e, c: F.when(F.col("__t") == c, F.col(f"__d_{c}")).otherwise(e), targets, F.lit(None).cast("double"))
    values = near.groupBy(*own).agg(F.coalesce(F.sum(weight * given) / F.sum(weight), F.first("__mean")).alias("__v"))
    values = values.groupBy(*group, *use).agg(*[F.max(F.when(F.col("__t") == c, F.col("__v"))).alias(f"__v_{c}") for c in targets])
    values = values.select(*[F.col(x).alias(f"__o_{x}") for x in (*group, *use)], *[f"__v_{c}" for c in targets])
    out = out.join(values, _same([*group, *use], [f"__o_{x}" for x in (*group, *use)]), "left").withColumns({c: F.coalesce(c, f"__v_{c}") for c in targets})
    return out.select(*df.columns)


def impute_labels(df: DataFrame, targets: Sequence[str], neighbours: Sequence[str], within: str | None = None, k: int = NEIGHBOURS) -> DataFrame:
    """Gaps in labels: the most frequent label among the ``k`` nearest rows that have one, ties to the smallest.

    Neighbour columns are filled with the group's median for the distance alone and not scaled. Without any known label a gap
    stays, as it does without any neighbour column.
    """
    use = [c for c in neighbours if c in df.columns]
    targets = [c for c in targets if c in df.columns]
    if not use or not targets:
        return df
    group = [within] if within else []
    medians = df.groupBy(*group).agg(*[F.median(F.col(c).cast("double")).alias(f"__m_{c}") for c in use])  # a row per group
    out = _with_group(df, medians, group)
    out = out.withColumns({f"__f_{c}": F.coalesce(F.when(~_missing(c), F.col(c).cast("double")), F.col(f"__m_{c}"), F.lit(0.0)) for c in use})
    vector = [f"__f_{c}" for c in use]
    for t in targets:
        counts = out.where(F.col(t).isNotNull()).groupBy(*group, *vector, t).agg(F.count("*").alias("__w"))
        asked = out.where(F.col(t).isNull()).select(*group, *vector).distinct()
        name = lambda label, rows: F.struct(*[F.col(g).alias(f"g{i}") for i, g in enumerate(group)], *[F.col(v).alias(v) for v in vector], label.alias("label"), rows.cast("long").alias("rows"))
        found = nearest(
            asked.select(name(F.lit(None).cast(df.schema[t].dataType), F.lit(0)).alias("id"), _block(group).alias("block"), *vector),
            counts.select(name(F.col(t), F.col("__w")).alias("id"), _block(group).alias("block"), *vector), "block", vector, k,
        )
        near = found.select(*[F.col(f"query_id.g{i}").alias(g) for i, g in enumerate(group)], *[F.col(f"query_id.{v}").alias(v) for v in vector], *[F.col(f"id.{v}").alias(f"__d{v}") for v in vector], F.col("id.label").alias("__label"), F.col("id.rows").alias("__w"))
        gaps = sum(((F.col(v) - F.col(f"__d{v}")) * (F.col(v) - F.col(f"__d{v}")) for v in vector), F.lit(0.0))
        near = near.withColumn("__dist", gaps)
        w = Window.partitionBy(*group, *vector).orderBy("__dist", *[f"__d{v}" for v in vector], "__label").rowsBetween(Window.unboundedPreceding, -1)
        near = near.withColumn("__before", F.coalesce(F.sum("__w").over(w), F.lit(0))).where(F.col("__before") < k)
        votes = near.groupBy(*group, *vector, "__label").agg(F.sum(F.least(F.col("__w"), k - F.col("__before"))).alias("__votes"))
        best = votes.groupBy(*group, *vector).agg(F.min_by("__label", F.struct(-F.col("__votes"), "__label")).alias("__best"))
        best = best.select(*[F.col(x).alias(f"__o_{x}") for x in (*group, *vector)], "__best")
        out = out.join(best, _same([*group, *vector], [f"__o_{x}" for x in (*group, *vector)]), "left")
        out = out.withColumn(t, F.coalesce(t, "__best")).drop("__best", *[f"__o_{x}" for x in (*group, *vector)])
    return out.select(*df.columns)


def fill_rest(df: DataFrame) -> DataFrame:
    """No gap is left: processors without a tier get 0, other numbers their median, texts their most frequent value or 'Inconnu'."""
    numbers = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in NO_TIER]
    texts = [f.name for f in df.schema if f.dataType.simpleString() == "string"]
    df = df.fillna(0, [c for c in NO_TIER if c in df.columns])
    if not numbers and not texts:
        return df
    middle = df.agg(*[F.median(c).alias(f"__m_{c}") for c in numbers], *[F.mode(c, True).alias(f"__m_{c}") for c in texts])  # one row
    filled = {c: F.coalesce(F.when(~_missing(c), F.col(c)), F.col(f"__m_{c}").cast(df.schema[c].dataType)) for c in numbers}
    filled |= {c: F.coalesce(F.col(c), F.col(f"__m_{c}"), F.lit("Inconnu")) for c in texts}
    return df.join(F.broadcast(middle)).withColumns(filled).select(*df.columns)


def prepare_category(df: DataFrame, category: str) -> DataFrame:
    """One category without the numbers that mean nothing in it, its gaps filled from its own rows."""
    targets = [c for c in numeric_targets(category) if c in df.columns]
    df = df.drop(*[c for c in irrelevant(category) if c in df.columns])
    df = impute_numbers(df, targets, targets)
    return impute_labels(df, ["os_platform", *(TV_TEXTS if category == TV else ())], targets)


def categories(df: DataFrame, category: str = "categorie") -> list[str]:
    """Names of the categories, a handful."""
    return sorted(r[0] for r in df.select(category).where(F.col(category).isNotNull()).distinct().collect())


#: Columns that identify a row or its price: never candidates.
_ALWAYS_DROP = (
    "gtin", "dedup_key", "prix_suspect", "ram_suspecte", "stockage_suspect", "stockage_incoherent_nom_vs_specs", "ecran_suspect", "date_collecte", "specs_brutes", "semaine", "categorie",
    "processeur", "os", "connectivite",
)
_ALWAYS_KEEP = ("url", "nom", "prix_tnd")


def _selected(prepared: DataFrame, category: str) -> tuple[list[str], list[Effect]]:
    keep = [c for c in _ALWAYS_KEEP if c in prepared.columns]
    return select(prepared, "prix_tnd", _ALWAYS_DROP, keep, sorted(forced(category) & set(prepared.columns)))


def stable_selection(df: DataFrame, names: Sequence[str] | None = None, category: str = "categorie") -> dict[str, tuple[list[str], list[Effect]]]:
    """Columns to keep and their report for each category, from the rows of all weeks together: weeks then share a schema.

    The prepared rows of all categories are one table; the roles of its columns and their effects, in each category, are one pass each.
    """
    priced = written(df.where("prix_tnd IS NOT NULL"), "priced")
    names = list(names or categories(priced, category))
    if not names:
        return {}
    ready = {c: prepare_category(priced.where(F.col(category) == c), c) for c in names}
    rows = written(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ready.values()), "prepared")
    numeric = {f.name for f in rows.schema if isinstance(f.dataType, NumericType)}
    candidates = [c for c in rows.columns if c not in (*_ALWAYS_DROP, *_ALWAYS_KEEP, category)]
    levels = {r[category]: r.asDict() for r in rows.groupBy(category).agg(*[F.count_distinct(c).alias(c) for c in candidates]).collect()}  # a row per category
    role = {(k, c): "spearman" if c in numeric and n > MAX_CATEGORIES else "kruskal" for k, own in levels.items() for c, n in own.items() if c in candidates and n > 1}
    tested = {t: [c for c in candidates if t in {role.get((k, c)) for k in names}] for t in ("spearman", "kruskal")}
    table = effect_table(rows, "prix_tnd", tested["spearman"], tested["kruskal"], [category]).collect() if role else []  # a row per category and column
    found = {(r[category], r["column"], r["test"]): Effect(**{f: r[f] for f in ("column", "test", "n", "statistic", "p_value", "kept", "reason")}) for r in table}
    out = {}
    for k in names:
        own = [(c, t) for t in ("spearman", "kruskal") for c in ready[k].columns if role.get((k, c)) == t]
        report = [found.get((k, c, t)) or Effect(c, t, 0, 0.0, None, False, "too few rows") for c, t in own]
        chosen = {e.column for e in report if e.kept} | forced(k) | set(_ALWAYS_KEEP)
        out[k] = [c for c in ready[k].columns if c in chosen], report
    return out


def process_category(df: DataFrame, category: str, stable: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, list[Effect] | None]:
    """(tidy, encoded, report): the kept columns without a gap, the same as numbers, and how they were chosen (None when ``stable``)."""
    prepared = prepare_category(df.where("prix_tnd IS NOT NULL"), category)
    columns, report = ([c for c in stable if c in prepared.columns], None) if stable is not None else _selected(prepared, category)
    tidy = fill_rest(prepared.select(*columns))
    tidy = tidy.select(*[F.col(f.name).cast("int").alias(f.name) if isinstance(f.dataType, BooleanType) else F.col(f.name) for f in tidy.schema])
    return tidy, encode(tidy), report


def encode(tidy: DataFrame, drop: Sequence[str] = ("nom", "url"), target: str = "prix_tnd") -> DataFrame:
    """All columns as numbers: texts become 0/1 columns of all levels but the first; ``drop`` goes."""
    fields = [f for f in tidy.schema if f.name not in drop and f.name != target]
    numbers = [f.name for f in fields if isinstance(f.dataType, (NumericType, BooleanType))]
    spec = DesignSpec.fit(tidy, numbers, [f.name for f in fields if f.name not in numbers])
    return tidy.select(*([F.col(target).cast("double").alias(target)] if target in tidy.columns else []), *spec.columns())


def build_weeks(df: DataFrame, path: str, stable: bool = True, week: str = "semaine", category: str = "categorie") -> list[dict]:
    """Tidy and encoded tables of every week and category under ``path``, and a summary row for each.

    With ``stable`` the selection is made once on all weeks. ``df`` are clean rows with their features.
    """
    df = df.where("prix_tnd IS NOT NULL")
    chosen = {c: kept for c, (kept, _) in stable_selection(df, category=category).items()} if stable else {}
    out = []
    for w in sorted(r[0] for r in df.select(week).distinct().collect()):  # weeks, a handful
        rows = df.where(F.col(week) == w)
        for c in categories(rows, category):
            tidy, encoded, _ = process_category(rows.where(F.col(category) == c), c, chosen.get(c))
            tidy.write.mode("overwrite").parquet(f"{path}/week_{w}/{c}_clean")
            encoded.write.mode("overwrite").parquet(f"{path}/week_{w}/{c}_encoded")
            spark = df.sparkSession
            out.append({week: w, category: c, "clean_rows": spark.read.parquet(f"{path}/week_{w}/{c}_clean").count(), "clean_cols": len(tidy.columns), "encoded_cols": len(encoded.columns)})
    return out
