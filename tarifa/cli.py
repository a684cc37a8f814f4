"""Command line.

    python -m tarifa.cli clean --raw DIR --out DIR                          raw JSON to the clean table
    python -m tarifa.cli pipeline --clean DIR --out DIR [--each-week]       tidy and encoded tables of all weeks and categories
    python -m tarifa.cli split --clean DIR --out DIR [--share 0.2]          full, train and test tables
    python -m tarifa.cli train --clean DIR --out DIR --category NAME        models and artifacts of a category
    python -m tarifa.cli reports --clean DIR --out DIR [--category NAME]    reports over the clean table
    python -m tarifa.cli reports --models DIR --out DIR                     the ten weekly reports of a trained category
    python -m tarifa.cli scrape --week N --out DIR --fetcher MODULE:NAME    collect the pages of a week, or go on with it
    python -m tarifa.cli serve --models DIR [--port 8050]                   /healthz, and downloads as CSV and JSON
    python -m tarifa.cli query NAME --data DIR [--limit N]
"""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from tarifa.functions.specs import geo_mean
from tarifa.operators import panel as P
from tarifa.operators import regression
from tarifa.operators.clean import add_features, clean_products, quality_summary
from tarifa.operators.design import DesignSpec
from tarifa.session import session
from tarifa.sources import ingest, sinks


def clean(args) -> None:
    spark = session()
    raw = ingest.raw_products(spark, args.raw).cache()
    rows = add_features(clean_products(ingest.readable(raw)))
    sinks.clean_table(rows, args.out)
    written = spark.read.parquet(args.out)
    quality_summary(written).orderBy(F.desc("n_null"), "column_name").show(50, False)
    ingest.unreadable(raw).show(20, False)


def weekly_reports(df):
    """Reports by category and week over the clean table."""
    kept = df.where("prix_tnd IS NOT NULL").withColumnsRenamed({"url": "product", "semaine": "period", "marque": "brand", "prix_tnd": "price"})
    keys = ["categorie", "period"]
    estimate = regression.ols(kept.where("price > 0"), DesignSpec.fit(kept, [], ["categorie", "brand"]), F.ln("price"))
    scored = kept.withColumn("estimate", F.exp(estimate.predict()))
    real, made = geo_mean("price"), geo_mean("estimate")
    return {
        "composition": kept.groupBy(*keys).agg(F.avg("ram_go").alias("ram_go"), F.avg("stockage_go").alias("stockage_go"), geo_mean("price").alias("prix_geometrique_tnd"), F.count("*").alias("n_produits")),
        "estimations": scored.groupBy(*keys).agg(F.count("*").alias("n_produits"), real.alias("reel"), made.alias("estime"), ((made - real) / real * 100).alias("erreur_pct"), F.avg(F.abs(F.col("estimate") - F.col("price")) / F.col("price") * 100).alias("mape_pct")),
        "churn": P.churn(kept),
        "brand_share": P.shares(kept, keys, "brand"),
        "tiers": P.tier_ranges(P.tiers(kept)),
        "coverage": df.groupBy("categorie", "semaine").agg(F.count("*").alias("n_raw"), F.count("prix_tnd").alias("n_clean"), F.count_if(F.col("prix_tnd").isNull()).alias("n_excluded")),
    }


def report(args) -> None:
    if args.models:
        from tarifa.operators import reports as R
        from tarifa.operators import train as T

        loaded = T.load(session(), args.models)
        families = [f for f in T.FAMILIES if f"estimate_{f}" in loaded.labelled.columns]
        sinks.reports(R.weekly_reports(loaded.labelled, loaded.segments, loaded.spec.continuous, families=families), args.out)
        return
    df = session().read.parquet(args.clean)
    if args.category:
        df = df.where(F.col("categorie") == args.category)
    sinks.reports(weekly_reports(df), args.out)


def pipeline(args) -> None:
    from tarifa.operators.prepare import build_weeks

    df = session().read.parquet(args.clean)
    for row in build_weeks(df, args.out, stable=not args.each_week):
        print(row)


def split(args) -> None:
    print(sinks.week_splits(session().read.parquet(args.clean).where("prix_tnd IS NOT NULL"), args.out, share=args.share))


def _catalogue(spark, path: str, category: str):
    """One category of the clean table under the operators' names, its gaps filled."""
    from tarifa.operators.prepare import fill_rest, numeric_targets, prepare_category

    rows = prepare_category(spark.read.parquet(path).where((F.col("categorie") == category) & F.col("prix_tnd").isNotNull()), category)
    specs = [c for c in numeric_targets(category) if c in rows.columns]
    labels = [c for c in ("os_platform", "cpu_brand") if c in rows.columns]
    rows = fill_rest(rows.select("url", "semaine", "marque", "prix_tnd", *specs, *labels))
    return rows.withColumnsRenamed({"url": "product", "semaine": "period", "marque": "brand", "prix_tnd": "price"}), specs, labels


def train(args) -> None:
    from tarifa.operators import train as T

    rows, specs, labels = _catalogue(session(), args.clean, args.category)
    models = T.fit_category(rows, specs, labels, families=args.families.split(","))
    T.persist(models, args.out)
    models.metrics.show(truncate=False)


def scrape(args) -> None:
    import importlib
    import json

    import re

    from tarifa.operators.html import parse_products
    from tarifa.sources.scrape import Checkpoint, collect_week

    module, _, name = args.fetcher.partition(":")
    fetcher = getattr(importlib.import_module(module), name)
    point = Checkpoint(f"{args.out}/checkpoint.json")
    if args.reset:
        point.reset(args.week)
    with open(args.sources, encoding="utf-8") as f:
        bases = json.load(f)
    links = lambda page: re.findall(args.links, page)
    status = collect_week(fetcher, args.week, bases, links, lambda url, page: {"url": url, "html": page}, f"{args.out}/pages", point)
    for row in status:
        print(row)
        if row["n_parsed"]:  # pages stay as they came; what they say is read by column expressions
            pages = session().read.schema("url string, html string").option("multiLine", True).json(f"{args.out}/pages/week_{args.week}/{row['category']}.json")
            sinks.json_export(parse_products(pages, row["category"], args.week), f"{args.out}/raw/week_{args.week}/{row['category']}")


def serve(args) -> None:
    from tarifa.operators.serving import server

    server(session(), args.models, args.port).serve_forever()


def query(args) -> None:
    from tarifa import registry

    registry.QUERIES[args.name](session(), args.data).show(args.limit, False)


def main(argv: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="tarifa")
    sub = top.add_subparsers(required=True)
    p = sub.add_parser("clean")
    p.add_argument("--raw", required=True)
    p.add_argument("--out", required=True)
    p.set_defaults(run=clean)
    p = sub.add_parser("reports")
    p.add_argument("--clean")
    p.add_argument("--models")
    p.add_argument("--out", required=True)
    p.add_argument("--category")
    p.set_defaults(run=report)
    p = sub.add_parser("pipeline")
    p.add_argument("--clean", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--each-week", action="store_true")
    p.set_defaults(run=pipeline)
    p = sub.add_parser("split")
    p.add_argument("--clean", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--share", type=float, default=0.2)
    p.set_defaults(run=split)
    p = sub.add_parser("train")
    p.add_argument("--clean", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--category", required=True)
    p.add_argument("--families", default="hedonic,ridge,random_forest")
    p.set_defaults(run=train)
    p = sub.add_parser("scrape")
    p.add_argument("--week", type=int, required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--fetcher", required=True)
    p.add_argument("--sources", required=True, help="JSON of category: listing page")
    p.add_argument("--links", default=r"""(?i)<a\b[^>]*href=["']([^"'#]+\.html)["']""", help="pattern of product links")
    p.add_argument("--reset", action="store_true")
    p.set_defaults(run=scrape)
    p = sub.add_parser("serve")
    p.add_argument("--models", required=True)
    p.add_argument("--port", type=int, default=8050)
    p.set_defaults(run=serve)
    p = sub.add_parser("query")
    p.add_argument("name")
    p.add_argument("--data", required=True)
    p.add_argument("--limit", type=int, default=20)
    p.set_defaults(run=query)
    args = top.parse_args(argv)
    args.run(args)


if __name__ == "__main__":
    main()
