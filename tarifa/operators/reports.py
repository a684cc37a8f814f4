"""The ten weekly reports of one category, as lazy tables over its labelled products."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarifa.functions.specs import geo_mean
from tarifa.operators import regression, segments, studies
from tarifa.operators.panel import tiers, transitions
from tarifa.operators.train import FAMILIES, score_labelled


def weekly_reports(labelled: DataFrame, models: DataFrame, specs: Sequence[str], raw: DataFrame | None = None, families: Sequence[str] = FAMILIES, replicates: int = 100, n_boot: int = 1000) -> dict[str, DataFrame]:
    """``labelled`` and ``models`` as ``train.fit_category`` gives them: products with period, brand, price, y, estimates and clusters."""
    spark = labelled.sparkSession
    scored = score_labelled(labelled, models, specs, families)
    prices = scored.withColumns({f"price_{f}": F.exp(f"scored_{f}") for f in families})
    by = {f: (f"price_{f}", f"source_{f}") for f in families}
    n2 = prices.where("cluster_n2 IS NOT NULL").withColumns({"tier": F.split("cluster_n2", "::")[1], "cluster": F.split("cluster_n2", "::")[2]})
    units = studies.cluster_estimates(n2, ["brand", "tier", "cluster", "period"], by)
    best = families[0]
    steps = transitions(units.withColumns({c: F.round(c, 2) for c in ("real", f"estimated_{best}")}), ["brand", "tier", "cluster"], "real", f"estimated_{best}", "n")
    tiered = tiers(labelled)
    index = regression.price_index(labelled, list(specs), ["brand"], "period", F.col("y"), "product").rename(columns={"period": "period"})
    priced = n2.select("brand", "tier", "cluster", "period", "product", F.col("price").alias("real"), F.col(f"price_{best}").alias("estimated"))
    gaps = segments.bootstrap_gap(segments.sides(priced, ["brand", "tier", "cluster"]), ["brand", "tier", "cluster", "t"], "product", n_boot)
    covered = labelled.groupBy("period").agg(F.count("*").alias("n"), F.count("cluster_n1").alias("n1_covered"), F.count("cluster_n2").alias("n2_covered"))
    whole = labelled.withColumns({"brand": F.lit(None).cast("string"), "tier": F.lit(None).cast("string")})  # the category's products as one unit
    trace = segments.k_trace(tiered, ["brand", "tier"], list(specs)).withColumn("level", F.lit("n2")).unionByName(segments.k_trace(whole, ["brand", "tier"], list(specs)).withColumn("level", F.lit("n1")))
    return {
        "composition": labelled.groupBy("period").agg(*[F.avg(s).alias(s) for s in specs], geo_mean("price").alias("geo_price"), F.count("*").alias("n")),
        "estimates": studies.estimates(labelled.withColumns({f"made_{f}": F.exp(f"estimate_{f}") for f in families}), {f: f"made_{f}" for f in families}, "period"),
        "price_index": spark.createDataFrame(index.astype(object).where(index.notna(), None), "period string, reference boolean, index_pct double, p_value double"),
        "n1_estimates": studies.cluster_estimates(prices, ["cluster_n1", "period"], by),
        "n2_estimates": units,
        "stability": segments.stability(tiered, ["brand", "tier"], list(specs), replicates),
        "k_justification": trace,
        "coverage": covered.withColumns({f"{c}_pct": F.col(c) * 100.0 / F.col("n") for c in ("n1_covered", "n2_covered")}),
        "raw_and_clean": studies.raw_and_clean(raw if raw is not None else labelled, labelled, "period"),
        "transitions": steps.join(gaps, ["brand", "tier", "cluster", "t"], "left"),
    }
