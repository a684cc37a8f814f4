"""The scalar builders and the trace of cluster numbers as functions of a session's SQL.

Scalars become SQL functions: their bodies are the builders' own expressions, so plans are the same as with the DataFrame API and nothing
runs in Python. ``k_trace`` is a table function over partitions:

    SELECT * FROM k_trace(TABLE(SELECT brand, tier, xxhash64(id) AS h, array(size) AS features FROM units) PARTITION BY (brand, tier))
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from tarifa.functions import format as fmt
from tarifa.functions import specs

#: name -> (builder, types of its arguments by name)
SCALARS: dict[str, tuple[Callable[..., Column], dict[str, str]]] = {
    "pct_change": (specs.pct_change, {"before": "DOUBLE", "after": "DOUBLE"}),
    "direction": (lambda delta, step: F.when(delta.isNull() | F.isnan(delta), "indéterminé").when(delta > step, "hausse").when(delta < -step, "baisse").otherwise("stable"), {"delta": "DOUBLE", "step": "DOUBLE"}),
    "effect_pct": (specs.effect_pct, {"beta": "DOUBLE", "dummy": "BOOLEAN"}),
    "safe_name": (specs.safe_name, {"name": "STRING"}),
    "file_size": (specs.file_size, {"bytes": "BIGINT"}),
    "french_number": (lambda value: fmt.number(value, 1), {"value": "DOUBLE"}),
    "french_price": (fmt.price, {"value": "DOUBLE"}),
    "french_percent": (fmt.percent, {"value": "DOUBLE"}),
    "period_label": (fmt.period_label, {"before": "STRING", "after": "STRING"}),
}


class KTrace:
    """Rows of one unit in, a row per number of clusters out; a unit is what one task may hold (``segments.MAX_UNIT`` rows)."""

    def __init__(self):
        self.rows: list[tuple[int, list[float]]] = []

    def eval(self, row):
        from tarifa.operators.segments import MAX_UNIT

        if len(self.rows) >= MAX_UNIT:
            raise ValueError(f"a unit of more than {MAX_UNIT} rows: use tarifa.operators.segments.k_trace")
        self.rows.append((row["h"], row["features"]))

    def terminate(self):
        from tarifa.operators import clusters

        if len(self.rows) < 10:
            return
        h = np.array([r[0] for r in self.rows], np.int64).view(np.uint64)
        x = clusters.on_grid(np.array([[np.nan if v is None else v for v in r[1]] for r in self.rows], float))
        k, trace, _ = clusters.locally(clusters.choose(len(x), x.shape[1]), x, h)
        for t in trace:
            yield (*t, t[0] == k)


def register(spark: SparkSession) -> list[str]:
    """Make all functions known to the session; their names."""
    for name, (builder, arguments) in SCALARS.items():
        empty = spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {a}" for a, t in arguments.items()))
        out = empty.select(builder(*[F.col(a) for a in arguments]).alias("out"))
        body = out._jdf.queryExecution().analyzed().projectList().head().child().sql()
        kind = out.schema["out"].dataType.simpleString().upper()
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({', '.join(f'{a} {t}' for a, t in arguments.items())}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("k_trace", udtf(KTrace, returnType="k int, n_clusters int, least_size int, silhouette double, valid boolean, inertia double, chosen boolean"))
    return [*SCALARS, "k_trace"]
