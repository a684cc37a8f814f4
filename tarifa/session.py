"""A session with the settings the engine expects; on a cluster the launcher's settings win."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "tarifa", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    }
    if "SPARK_MASTER" in os.environ:
        defaults["spark.master"] = os.environ["SPARK_MASTER"]
    for k, v in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
