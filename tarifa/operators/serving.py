"""A small HTTP server over the artifacts of a category: health, and downloads of filtered tables."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarifa.operators.train import ArtifactsMissing, available, load, segment_products

#: Tables that can be downloaded; a reply streams partition by partition.
TABLES = ("labelled", "segments", "ranges")


def csv_lines(df: DataFrame):
    """Header and rows of a table as CSV text, with a byte-order mark for spreadsheets; one partition at a time on the driver."""
    quote = lambda c: F.when(F.col(c).isNull(), "").otherwise(F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"')))
    flat = [f.name for f in df.schema if f.dataType.typeName() not in ("map", "array", "struct")]
    yield "﻿" + ",".join(flat) + "\n"
    for row in df.select(F.concat_ws(",", *[quote(c) for c in flat]).alias("line")).toLocalIterator():
        yield row["line"] + "\n"


def table(spark: SparkSession, models: str, name: str, query: dict[str, list[str]]) -> DataFrame:
    """A table of the artifacts, filtered: ``cluster_n1``/``cluster_n2`` for products, other columns compared as text."""
    if name not in TABLES:
        raise KeyError(name)
    df = getattr(load(spark, models), name)
    for column, values in query.items():
        if column in ("cluster_n1", "cluster_n2") and name == "labelled":
            df = segment_products(df, column[-2:], values[0])
        elif column in df.columns:
            df = df.where(F.col(column).cast("string") == values[0])
    return df


def server(spark: SparkSession, models: str, port: int) -> ThreadingHTTPServer:
    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: str, kind: str) -> None:
            data = body.encode("utf-8")
            self.send_response(status)
            self.send_header("Content-Type", f"{kind}; charset=utf-8")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            url = urlparse(self.path)
            name, _, kind = url.path.strip("/").partition(".")
            try:
                if url.path == "/healthz":
                    self._send(200, json.dumps({"status": "ok", "models": available(spark, models)}), "application/json")
                elif kind == "csv":
                    lines = csv_lines(table(spark, models, name, parse_qs(url.query)))
                    self.send_response(200)
                    self.send_header("Content-Type", "text/csv; charset=utf-8")
                    self.end_headers()
                    for line in lines:
                        self.wfile.write(line.encode("utf-8"))
                elif url.path == "/metrics.json":
                    rows = spark.read.parquet(f"{models}/metrics").collect()  # a row per family
                    self._send(200, json.dumps([r.asDict() for r in rows]), "application/json")
                else:
                    self._send(404, "unknown path", "text/plain")
            except (KeyError, ArtifactsMissing) as e:
                self._send(404, str(e), "text/plain")

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer(("", port), Handler)
