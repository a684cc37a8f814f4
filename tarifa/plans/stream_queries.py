"""Streaming queries over the events table, held against batch SQL on the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarifa.plans.data import table
from tarifa.streaming import events as E


def _events(spark, d):
    return E.file_stream(spark, d, table(spark, d, "events").schema, "events.parquet")


def stream_tumbling(spark, d):
    out = E.drained(E.tumbling(_events(spark, d).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type"), "complete")
    return out.select(F.date_format("window.start", "yyyy-MM-dd").alias("start"), "event_type", "n", (F.round("total", 4) + F.lit(0.0)).alias("total"))


def stream_distinct_users(spark, d):
    out = E.drained(_events(spark, d).groupBy("event_type", "user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n")), "complete")
    return out.select("event_type", "user_id", "n")


ALL = {
    "stream_tumbling": (
        stream_tumbling,
        """SELECT strftime(CAST(TIMESTAMP '1970-01-01' + to_days(CAST(floor(epoch(ts) / 604800) * 7 AS INTEGER)) AS DATE), '%Y-%m-%d') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total
           FROM events GROUP BY 1, 2""",
    ),
    "stream_distinct_users": (stream_distinct_users, "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY 1, 2"),
}
