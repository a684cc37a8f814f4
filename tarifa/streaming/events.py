"""Incremental loads with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tarifa.operators.clean import latest
from tarifa.sources.scratch import shared_dir


def file_stream(spark: SparkSession, path: str, schema: StructType, glob: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).option("pathGlobFilter", glob).load(path)


def tumbling(events: DataFrame, ts: str, *keys: str, width: str = "7 days", late: str = "1 day") -> DataFrame:
    """Counts and sums by window; a window is emitted once the watermark has passed it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def first_within(events: DataFrame, ts: str, keys: list[str], late: str = "1 day") -> DataFrame:
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


#: Parts that an upserted table is kept in, by a hash of the key.
BUCKETS = 64


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rows of an upserted table: of each part the last version (under ``before``)."""
    versions = spark.read.option("basePath", path).parquet(path)
    if before is not None:
        versions = versions.where(F.col("__version") < before)
    last = versions.groupBy("__bucket").agg(F.max("__version").alias("__version"))  # a row per part
    return versions.join(F.broadcast(last), ["__bucket", "__version"], "left_semi")


def upsert_latest(stream: DataFrame, path: str, keys: list[str], ts: str, *ties: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest row per key in a Parquet table, in ``BUCKETS`` parts by key: a micro-batch rewrites the parts it touches.

    Each batch writes a version of its parts, and ``current`` reads the last one of each; a batch that is run again writes the same
    version. ``tidy`` removes versions that were superseded.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("__bucket", F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int"))
        touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return
        if number > 0 and _versions(spark, path):
            held = current(spark, path, number).where(F.col("__bucket").isin(touched)).drop("__version")
            rows = rows.unionByName(held)
        latest(rows, keys, ts, *ties).write.mode("overwrite").partitionBy("__bucket").parquet(f"{path}/__version={number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _versions(spark: SparkSession, path: str) -> list[int]:
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("__version="))


def tidy(spark: SparkSession, path: str) -> int:
    """Remove the parts of older versions that a later version has again; how many there were. For when no reader is at work."""
    pairs = spark.read.option("basePath", path).parquet(path).select("__version", "__bucket").distinct().collect()  # parts x versions
    last = {}
    for v, b in pairs:
        last[b] = max(v, last.get(b, v))
    old = [(v, b) for v, b in pairs if v < last[b]]
    for v, b in old:
        where, fs = _folder(spark, f"{path}/__version={v}/__bucket={b}")
        fs.delete(where, True)
    return len(old)


def split_late(stream: DataFrame, ts: str, path: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Rows in time to ``path/on_time`` and those behind the watermark to ``path/late``: nothing is dropped unseen.

    The watermark is the latest time of the batches before, less ``late``; it is kept by batch, so that a batch that is run again
    divides its rows alike.
    """

    def divide(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where, fs = _folder(spark, f"{path}/marks")
        seen = spark.read.option("recursiveFileLookup", True).parquet(f"{path}/marks").where(F.col("batch") < number).agg(F.max("mark")).first()[0] if fs.exists(where) else None
        behind = F.coalesce(F.col(ts) < F.lit(seen).cast("timestamp") - F.expr(f"INTERVAL {late}"), F.lit(False)) if seen is not None else F.lit(False)
        marked = batch.withColumn("__late", behind).persist()
        for name, rows in (("on_time", marked.where("NOT __late")), ("late", marked.where("__late"))):
            rows.drop("__late").write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        marked.agg(F.max(ts).alias("mark")).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/marks/b{number}")
        marked.unpersist()

    return stream.writeStream.foreachBatch(divide).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest(spark: SparkSession, source: str, target: str, schema: StructType, checkpoint: str, partitions: list[str]) -> StreamingQuery:
    """Load new JSON-array files exactly once into a partitioned table; a rerun goes on where the last one stopped."""
    rows = spark.readStream.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(source)
    return rows.writeStream.format("parquet").partitionBy(*partitions).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(target)


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Rows that the stream gives for all that is there now, as a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/drained-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:  # in complete mode each batch has the whole result, and the last one counts
        batch.write.mode("overwrite").parquet(f"{path}/rows" if mode == "complete" else f"{path}/rows/batch={number}")

    query = stream.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
