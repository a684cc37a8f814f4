"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word pattern of every operator: runs of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Where that is unset a folder on this machine is made and set for the rest
    of the session, but only where driver and executors are one machine (tests); elsewhere it is an error.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tarifa.shared.dir", None)
    if not where:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="tarifa-shared-")
        spark.conf.set("tarifa.shared.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses; ``forget`` removes it."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


#: Paths that ``scratch`` gave in this process.
_made: list[str] = []


def made() -> int:
    """How many paths ``scratch`` has given: a mark for ``forget``."""
    return len(_made)


def forget(spark: SparkSession, since: int = 0, keep: Sequence[str] = ()) -> int:
    """Remove what this process wrote into the shared folder after the mark ``since``, but for the names in ``keep``; how many paths.

    Tables that still read them are gone afterwards: for when the results have been read or written.
    """
    jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    gone = [p for p in _made[since:] if not p.rpartition("/")[2].startswith(tuple(f"{k}-" for k in keep))] if keep else _made[since:]
    for path in gone:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
        _made.remove(path)
    return len(gone)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """What tasks read a file of the shared folder with, and its path there; the folder may be any that pyarrow can open."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return pafs.LocalFileSystem(), "/" + (rest or path).lstrip("/")
    return pafs.FileSystem.from_uri(path)


#: Rows and bytes of an Arrow batch between Spark and Python: texts are long, and a batch is held several times.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; from now on its session sends at most ``BATCH_ROWS`` rows, or about ``BATCH_BYTES``, to Python at once.

    Spark has these bounds as settings of the session alone; smaller ones are left as they are.
    """
    conf = df.sparkSession.conf
    if not 0 < int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= BATCH_ROWS:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "67108864b":  # Spark's own, where nothing was set
        conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    This cuts the lineage: later stages and retries read the files, so the loss of an
    executor costs one task and not the stages before.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(df: DataFrame, columns: Sequence[str] = ("doc_id", "text")) -> DataFrame:
    """The named columns alone, so that extra columns can't clash with the operators' own."""
    return bounded_batches(df).select(*[F.col(c) for c in columns])


def text_or_empty(column: str | Column = "text") -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
