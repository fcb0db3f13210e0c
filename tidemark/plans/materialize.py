"""Cutting lineage with tables in the shared folder, and broadcasts of a checked size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []

#: A side with more rows than this is joined by shuffle.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; on one machine a temporary one of our own where the session names none. A cluster must name one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_before = context._jsc.sc().getCheckpointDir()
    if set_before.isDefined():
        return set_before.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    context.setCheckpointDir(own)
    return own


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """Write df once as parquet into the shared folder and read it back.

    The result survives lost executors and is column-pruned by each of its readers. Files are dropped by release() or when
    the interpreter ends.
    """
    spark = df.sparkSession
    path = own_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def own_folder(spark: SparkSession, label: str) -> str:
    """A new name for a folder in the shared folder, deleted by release()."""
    path = f"{shared_dir(spark)}/tidemark-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def release() -> None:
    """Delete what materialize() wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            jvm = spark._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session is gone
            pass


atexit.register(release)


def small(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most `limit` rows, else as it is, for a shuffled join.

    df must be cheap to count, such as a materialised table (parquet footers); rows: its size, if known.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt to as many partitions as there are cores, if its files give fewer: for work that costs much more per row than moving it.

    Tables of many files or row groups are left as they are, so that large ones are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df
