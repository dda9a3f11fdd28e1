"""Tables that a computation writes for itself and reads back."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_folders: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``); a temporary one only where none is set and the master is local."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            base = current.get()
        elif sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            base = "file://" + tempfile.mkdtemp(prefix="strataflow-")
            sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below one folder an application that goes when the driver ends."""
    folder = f"{shared_folder(spark)}/strataflow/{spark.sparkContext.applicationId}"
    if folder not in _folders:
        _folders.add(folder)
        atexit.register(_remove, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    """Delete ``path``; what cannot be deleted (the session has ended) is left to the folder's owner."""
    with contextlib.suppress(Exception):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, on any file system."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads."""
    for df in frames:
        _remove(df.sparkSession, df._scratch)


def numbered(df: DataFrame, order: list, name: str = "number") -> DataFrame:
    """``df`` with its rows numbered from 1 by ``order`` (columns), range by range: no task holds all rows.

    Rows that tie get numbers in any order, each its own.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = materialize(df.repartitionByRange(*keys).withColumn("sf_part", F.spark_partition_id()), "dealt")
    before = Window.orderBy("sf_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    starts = dealt.groupBy("sf_part").agg(F.count(F.lit(1)).alias("sf_rows")).withColumn("sf_before", F.coalesce(F.sum("sf_rows").over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("sf_part").orderBy(*keys))
    out = dealt.withColumn(name, within).join(F.broadcast(starts.select("sf_part", "sf_before")), "sf_part")
    return out.withColumn(name, F.col(name) + F.col("sf_before")).drop("sf_part", "sf_before")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
