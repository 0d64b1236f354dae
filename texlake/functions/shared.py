"""Tables in the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a new temporary one in local mode, and an error on a cluster."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="texlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: its lineage is cut, and lost executors cost nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._texlake_path = path
    return out


def spread(df: DataFrame, *keys: str, per_core: int = 32 << 20) -> DataFrame:
    """``df``, dealt out by ``keys`` over all cores if it is too small for as many splits of its own.

    A file of one row group is one task, however many cores wait. What moves is at most ``per_core`` bytes a core; a
    larger table has splits enough and stays where it is.
    """
    context = df.sparkSession.sparkContext
    cores = context.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores, *keys) if cores > 1 and size < cores * per_core else df


def drop(*frames: DataFrame) -> None:
    """Delete the folders of written tables that nothing will read any more."""
    for frame in frames:
        path = getattr(frame, "_texlake_path", None)
        if path:
            context = frame.sparkSession.sparkContext
            place = context._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)
