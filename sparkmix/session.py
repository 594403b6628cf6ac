"""What jobs need from the session: the package in Python workers, and tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _place(spark: SparkSession, path: str):
    """A path and its file system, as Spark sees them."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, files = _place(spark, path)
    return files.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    where, files = _place(spark, path)
    files.delete(where, True)


def shared_folder(spark: SparkSession) -> str:
    """Path of a new folder under ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
    return f"{root.rstrip('/')}/work-{uuid.uuid4().hex}"


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


def written(df: DataFrame) -> DataFrame:
    """``df``, computed once and read again from the shared folder; a lost executor costs a reread."""
    path = f"{shared_folder(df.sparkSession)}/rows"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
