"""Tables bucketed by a key, so that joins and groups by that key need no shuffle, however often they are repeated."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import shared_folder


def write_bucketed(df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None) -> DataFrame:
    """``df`` as a table of ``buckets`` files of sorted keys for each writing task, and that table.

    Tables that are to meet without a shuffle need the same number of buckets: about the bytes of the larger one over those that
    a task should read. The rows are dealt to the buckets first, so that each is one file.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(spark)}/{name}"
    dealt = df.repartition(buckets, key)
    dealt.write.bucketBy(buckets, key).sortBy(key).option("path", path).mode("overwrite").saveAsTable(name)
    return spark.table(name)


def drop_bucketed(spark: SparkSession, name: str) -> None:
    """Forget a table; its files stay where they are."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
