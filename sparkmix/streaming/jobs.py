"""Incremental ingest and streaming analysis."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.joins import resume_pending
from ..plans.analyze import analyze
from ..sources.tables import exists, remove


def checkpoint_readable(spark: SparkSession, checkpoint: str) -> bool:
    """Whether a stream can go on from a checkpoint: its id and the heads of its logs can be read. An absent one counts as readable."""
    if not exists(spark, f"{checkpoint}/metadata"):
        return not exists(spark, f"{checkpoint}/offsets")
    whole = spark.read.option("wholetext", True)
    try:
        ids = whole.text(f"{checkpoint}/metadata").select(F.get_json_object("value", "$.id").alias("id"))
        if not ids.filter("id is not null").count():
            return False
        logs = [f"{checkpoint}/{log}" for log in ("offsets", "commits") if exists(spark, f"{checkpoint}/{log}")]
        return all(not whole.text(log).filter("value not like 'v1%'").count() for log in logs)
    except (PySparkException, Py4JJavaError):
        return False


def ingest_incremental(
    spark: SparkSession, src: str, dst: str, checkpoint: str, schema: str, select: Callable[[DataFrame], DataFrame] | None = None, force: bool = False
) -> StreamingQuery:
    """Take in the shards that earlier runs have not, and end. Which are done is kept in the checkpoint folder.

    ``force``, or a checkpoint that cannot be read, starts afresh: checkpoint and output are
    removed and all shards taken in, so none is lost or doubled.
    """
    if force or not checkpoint_readable(spark, checkpoint):
        remove(spark, checkpoint)
        remove(spark, dst)
    rows = spark.readStream.schema(schema).parquet(src)
    out = select(rows) if select else rows
    query = out.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def score_resumable(stream: DataFrame, score: Callable[[DataFrame], DataFrame], dst: str, checkpoint: str, key: str, media: DataFrame | None = None, file_col: str = "file") -> StreamingQuery:
    """Score arriving rows whose key has no result in ``dst`` yet; each micro-batch is appended.

    With ``media``, a listing with ``path``, rows whose ``file_col`` is not in it are skipped; they are scored when they arrive again.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if media is not None:
            batch = batch.join(media.select(F.col("path").alias(file_col)).distinct(), file_col, "left_semi")
        done = spark.read.parquet(dst) if exists(spark, dst) else None
        score(resume_pending(batch, done, key) if done is not None else batch).write.mode("append").parquet(dst)

    query = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def analyze_stream(stream: DataFrame, dst: str, checkpoint: str, text_col: str = "text") -> StreamingQuery:
    """The text analysis on arriving rows: narrow operators only, so no state and no watermark."""
    query = analyze(stream, text_col).writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
