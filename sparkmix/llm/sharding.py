"""Operator 6: sharding by sampled splitters. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, whole_text
from .ranges import order_and_sum

#: Bytes that each record takes beside its text.
RECORD_BYTES = 16


def assign_shards(df: DataFrame, shards: int = 40, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", ranges: int = 1024) -> DataFrame:
    """(id, size, text_crc32, law, shard, slot, grown_shard), one row for each record.

    Records are ordered by a hash of the text and then of the id, so equal texts lie
    side by side and a large group of them can be cut anywhere. Under ``bytes`` a record
    goes to the shard in which the middle of its bytes falls: shards differ by one
    record's size at most. Under ``rows`` counts differ by one at most. ``slot`` counts
    from 0 in each shard. A null text has no bytes and the checksum of nothing; repeated
    rows keep their own slots; an empty table gives an empty result; other columns are not read.
    """
    if law not in ("bytes", "rows"):
        raise ValueError(f"unknown law {law}")
    scratch = Scratch(df.sparkSession)
    text = whole_text(text_col)
    rows = scratch.save(
        df.select(
            F.col(id_col).alias("id"),
            (F.octet_length(text) + RECORD_BYTES).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftright(F.xxhash64(text), 20).alias("head"),
        ).select(
            "id",
            "size",
            "text_crc32",
            (F.shiftleft(F.col("head"), 20) + F.pmod(F.xxhash64("id"), F.lit(1 << 20))).alias("sort_key"),
            F.xxhash64("id", F.lit("tie")).alias("tie"),
            F.lit(1).cast("bigint").alias("one"),
        ),
        "sizes",
    )
    weight = "size" if law == "bytes" else "one"
    ordered = order_and_sum(rows, weight, scratch, ranges)
    if law == "bytes":
        shard = F.expr(f"((2 * weight_before + size) * {shards}) div (2 * weight_total)")
    else:
        shard = F.expr(f"(rows_before * {shards}) div rows_total")
    placed = scratch.save(ordered.select("id", "size", "text_crc32", "rows_before", shard.cast("int").alias("shard")), "placed")
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))  # a row for each shard
    return placed.join(F.broadcast(first), "shard").select(
        F.col("id").alias(id_col),
        "size",
        "text_crc32",
        F.lit(law).alias("law"),
        "shard",
        (F.col("rows_before") - F.col("first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(df: DataFrame, path: str, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the records of ``df`` with their shard and slot, one folder for each shard, in files of consecutive slots.

    Ids must be unique; a null id is one of them. Columns of the caller named shard or slot stay,
    and the new ones get underscores behind their names. An empty table writes no folder.
    """
    shard = free_name(df.columns, "shard")
    slot = free_name(df.columns, "slot")
    key = free_name(df.columns, "key")
    places = assign_shards(df, shards, "bytes", id_col, text_col).select(F.col(id_col).alias(key), F.col("shard").alias(shard), F.col("slot").alias(slot))
    placed = df.join(places, F.col(id_col).eqNullSafe(F.col(key))).drop(key)
    placed.repartitionByRange(shard, slot).sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)
