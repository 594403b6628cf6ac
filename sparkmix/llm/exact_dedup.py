"""Operator 13: exact dedup with a heavy-hitter split. DataFrame functions only.

Texts become digests in one scan. Misra-Gries counters, one bounded set in each task, name every
digest that can hold a large share of the rows; an exact count verifies them, and the few that are
frequent are broadcast with their winning row, so their copies never shuffle. All other digests
are grouped by an ordinary shuffle, in which no group is large.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, free_name, whole_text

#: A digest in at least this share of the rows is split off. At most ``1 / FREQUENT`` digests are, whatever the table's size.
FREQUENT = 1 / 1024


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(whole_text(text), r"[\x20\x09-\x0D]+", " ")


def _digests(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, row, digest); ``row`` numbers the rows, so that rows that are equal in all columns still differ once this is written."""
    digest = F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256))
    return df.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("row"), digest.alias("digest"))


def _winner() -> tuple[Column, Column]:
    """Of a group, the row with the smallest id (a null id comes last, then the first row), and the group's size."""
    return F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row")).alias("winner"), F.count("*").alias("size")


def frequent_digests(rows: DataFrame, share: float = FREQUENT) -> DataFrame:
    """(digest, winner, size) of every digest in at least ``share`` of the rows.

    Misra-Gries counters miss none that is as frequent as that; they run over 64-bit marks, and all that
    they name is counted again by whole digests. At most ``1 / share`` rows, as shares add up to one.
    """
    mark = F.xxhash64("digest")
    named = rows.select(mark.alias("mark")).freqItems(["mark"], share / 2).select(F.explode("mark_freqItems").alias("mark"))
    counts = rows.join(F.broadcast(named), mark == F.col("mark")).groupBy("digest").agg(*_winner())
    return counts.filter(F.col("size") >= rows.count() * share)


def _grouped(rows: DataFrame, scratch: Scratch, share: float) -> DataFrame:
    """``rows`` with the winner and size of their group."""
    heavy = scratch.save(frequent_digests(rows, share), "frequent")
    rest = rows.join(F.broadcast(heavy.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(*_winner())
    return rows.join(F.broadcast(heavy), "digest").unionByName(rest.join(groups, "digest"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FREQUENT) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256), one row for each row of ``df``.

    Texts are equal when they are identical after each run of ASCII white space has become one space; null
    counts as empty. Of equal texts the row with the smallest id stays, an id before none; of rows that share
    that id too, one. Very long texts are digested whole. An empty table gives an empty result, and other
    columns, whatever their names, are not read.
    """
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(_digests(df, id_col, text_col), "digests")
    return _grouped(rows, scratch, share).select(
        F.col("id").alias(id_col),
        F.col("winner.id").alias("keep_id"),
        F.col("size").alias("group_size"),
        (F.col("row") == F.col("winner.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = FREQUENT) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns as they were; cases as in ``exact_duplicates``.

    Copies of frequent texts are left out where they are read; of the rest only those that stay meet their row again.
    """
    scratch = Scratch(df.sparkSession)
    names = df.columns
    box = free_name([id_col, text_col], "box")
    boxed = scratch.save(df.select(F.struct(*names).alias(box), F.monotonically_increasing_id().alias("row"), F.unhex(F.sha2(normalised(F.col(text_col)).cast("binary"), 256)).alias("digest")), "rows")
    rows = boxed.select(F.col(box)[id_col].alias("id"), "row", "digest")
    stay = _grouped(rows, scratch, share).filter("row = winner.row").select("row")
    return boxed.join(stay, "row", "left_semi").select(*[F.col(box)[c].alias(c) for c in names])
