"""Sampled splitters: exact running sums over a global order, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch

#: Sampled keys for each range, on average.
OVERSAMPLE = 16
#: Fine ranges under each coarse one; a row compares with two short lists instead of all boundaries.
FAN = 32
#: Rows of a part of a range, about; a range with more is divided, so parts grow in number and not in size.
PART_ROWS = 1 << 20


def _below(bounds: Column, key: Column) -> Column:
    return F.size(F.filter(bounds, lambda b: b <= key))


def order_and_sum(rows: DataFrame, weight: str, scratch: Scratch, ranges: int = 1024, key: str = "sort_key", tie: str = "tie", part_rows: int = PART_ROWS) -> DataFrame:
    """Adds weight_before, rows_before, weight_total and rows_total in the order of (key, tie).

    ``rows`` is a written table with a bigint ``key`` and ``tie``. Keys are sampled with
    probability in proportion to their share, half of it of the weight and half of the
    rows, so that neither heavy rows nor very many light ones fill a range; at most
    ``ranges * 16`` are expected, and their quantiles bound the ranges. A range that
    still holds over twice the mean, or more than ``part_rows`` rows, is divided by a hash of
    the tie. Totals of the parts, one row for each part, give each its offset; inside a part a
    window sums the rows. Equal (key, tie) rows follow each other in any order.
    """
    total, n = rows.agg(F.sum(weight), F.count("*")).first()
    out_names = ["weight_before", "rows_before", "weight_total", "rows_total"]
    if not n:
        return rows.select("*", *[F.lit(None).cast("bigint").alias(c) for c in out_names])
    total = int(total or 0)
    want = ranges * OVERSAMPLE
    share = lambda w, k: w * F.lit(0.5 / max(total, 1)) + k * F.lit(0.5 / n)
    chance = (F.pmod(F.xxhash64(key, tie, F.lit("sample")), F.lit(1 << 53)) / F.lit(float(1 << 53))).cast("double")
    picked = rows.filter(chance < share(F.col(weight), F.lit(1)) * want).select(key)
    bounds = [r[0] for r in picked.orderBy(key).collect()][OVERSAMPLE // 2 :: OVERSAMPLE]
    coarse = bounds[FAN - 1 :: FAN]
    fine = [bounds[i : i + FAN - 1] for i in range(0, len(bounds), FAN)] or [[]]
    fine += [[]] * (len(coarse) + 1 - len(fine))
    as_list = lambda xs: F.array(*[F.lit(x).cast("bigint") for x in xs]).cast("array<bigint>")
    top = _below(as_list(coarse), F.col(key)) if coarse else F.lit(0)
    placed = rows.withColumn("top", top)
    placed = placed.withColumn("range", F.col("top") * FAN + _below(F.element_at(F.array(*[as_list(x) for x in fine]), F.col("top") + 1), F.col(key))).drop("top")
    sizes = placed.groupBy("range").agg(F.sum(weight).alias("w"), F.count("*").alias("k"))  # whole numbers: the same whenever it is computed
    parts = sizes.select("range", F.greatest(F.lit(1), F.ceil(share(F.col("w"), F.col("k")) * (len(bounds) + 1) / 2), F.ceil(F.col("k") / part_rows)).alias("parts"))
    placed = placed.join(F.broadcast(parts), "range").withColumn("part", F.pmod(F.xxhash64(tie, F.lit("part")), "parts")).drop("parts")
    offsets = (
        placed.groupBy("range", "part")
        .agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
        .select(
            "range",
            "part",
            (F.sum("w").over(W.orderBy("range", "part")) - F.col("w")).alias("w0"),
            (F.sum("n").over(W.orderBy("range", "part")) - F.col("n")).alias("n0"),
        )
    )
    inside = W.partitionBy("range", "part").orderBy(key, tie)
    upto = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    return (
        placed.join(F.broadcast(offsets), ["range", "part"])
        .withColumns({"weight_before": F.col("w0") + F.sum(weight).over(upto) - F.col(weight), "rows_before": F.col("n0") + F.row_number().over(inside) - 1})
        .withColumns({"weight_total": F.lit(total).cast("bigint"), "rows_total": F.lit(n).cast("bigint")})
        .drop("range", "part", "w0", "n0")
    )
