"""Exact order statistics by repeated histograms.

Every pass is one aggregate: each value between the bounds in which a wanted place is known to lie counts in one of a fixed
number of buckets, and the bucket that holds the place gives the next bounds. Nothing is sorted, no table of distinct values is
made, and a task holds ``BUCKETS`` counts for each place, whatever the number of values.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Buckets of equal width in a pass; and bounds of buckets that are equal in the doubles they hold, for values that crowd in one bucket.
BUCKETS, SPLITS = 4096, 64


@dataclass(frozen=True)
class Bracket:
    """Values of a column from low to high; ``below`` are less than low."""

    col: str
    low: float
    high: float
    below: int
    by_order: bool = False


def _ordinal(x: float) -> int:
    """The place of a double among all doubles."""
    bits = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _double(ordinal: int) -> float:
    bits = ordinal if ordinal >= 0 else -ordinal | (1 << 63)
    return struct.unpack("<d", struct.pack("<Q", bits))[0]


def _bucket(b: Bracket, v: Column) -> Column:
    half = b.high / 2 - b.low / 2  # halves, so that the width of all doubles doesn't overflow
    if b.by_order or half / BUCKETS == 0:
        low, high = _ordinal(b.low), _ordinal(b.high)
        bounds = sorted({_double(low + (high - low) * i // SPLITS) for i in range(1, SPLITS + 1)})
        return F.size(F.filter(F.array(*[F.lit(x) for x in bounds]), lambda x: x <= v))
    return F.least(F.lit(BUCKETS - 1), F.floor((v / 2 - F.lit(b.low / 2)) / F.lit(half) * BUCKETS)).cast("int")


def values_at(df: DataFrame, cols: list[str], places: Callable[[int], list[int]], *stats: Column) -> tuple[Row, dict[str, list[float | None]]]:
    """A row of ``stats`` with ``n_<col>``, the number of values, and for each column the values at ``places(n)``, from 0, in ascending order.

    Columns count as doubles; null and NaN are left out. Exact for any distribution: a bucket that keeps most values is divided
    by the order of the doubles next, which ends after eleven passes at most. A column without values has none at any place.
    """
    number = {c: F.col(c).cast("double") for c in cols}
    fits = {c: v.isNotNull() & ~F.isnan(v) for c, v in number.items()}
    finite = {c: fits[c] & (F.abs(v) < math.inf) for c, v in number.items()}
    aggs = list(stats)
    for c, v in number.items():
        aggs += [F.count_if(fits[c]).alias(f"n_{c}"), F.count_if(fits[c] & (v == -math.inf)).alias(f"under_{c}"), F.count_if(finite[c]).alias(f"k_{c}")]
        aggs += [F.min(F.when(finite[c], v)).alias(f"low_{c}"), F.max(F.when(finite[c], v)).alias(f"high_{c}")]
    first = df.agg(*aggs).first()
    wanted: dict[tuple[str, int], Bracket] = {}
    found: dict[tuple[str, int], float | None] = {}
    for c in cols:
        under, k = first[f"under_{c}"], first[f"k_{c}"]
        for place in places(first[f"n_{c}"]) if first[f"n_{c}"] else []:
            if place < under or place >= under + k:
                found[c, place] = -math.inf if place < under else math.inf
            elif first[f"low_{c}"] == first[f"high_{c}"]:
                found[c, place] = first[f"low_{c}"]
            else:
                wanted[c, place] = Bracket(c, first[f"low_{c}"], first[f"high_{c}"], under)
    while wanted:
        brackets = list(dict.fromkeys(wanted.values()))
        each = [
            F.when(finite[b.col] & number[b.col].between(b.low, b.high), F.struct(F.lit(i).alias("i"), _bucket(b, number[b.col]).alias("bucket"), number[b.col].alias("v"))) for i, b in enumerate(brackets)
        ]
        counts = df.select(F.inline(F.array_compact(F.array(*each)))).groupBy("i", "bucket").agg(F.count("*").alias("k"), F.min("v").alias("low"), F.max("v").alias("high"))
        rows: dict[Bracket, list[Row]] = {b: [] for b in brackets}
        for r in counts.collect():  # at most BUCKETS rows for each place
            rows[brackets[r.i]].append(r)
        for key, b in list(wanted.items()):
            own, below = sorted(rows[b], key=lambda r: r.low), b.below
            total = sum(r.k for r in own)
            for r in own:
                if key[1] < below + r.k:
                    break
                below += r.k
            if r.low == r.high:
                found[key] = r.low
                del wanted[key]
            else:
                wanted[key] = Bracket(b.col, r.low, r.high, below, r.k * (2 if b.by_order else 16) > total)
    return first, {c: [found[c, p] for p in (places(first[f"n_{c}"]) if first[f"n_{c}"] else [])] for c in cols}
