"""Edit distances of word arrays in time that grows with the errors, and their substitutions, deletions and insertions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import share_package

FAR = 1 << 30
KEPT, CHANGED, DELETED, INSERTED = range(4)


def _row(before: np.ndarray, word: int, hyp: np.ndarray, i: int, band: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs of row ``i`` (from 1) of the table, for columns i - band to i + band, and where the words are equal."""
    low = i - band
    same = np.zeros(len(before), bool)
    first, last = max(1, low), min(len(hyp), i + band)
    if first <= last:
        same[first - low : last - low + 1] = hyp[first - 1 : last] == word
    costs = before + ~same
    costs[:-1] = np.minimum(costs[:-1], before[1:] + 1)
    if low <= 0:
        costs[: -low + 1] = FAR
        costs[-low] = i
    if i + band > len(hyp):
        costs[max(0, len(hyp) - low + 1) :] = FAR
    return np.minimum(np.minimum.accumulate(costs - steps) + steps, FAR), same


def _banded(ref: np.ndarray, hyp: np.ndarray, band: int, every: int) -> tuple[int, list[np.ndarray]]:
    """The distance within a band, exact if it is no more than the band, and every ``every``-th row."""
    steps = np.arange(2 * band + 1)
    row = np.where((steps >= band) & (steps - band <= len(hyp)), steps - band, FAR)
    kept = [row]
    for i in range(1, len(ref) + 1):
        row, _ = _row(row, ref[i - 1], hyp, i, band, steps)
        if i % every == 0:
            kept.append(row)
    at = len(hyp) - len(ref) + band
    return int(row[at]) if 0 <= at < len(row) else FAR, kept


def edit_counts(ref: list, hyp: list) -> tuple[int, int, int, int]:
    """(distance, substitutions, deletions, insertions) of the alignment that, from the end, keeps equal words and else prefers a substitution to a
    deletion to an insertion of equal cost.

    The band about the diagonal doubles until it holds the distance, so time is that of words times errors. Of the rows only about the square root of
    their number are kept; the others are computed again on the way back.
    """
    while ref and hyp and ref[-1] == hyp[-1]:
        ref, hyp = ref[:-1], hyp[:-1]
    if not ref or not hyp:
        return len(ref) + len(hyp), 0, len(ref), len(hyp)
    codes: dict = {}
    a, b = (np.array([codes.setdefault(w, len(codes)) for w in words], np.int32) for words in (ref, hyp))
    n, m = len(a), len(b)
    every, band = max(8, math.isqrt(n)), max(4, abs(n - m))
    distance, kept = _banded(a, b, band, every)
    while distance > band:
        band = min(2 * band, max(n, m))
        distance, kept = _banded(a, b, band, every)
    steps = np.arange(2 * band + 1)
    counts = [0, 0, 0, 0]
    i, j = n, m
    while i and j:
        base = (i - 1) // every * every
        rows, same = [kept[base // every]], [None]
        for k in range(base + 1, i + 1):
            row, equal = _row(rows[-1], a[k - 1], b, k, band, steps)
            rows.append(row)
            same.append(equal)
        while i > base and j:
            at = j - i + band
            before, here = rows[i - 1 - base], rows[i - base]
            if same[i - base][at]:
                kind = KEPT
            else:
                ways = (before[at], before[at + 1] if at + 1 < len(before) else FAR, here[at - 1] if at else FAR)
                kind = CHANGED + ways.index(min(ways))
            counts[kind] += 1
            i -= kind != INSERTED
            j -= kind != DELETED
    return distance, counts[CHANGED], counts[DELETED] + i, counts[INSERTED] + j


def word_errors() -> Callable[[Column, Column], Column]:
    """A function of two columns, arrays of words: struct(distance, substitutions, deletions, insertions); null if one of them is."""
    share_package(SparkSession.active())

    @F.arrow_udf("distance int, substitutions int, deletions int, insertions int")
    def errors(refs: pa.Array, hyps: pa.Array) -> pa.Array:
        found = [None if r is None or h is None else edit_counts(r, h) for r, h in zip(refs.to_pylist(), hyps.to_pylist(), strict=True)]
        names = ["distance", "substitutions", "deletions", "insertions"]
        columns = [pa.array([None if x is None else x[k] for x in found], pa.int32()) for k in range(4)]
        return pa.StructArray.from_arrays(columns, names, mask=pa.array([x is None for x in found]))

    return errors
