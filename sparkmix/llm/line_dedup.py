"""Operator 4: line dedup with two Bloom filters.

The first pass builds two filters of line hashes: seen in one document, seen in two.
The second pass shuffles only lines that the second filter suspects; a count of their
whole keys confirms which are common. The last pass drops those lines.
Filters have no false negatives, so the result is exact at any fill.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import Scratch, arrow_map, free_name, ship_package

#: Bits for each line, and the bounds of a filter's size in bits. Beyond the upper bound
#: (2**28 bits, 32 MB) more lines are suspected and shuffled; nothing else changes.
BITS_PER_LINE, LEAST_BITS, MOST_BITS = 8, 1 << 16, 1 << 28
CHUNK_BYTES = 1 << 16
#: Common keys are broadcast up to so many bytes and keys; beyond, they are joined.
BROADCAST_BYTES, BROADCAST_KEYS = 16 << 20, 200_000


def line_keys(text: str) -> list[bytes]:
    """Key of each line: bytes without white space at both ends, A-Z in lower case."""
    return [line.strip() for line in text.encode().lower().split(b"\n")]


def _spots(keys: set[bytes], bits: int) -> np.ndarray:
    """Two bit numbers for each key."""
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))
    return np.stack([h & np.uint64(bits - 1), (h >> np.uint64(32)) & np.uint64(bits - 1)]).astype(np.int64)


class TwoFilters:
    def __init__(self, n_bytes: int):
        self.once = np.zeros(n_bytes, np.uint8)
        self.twice = np.zeros(n_bytes, np.uint8)

    def add(self, spots: np.ndarray) -> None:
        """Add one document's distinct keys."""
        byte, bit = spots >> 3, (1 << (spots & 7)).astype(np.uint8)
        known = ((self.once[byte] & bit) != 0).all(0)
        np.bitwise_or.at(self.twice, byte[:, known], bit[:, known])
        np.bitwise_or.at(self.once, byte, bit)

    def merge(self, once: np.ndarray, twice: np.ndarray) -> None:
        self.twice |= twice | (self.once & once)
        self.once |= once


def _build(texts: DataFrame, bits: int) -> np.ndarray:
    """The filter of keys suspected to be in two documents or more."""
    ship_package(texts.sparkSession)
    n_chunks = max(1, bits // 8 // CHUNK_BYTES)
    size = bits // 8 // n_chunks

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = TwoFilters(bits // 8)
        for batch in batches:
            for text in batch.column(0):
                keys = set(line_keys(text.as_py() or ""))
                keys.discard(b"")
                if keys:
                    filters.add(_spots(keys, bits))
        for i in range(n_chunks):
            once, twice = (f[i * size : (i + 1) * size] for f in (filters.once, filters.twice))
            if once.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary())],
                    ["chunk", "once", "twice"],
                )

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(at: int, filters: TwoFilters) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(filters.twice.tobytes(), 1)], pa.binary())], ["chunk", "twice"])

        at, filters = -1, TwoFilters(size)
        for batch in batches:
            for chunk, once, twice in zip(*(batch.column(i) for i in range(3)), strict=True):
                if chunk.as_py() != at:
                    if at >= 0:
                        yield out(at, filters)
                    at, filters = chunk.as_py(), TwoFilters(size)
                filters.merge(*(np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (once, twice)))
        if at >= 0:
            yield out(at, filters)

    chunks = (
        texts.mapInArrow(partial, "chunk int, once binary, twice binary")
        .repartition("chunk")
        .sortWithinPartitions("chunk")
        .mapInArrow(merged, "chunk int, twice binary")
    )
    whole = np.zeros(bits // 8, np.uint8)
    for chunk, twice in chunks.toLocalIterator():  # bounded: the filter's size
        whole[chunk * size : (chunk + 1) * size] = np.frombuffer(zlib.decompress(bytes(twice)), np.uint8)
    return whole


def common_lines(df: DataFrame, text_col: str, min_docs: int, most_bits: int = MOST_BITS, keep: str = "none", id_col: str | None = None) -> DataFrame:
    """(key binary, n_docs[, first]) of the line keys in at least ``min_docs`` rows; ``first`` is the smallest id that has one."""
    texts = df.select(F.col(text_col).alias("text"), *([F.col(id_col).alias("id")] if keep == "first" else []))
    lines = texts.agg(F.sum(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)).first()[0] or 0
    bits = min(most_bits, max(LEAST_BITS, 1 << (int(lines) * BITS_PER_LINE - 1).bit_length() if lines else 0))
    filter_bytes = texts.sparkSession.sparkContext.broadcast(_build(texts.select("text"), bits).tobytes())
    id_kind = df.schema[id_col].dataType.simpleString() if keep == "first" else None

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        twice = np.frombuffer(filter_bytes.value, np.uint8)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: list[bytes] = []
            owner: list[int] = []
            for row, text in enumerate(batch.column(0).to_pylist()):
                keys = set(line_keys(text or ""))
                keys.discard(b"")
                if keys:
                    spots = _spots(keys, bits)
                    hit = ((twice[spots >> 3] >> (spots & 7).astype(np.uint8)) & 1).all(0)
                    mine = [k for k, h in zip(keys, hit.tolist(), strict=True) if h]
                    found += mine
                    owner += [row] * len(mine)
            cols = [pa.array(found, pa.binary())]
            if keep == "first":
                cols.append(batch.column(1).take(pa.array(owner, pa.int64())))
            return pa.RecordBatch.from_arrays(cols, ["key", "id"][: len(cols)])

        return step

    suspects = arrow_map(texts, make, "key binary" + (f", id {id_kind}" if keep == "first" else ""))
    aggs = [F.count("*").alias("n_docs"), *([F.min("id").alias("first")] if keep == "first" else [])]
    return suspects.groupBy("key").agg(*aggs).filter(F.col("n_docs") >= min_docs)


def drop_common_lines(
    df: DataFrame,
    min_docs: int = 10,
    text_col: str = "text",
    id_col: str = "doc_id",
    keep: str = "none",
    counts: tuple[str, str] = ("n_lines", "n_dropped"),
    broadcast_bytes: int = BROADCAST_BYTES,
    most_bits: int = MOST_BITS,
) -> DataFrame:
    """``df`` with every common line taken out of ``text_col``, and two counts of lines.

    A line is common if its key, of one code point at least, is in ``min_docs`` rows or
    more. ``keep='first'`` leaves its first line in the rows of the smallest id that has it.
    A null or empty text is one empty line, and null becomes an empty text. Empty lines
    are never common. A key counts once for each row, so repeated rows count as
    documents of their own. An empty table gives an empty result. Columns that are named
    like the counts are replaced; all others are kept.
    """
    if keep not in ("none", "first"):
        raise ValueError(f"unknown keep {keep}")
    scratch = Scratch(df.sparkSession)
    df = df.drop(*counts)
    common = scratch.save(common_lines(df, text_col, min_docs, most_bits, keep, id_col), "common")
    n, size = common.agg(F.count("*"), F.sum(F.octet_length("key"))).first()
    names = df.columns
    at_text, at_id = names.index(text_col), names.index(id_col)
    first = keep == "first"

    def rewrite(batch: pa.RecordBatch, lookup: Callable[[int], dict]) -> pa.RecordBatch:
        out, lines, dropped = [], [], []
        ids = batch.column(at_id).to_pylist() if first else [None] * batch.num_rows
        for row, (text, own) in enumerate(zip(batch.column(at_text).to_pylist(), ids, strict=True)):
            parts, keys, known = (text or "").split("\n"), line_keys(text or ""), lookup(row)
            left: set[bytes] = set()
            stay = []
            for part, key in zip(parts, keys, strict=True):
                if key in known and not (first and known[key] == own and key not in left):
                    continue
                left.add(key)
                stay.append(part)
            out.append("\n".join(stay))
            lines.append(len(parts))
            dropped.append(len(parts) - len(stay))
        cols = [batch.column(i) for i in range(len(names))]
        cols[at_text] = pa.array(out, pa.string())
        return pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, *counts])

    schema = StructType([*df.schema, *(StructField(c, LongType()) for c in counts)])
    if n <= BROADCAST_KEYS and (size or 0) <= broadcast_bytes:
        found = df.sparkSession.sparkContext.broadcast({bytes(r[0]): r[2] if first else None for r in common.collect()})

        def make():
            known = found.value
            return lambda batch: rewrite(batch, lambda row: known)

        return arrow_map(df, make, schema)

    # Too many to broadcast: give each text its own common keys by joins.
    texts = df.select(F.col(text_col).alias("text")).filter("text is not null").distinct()
    mark = F.sha2(F.col("text"), 256)

    def explode_make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = [(m, k) for m, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in set(line_keys(t)) if k]
            cols = list(zip(*rows, strict=True)) or [(), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.binary())], ["mark", "key"])

        return step

    lines = arrow_map(texts.select(mark.alias("mark"), "text"), explode_make, "mark string, key binary")
    own = lines.join(common, "key").groupBy("mark").agg(F.collect_list(F.struct("key", *(["first"] if first else []))).alias("found"))
    boxed = df.select(F.struct(*names).alias("row"), F.sha2(F.col(text_col), 256).alias("mark"))  # boxed, so that no name clashes
    wide = boxed.join(own, "mark", "left").select(*[F.col("row")[c].alias(c) for c in names], F.col("found").alias(free_name(names, "found")))

    def join_make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [{r["key"]: r.get("first") for r in x or []} for x in batch.column(len(names)).to_pylist()]
            return rewrite(batch, found.__getitem__)

        return step

    return arrow_map(wide, join_make, schema)
