"""Operator 5: packing along a space-filling curve.

Each document's token ids are projected to a few dimensions by fixed random weights and
put on a Hilbert curve. Documents are sorted by range along the curve and their ids laid
end to end, so a sequence holds neighbouring documents and only the last one is padded.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_files import json_tokenizer
from .common import Scratch, arrow_map
from .ranges import order_and_sum


def hilbert_index(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of coordinates in [0, 2**bits), after Skilling's transpose form."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for i in range(dims):
            flip = (x[i] & step) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn ^= np.where(x[dims - 1] & step, step - 1, 0)
        step >>= 1
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def curve_keys(id_lists: list[np.ndarray], weights: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert key of each list of ids: the mean of its ids' weights, spread over the cells of a grid."""
    mean = np.stack([weights[ids].mean(0) for ids in id_lists]) if id_lists else np.zeros((0, weights.shape[1]))
    cells = np.clip((np.tanh(4 * mean) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert_index(cells, bits)


def tokenise_for_packing(df: DataFrame, tokenizer_path: str, pattern: str, end_id: int, id_col: str, text_col: str, dims: int, bits: int, seed: int) -> DataFrame:
    """(id, ids binary of little-endian unsigned 16- or 32-bit ids with the end id, n, curve)."""

    def make():
        tok = json_tokenizer(tokenizer_path, pattern)
        size = max(tok.size, end_id + 1)
        kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        weights = np.random.default_rng(seed).standard_normal((size, dims)).astype(np.float32)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [np.array([*(tok.encode(t) if t else ()), end_id], kind) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64()), pa.array(curve_keys(ids, weights, bits), pa.int64())],
                ["id", "ids", "n", "curve"],
            )

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, ids binary, n long, curve long", rows=64)


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    pattern: str,
    end_id: int = 1,
    length: int = 2048,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: int = 4,
    bits: int = 10,
    ranges: int = 1024,
    seed: int = 7,
    with_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids array<int>]), one row for each piece.

    A document is its ids followed by ``end_id``, so a null or empty text is one id.
    Every id lies in one piece; offsets in a sequence have no gap; all sequences but the
    last are full. Repeated rows are packed as often as they occur; an empty table gives
    an empty result; other columns are not read. ``dims * bits`` may be 40 at most.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    tokens = tokenise_for_packing(df, tokenizer_path, pattern, end_id, id_col, text_col, dims, bits, seed)
    tokens = scratch.save(tokens.withColumn("row", F.monotonically_increasing_id()), "tokens")
    order = scratch.save(
        tokens.select(
            "row",
            "n",
            (F.shiftleft(F.col("curve"), 22) + F.pmod(F.xxhash64("row"), F.lit(1 << 22))).alias("sort_key"),
            F.xxhash64("row", F.lit("tie")).alias("tie"),
        ),
        "curve",
    )
    places = order_and_sum(order, "n", scratch, ranges).select("row", F.col("weight_before").alias("at"))
    joined = tokens.select("row", "id", "ids", "n").join(places, "row").select("id", "ids", "n", "at")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for key, raw, n, at in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, length)
                    stop = min(n, start + length - offset)
                    part = ids[start:stop]
                    out.append((key, start, stop - start, zlib.crc32(part.tobytes()), n, sequence, offset, *([part.tolist()] if with_ids else [])))
                    start = stop
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if with_ids else [])]
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if with_ids else [])]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

        return step

    return arrow_map(joined, make, schema).withColumnRenamed("id", id_col)
