"""Operator 2: token counts by overlap resynchronisation.

A document longer than ``chunk_chars`` is encoded in chunks that overlap. Neighbours
are spliced at a stable common boundary: a white space after a non-space character
where both encodings begin a token. The pre-tokenising pattern has no alternative that
spans such a place and looks at nothing before it, so a match begins there whatever
came earlier, and the encodings agree from there on. If the overlap holds no such
place, it is doubled until it does or until it reaches the end of the document.
Memory for ids is bounded by the chunk, not by the document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_files import JsonTokenizer, json_tokenizer
from .common import arrow_map

_STABLE = re.compile(r"(?<=\S)\s")


def splice(text: str, tok: JsonTokenizer, chunk_chars: int, overlap_chars: int) -> Iterator[list[int]]:
    """The ids of a text, in pieces whose concatenation equals encoding it at once."""
    n, start = len(text), 0
    if n <= chunk_chars or tok.slow is not None:
        yield tok.encode(text)
        return
    while True:
        end = start + chunk_chars
        overlap = overlap_chars
        cut = None
        while end < n:
            stop = min(n, end + overlap)
            left, right = tok.encode(text[start:stop]), tok.encode(text[end:stop])
            starts = np.concatenate(([0], np.cumsum(tok.lengths[left])))
            others = np.concatenate(([0], np.cumsum(tok.lengths[right])))
            base = len(text[start:end].encode())
            for m in _STABLE.finditer(text, end, stop):
                rel = len(text[end : m.start()].encode())
                i, j = np.searchsorted(starts, base + rel), np.searchsorted(others, rel)
                if starts[i] == base + rel and others[j] == rel:
                    cut = (int(i), m.start())
                    break
            if cut or stop == n:
                break
            overlap *= 2  # alignment failed: widen
        if cut is None:
            yield tok.encode(text[start:])
            return
        yield left[: cut[0]]
        start = cut[1]


def count_tokens(
    df: DataFrame,
    tokenizer_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    chunk_chars: int = 4096,
    overlap_chars: int = 256,
) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows and ids give one row
    each; an empty table gives an empty result; other columns are not read.
    """

    def make():
        tok = json_tokenizer(tokenizer_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            counts = [sum(map(len, splice(t, tok, chunk_chars, overlap_chars))) if t else 0 for t in texts]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts])],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)
