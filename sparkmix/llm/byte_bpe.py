"""Operator 3: byte-level BPE encoding and decoding by longest matches with backtracking.

Bytes are mapped to Latin-1 characters, so an Aho-Corasick automaton of all tokens
finds every token of a piece in one pass. The encoder takes the longest token that is
compatible with the one before it and backtracks from dead ends. Two tokens are
compatible if merging their concatenation would leave that boundary standing; the
test walks down the merge trees of the two and is memoised. Each position is given up
at most once, so the work is linear, and the result equals applying merges by rank.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_files import read_ranks
from .common import arrow_map


def merge_parts(word: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Plain merging of a short byte string by ranks under ``below``."""
    parts = [word[i : i + 1] for i in range(len(word))]
    while len(parts) > 1:
        best, at = below, -1
        for i in range(len(parts) - 1):
            r = ranks.get(parts[i] + parts[i + 1], below)
            if r < best:
                best, at = r, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class BytePairCoder:
    """Encodes and decodes by the ranks of a file; a rank is the token's id."""

    #: Pieces remembered in each of two generations.
    MEMO = 200_000

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.words: list[bytes] = [b""] * self.size
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(self.size)]
        self.pairs: dict[tuple[int, int], int] = {}
        self.tree = ahocorasick.Automaton()
        self.compatible: dict[int, bool] = {}
        for word, rank in ranks.items():
            self.words[rank] = word
            if len(word) > 1:
                parts = merge_parts(word, ranks, rank)
                if len(parts) != 2:  # no merge makes it; it stands only for a whole piece
                    continue
                self.halves[rank] = (ranks[parts[0]], ranks[parts[1]])
                self.pairs[self.halves[rank]] = rank
            self.tree.add_word(word.decode("latin-1"), (rank, len(word)))
        self.tree.make_automaton()
        self.split = regex.compile(pattern)
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def fits(self, left: int, right: int) -> bool:
        key = left * self.size + right
        known = self.compatible.get(key)
        if known is None:
            if len(self.compatible) > 2_000_000:
                self.compatible.clear()
            known = self.compatible[key] = self._stands(left, right)
        return known

    def _stands(self, left: int, right: int) -> bool:
        """Whether no merge across the boundary comes before the merges that made the two sides."""
        halves, pairs = self.halves, self.pairs
        before = self.size + 1
        while True:
            if pairs.get((left, right), before) < before:
                return False
            inner, outer = halves[left][1], halves[right][0]
            open_left, open_right = inner != left, outer != right
            if open_left and (left > right or not open_right):
                before, left = left, inner
            elif open_right:
                before, right = right + 1, outer
            else:
                return True

    def piece(self, word: bytes) -> tuple[int, ...]:
        whole = self.ranks.get(word)
        if whole is not None:
            return (whole,)
        n = len(word)
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for end, found in self.tree.iter(word.decode("latin-1")):
            starts[end + 1 - found[1]].append(found)
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        tried: list[int] = []
        known, size = self.compatible.get, self.size
        at, k, last = 0, len(starts[0]) - 1, -1
        while at < n:
            options = starts[at]
            while k >= 0:
                token, length = options[k]
                if alive[at + length]:
                    fine = True if last < 0 else known(last * size + token)
                    if self.fits(last, token) if fine is None else fine:
                        break
                k -= 1
            if k >= 0:
                out.append(token)
                tried.append(k)
                at += length
                last, k = token, len(starts[at]) - 1
            else:
                alive[at] = 0
                at -= len(self.words[out.pop()])
                k = tried.pop() - 1
                last = out[-1] if out else -1
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        words = self.split.findall(text)
        memo = self.memo
        for word in words:
            if word not in memo:
                if len(memo) >= self.MEMO:  # a generation is full: words still in use come back from the older one
                    self.older = memo
                    memo = self.memo = {}
                    return list(chain.from_iterable(self.older.get(w) or self.piece(w.encode()) for w in words))
                memo[word] = self.older.get(word) or self.piece(word.encode())
        return list(chain.from_iterable(map(memo.__getitem__, words)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))


@lru_cache(maxsize=2)
def coder(path: str, pattern: str) -> BytePairCoder:
    return BytePairCoder(read_ranks(path), pattern)


def encode_texts(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for every row; null text gives an empty array."""

    def make():
        code = coder(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = [code.encode(t) if t else [] for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["id", "ids"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) for every row of ids; null ids give empty bytes."""

    def make():
        code = coder(ranks_path, pattern)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = [code.decode(ids or []) for ids in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "decoded"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), make, f"id {kind}, decoded binary").withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) in one pass, without moving ids between processes.

    ids_sha256 is of the decimal ids joined by commas; decoded_sha256 of the bytes that
    decoding the ids gives. A null or empty text has 0 tokens and the digests of nothing.
    Repeated rows give one row each; other columns are not read.
    """

    def make():
        code = coder(ranks_path, pattern)
        decimal = [str(i) for i in range(code.size)].__getitem__

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, text_sha = [], [], []
            for text in batch.column(1).to_pylist():
                ids = code.encode(text) if text else []
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(decimal, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(code.decode(ids)).hexdigest())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", rows=64).withColumnRenamed("id", id_col)
