"""Operator 9: language identification by multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ship_package

BUCKETS = 1 << 15
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-case code point of each letter under 65536, and the space for all else."""
    out = np.full(1 << 16, 32, np.uint64)
    for c in range(1 << 16):
        if (s := chr(c)).isalpha():
            out[c] = ord(s.lower()) if len(s.lower()) == 1 else c
    return out


def _points(text: str) -> np.ndarray:
    """A text's letters in lower case, other characters being spaces, between two spaces."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    table = _letters()
    c = table[np.minimum(points, (1 << 16) - 1)]
    for p in np.unique(points[points >= 1 << 16]).tolist():
        c[points == p] = ord(s.lower()) if (s := chr(p)).isalpha() and len(s.lower()) == 1 else p if s.isalpha() else 32
    return np.concatenate(([np.uint64(32)], c, [np.uint64(32)]))


def _grams(c: np.ndarray, stop: int, buckets: int) -> np.ndarray:
    """Buckets of the 1- to 3-grams that begin before ``stop``."""
    a = c * np.uint64(0x9E3779B97F4A7C15)
    b = a[:-1] + c[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
    d = b[:-1] + c[2:] * np.uint64(0x165667B19E3779F9)
    all_ = np.concatenate((a[:stop], b[:stop], d[:stop]))
    all_ ^= all_ >> np.uint64(29)
    all_ *= np.uint64(0xBF58476D1CE4E5B9)
    return (all_ >> np.uint64(40)).astype(np.int64) & (buckets - 1)


#: Characters of a text whose n-grams are in memory at once.
PIECE = 1 << 16


def gram_pieces(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Hashed 1- to 3-grams of a text, piece by piece; nothing if it has no letter."""
    c = _points(text)
    if (c != 32).any():
        for at in range(0, len(c), PIECE):
            yield _grams(c[at : at + PIECE + 2], PIECE, buckets)


def gram_buckets(text: str, buckets: int = BUCKETS) -> tuple[np.ndarray, bool]:
    """Hashed 1- to 3-grams of the letters, other characters being spaces; whether there is a letter."""
    found = list(gram_pieces(text, buckets))
    return np.concatenate([np.zeros(0, np.int64), *found]), bool(found)


@dataclass
class LanguageModel:
    langs: list[str]
    prior: np.ndarray
    log_prob: np.ndarray  # languages x buckets

    @cached_property
    def by_bucket(self) -> np.ndarray:
        return np.ascontiguousarray(self.log_prob.T)

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_batch([text])[0]

    def predict_batch(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """The language and score of each text, from sums of log probabilities over the n-grams of many texts at once."""
        z = np.tile(self.prior, (len(texts), 1))
        letters = np.zeros(len(texts), bool)
        by_bucket = self.by_bucket
        held: list[tuple[int, np.ndarray]] = []

        def add() -> None:
            """Add the held pieces to the sums of their rows."""
            sizes = np.array([len(g) for _, g in held])
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            np.add.at(z, [row for row, _ in held], np.add.reduceat(by_bucket[np.concatenate([g for _, g in held])], starts, axis=0))
            held.clear()

        waiting = 0
        for row, text in enumerate(texts if self.langs else []):
            for grams in gram_pieces(text or "", self.log_prob.shape[1]):
                letters[row] = True
                held.append((row, grams))
                waiting += len(grams)
                if waiting * len(self.langs) > 1 << 20:
                    add()
                    waiting = 0
        if held:
            add()
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        best = z.argmax(1)
        score = 1 / np.exp(z - z.max(1, keepdims=True)).sum(1)
        return [(self.langs[b], float(p)) if known else (UNKNOWN, 0.0) for b, p, known in zip(best.tolist(), score.tolist(), letters.tolist(), strict=True)]


def train(docs: DataFrame, usable: Column | None = None, text_col: str = "text", lang_col: str = "lang", buckets: int = BUCKETS, smooth: float = 0.5) -> LanguageModel:
    """Counts over all usable rows with a text and a language; only sums per language and bucket reach the driver."""
    ship_package(docs.sparkSession)
    rows = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    rows = (rows.filter(usable) if usable is not None else rows).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                own = sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
                own[buckets] += 1
                for grams in gram_pieces(text.as_py(), buckets):
                    own[:buckets] += np.bincount(grams, minlength=buckets)
        for lang, own in sums.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used), pa.string()), pa.array(used, pa.int32()), pa.array(own[used], pa.int64())], ["lang", "bucket", "n"])

    sums = rows.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow().to_pandas()
    langs = sorted(got["lang"].unique())
    grid = np.zeros((len(langs), buckets + 1))
    place = {lang: i for i, lang in enumerate(langs)}
    grid[got["lang"].map(place), got["bucket"]] = got["n"]
    if not langs:
        return LanguageModel([], np.zeros(0), np.zeros((0, buckets)))
    seen = grid[:, :buckets] + smooth
    return LanguageModel(langs, np.log(grid[:, buckets] / grid[:, buckets].sum()), np.log(seen / seen.sum(1, keepdims=True)))


def predict_texts(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row.

    A null text, one without a letter, or a model without languages gives ``und`` and 0.
    The score is the posterior of the predicted language. Ties go to the first language
    in alphabetical order. Repeated rows repeat; other columns are not read.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # languages x buckets doubles

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = own.predict_batch(batch.column(1).to_pylist())
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["id", "lang_pred", "score"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id_col)


def keep_known(df: DataFrame, model: LanguageModel, least_score: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows with a learned language and a score of ``least_score`` or more, with all their columns."""
    at = df.columns.index(text_col)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = own.predict_batch(batch.column(at).to_pylist())
            return batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in got], pa.bool_()))

        return step

    return arrow_map(df, make, df.schema)
