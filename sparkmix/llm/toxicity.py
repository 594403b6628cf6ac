"""Operator 7: a toxicity classifier with counterfactual regularisation.

A logistic model over words and word beginnings. Sentences of labelled documents that
name a group are copied with the group swapped, and the fit penalises the squared
difference of the two scores, so naming a group does not by itself raise a score.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map

#: Labelled rows that a model is fitted on, at most; those with the smallest id hashes.
MOST_LABELLED = 20_000
#: Terms of one line stand for each other in swapped sentences. Another table is a parameter of ``train``.
IDENTITY_TERMS = (
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("women", "men"),
    ("woman", "man"),
    ("girls", "boys"),
    ("black", "white", "asian", "latino"),
    ("african", "american", "european", "arab", "chinese", "indian", "mexican"),
    ("gay", "lesbian", "bisexual", "transgender", "straight"),
    ("gay people", "straight people", "transgender people"),
    ("immigrant", "refugee", "citizen"),
    ("immigrants", "refugees", "citizens"),
    ("blind", "deaf", "disabled"),
    ("old", "young"),
    ("musulmans", "chrétiens", "juifs", "athées"),
    ("femmes", "hommes"),
    ("immigrés", "réfugiés", "citoyens"),
    ("muslime", "christen", "juden", "atheisten"),
    ("frauen", "männer"),
    ("einwanderer", "flüchtlinge", "bürger"),
    ("musulmanes", "cristianos", "judíos", "ateos"),
    ("mujeres", "hombres"),
    ("inmigrantes", "refugiados", "ciudadanos"),
)
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?\n]*")
#: Lengths of the word beginnings that count as features.
BEGINNINGS = (3, 4, 5)
#: A feature is used if it is in so many labelled texts and its log odds ratio is so many standard errors from 0.
LEAST_ROWS, LEAST_Z = 4, 3.0


def word_features(word: str) -> list[int]:
    """64-bit hashes of a word and of its beginnings."""
    return [xxhash.xxh64_intdigest(word), *(xxhash.xxh64_intdigest("^" + word[:k]) for k in BEGINNINGS if len(word) > k)]


def text_features(text: str) -> set[int]:
    out: set[int] = set()
    for word in set(_WORD.findall(text.lower())):
        out.update(word_features(word))
    return out


class Swaps:
    """Replaces the identity terms of a sentence by each of their alternatives."""

    def __init__(self, terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS):
        self.rows = {term: (row, i) for row in terms for i, term in enumerate(row)}
        longest_first = sorted(self.rows, key=lambda t: (-len(t), t))
        self.term = re.compile(r"\b(" + "|".join(map(re.escape, longest_first)) + r")\b") if self.rows else None

    def sentences(self, text: str) -> list[tuple[str, str]]:
        """Each sentence that holds a term, once with every alternative in the term's place."""
        lower = text.lower()
        if self.term is None or not self.term.search(lower):
            return []
        out = []
        for s in _SENTENCE.findall(lower):
            if found := self.term.findall(s):
                for step in range(1, max(len(self.rows[t][0]) for t in found)):
                    out.append((s, self.term.sub(lambda m: self._turned(m[1], step), s)))
        return [pair for pair in out if pair[0] != pair[1]]

    def _turned(self, term: str, step: int) -> str:
        row, i = self.rows[term]
        return row[(i + step) % len(row)]


@dataclass
class ToxicityModel:
    """Weights by feature hash. ``bias`` is the logit of a text with no known feature."""

    bias: float
    weights: dict[int, float] = field(default_factory=dict)

    def word_hits(self, word: str) -> tuple[tuple[int, float], ...]:
        return tuple((f, self.weights[f]) for f in word_features(word) if f in self.weights)

    def score(self, text: str | None) -> float:
        return TextScorer(self).score(text)


class TextScorer:
    """Scores texts, remembering the features of words seen."""

    MEMO = 200_000

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.memo: dict[str, tuple] = {}

    def score(self, text: str | None) -> float:
        memo, hits = self.memo, {}
        for word in set(_WORD.findall((text or "").lower())):
            known = memo.get(word)
            if known is None:
                if len(memo) >= self.MEMO:
                    memo.clear()
                known = memo[word] = self.model.word_hits(word)
            if known:
                hits.update(known)
        z = self.model.bias + sum(hits[f] for f in sorted(hits))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(
    features: list[np.ndarray],
    labels: np.ndarray,
    swaps: list[tuple[np.ndarray, np.ndarray]],
    least_rows: int = LEAST_ROWS,
    least_z: float = LEAST_Z,
    l2: float = 0.5,
    fairness: float = 5.0,
    rounds: int = 200,
) -> ToxicityModel:
    """Fit on distinct feature hashes of each labelled text.

    Features enter if they occur in ``least_rows`` texts and their log odds ratio is at
    least ``least_z`` standard errors from 0. ``fairness`` weighs the squared logit
    change of swapped sentences. Without both labels the score is the share of label 1.
    """
    n, ones = len(labels), int(labels.sum())
    if not n:
        return ToxicityModel(-30.0)
    rate = np.clip(ones / n, 1e-6, 1 - 1e-6)
    prior = float(np.log(rate / (1 - rate)))
    if ones in (0, n):
        return ToxicityModel(prior)
    row = np.repeat(np.arange(n), [len(f) for f in features])
    names, col = np.unique(np.concatenate(features), return_inverse=True)
    seen = np.bincount(col, minlength=len(names))
    a = np.bincount(col, labels[row], len(names))
    b, n0 = seen - a, n - ones
    odds = np.log((a + 0.5) / (ones - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))
    error = np.sqrt(1 / (a + 0.5) + 1 / (ones - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))
    use = np.flatnonzero((seen >= least_rows) & (np.abs(odds / error) >= least_z))
    place = np.full(len(names), -1)
    place[use] = np.arange(len(use))
    stay = place[col] >= 0
    row, col, k = row[stay], place[col[stay]], len(use)
    kept = names[use]
    if not k:
        return ToxicityModel(prior)

    def cols(hashes: np.ndarray) -> np.ndarray:
        at = np.clip(np.searchsorted(kept, hashes), 0, k - 1)
        return at[kept[at] == hashes]

    pair, pair_col, sign = [], [], []
    for i, (left, right) in enumerate(swaps):
        for s, hashes in ((1.0, left), (-1.0, right)):
            c = cols(hashes)
            pair.append(np.full(len(c), i))
            pair_col.append(c)
            sign.append(np.full(len(c), s))
    pair_ = np.concatenate(pair) if pair else np.zeros(0, np.int64)
    pair_col_ = np.concatenate(pair_col) if pair else np.zeros(0, np.int64)
    sign_ = np.concatenate(sign) if pair else np.zeros(0)
    w, bias, squares, bias_squares = np.zeros(k), prior, np.full(k, 1e-8), 1e-8
    for _ in range(rounds):
        z = np.clip(bias + np.bincount(row, w[col], n), -30, 30)
        off = 1 / (1 + np.exp(-z)) - labels
        g = np.bincount(col, off[row], k) + l2 * w
        if len(swaps):
            change = np.bincount(pair_, sign_ * w[pair_col_], len(swaps))
            g += np.bincount(pair_col_, 2 * fairness * sign_ * change[pair_], k)
        squares += g * g
        w -= 0.3 * g / np.sqrt(squares)
        gb = off.sum()
        bias_squares += gb * gb
        bias -= 0.1 * gb / np.sqrt(bias_squares)
    return ToxicityModel(float(bias), dict(zip(kept.tolist(), w.tolist(), strict=True)))


def train(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = MOST_LABELLED, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", terms: tuple[tuple[str, ...], ...] = IDENTITY_TERMS) -> ToxicityModel:
    """Fit on labelled rows, at most ``most`` of them; ``usable`` restricts the label rows.

    Only the text is a feature. Rows with a null id or label are left out; a null text
    counts as empty. If an id repeats, each of its pairs of text and label counts.
    """
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    marked = marked.filter(usable) if usable is not None else marked
    chosen = marked.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(most)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # bounded by ``most``
    rows = Scratch(docs.sparkSession).save(rows.select("text", "y"), "labelled")
    known = set(informative_features(rows))

    def make():
        swap = Swaps(terms)
        pack = lambda text: np.array(sorted(known & text_features(text)), np.uint64).tobytes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in batch.column(0).to_pylist()]
            swaps = [[x for pair in swap.sentences(t) for x in map(pack, pair)] for t in texts]
            return pa.RecordBatch.from_arrays([pa.array(list(map(pack, texts)), pa.binary()), batch.column(1), pa.array(swaps, pa.list_(pa.binary()))], ["features", "y", "swaps"])

        return step

    got = arrow_map(rows, make, "features binary, y double, swaps array<binary>").collect()
    got.sort(key=lambda r: (bytes(r[0]), r[1]))
    unpack = lambda raw: np.frombuffer(bytes(raw), np.uint64)
    return fit([unpack(r[0]) for r in got], np.array([r[1] for r in got]), [(unpack(r[2][i]), unpack(r[2][i + 1])) for r in got for i in range(0, len(r[2]), 2)])


def informative_features(rows: DataFrame, least_rows: int = LEAST_ROWS, least_z: float = LEAST_Z) -> list[int]:
    """Hashes of the features of (text, y) rows that tell the labels apart. All features are counted on Spark; only these reach the driver."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            y = batch.column(1).to_numpy()
            found = [np.fromiter(fs, np.uint64, len(fs)) for fs in (text_features(t or "") for t in batch.column(0).to_pylist())]
            names, place, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_inverse=True, return_counts=True)
            ones = np.bincount(place, np.repeat(y, [len(f) for f in found]), len(names))
            return pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(ones), pa.array(n.astype(np.int64))], ["feature", "a", "n"])

        return step

    n, ones = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    counts = arrow_map(rows, make, "feature long, a double, n long", rows=1024).groupBy("feature").agg(F.sum("a").alias("a"), F.sum("n").alias("n"))
    a, b = F.col("a") + 0.5, F.col("n") - F.col("a") + 0.5
    c, d = F.lit(ones + 1) - a, F.lit(n - ones + 1) - b
    z = (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / c + 1 / b + 1 / d)
    return [r[0] % (1 << 64) for r in counts.filter((F.col("n") >= least_rows) & (F.abs(z) >= least_z)).select("feature").collect()]


def score_texts(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; a null text scores as an empty one. Repeated rows repeat."""

    def make():
        scorer = TextScorer(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([scorer.score(t) for t in batch.column(1).to_pylist()], pa.float64())], ["id", "score"])

        return step

    kind = df.schema[id_col].dataType.simpleString()
    return arrow_map(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), make, f"id {kind}, score double").withColumnRenamed("id", id_col)


def keep_clean(df: DataFrame, model: ToxicityModel, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows that score under ``threshold``, with all their columns."""
    at = df.columns.index(text_col)

    def make():
        scorer = TextScorer(model)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            return batch.filter(pa.array([scorer.score(t) < threshold for t in batch.column(at).to_pylist()], pa.bool_()))

        return step

    return arrow_map(df, make, df.schema)
