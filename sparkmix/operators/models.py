"""Batch scorers and label models."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import closing
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import descent as D
from . import metrics as M


def score_batches(df: DataFrame, score: Callable[[list], list[str]], id_col: str, input_col: str, batch: int = 32) -> DataFrame:
    """(id, prediction, error, seconds): ``score`` maps a batch of inputs to texts. A batch that fails gives empty texts and its error."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for at in range(0, len(frame), batch):
                part = frame.iloc[at : at + batch]
                began, error = time.perf_counter(), None
                try:
                    texts = list(score(part[input_col].tolist()))
                except Exception as e:  # one bad batch must not end the job
                    texts, error = [""] * len(part), str(e)
                took = (time.perf_counter() - began) / max(len(part), 1)
                yield pd.DataFrame({id_col: part[id_col].to_numpy(), "prediction": texts, "error": [error] * len(part), "seconds": took})

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, input_col).mapInPandas(run, f"`{id_col}` {kind}, prediction string, error string, seconds double")


def with_features(df: DataFrame, vector_col: str = "embedding") -> DataFrame:
    return df.withColumn("features", array_to_vector(F.col(vector_col).cast("array<double>")))


def _network_at(spark: SparkSession, layers: list[int], seed: int, weights: np.ndarray | None = None):
    """Spark's model with these weights, or with those that a fit with this seed starts from; no iterations, so the one row decides nothing."""
    est = MultilayerPerceptronClassifier(layers=layers, maxIter=0, seed=seed, **({} if weights is None else {"initialWeights": Vectors.dense(weights)}))
    return est.fit(spark.createDataFrame([(Vectors.dense([0.0] * layers[0]), 0.0)], ["features", "label"]))


def _networks(train: DataFrame, layers: list[int], iterations: list[int], seed: int) -> Iterator:
    """The network after each of these numbers of iterations, of one descent; a number is reached only when the model before it was taken."""
    blocks = D.packed(train, layers[0], layers[-1])
    try:
        weights = _network_at(train.sparkSession, layers, seed).weights.toArray()
        path, done = D.descend(D.objective(blocks, layers), weights), 0
        for n in iterations:
            for weights in islice(path, n - done):
                pass
            done = n
            yield _network_at(train.sparkSession, layers, seed, weights)
    finally:
        blocks.unpersist()


def train_label_model(df: DataFrame, hidden: tuple[int, ...] = (256, 128), iterations: tuple[int, ...] = (25, 50, 100), seed: int = 42, id_col: str = "vec_id", linear: bool = False):
    """The model with the best accuracy on the tenth of rows held out by a hash, over a grid of iterations."""
    data = with_features(df).withColumn("label", F.col("label").cast("double"))
    part = F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(10))
    train, val = data.filter(part > 0), data.filter(part == 0)
    size, classes = len(data.select("embedding").first()[0]), int(data.agg(F.max("label")).first()[0]) + 1
    grid, best, score = sorted(iterations), None, -1.0
    models = (LogisticRegression(maxIter=n).fit(train) for n in grid) if linear else _networks(train, [size, *hidden, classes], grid, seed)
    with closing(models):
        for model in models:
            got = model.transform(val).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0
            if got <= score:
                break  # more iterations no longer help
            best, score = model, got
    return best


def top_k_labels(probabilities: str, k: int = 2):
    """Array of (probability, class) of the k most likely classes."""
    pairs = F.transform(F.col(probabilities), lambda p, i: F.struct(p.alias("probability"), i.alias("class")))
    return F.slice(F.array_sort(pairs, lambda a, b: F.when(a["probability"] != b["probability"], F.when(a["probability"] > b["probability"], -1).otherwise(1)).otherwise(a["class"] - b["class"])), 1, k)


def evaluate_labels(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(part, class, prediction, value): accuracy, macro F1 and rows of a table of predictions; precision, recall, F1 and
    support of each class; and the confusion matrix over the classes that occur. Rows without a label or a prediction are left out."""
    pairs = predicted.select(F.col(label).cast("string").alias("truth"), F.col(prediction).cast("string").alias("prediction")).dropna()
    none = F.lit(None).cast("string")
    row = lambda part, cls, pred, v: F.struct(F.lit(part).alias("part"), cls.alias("class"), pred.alias("prediction"), v.cast("double").alias("value"))
    prf = M.per_class_prf(pairs)
    per = prf.select(F.inline(F.array(*[row(c, F.col("class"), none, F.col(c)) for c in ("precision", "recall", "f1", "support")])))
    totals = M.accuracy(pairs).select(F.inline(F.array(*[row(c, none, none, F.col(c)) for c in ("accuracy", "n")])))
    totals = totals.unionByName(M.macro_f1(pairs).select(F.inline(F.array(row("macro_f1", none, none, F.col("macro_f1"))))))
    matrix = pairs.groupBy("truth", "prediction").agg(F.count("*").alias("n")).select(F.inline(F.array(row("confusion", F.col("truth"), F.col("prediction"), F.col("n")))))
    return totals.unionByName(per).unionByName(matrix)


def predict_labels(model, df: DataFrame, id_col: str = "vec_id", k: int = 2) -> DataFrame:
    """(id, label, prediction, probability, top). A row without a vector gets nulls."""
    good = model.transform(with_features(df.filter(F.col("embedding").isNotNull()))).withColumn("p", vector_to_array("probability"))
    out = good.select(id_col, "label", F.col("prediction").cast("int").alias("prediction"), F.round(F.array_max("p"), 6).alias("probability"), top_k_labels("p", k).alias("top"))
    bad = df.filter(F.col("embedding").isNull()).select(id_col, "label")
    return out.unionByName(bad, allowMissingColumns=True)


def label_samples(model, df: DataFrame, names: list[str], id_col: str = "vec_id", label: str = "label") -> DataFrame:
    """(id, true_label, pred_label, correct, confidence, prob_<name> of every class), one row for each row with a vector and a label.

    ``names`` are the classes in the order of their numbers; probabilities have four decimals.
    """
    rows = df.filter(F.col("embedding").isNotNull() & F.col(label).isNotNull())
    named = lambda c: F.get(F.array(*[F.lit(n) for n in names]), c.cast("int"))
    scored = model.transform(with_features(rows)).withColumn("p", vector_to_array("probability"))
    return scored.select(
        id_col,
        named(F.col(label)).alias("true_label"),
        named(F.col("prediction")).alias("pred_label"),
        (F.col(label).cast("double") == F.col("prediction")).alias("correct"),
        F.round(F.array_max("p"), 4).alias("confidence"),
        *[F.round(F.get("p", i), 4).alias(f"prob_{n}") for i, n in enumerate(names)],
    )
