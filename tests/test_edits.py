"""Word edit distances and operation counts against the whole table."""

import random
import time

from pyspark.sql import functions as F

from sparkmix.functions import edits as E
from sparkmix.functions import text as X
from sparkmix.operators import metrics as M


def table(ref, hyp):
    rows = [[(j, 0, 0, j) for j in range(len(hyp) + 1)]]
    for i, a in enumerate(ref, 1):
        rows.append([(i, 0, i, 0)])
        for j, b in enumerate(hyp, 1):
            if a == b:
                rows[i].append(rows[i - 1][j - 1])
                continue
            ways = [(rows[i - 1][j - 1], 1), (rows[i - 1][j], 2), (rows[i][j - 1], 3)]
            best, kind = min(ways, key=lambda w: w[0][0])
            rows[i].append(tuple(x + (k in (0, kind)) for k, x in enumerate(best)))
    return rows[-1][-1]


def test_counts_against_the_whole_table():
    rnd = random.Random(1)
    for _ in range(1500):
        letters = "ab" if rnd.random() < 0.5 else "abcdefgh"
        ref = rnd.choices(letters, k=rnd.choice([0, 1, 2, 5, 9, 30]))
        hyp = rnd.choices(letters, k=rnd.choice([0, 1, 3, 8, 40])) if rnd.random() < 0.5 else [x for w in ref for x in rnd.choice([[w]] * 6 + [[], ["z"], [w, "y"]])]
        assert E.edit_counts(ref, hyp) == table(ref, hyp), (ref, hyp)


def test_long_pairs_take_seconds():
    rnd = random.Random(2)
    ref = [f"w{rnd.randint(0, 3000)}" for _ in range(20_000)]
    hyp = list(ref)
    for at in sorted(rnd.sample(range(20_000), 60), reverse=True):
        hyp[at : at + 1] = rnd.choice([[], ["x"], [ref[at], "y"]])
    began = time.perf_counter()
    distance, s, d, i = E.edit_counts(ref, hyp)
    assert distance == s + d + i <= 60 and d - i == len(ref) - len(hyp)
    assert time.perf_counter() - began < 20


def test_columns(spark):
    rows = [("the cat sat", "a cat sat down"), (None, "x y"), ("a b", None), ("", ""), ("One, two!", "one two")]
    df = spark.createDataFrame(rows, "reference string, prediction string")
    got = df.select(X.word_errors(F.col("reference"), F.col("prediction")).alias("e"), X.wer(F.col("reference"), F.col("prediction")).alias("w")).collect()
    assert [tuple(r.e) for r in got] == [(2, 1, 0, 1), (2, 0, 0, 2), (2, 0, 2, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert [r.w for r in got] == [0.6667, 1.0, 1.0, 0.0, 0.0]
    assert tuple(M.word_error_counts(df).first()) == (7, 6, 1, 2, 3, 0.8571)
