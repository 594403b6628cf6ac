"""Samples and splits: columns of the caller, hot groups, cuts by hash."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkmix.operators import corpus as C

NAMES = ["mark", "part", "round", "_bucket", "place", "turn", "stratum", "row", "cell", "who", "tie", "bucket", "size", "quota", "_rank", "total"]


def clashing(spark, n, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["x", "y", None]), f"s{rnd.choice([0, 0, 0, rnd.randint(1, 30)])}", *[f"{c}{i}" for c in NAMES]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, area string, speaker string, " + ", ".join(f"{c} string" for c in NAMES)).repartition(3)


def md5(i, seed=42):
    return hashlib.md5(f"{seed}|{i}".encode()).hexdigest()


def brute_sample(rows, n):
    cells = defaultdict(list)
    for r in rows:
        cells[(r[1] or "nan").strip().lower()].append(r)
    total = len(rows)
    share = {c: len(v) * min(n, total) / total for c, v in cells.items()}
    quota = {c: int(x) for c, x in share.items()}
    left = min(n, total) - sum(quota.values())
    for c in sorted(cells, key=lambda c: (-round(share[c] - int(share[c]), 9), -len(cells[c]), c))[:left]:
        quota[c] += 1
    picked = []
    for c, own in cells.items():
        turns = defaultdict(list)
        for r in sorted(own, key=lambda r: md5(r[0])):
            turns[r[2]].append(r)
        order = sorted((t, who, r) for who, rs in turns.items() for t, r in enumerate(rs))
        picked += [(c, r) for _, _, r in order[: quota[c]]]
    return sorted(((c, r) for c, r in picked), key=lambda x: md5(x[1][0]))


@pytest.mark.parametrize("cut", [1000, 5])
def test_sample_keeps_all_columns(spark, monkeypatch, cut):
    """Also where a group is cut in parts."""
    monkeypatch.setattr(C, "CUT_BY_SPARK", cut)
    rows, df = clashing(spark, 400)
    out = C.stratified_sample(df, ["area"], 60, "speaker", "id")
    assert out.columns == [*df.columns, "stratum_key", "selection_rank"]
    got = sorted((tuple(r) for r in out.collect()), key=lambda r: r[-1])
    assert got == [(*r, c, k) for k, (c, r) in enumerate(brute_sample(rows, 60), 1)]
    cells = df.groupBy(C.X.stratum_key("area").alias("stratum_key")).agg(F.count("*").alias("n"))
    picked = C.round_robin_pick(df.withColumn("stratum_key", C.X.stratum_key("area")), C.allocate_quota(cells, 60, "stratum_key", "n"), "stratum_key", "speaker", "id")
    assert sorted(tuple(r)[:-1] for r in picked.collect()) == sorted(r[:-2] for r in got)


def test_sample_reads_its_table_twice(spark, tmp_path):
    _, df = clashing(spark, 200)
    df.write.parquet(str(tmp_path / "t"))
    out = C.stratified_sample(spark.read.parquet(str(tmp_path / "t")), ["area"], 20, "speaker", "id")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 2
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sorted_rows", [100_000, 3])
def test_random_split_moves_no_row(spark, monkeypatch, sorted_rows):
    monkeypatch.setattr(C, "SORTED_ROWS", sorted_rows)
    rows, df = clashing(spark, 333)
    out = C.random_split(df, "id", 0.8, 0.1)
    assert out.columns == [*df.columns, "split"] and "Exchange" not in out.drop("split")._jdf.queryExecution().optimizedPlan().toString()
    order = sorted((r[0] for r in rows), key=lambda i: (md5(i), i))
    want = {i: "train" if k < round(333 * 0.8) else "val" if k < round(333 * 0.8) + round(333 * 0.1) else "test" for k, i in enumerate(order)}
    got = out.collect()
    assert {r.id: r.split for r in got} == want and sorted(tuple(r)[:-1] for r in got) == sorted(rows, key=lambda r: r[0])


def test_random_split_of_few_and_repeated_rows(spark):
    assert C.random_split(spark.createDataFrame([], "id int"), "id").collect() == []
    one = spark.createDataFrame([(5,)] * 10 + [(None,)], "id int")
    assert set(Counter(r.split for r in C.random_split(one, "id").filter("id = 5").collect()).values()) == {10}


@pytest.mark.parametrize("few", [100, 1])
def test_interleaving_keeps_all_columns(spark, monkeypatch, few):
    monkeypatch.setattr(C, "FEW_STRATA", few)
    rows, df = clashing(spark, 120)
    out = C.interleave_speakers(df, "id", ["area"])
    assert out.columns == [*[c for c in df.columns if c != "stratum"], "stratum", "position"]
    strata = defaultdict(list)
    for r in sorted(rows, key=lambda r: md5(r[0])):
        strata[r[1] or "nan"].append(r[0])
    order = [i for _, _, i in sorted((t, s, i) for s, ids in strata.items() for t, i in enumerate(ids))]
    got = out.collect()
    assert [r.id for r in sorted(got, key=lambda r: r.position)] == order and all(r.mark == f"mark{r.id}" for r in got)
