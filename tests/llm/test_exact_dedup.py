"""Exact dedup against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from sparkmix.llm import exact_dedup as X
from sparkmix.llm import queries as Q
from sparkmix.llm.common import Scratch


def brute(rows):
    groups = defaultdict(list)
    for place, (i, t) in enumerate(rows):
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append((i is None, i or 0, place))
    out = []
    for text, members in groups.items():
        first = min(members)
        for none, i, place in members:
            out.append((None if none else i, None if first[0] else first[1], len(members), (none, i, place) == first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed, n=600):
    rnd = random.Random(seed)
    texts = ["a b", "a  b", "a\tb", "a\x0bb", " a b", "a b", "", None, " ", "\n\n", "é" * 3, "x" * 300_000, "A b", "one\nline"] + [f"text {i}" for i in range(150)]
    rows = [(rnd.choice([i, i, i, 7, None]), rnd.choice(texts)) for i in range(n)]
    return rows + [(10_000 + i, rnd.choice(["hot text", "hot\ttext"])) for i in range(n // 2)]


@pytest.mark.parametrize("share", [X.FREQUENT, 0.2, 0.9])
def test_against_brute_force(spark, share):
    """At a share of 0.2 one text is split off, at 0.9 none, at 1/1024 nearly all."""
    rows = rows_of(1)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, row string, digest string").coalesce(1)
    got = [tuple(r) for r in X.exact_duplicates(df, share=share).collect()]
    assert sorted(got, key=str) == brute(rows)


def test_frequent_digests_are_all_found_and_few(spark):
    df = spark.createDataFrame([(i, t) for i, t in rows_of(2)], "doc_id long, text string")
    rows = Scratch(spark).save(X._digests(df, "doc_id", "text").repartition(7), "r")
    sizes = {bytes(r[0]): r[1] for r in rows.groupBy("digest").count().collect()}
    for share in (0.3, 0.02, 0.005):
        got = {bytes(r.digest): r["size"] for r in X.frequent_digests(rows, share).collect()}
        assert got == {d: n for d, n in sizes.items() if n >= share * sum(sizes.values())} and len(got) <= 1 / share


def test_rows_that_stay_keep_their_columns(spark):
    rows = rows_of(3)
    df = spark.createDataFrame([(i, t, p, "z") for p, (i, t) in enumerate(rows)], "doc_id long, text string, row int, box string").coalesce(1)
    out = X.drop_exact_copies(df)
    assert out.schema == df.schema
    got = {re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""): r.doc_id for r in out.collect()}
    want = {}
    for i, t in rows:
        key = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
        want[key] = min((x for x in (want.get(key), i) if x is not None), default=None)
    assert got == want and out.count() == len(want)


def test_empty_table_and_plan(spark):
    empty = spark.createDataFrame([], "doc_id string, text string, text_sha256 int")
    assert X.exact_duplicates(empty).collect() == [] and X.drop_exact_copies(empty).collect() == []
    plan = X.exact_duplicates(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((tuple(r) for r in Q.op13_exact_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows)
