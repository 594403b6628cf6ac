"""The manifest source: read, append, overwrite, abort; and listings."""

import os

import pytest
from pyspark.sql import functions as F

from sparkmix.sources import manifests as S

SCHEMA = "id long, name string, x double, ok boolean, at timestamp"


def rows(spark, low, high):
    name = F.when(F.col("id") % 5 == 0, F.lit(None)).when(F.col("id") % 5 == 1, "").when(F.col("id") % 5 == 2, 'a "b", c\nd').otherwise("é")
    return spark.range(low, high).select("id", name.alias("name"), (F.col("id") / 3).alias("x"), (F.col("id") % 2 == 0).alias("ok"), F.timestamp_seconds("id").alias("at"))


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: r[0])


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_append_and_overwrite(spark, tmp_path, scheme):
    path = f"{scheme}{tmp_path}/log"
    assert S.read_rows(spark, path, SCHEMA).collect() == []
    S.append_rows(rows(spark, 0, 50).repartition(3), path)
    S.append_rows(rows(spark, 50, 60), path)
    got = S.read_rows(spark, path, SCHEMA)
    assert sorted_rows(got) == sorted_rows(rows(spark, 0, 60)) and got.rdd.getNumPartitions() == len(S.committed(path))
    assert sum(f["rows"] for f in S.committed(path)) == 60
    S.append_rows(rows(spark, 7, 9), path, overwrite=True)
    assert sorted_rows(S.read_rows(spark, path, SCHEMA)) == sorted_rows(rows(spark, 7, 9))
    more = S.read_rows(spark, path, "name string, later string, id long").orderBy("id").collect()
    assert [tuple(r) for r in more] == [('a "b", c\nd', None, 7), ("é", None, 8)]


def test_a_failed_task_leaves_no_part_of_a_log(spark, tmp_path):
    path = str(tmp_path / "log")
    S.append_rows(rows(spark, 0, 10), path)
    before = sorted_rows(S.read_rows(spark, path, SCHEMA))
    bad = rows(spark, 10, 200).repartition(4).withColumn("x", F.when(F.col("id") == 150, F.raise_error(F.lit("no"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="no"):
        S.append_rows(bad, path)
    with pytest.raises(Exception, match="no"):
        S.append_rows(bad, path, overwrite=True)
    assert sorted_rows(S.read_rows(spark, path, SCHEMA)) == before
    named = {f["name"] for f in S.committed(path)}
    assert S.remove_leftovers(path) == []
    S.remove_leftovers(path, older_than=-1)
    assert {f for f in os.listdir(path) if f.endswith(".csv") and not f.startswith(".")} == named


def test_listing(spark, tmp_path):
    for name in ("a.wav", "b.txt", "x/c.FLAC", "x/y/d.mp3", "z/e.doc"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"123")
    found = S.list_files(spark, str(tmp_path))
    assert sorted((os.path.relpath(r.path, tmp_path), r.length) for r in found.collect()) == [("a.wav", 3), ("x/c.FLAC", 3), ("x/y/d.mp3", 3)]
    assert found.rdd.getNumPartitions() == 3
