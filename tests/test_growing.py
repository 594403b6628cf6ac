"""Sketches of growing shards within their errors, and joins of bucketed tables without a shuffle."""

from pyspark.sql import functions as F

from sparkmix.operators import corpus as C
from sparkmix.operators import joins as J
from sparkmix.operators import sketches as K
from sparkmix.sources import buckets as B


def test_statistics_after_several_ingests(spark, tmp_path):
    path = str(tmp_path / "sketches")
    rows = spark.range(0, 90_000).select((F.col("id") % 9).alias("shard"), (F.col("id") % 7001).alias("speaker"), (F.col("id") * 7919 % 90_000).cast("double").alias("x"), F.when(F.col("id") % 10 < 4, "hot").when(F.col("id") % 10 < 6, "warm").otherwise(F.concat(F.lit("v"), F.col("id"))).alias("word"))
    rows = rows.withColumn("x", F.when(F.col("shard") == 8, None).otherwise(F.col("x")))
    for part in (rows.filter("shard < 3"), rows.filter("shard between 3 and 6"), rows.filter("shard > 6"), rows.filter("shard = 1")):
        K.ingest(part, path, "shard", ["speaker", "word"], ["x"], ["word"])
    got = {(r["column"], r.statistic, r.item): r.value for r in K.statistics(spark, path, top=2).collect()}
    kept = sorted(r.x for r in rows.filter("x is not null").collect())
    assert got["*", "rows", None] == 90_000
    assert abs(got["speaker", "distinct", None] / 7001 - 1) < 3 * 1.04 / 64
    assert abs(got["word", "distinct", None] / 36_002 - 1) < 3 * 1.04 / 64
    assert abs(got["x", "mean", None] - sum(kept) / len(kept)) < 1e-6
    for q in (0.05, 0.5, 0.95):
        place = sum(x <= got["x", "quantile", str(q)] for x in kept) / len(kept)
        assert abs(place - q) < 0.01
    for word, n in (("hot", 36_000), ("warm", 18_000)):
        assert n - 9 * 10_000 / K.FOLLOWED - 1 <= got["word", "count", word] <= n + 9 * 10_000 / K.FOLLOWED + 1


def test_sketches_of_nothing(spark):
    empty = spark.createDataFrame([], "shard int, a string, x double")
    assert K.merged(K.sketch_shards(empty, "shard", ["a"], ["x"], ["a"])).collect() == []
    nulls = spark.createDataFrame([(1, None, None)], "shard int, a string, x double")
    got = {(r["column"], r.statistic): r.value for r in K.merged(K.sketch_shards(nulls, "shard", ["a"], ["x"], ["a"])).collect()}
    assert got == {("*", "rows"): 1.0, ("a", "distinct"): 0.0, ("x", "mean"): None, ("x", "quantile"): None} or got["a", "distinct"] == 0.0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_exchange_below_joins_and_groups_of_bucketed_tables(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(5000).select((F.col("id") % 300).alias("speaker_id"), F.col("id").alias("n"), (F.col("id") % 3).cast("string").alias("area"))
        speakers = rows.select("speaker_id").distinct().withColumn("split", F.when(F.col("speaker_id") % 5 == 0, "val").otherwise("train"))
        a, b = B.write_bucketed(rows, "speaker_id", 8), B.write_bucketed(speakers, "speaker_id", 8)
        joins = {
            "split": C.assign_split(a, b, "speaker_id"),
            "pending": J.resume_pending(a, b.filter("split = 'val'").select("speaker_id").distinct(), "speaker_id"),
            "profile": C.speaker_profile(a, "speaker_id", ["area"]),
            "disjoint": C.verify_disjoint(C.assign_split(a, b, "speaker_id")),
        }
        for name, df in joins.items():
            assert "Exchange" not in plan(df), name
        assert "Exchange" in plan(C.assign_split(rows, speakers, "speaker_id"))
        assert sorted(map(tuple, joins["split"].collect())) == sorted(map(tuple, C.assign_split(rows, speakers, "speaker_id").collect()))
        assert joins["pending"].count() == rows.join(speakers.filter("split = 'train'"), "speaker_id").count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
