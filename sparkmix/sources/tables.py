"""Readers and writers of shards, manifests, logs and media listings."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.corpus import decode_labels
from ..session import exists, remove, shared_folder

AUDIO_COLUMNS = ("audio",)
MEDIA_GLOB = "*.{wav,flac,mp3,m4a,ogg,opus}"


def read_shards(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of parquet shards; nothing else is read."""
    return spark.read.parquet(path).select(*columns)


def shard_paths(spark: SparkSession, path: str) -> list[str]:
    """Sorted file paths of a directory of shards, as Spark's own file system sees them."""
    return sorted(spark.read.parquet(path).inputFiles())


def limit_shards(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n shards by name."""
    return spark.read.parquet(*shard_paths(spark, path)[:n])


#: Files whose row counts are sent to every task; more of them are joined as any other table.
FEW_FILES = 10_000


def with_lineage(df: DataFrame) -> DataFrame:
    """Adds audio_hf_path, shard_idx and row_within_shard of a table read from files.

    A shard is a parquet file, or a folder named like one: its files, in order of their names, are one run of rows.
    """
    path, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    shard = lambda p: F.regexp_extract(p, r"^(.*?\.parquet)(?:/.*)?$", 1)
    out = df.select(
        "*",
        path.alias("audio_hf_path"),
        F.coalesce(F.regexp_extract(shard(path), r"(\d+)(?:-of-\d+)?[^/\d]*\.parquet$", 1).try_cast("int"), F.lit(0)).alias("shard_idx"),
        row.alias("row_within_shard"),
    )
    files = df.inputFiles()
    if not any(".parquet/" in f for f in files):
        return out
    sizes = df.sparkSession.read.parquet(*map(unquote, files)).groupBy(path.alias("audio_hf_path")).agg(F.count("*").alias("_n"))
    before = W.partitionBy(shard(F.col("audio_hf_path"))).orderBy("audio_hf_path").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("audio_hf_path", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = out.join(F.broadcast(starts) if len(files) <= FEW_FILES else starts, "audio_hf_path")
    return joined.withColumn("row_within_shard", F.col("row_within_shard") + F.col("_start")).select(*out.columns)


def sample_head(df: DataFrame, n: int, drop: tuple[str, ...] = AUDIO_COLUMNS) -> DataFrame:
    return df.drop(*drop).limit(n)


def inspect_schema(spark: SparkSession, path: str, required: list[str] = ()) -> DataFrame:
    """(name, type, required) of each column, from the footer."""
    rows = [(f.name, f.dataType.simpleString(), f.name in required) for f in spark.read.parquet(path).schema]
    return spark.createDataFrame(rows, "name string, type string, required boolean")


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header, as ``write_manifest`` leaves it: quotes are doubled, values may hold line breaks, and an empty text comes back as null."""
    return spark.read.options(header=True, escape='"', multiLine=True).schema(schema).csv(path)


def write_manifest(df: DataFrame, path: str, force: bool = False) -> None:
    """CSV with a header; an existing manifest is an error unless forced."""
    spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    df.write.mode("overwrite" if force else "errorifexists").options(header=True, escape='"', **spaces).csv(path)


def reuse_manifest(spark: SparkSession, path: str, schema: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """The manifest at ``path``; built and written only if there is no whole one yet, or if forced."""
    if force or not exists(spark, f"{path}/_SUCCESS"):
        write_manifest(build(), path, force=True)
    return read_manifest(spark, path, schema)


def list_media(spark: SparkSession, path: str, glob: str = MEDIA_GLOB) -> DataFrame:
    """(path, length, modificationTime) of the media below a folder; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")


def log_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns as text in a fixed order: four decimals, nothing for null and NaN."""
    kinds = dict(df.dtypes)

    def one(c: str):
        if kinds[c] in ("double", "float"):
            return F.when(F.col(c).isNull() | F.isnan(c), "").otherwise(F.format_string("%.4f", F.col(c).cast("double"))).alias(c)
        return F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    return df.select(*[one(c) for c in columns])


def append_log(df: DataFrame, path: str, columns: list[str]) -> None:
    log_rows(df, columns).write.mode("append").option("header", True).option("emptyValue", "").csv(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    metrics.write.mode("overwrite").json(f"{path}/json")
    metrics.write.mode("overwrite").option("header", True).csv(f"{path}/csv")


def missing_media(manifest: DataFrame, listing: DataFrame, col: str = "file") -> DataFrame:
    """Manifest rows whose file is not in the listing."""
    return manifest.join(listing.select(F.col("path").alias(col)), col, "left_anti")


def present_media(manifest: DataFrame, listing: DataFrame, col: str = "file") -> DataFrame:
    return manifest.join(listing.select(F.col("path").alias(col)), col, "left_semi")


def union_shards(*parts: DataFrame) -> DataFrame:
    """Union by name; a column that a part lacks is null in it."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def read_corpus(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Shards with lineage and decoded class labels."""
    return decode_labels(with_lineage(spark.read.parquet(path)).select(*columns, "audio_hf_path", "shard_idx", "row_within_shard"))
