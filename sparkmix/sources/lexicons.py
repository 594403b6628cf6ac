"""Dictionaries as tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import keep_latest


def _text_schema(cols: str) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in cols.split()])


def _clean(col: str, default: str):
    return F.coalesce(F.trim(col), F.lit(default))


def lexicon_entries(raw: DataFrame, file_no: int = 0) -> DataFrame:
    """Clean dictionary rows: trimmed lower-case key, upper category; blank and ``#`` keys are left out. ``line`` orders them."""
    has = lambda c, d: _clean(c, d) if c in raw.columns else F.lit(d)
    return raw.withColumn("informal", F.lower(F.trim("informal"))).filter("informal <> '' and informal not like '#%'").select(
        "informal",
        F.coalesce(F.trim("normalized"), "informal").alias("normalized"),
        F.upper(has("category", "UNKNOWN")).alias("category"),
        has("dialect", "Standard").alias("dialect"),
        F.lit(file_no).alias("file_no"),
        (F.col("line") if "line" in raw.columns else F.monotonically_increasing_id()).cast("long").alias("line"),
    )


def override(tables: list[DataFrame]) -> DataFrame:
    """Union of dictionaries; the later table, and in it the later line, wins on an equal key."""
    both = reduce(lambda a, b: a.unionByName(b), [t.withColumn("file_no", F.lit(i)) for i, t in enumerate(tables)])
    return keep_latest(both, ["informal"], ["file_no", "line"])


def load_lexicon(spark: SparkSession, paths: list[str], columns: str = "informal normalized category dialect example_input example_output notes") -> DataFrame:
    """Dictionary CSV files with a header; columns are taken by name."""

    def read(path: str) -> DataFrame:
        df = spark.read.option("header", True).option("enforceSchema", False).option("multiLine", True).option("escape", '"').csv(path)
        return lexicon_entries(df)

    return override([read(p) for p in paths])


def expression_entries(raw: DataFrame) -> DataFrame:
    """Clean expression rows with ``token_count``."""
    return raw.withColumn("expression", F.lower(F.trim("expression"))).filter("expression <> '' and expression not like '#%'").select(
        "expression",
        F.coalesce(F.trim("normalized"), "expression").alias("normalized"),
        F.upper(_clean("category", "EXPRESSION")).alias("category"),
        _clean("dialect", "Standard").alias("dialect"),
        F.size(F.split("expression", r"\s+")).alias("token_count"),
    )


def load_expressions(spark: SparkSession, path: str) -> DataFrame:
    return expression_entries(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))


def lexicon_filter(lex: DataFrame, category: str | None = None, dialect: str | None = None) -> DataFrame:
    """Entries of a category or a dialect, without regard to case."""
    out = lex.filter(F.upper("category") == category.upper()) if category else lex
    return out.filter(F.lower("dialect") == dialect.lower()) if dialect else out


def rules_ordered(expressions: DataFrame) -> DataFrame:
    """Expressions in the order in which they apply: more words first, then by alphabet."""
    return expressions.orderBy(F.col("token_count").desc(), "expression")
