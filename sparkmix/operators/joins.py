"""Lookups and matches as equi-joins."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.phrases import PhraseTable
from ..session import share_package

#: Sides of at most so many rows are broadcast; larger ones are left to the planner.
SMALL_ROWS = 10_000
#: Texts of one user that a task gets, about.
SHARE_ROWS = 100_000


def small(df: DataFrame) -> DataFrame:
    """A broadcast hint, if the table is small enough."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def lookup_tokens(tokens: DataFrame, lexicon: DataFrame, token: str = "token") -> DataFrame:
    """Adds normalized, category and matched by the cleaned lower-case token; a miss passes through as UNKNOWN."""
    key = F.regexp_replace(F.lower(token), r"""^[.,!?;:"'()]+|[.,!?;:"'()]+$""", "")
    lex = lexicon.select(F.col("informal").alias("_key"), F.col("normalized").alias("_norm"), F.col("category").alias("_cat"))
    return (
        tokens.withColumn("_key", key)
        .join(small(lex), "_key", "left")
        .withColumns({"normalized": F.coalesce("_norm", token), "category": F.coalesce("_cat", F.lit("UNKNOWN")), "matched": F.col("_norm").isNotNull()})
        .drop("_key", "_norm", "_cat")
    )


def district_dimension(spark: SparkSession) -> DataFrame:
    pairs = [(d, name) for name, ds in L.DISTRICTS.items() for d in ds]
    return spark.createDataFrame(pairs, "district string, dialect string")


def map_district(df: DataFrame, dim: DataFrame, col: str = "district", default: str = "Standard") -> DataFrame:
    """Adds dialect: the exact district, else the trimmed title-case one, else the default."""
    one = dim.select(F.col("district").alias("_a"), F.col("dialect").alias("_da"))
    two = dim.select(F.col("district").alias("_b"), F.col("dialect").alias("_db"))
    return (
        df.withColumn("_a", F.col(col))
        .withColumn("_b", F.initcap(F.trim(F.col(col))))
        .join(small(one), "_a", "left")
        .join(small(two), "_b", "left")
        .withColumn("dialect", F.coalesce("_da", "_db", F.lit(default)))
        .drop("_a", "_b", "_da", "_db")
    )


def resume_pending(manifest: DataFrame, done: DataFrame, key: str = "sample_id") -> DataFrame:
    """Rows of the manifest without a result yet."""
    return manifest.join(done.select(key).distinct(), key, "left_anti")


def ngrams(df: DataFrame, most: int, id_col: str = "utt_id", text_col: str = "text") -> DataFrame:
    """(id, start, end, gram) of all runs of up to ``most`` lower-case words; ``end`` is exclusive."""
    words = df.select(id_col, X.split_words(F.regexp_replace(F.lower(text_col), r"[^\p{L}\p{N}_]+", " "), " ").alias("words"))
    starts = words.filter(F.size("words") > 0).select(id_col, "words", F.explode(F.sequence(F.lit(0), F.size("words") - 1)).alias("start"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(most), F.size("words") - F.col("start")))
    return starts.select(id_col, "words", "start", F.explode(lengths).alias("n")).select(
        id_col, "start", (F.col("start") + F.col("n")).alias("end"), F.array_join(F.slice("words", F.col("start") + 1, F.col("n")), " ").alias("gram")
    )


def match_expressions(df: DataFrame, expressions: DataFrame, id_col: str = "utt_id", text_col: str = "text") -> DataFrame:
    """(id, expression, normalized, category, start, end) of expressions at word boundaries, by n-gram equality."""
    most = expressions.agg(F.max("token_count")).first()[0] or 1
    side = expressions.select(F.col("expression").alias("gram"), "normalized", "category", "token_count")
    return ngrams(df, most, id_col, text_col).join(small(side), "gram").withColumnRenamed("gram", "expression")


def longest_match(matches: DataFrame, id_col: str = "utt_id") -> DataFrame:
    """Matches left when longer expressions, then alphabetically first ones, then earlier ones win over those they overlap.

    The matches of one text are taken in that order; those that are kept lie in order, so that each looks at its two neighbours only.
    """
    order = F.sort_array(F.collect_list(F.struct((-F.col("token_count")).alias("o1"), F.col("expression").alias("o2"), F.col("start").alias("o3"), "end", "normalized", "category")))
    share_package(matches.sparkSession)
    grouped = matches.groupBy(id_col).agg(order.alias("all"))

    @F.arrow_udf("array<int>")
    def places(starts: pa.Array, ends: pa.Array) -> pa.Array:
        return pa.array([free_places(s, e) for s, e in zip(starts.to_pylist(), ends.to_pylist(), strict=True)], pa.list_(pa.int32()))

    kept = F.transform("places", lambda i: F.get("all", i))
    grouped = grouped.withColumn("places", places(F.col("all.o3"), F.col("all.end"))).select(id_col, F.explode(kept).alias("m"))
    return grouped.select(id_col, F.col("m.o2").alias("expression"), F.col("m.normalized").alias("normalized"), F.col("m.category").alias("category"), F.col("m.o3").alias("start"), F.col("m.end").alias("end"), (-F.col("m.o1")).alias("token_count"))


def free_places(starts: list[int], ends: list[int]) -> list[int]:
    """The places of the intervals [start, end) that overlap none kept before them."""
    left: list[int] = []
    right: list[int] = []
    out = []
    for place, (start, end) in enumerate(zip(starts, ends, strict=True)):
        at = bisect_left(left, end)  # the kept ones before it begin before this one ends; the last of them ends last
        if not at or right[at - 1] <= start:
            left.insert(at, start)
            right.insert(at, end)
            out.append(place)
    return out


def pair_truth(truth: DataFrame, pred: DataFrame, key: str, value: str) -> DataFrame:
    """(key, truth, prediction) of rows in both."""
    return truth.select(key, F.col(value).alias("truth")).join(pred.select(key, F.col(value).alias("prediction")), key)


def resolve_dialect(utt: DataFrame, profiles: DataFrame) -> DataFrame:
    """Adds effective_dialect and dialect_source: explicit (not auto), detected regional, preferred, Standard."""
    prefs = profiles.select("user_id", F.trim("preferred_dialect").alias("_pref"))
    explicit, detected = F.trim("explicit_dialect"), F.trim("detected_dialect")
    says = F.coalesce((explicit != "") & (F.lower(explicit) != "auto"), F.lit(False))
    heard = F.coalesce(~F.lower(detected).isin("standard", "unknown", ""), F.lit(False))
    likes = F.coalesce(~F.lower("_pref").isin("standard", ""), F.lit(False))
    return (
        utt.join(prefs, "user_id", "left")
        .withColumns(
            {
                "effective_dialect": F.when(says, explicit).when(heard, detected).when(likes, F.col("_pref")).otherwise("Standard"),
                "dialect_source": F.when(says, "explicit_instruction").when(heard, "detected_speech").when(likes, "personalized_preference").otherwise("default_standard"),
            }
        )
        .drop("_pref")
    )


def _in_personal_order(term: Column) -> list[Column]:
    """Expressions of several words first, by words descending; then single words by characters descending; then alphabetically."""
    words = F.size(F.split(F.trim(term), r"\s+"))
    return [F.when(words > 1, -words).otherwise(0), -F.length(term), term]


def apply_user_terms(utt: DataFrame, terms: DataFrame, id_col: str = "utt_id", user_col: str = "user_id", text_col: str = "text", share_rows: int = SHARE_ROWS) -> DataFrame:
    """(id, user, personal_text, used), one row for each row of ``utt``: the user's own terms replaced, and the terms that were found.

    Each term, between word boundaries and without regard to case, is replaced over the whole text after those before it; what lies
    outside the matches stays as it is. A text of a user without terms, of no user, or null, stays too. ``terms`` has (user, term, normalized).

    A user's terms and texts meet in one task, terms first, and the texts stream by them; the texts of a user with more than
    ``share_rows`` of them are dealt to several tasks, each with all terms of that user.
    """
    spark = utt.sparkSession
    share_package(spark)
    id_type, user_type = utt.schema[id_col].dataType, utt.schema[user_col].dataType
    texts = utt.select(F.col(id_col).alias("id"), F.col(user_col).alias("user"), F.col(text_col).alias("a"))
    shares = texts.filter("user is not null").groupBy("user").agg(F.ceil(F.count("*") / share_rows).cast("int").alias("shares")).filter("shares > 1")
    term = F.trim("term")
    order = _in_personal_order(term)
    own = terms.filter(F.col(user_col).isNotNull() & (F.length(term) > 0)).select(F.col(user_col).cast(user_type).alias("user"), term.alias("a"), F.col("normalized").alias("b"), *[c.alias(f"o{i}") for i, c in enumerate(order[:2])])
    own = own.join(shares, "user", "left").select(
        "user", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share"), F.lit(0).alias("kind"), "o0", "o1", F.lit(None).cast(id_type).alias("id"), "a", "b"
    )
    dealt = F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))).cast("int")
    said = texts.filter("user is not null").join(shares, "user", "left").select("user", dealt.alias("share"), F.lit(1).alias("kind"), F.lit(0).alias("o0"), F.lit(0).alias("o1"), "id", "a", F.lit(None).cast("string").alias("b"))
    schema = StructType([StructField(id_col, id_type), StructField(user_col, user_type), StructField("personal_text", StringType()), StructField("used", ArrayType(StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, entries, table = None, [], PhraseTable([])
        for batch in batches:
            rows, put, used = [], [], []
            for at, (user, share, kind, a, b) in enumerate(zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 6, 7)), strict=True)):
                if owner != (user, share):
                    owner, entries, table = (user, share), [], None
                if not kind:
                    entries.append((a, b or "", a))
                    continue
                table = PhraseTable(entries) if table is None else table
                text, found = (None, []) if a is None else table.replace(a)
                rows.append(at)
                put.append(text)
                used.append(list(dict.fromkeys(term for _, _, term in found)))
            yield pa.RecordBatch.from_arrays([batch.column(5).take(pa.array(rows, pa.int64())), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(put, pa.string()), pa.array(used, pa.list_(pa.string()))], schema.names)

    both = own.unionByName(said).repartition("user", "share").sortWithinPartitions("user", "share", "kind", "o0", "o1", "a")
    nobody = texts.filter("user is null").select("id", "user", "a", F.array().cast("array<string>").alias("used")).toDF(*schema.names)
    return both.select("user", "share", "kind", "o0", "o1", "id", "a", "b").mapInArrow(run, schema).union(nobody)


def usage_counts(utt: DataFrame, terms: DataFrame, id_col: str = "utt_id") -> DataFrame:
    """(user_id, term, usage_count): in how many of the user's texts each term is replaced."""
    return apply_user_terms(utt, terms, id_col).select("user_id", F.explode("used").alias("term")).groupBy("user_id", "term").agg(F.count("*").alias("usage_count"))


def compare_systems(rows: DataFrame, systems: list[str], metric: str = "metric", value: str = "value") -> DataFrame:
    """One row for each metric, a column for each system, and the last one minus the first as ``delta``."""
    wide = rows.groupBy(metric).pivot("system", systems).agg(F.first(value))
    return wide.withColumn("delta", F.round(F.col(systems[-1]) - F.col(systems[0]), 4))


def keep_latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    packed = F.struct(*order, *[c for c in df.columns if c not in order])
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.max(packed).alias("r")).select(*[F.col(f"r.{c}") for c in df.columns])


def numbered(df: DataFrame, partition: list[str], order: list) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.partitionBy(*partition).orderBy(*order)))
