"""Tables of users' profiles, terms and commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .joins import keep_latest

DEFAULTS = {"preferred_language": "Tanglish", "preferred_dialect": "Standard", "response_style": "concise"}


def upsert_terms(base: DataFrame, changes: DataFrame) -> DataFrame:
    """(user_id, term, normalized, category) after ordered changes (op ``put`` or ``remove``, seq).

    Keys are trimmed and lower-cased, categories upper-cased, sensitive puts are
    rejected, the last change of a key wins.
    """
    old = base.select("user_id", "term", "normalized", "category", F.lit("put").alias("op"), F.lit(-1).cast("long").alias("seq"))
    new = changes.select("user_id", "term", "normalized", "category", "op", F.col("seq").cast("long").alias("seq"))
    clean = new.filter((F.col("op") == "remove") | X.sensitive_rule(F.col("term"), F.col("normalized")).isNull())
    both = old.unionByName(clean).withColumns({"term": F.lower(F.trim("term")), "normalized": F.trim("normalized"), "category": F.upper("category")})
    return keep_latest(both, ["user_id", "term"], ["seq"]).filter("op = 'put'").select("user_id", "term", "normalized", "category")


def profiles_effective(users: DataFrame, profiles: DataFrame) -> DataFrame:
    """A profile for every user; what is missing is a default."""
    p = profiles.select("user_id", *[F.col(c).alias(f"_{c}") for c in DEFAULTS])
    return users.select("user_id").distinct().join(p, "user_id", "left").select("user_id", *[F.coalesce(f"_{c}", F.lit(v)).alias(c) for c, v in DEFAULTS.items()])


def update_profiles(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """Profiles with the non-null fields of ``changes``; user_id and created_at never change."""
    c = changes.select("user_id", *[F.col(x).alias(f"_{x}") for x in DEFAULTS if x in changes.columns])
    return profiles.join(c, "user_id", "left").select(*[F.coalesce(f"_{x}", x).alias(x) if f"_{x}" in c.columns else F.col(x) for x in profiles.columns])


def reset_users(profiles: DataFrame, terms: DataFrame, users: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles with the given users back at defaults, and terms without theirs."""
    gone = users.select("user_id").distinct()
    kept = profiles.join(gone, "user_id", "left_anti").select("user_id", *DEFAULTS)
    fresh = gone.select("user_id", *[F.lit(v).alias(c) for c, v in DEFAULTS.items()])
    return kept.unionByName(fresh), terms.join(gone, "user_id", "left_anti")


def command_counts(events: DataFrame, k: int = 5, command: str = "command") -> DataFrame:
    """(user_id, command, n, rank) of each user's k most frequent commands; blank and sensitive ones are left out."""
    clean = events.select("user_id", F.lower(F.trim(command)).alias("command")).filter("command <> ''")
    clean = clean.filter(X.sensitive_rule(F.col("command")).isNull())
    counts = clean.groupBy("user_id", "command").agg(F.count("*").alias("n"))
    return counts.withColumn("rank", F.row_number().over(W.partitionBy("user_id").orderBy(F.col("n").desc(), "command"))).filter(F.col("rank") <= k)
