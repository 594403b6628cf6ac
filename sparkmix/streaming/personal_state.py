"""Personal terms as state of a stream of changes, keyed by user, and read back as a table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..session import share_package

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = -(1 << 62)
#: What the state holds for a term; ``op`` is put or remove, so that an older change that comes late finds the newer one.
TERM = "normalized string, category string, op string, seq long, usage_count long"


class PersonalTerms(StatefulProcessor):
    """One row of output for each change that took effect."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.terms = handle.getMapState("terms", "term string", TERM)
        self.cleared = handle.getValueState("cleared", "seq long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        """Every call on the state is a round trip, so a term is read once and written once, however many changes it takes."""
        kept = self.cleared.get()
        cleared = before = NEVER if kept is None else kept[0]
        unread, stored, known, touched = self.terms.exists(), set(), {}, set()
        changes = [c for frame in rows for c in zip(*(frame[name].tolist() for name in ("seq", "op", "term", "normalized", "category")))]
        changes.sort(key=lambda c: c[0])
        done = []
        for seq, op, term, normalized, category in changes:
            if seq <= cleared:
                continue
            if op == "reset":
                if unread:
                    for (old,), value in self.terms.iterator():
                        if old not in stored and old not in touched:
                            known[old] = tuple(value)
                        stored.add(old)
                    unread = False
                touched.update(known)
                known = {old: value for old, value in known.items() if value[3] >= seq}
                cleared = seq
            else:
                if unread and term not in known and term not in touched:
                    value = self.terms.getValue((term,))
                    if value is not None:
                        known[term] = tuple(value)
                        stored.add(term)
                value = known.get(term)
                if op == "use":
                    if value is None or value[2] != "put" or value[3] > seq:
                        continue
                    known[term] = (*value[:4], value[4] + 1)
                elif value is None or value[3] < seq:
                    put = op == "put"
                    known[term] = (normalized if put else None, category if put else None, op, seq, 0)
                else:
                    continue
                touched.add(term)
            done.append((key[0], seq, op, term))
        for term in touched:
            if term in known:
                self.terms.updateValue((term,), known[term])
            elif term in stored:
                self.terms.removeKey((term,))
        if cleared != before:
            self.cleared.update((cleared,))
        yield pd.DataFrame(done, columns=["user_id", "seq", "op", "term"])

    def close(self) -> None:
        pass


def clean_changes(changes: DataFrame) -> DataFrame:
    """Changes (user_id, seq, op, term, normalized, category) with trimmed, lower-cased terms and upper-cased categories; sensitive puts, unknown
    operations, and changes without user, number or term (but for ``reset``) are left out."""
    term = F.lower(F.trim("term"))
    sensitive = X.sensitive_rule(F.col("term"), F.col("normalized")).isNotNull()
    return (
        changes.filter(F.col("user_id").isNotNull() & F.col("seq").isNotNull() & F.col("op").isin("put", "remove", "use", "reset"))
        .filter((F.col("op") == "reset") | F.col("term").isNotNull())
        .filter(~((F.col("op") == "put") & sensitive))
        .select("user_id", F.col("seq").cast("long").alias("seq"), "op", F.when(F.col("op") != "reset", term).alias("term"), F.trim("normalized").alias("normalized"), F.upper("category").alias("category"))
    )


def follow_terms(changes: DataFrame, dst: str, checkpoint: str) -> None:
    """Take all changes that have arrived into the state under ``checkpoint``, and append those that took effect to ``dst``.

    Ordered by ``seq`` a user's last put or remove of a term counts, also when it arrives before an older one; ``reset`` takes all terms
    before it; ``use`` counts the uses of a term since it was put. Each change touches one user's state; no table is rewritten, and
    after a failure the stream goes on from its last checkpoint.
    """
    spark = changes.sparkSession
    share_package(spark)
    user = dict(changes.dtypes)["user_id"]
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        took = clean_changes(changes).groupBy("user_id").transformWithStateInPandas(PersonalTerms(), f"user_id {user}, seq long, op string, term string", "Append", "None")
        took.writeStream.format("parquet").option("path", dst).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(PROVIDER, before)


def current_terms(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(user_id, term, normalized, category, usage_count) as the state under ``checkpoint`` holds them."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "terms").load()
    value = F.col("user_map_value")
    return state.filter(value["op"] == "put").select(
        F.col("key")["user_id"].alias("user_id"), F.col("user_map_key")["term"].alias("term"), value["normalized"].alias("normalized"), value["category"].alias("category"), value["usage_count"].alias("usage_count")
    )
