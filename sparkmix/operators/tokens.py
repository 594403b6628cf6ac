"""Language and code-mixing, per row by array functions and per corpus by token tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicon as L
from ..functions import tags
from ..functions import text as X


def tokens_table(df: DataFrame, id_col: str = "utt_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, tag, tamil_chars, ascii_alpha, tng_score), one row for each token."""
    return df.select(F.col(id_col), F.posexplode(X.tokenize(F.col(text_col))).alias("pos", "token")).withColumn("tag", X.tag_token(F.col("token"))).withColumns(
        {
            "tamil_chars": X.tamil_chars(F.col("token")),
            "ascii_alpha": X.ascii_letters(F.col("token")),
            "tng_score": F.when(F.col("tag") == "tanglish", X.tanglish_score(X.lower_token(F.col("token")))).otherwise(0.0),
        }
    )


def token_tag_counts(tokens: DataFrame, id_col: str = "utt_id") -> DataFrame:
    n = lambda tag: F.count_if(F.col("tag") == tag)
    return tokens.groupBy(id_col).agg(
        F.count("*").alias("n_tokens"),
        F.count_if(F.col("tag") != "other").alias("n_classified"),
        n("ta").alias("n_ta"),
        n("en").alias("n_en"),
        n("tanglish").alias("n_tanglish"),
        n("mixed").alias("n_mixed"),
        F.sum("tamil_chars").alias("tamil_chars"),
        F.sum("ascii_alpha").alias("ascii_chars"),
        F.round(F.avg("tng_score"), 6).alias("avg_tanglish_score"),
    )


def code_mix_index(tokens: DataFrame, id_col: str = "utt_id") -> DataFrame:
    """One minus the share of the largest language; a mixed token counts half for each of two."""
    n = lambda tag: F.count_if(F.col("tag") == tag)
    half = F.lit(0.5) * n("mixed")
    largest = F.greatest(n("ta") + half, n("en") + half, n("tanglish").cast("double"))
    return tokens.filter("tag <> 'other'").groupBy(id_col).agg(X.rounded(F.greatest(F.lit(0.0), 1 - largest / F.count("*"))).alias("cmi"))


def m_index(tokens: DataFrame, id_col: str = "utt_id") -> DataFrame:
    """Entropy of the tags over the log of their number."""
    counts = tokens.filter("tag <> 'other'").groupBy(id_col, "tag").count()
    total = F.sum("count").over(W.partitionBy(id_col))
    share = counts.withColumn("p", F.col("count") / total)
    k = F.count("*")
    return share.groupBy(id_col).agg(F.round(F.when(k > 1, F.sum(-F.col("p") * F.log2("p")) / F.log2(k)).otherwise(0.0), 4).alias("m_index"))


def switch_points(tokens: DataFrame, id_col: str = "utt_id") -> DataFrame:
    order = W.partitionBy(id_col).orderBy("pos")
    return tokens.filter("tag <> 'other'").withColumn("turn", F.col("tag") != F.lag("tag").over(order)).groupBy(id_col).agg(F.count_if("turn").alias("switch_points"))


def dominant_spans(tokens: DataFrame, id_col: str = "utt_id") -> DataFrame:
    """Runs of equal tags: start, end (exclusive) and the tokens."""
    order = W.partitionBy(id_col).orderBy("pos")
    changed = F.coalesce((F.col("tag") != F.lag("tag").over(order)).cast("int"), F.lit(0))
    runs = tokens.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order))
    return runs.groupBy(id_col, "run").agg(
        F.min("pos").alias("start"),
        (F.max("pos") + 1).alias("end"),
        F.min("tag").alias("language"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), " ").alias("tokens"),
    ).drop("run")


def collapse_repeats(tokens: DataFrame, id_col: str = "utt_id") -> DataFrame:
    """The token rows without those that repeat the one before, without regard to case."""
    order = W.partitionBy(id_col).orderBy("pos")
    return tokens.withColumn("last", F.lag(F.lower("token")).over(order)).filter(F.col("last").isNull() | (F.col("last") != F.lower("token"))).drop("last")


def lexicon_coverage(tokens: DataFrame, known: Column, id_col: str = "utt_id") -> DataFrame:
    return tokens.groupBy(id_col).agg(F.round(F.avg(known.cast("double")), 6).alias("coverage"))


# Per row ------------------------------------------------------------------


def detect_language(df: DataFrame, text_col: str = "text", cfg: dict = L.LANGUAGE_THRESHOLDS) -> DataFrame:
    """Adds tokens, tags, evidence counts, ratios, language, code_mixed and confidence. No shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumn("tokens", X.tokenize(text)).withColumn("_tagged", tags.tag_words(cfg)(F.col("tokens")))
    out = out.withColumns({c: F.col(f"_tagged.{c}") for c in ("tags", "n_ta", "n_en", "n_tanglish", "n_mixed", "score_sum")}).withColumns(
        {
            "n_tokens": F.size("tokens"),
            "tamil_chars": X.tamil_chars(text),
            "ascii_chars": X.ascii_letters(text),
        }
    ).drop("_tagged")
    out = out.withColumn("n_classified", F.col("n_ta") + F.col("n_en") + F.col("n_tanglish") + F.col("n_mixed"))
    n = F.greatest("n_classified", F.lit(1))
    out = out.withColumns(
        {
            "tamil_ratio": F.col("tamil_chars") / F.greatest(F.col("tamil_chars") + F.col("ascii_chars"), F.lit(1)),
            "token_tamil_ratio": (F.col("n_ta") + F.col("n_mixed")) / n,
            "english_ratio": F.col("n_en") / n,
            "tanglish_ratio": F.col("n_tanglish") / n,
            "avg_tanglish_score": F.col("score_sum") / F.greatest("n_tokens", F.lit(1)),
        }
    ).drop("score_sum")
    ratios = [F.col(c) for c in ("tamil_ratio", "english_ratio", "tanglish_ratio", "avg_tanglish_score")]
    out = out.withColumn("label", X.classify_language(*ratios, cfg=cfg)).withColumns({"language": F.col("label.language"), "code_mixed": F.col("label.code_mixed")}).drop("label")
    blank = F.length(F.trim(text)) == 0
    return out.withColumn("confidence", F.when(blank, 0.0).otherwise(X.language_confidence(F.col("language"), *ratios, F.col("n_tokens"), cfg=cfg)))


def detect_code_mix(df: DataFrame, text_col: str = "text", cfg: dict = L.LANGUAGE_THRESHOLDS) -> DataFrame:
    """``detect_language`` plus cmi, switch_points, m_index and dominant_spans. No shuffle."""
    out = detect_language(df, text_col, cfg)
    n, half = F.col("n_classified"), F.lit(0.5) * F.col("n_mixed")
    largest = F.greatest(F.col("n_ta") + half, F.col("n_en") + half, F.col("n_tanglish").cast("double"))
    used = F.filter("tags", lambda t: t != "other")
    parts = [F.col(c) for c in ("n_ta", "n_en", "n_tanglish", "n_mixed")]
    kinds = sum((p > 0).cast("int") for p in parts)
    entropy = sum(F.when(p > 0, -(p / n) * F.log2(p / n)).otherwise(0.0) for p in parts)
    starts = F.filter(F.sequence(F.lit(0), F.size("tags") - 1), lambda i: (i == 0) | (F.get("tags", i) != F.get("tags", i - 1)))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("tags")))
    return (
        out.withColumns(
            {
                "cmi": F.when(n == 0, 0.0).otherwise(X.rounded(F.greatest(F.lit(0.0), 1 - largest / n))),
                "switch_points": F.size(F.filter(F.zip_with(used, F.slice(used, 2, F.greatest(F.size(used), F.lit(1))), lambda a, b: b.isNotNull() & (a != b)), lambda x: x)),
                "m_index": F.when(kinds <= 1, 0.0).otherwise(F.round(entropy / F.log2(kinds), 4)),
                "starts": F.when(F.size("tags") > 0, starts).otherwise(F.array().cast("array<int>")),
            }
        )
        .withColumn(
            "dominant_spans",
            F.when(
                F.size("tags") > 0,
                F.zip_with("starts", ends, lambda a, b: F.struct(a.alias("start"), b.alias("end"), F.get("tags", a).alias("language"), F.slice("tokens", a + 1, b - a).alias("tokens"))),
            ).otherwise(F.array().cast("array<struct<start:int,end:int,language:string,tokens:array<string>>>")),
        )
        .drop("starts")
    )
