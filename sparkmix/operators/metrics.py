"""Evaluation metrics in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as X
from .ranks import values_at


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.when(b == 0, 0.0).otherwise(a / F.when(b == 0, 1).otherwise(b))


def confusion_matrix(pairs: DataFrame, classes: list[str]) -> DataFrame:
    """(truth, prediction, n) over the whole grid of classes, zeros included; other labels are left out.

    Spellings of a dialect count as its class, unless ``classes`` names the spelling itself.
    """
    named = lambda c: F.when(F.col(c).isin(*classes), F.col(c)).otherwise(X.canonical_dialect(F.col(c))).alias(c)
    pairs = pairs.select(named("truth"), named("prediction"))
    spark = pairs.sparkSession
    labels = spark.createDataFrame([(c,) for c in classes], "truth string")
    grid = labels.select("truth", F.explode(F.array(*[F.lit(c) for c in classes])).alias("prediction"))
    counts = pairs.groupBy("truth", "prediction").agg(F.count("*").alias("k"))
    return F.broadcast(grid).join(counts, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("k", F.lit(0)).alias("n"))


def accuracy(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.round(F.avg((F.col("truth") == F.col("prediction")).cast("double")), 4).alias("accuracy"), F.count("*").alias("n"))


def per_class_prf(pairs: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support, predicted) of every class that occurs on either side."""
    both = pairs.select(F.inline(F.array(F.struct(F.col("truth").alias("class"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("prediction")).cast("int").alias("ok")), F.struct(F.col("prediction").alias("class"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("ok")))))
    sums = both.groupBy("class").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum("ok").alias("tp"))
    p, r = ratio(F.col("tp"), F.col("predicted")), ratio(F.col("tp"), F.col("support"))
    return sums.select("class", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(ratio(2 * p * r, p + r), 4).alias("f1"), "support", "predicted", ratio(2 * p * r, p + r).alias("_f1"))


def macro_f1(pairs: DataFrame, classes: list[str] | None = None) -> DataFrame:
    """Mean F1 of the classes that occur; with ``classes``, of those among them."""
    prf = per_class_prf(pairs)
    prf = prf.filter(F.col("class").isin(*classes)) if classes else prf
    return prf.agg(F.round(F.coalesce(F.avg("_f1"), F.lit(0.0)), 4).alias("macro_f1"))


def binary_prf(pairs: DataFrame) -> DataFrame:
    t, p = F.col("truth"), F.col("prediction")
    one = pairs.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"))
    c = {k: F.col(k) for k in ("tp", "tn", "fp", "fn")}
    prec, rec = ratio(c["tp"], c["tp"] + c["fp"]), ratio(c["tp"], c["tp"] + c["fn"])
    return one.select(
        F.round(ratio(c["tp"] + c["tn"], c["tp"] + c["tn"] + c["fp"] + c["fn"]), 4).alias("accuracy"),
        F.round(prec, 4).alias("precision"),
        F.round(rec, 4).alias("recall"),
        F.round(ratio(2 * prec * rec, prec + rec), 4).alias("f1"),
    )


def error_rates(pairs: DataFrame, ref: str = "reference", hyp: str = "prediction") -> DataFrame:
    """Means of the rows' WER and CER, which may exceed 1, and their number."""
    return pairs.agg(F.round(F.avg(X.wer(F.col(ref), F.col(hyp))), 4).alias("wer"), F.round(F.avg(X.cer(F.col(ref), F.col(hyp))), 4).alias("cer"), F.count("*").alias("n"))


def word_error_counts(pairs: DataFrame, ref: str = "reference", hyp: str = "prediction") -> DataFrame:
    """(words, errors, substitutions, deletions, insertions, wer) of all rows together; ``wer`` weighs rows by their words."""
    words = F.size(X.split_words(X.normalize_transcript(F.col(ref)), " "))
    kinds = ("substitutions", "deletions", "insertions")
    one = pairs.select(words.alias("words"), X.word_errors(F.col(ref), F.col(hyp)).alias("e")).agg(F.sum("words").alias("words"), F.sum("e.distance").alias("errors"), *[F.sum(f"e.{k}").alias(k) for k in kinds])
    return one.withColumn("wer", F.round(ratio(F.col("errors"), F.col("words")), 4))


def normalisation_quality(pairs: DataFrame, ref: str = "reference", hyp: str = "prediction") -> DataFrame:
    a, b = F.col(ref), F.col(hyp)
    mean = lambda c: F.round(F.avg(c.cast("double")), 4)
    return pairs.agg(
        mean(X.exact_match(a, b)).alias("exact_match_rate"),
        mean(X.token_f1(a, b)).alias("token_f1"),
        mean(X.bleu1(a, b)).alias("bleu1"),
        mean(X.char_similarity(a, b)).alias("char_similarity"),
    )


def preservation_rate(rows: DataFrame, anchors: str = "anchors", normalized: str = "normalized_text") -> DataFrame:
    """Share of anchors whose value is in the output; 1 without anchors. A negation counts only if its value does."""
    low = F.lower(normalized)
    n = F.size(anchors)
    ok = F.size(F.filter(anchors, lambda a: low.contains(F.lower(a["value"]))))
    return rows.agg(F.sum(n).alias("total_anchors"), F.sum(ok).alias("anchors_preserved")).select(
        F.round(F.when(F.col("total_anchors") > 0, F.col("anchors_preserved") / F.greatest("total_anchors", F.lit(1))).otherwise(1.0), 4).alias("preservation_rate"), "total_anchors", "anchors_preserved"
    )


def entity_prf(rows: DataFrame, pred: str = "pred", ref: str = "ref") -> DataFrame:
    """Micro precision, recall and F1 of two arrays of values taken as sets."""
    p, r = F.array_distinct(pred), F.array_distinct(ref)
    one = rows.agg(F.sum(F.size(F.array_intersect(p, r))).alias("tp"), F.sum(F.size(F.array_except(p, r))).alias("fp"), F.sum(F.size(F.array_except(r, p))).alias("fn"))
    prec, rec = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return one.select(F.round(prec, 4).alias("precision"), F.round(rec, 4).alias("recall"), F.round(ratio(2 * prec * rec, prec + rec), 4).alias("f1"))


#: Parts of words that must not be in a response.
RAW_SLANG = ("dei", "machi", "pannu", "da", "la", "kudu")


def task_checks(rows: DataFrame) -> DataFrame:
    """Adds intent_ok, entity_ok, slang_found and success from pred_intent, ref_intent, entities (map) and response."""
    resp = F.lower("response")
    values = F.filter(F.map_values("entities"), lambda v: F.coalesce(v != "", F.lit(False)))
    return rows.withColumns(
        {
            "intent_ok": X.canonical_intent(F.col("pred_intent")) == X.canonical_intent(F.col("ref_intent")),
            "entity_ok": (F.size("entities") == 0) | F.exists(values, lambda v: resp.contains(F.lower(v))),
            "slang_found": resp.rlike("|".join(RAW_SLANG)),
        }
    ).withColumn("success", F.col("intent_ok") & F.col("entity_ok") & ~F.col("slang_found"))


def task_success(rows: DataFrame) -> DataFrame:
    return task_checks(rows).agg(
        F.round(F.coalesce(F.avg(F.col("success").cast("double")), F.lit(0.0)), 4).alias("task_success_rate"), F.count_if("success").alias("success_count"), F.count_if(~F.col("success")).alias("failure_count")
    )


def latency_summary(records: DataFrame, components: list[str]) -> DataFrame:
    """(component, mean, p50, p95, max); a percentile is the value at place floor(q * (n - 1)) of the ascending values, by ``values_at``.

    Null and NaN are left out, and so is a component without values.
    """
    value = {c: F.col(c).cast("double") for c in components}
    value = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    stats = [f(v).alias(f"{name}_{c}") for c, v in value.items() for name, f in (("mean", F.avg), ("max", F.max))]
    row, at = values_at(records, components, lambda n: [int(0.50 * (n - 1)), int(0.95 * (n - 1))], *stats)
    rows = [(c, row[f"mean_{c}"], *at[c], row[f"max_{c}"]) for c in components if at[c]]
    out = records.sparkSession.createDataFrame(rows, "component string, mean double, p50 double, p95 double, max double")
    return out.select("component", *[F.round(c, 2).alias(c) for c in ("mean", "p50", "p95", "max")])


def status_summary(qc: DataFrame, status: str = "status") -> DataFrame:
    counts = qc.groupBy(status).agg(F.count("*").alias("n"))
    return counts.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(W.partitionBy()), 2))


def first_reasons(qc: DataFrame, k: int = 5, id_col: str = "clip_id") -> DataFrame:
    return qc.filter("status = 'REJECT'").orderBy(id_col).limit(k).select(id_col, "error")


def agreement_detail(rows: DataFrame, fields: list[str]) -> DataFrame:
    """Adds ``<field>_matched`` for each field, compared without regard to case."""
    text = lambda c: F.lower(F.col(c).cast("string"))
    return rows.withColumns({f"{f}_matched": text(f"expected_{f}") == text(f"predicted_{f}") for f in fields})


def agreement_report(rows: DataFrame, fields: list[str], latency: str = "latency_ms") -> DataFrame:
    """Match rates in percent, and the mean latency."""
    d = agreement_detail(rows, fields)
    return d.agg(F.count("*").alias("n"), *[F.round(100 * F.avg(F.col(f"{f}_matched").cast("double")), 4).alias(f"{f}_accuracy") for f in fields], F.round(F.avg(latency), 4).alias("mean_latency_ms"))
