"""Quality control of sample arrays, by array functions alone."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

LIMITS = {"min_s": 0.1, "max_s": 60.0, "warn_min_s": 0.5, "warn_max_s": 30.0, "min_peak": 1e-6, "max_peak": 1.1, "max_channels": 8, "rates": ()}
GAIN = {"peak_db": -3.0, "rms_db": -20.0, "clip_db": -0.1, "silence_db": -60.0}


def _sum(xs: Column, f=lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x.cast("double")))


def decibels(linear: Column) -> Column:
    return F.when(linear > 0, 20 * F.log10(F.when(linear > 0, linear))).otherwise(float("-inf"))


def rounded(x: Column, places: int = 4) -> Column:
    """``round`` that keeps the sign of what becomes zero, as logs show it: -0.00002 is -0.0000."""
    return F.round(F.abs(x), places) * F.signum(x)


def to_linear(db: float) -> float:
    return 10 ** (db / 20)


def mono(clips: DataFrame) -> DataFrame:
    """``samples`` of one channel: arrays of channels become the mean over channels, plain arrays stay. A channel that ends early counts with the places it has."""
    if not isinstance(clips.schema["samples"].dataType.elementType, ArrayType):
        return clips
    size = F.array_max(F.transform("samples", F.size))
    at = lambda i: F.filter(F.transform("samples", lambda c: F.get(c, i).cast("double")), lambda x: x.isNotNull())
    mean = F.transform(F.sequence(F.lit(0), size - 1), lambda i: _sum(at(i)) / F.nullif(F.size(at(i)), F.lit(0)))
    return clips.withColumn("samples", F.when(size > 0, mean).when(F.col("samples").isNotNull(), F.array().cast("array<double>")))


def clip_stats(clips: DataFrame) -> DataFrame:
    """Adds finite, duration, peak, rms, rms_dbfs and std of ``samples``, channels being averaged. An empty or null clip has null measures."""
    clips = mono(clips)
    xs = F.col("samples")
    n = F.nullif(F.size(xs), F.lit(0))
    mean = _sum(xs) / n
    out = clips.withColumns(
        {
            "finite": ~F.exists(xs, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))),
            "duration": F.size(xs) / F.col("sample_rate"),
            "peak": F.array_max(F.transform(xs, lambda x: F.abs(x.cast("double")))),
            "rms": F.sqrt(_sum(xs, lambda x: x * x) / n),
            "std": F.sqrt(F.greatest(F.lit(0.0), _sum(xs, lambda x: x * x) / n - mean * mean)),
        }
    )
    return out.withColumn("rms_dbfs", decibels(F.col("rms")))


def validate_clips(stats: DataFrame, limits: dict = LIMITS) -> DataFrame:
    """Adds status (PASS, WARN, REJECT) and messages. Broken samples and an impossible duration end the checks."""
    d, peak = F.col("duration"), F.col("peak")
    broken = ~F.coalesce("finite", F.lit(False))
    hard = F.when(d < limits["min_s"], "duration below hard minimum").when(d > limits["max_s"], "duration above hard maximum")
    soft = F.when(d < limits["warn_min_s"], "duration below recommended minimum").when(d > limits["warn_max_s"], "duration above recommended maximum")
    rate = F.when((F.col("sample_rate") <= 0) | (F.col("sample_rate") > 384_000), "implausible sample rate")
    listed = F.when(~F.col("sample_rate").isin(*limits["rates"]), "sample rate not in list") if limits["rates"] else F.lit(None).cast("string")
    channels = F.when(F.col("channels") > limits["max_channels"], "too many channels").when(F.col("channels") < 1, "invalid channel count")
    silent = F.when(peak < limits["min_peak"], "silent")
    clipped = F.when((peak >= limits["min_peak"]) & (peak > limits["max_peak"]), "possible clipping")
    flat = F.when(F.col("std") < 1e-9, "no variation")
    rejects, warns = F.array_compact(F.array(rate, channels, silent, flat)), F.array_compact(F.array(soft, listed, clipped))
    return stats.withColumns(
        {
            "status": F.when(broken | hard.isNotNull() | (F.size(rejects) > 0), "REJECT").when(F.size(warns) > 0, "WARN").otherwise("PASS"),
            "messages": F.when(broken, F.array(F.lit("not finite"))).when(hard.isNotNull(), F.array(hard)).otherwise(F.concat(warns, rejects)),
        }
    )


def estimate_snr(clips: DataFrame, frame_ms: float = 25, hop_ms: float = 10, noise_pct: float = 10) -> DataFrame:
    """Adds snr_db: mean RMS of the louder frames over that of the quietest; null for fewer than two frames or silence."""
    frame, hop = F.floor(F.col("sample_rate") * frame_ms / 1000).cast("int"), F.greatest(F.lit(1), F.floor(F.col("sample_rate") * hop_ms / 1000).cast("int"))
    n = F.when((frame > 0) & (F.size("samples") >= frame), 1 + F.floor((F.size("samples") - frame) / hop)).otherwise(0).cast("int")
    frames = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.sqrt(_sum(F.slice("samples", i * hop + 1, frame), lambda x: x * x) / frame))
    out = clips.withColumn("_f", F.when(n >= 2, F.sort_array(frames)))
    cut = F.greatest(F.lit(1), F.floor(F.size("_f") * noise_pct / 100).cast("int"))
    noise = _sum(F.slice("_f", F.lit(1), cut)) / cut + 1e-12
    speech = _sum(F.slice("_f", cut + 1, F.size("_f"))) / (F.size("_f") - cut) + 1e-12
    return out.withColumn("snr_db", F.when(F.array_max("_f") >= 1e-10, rounded(20 * F.log10(speech / noise), 2))).drop("_f")


def normalize_gain(stats: DataFrame, strategy: str = "peak", cfg: dict = GAIN) -> DataFrame:
    """Adds gain_db, norm_status, peak_out and normalized samples from the columns of ``clip_stats``."""
    guard = to_linear(cfg["clip_db"])
    silent = F.col("rms") < to_linear(cfg["silence_db"])
    target = {"peak": to_linear(cfg["peak_db"]) / (F.col("peak") + 1e-12), "rms": to_linear(cfg["rms_db"]) / (F.col("rms") + 1e-12), "none": F.lit(1.0)}[strategy]
    gain = F.when(silent, 1.0).otherwise(target)
    clamped = ~silent & (F.col("peak") * gain > guard) & F.lit(strategy != "none")
    scaled = F.transform("samples", lambda x: F.when(clamped, F.least(F.greatest(x * gain, F.lit(-guard)), F.lit(guard))).otherwise(x * gain))
    return stats.withColumns(
        {
            "gain_db": rounded(F.when(silent, 0.0).otherwise(decibels(gain))),
            "norm_status": F.when(silent, "SILENT").when(clamped, "CLAMPED").otherwise("OK"),
            "peak_out": F.when(clamped, F.lit(guard)).otherwise(F.col("peak") * gain),
            "normalized": scaled,
        }
    )


#: Columns of a quality row, in order.
QC_COLUMNS = "file status error duration orig_sample_rate target_sample_rate channels snr_db peak_in_dbfs peak_out_dbfs rms_in_dbfs gain_db norm_status".split()


def qc_report(clips: DataFrame, done: DataFrame | None = None, strategy: str = "peak", id_col: str = "clip_id") -> DataFrame:
    """One quality row for each clip that is not in ``done``. Samples keep their rate and rows are not timed one by one; ``peak_in`` is the linear peak."""
    rows = clips.join(done.select(id_col).distinct(), id_col, "left_anti") if done is not None else clips
    q = normalize_gain(estimate_snr(validate_clips(clip_stats(rows))), strategy)
    ok = F.col("status") != "REJECT"
    return q.select(
        F.col(id_col).cast("string").alias("file"),
        "status",
        F.array_join("messages", "; ").alias("error"),
        rounded(F.col("duration")).alias("duration"),
        F.col("sample_rate").alias("orig_sample_rate"),
        F.when(ok, F.col("sample_rate")).otherwise(0).alias("target_sample_rate"),
        "channels",
        F.when(ok, F.col("snr_db")).alias("snr_db"),
        rounded(decibels(F.col("peak"))).alias("peak_in_dbfs"),
        F.when(ok, rounded(decibels(F.col("peak_out")))).alias("peak_out_dbfs"),
        rounded(F.col("rms_dbfs")).alias("rms_in_dbfs"),
        F.when(ok, F.col("gain_db")).alias("gain_db"),
        F.when(ok, F.col("norm_status")).otherwise("").alias("norm_status"),
        rounded(F.col("peak")).alias("peak_in"),
    )


