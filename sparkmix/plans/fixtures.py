"""Inputs of the registered queries, derived from the driver's tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L

#: Example utterances that are put before the texts of conversations, which hold no romanised Tamil.
UTTERANCES = [
    "Dei nalaiku assignment submit panna remind pannu",
    "Machi inniku evening gym poga remind pannu",
    "Naalaikku kaalaila 6 maniku alarm vai",
    "Amma ku call pannu",
    "Thambi ku oru message anuppu naan late ah varen nu",
    "Semma song ondru podu",
    "Inniku weather eppadi iruku",
    "WhatsApp open pannu da",
    "Coimbatore ku vazhi kaatu",
    "Volume konjam kammi pannu",
    "Anna nalaiku meeting iruku remind pannunga",
    "Remind me to pay the electricity bill tomorrow",
    "Set an alarm for 5:30 am",
    "Appa ku phone pottu kudu",
    "Ilayaraja paatu podu la",
    "Naalaikku mazhai varuma",
    "Camera open pannu sikkiram",
    "Office ku route sollu bruh",
    "Brightness konjam koothu",
    "Ava enna panra ipo",
    "Vanakkam AVA eppadi iruka",
    "Bangalore population evlo nu search pannu",
    "Tomorrow morning ku 7 maniku alarm vai da",
    "Sister ku message anuppu",
    "Konjam music podu please",
    "Ayya nalaiku medicine saapida remind pannunga",
    "Chennai la traffic eppadi iruku nu sollu",
    "Wifi off pannu",
    "Friend ku call pottu kudu pa",
    "Play some Tamil songs please",
    "நான் school போகிறேன் schedule meeting tomorrow",
    "நான் பள்ளிக்கு போகிறேன் never check email",
    "call call pannu xநான்y 12 rendu 13",
]
CLASSES = ["error", "click", "view", "signup", "purchase"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt to all cores where a scan has fewer parts than there are cores; larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(utt_id, user_id, text): every turn of every conversation behind an example."""
    return as_utterances(spread(table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")))


def as_utterances(c: DataFrame) -> DataFrame:
    utt = (F.col("conv_id") * 1000 + F.col("turn")).alias("utt_id")
    first = F.element_at(F.array(*[F.lit(u) for u in UTTERANCES]), (F.pmod(F.col("conv_id") * 1000 + F.col("turn"), F.lit(len(UTTERANCES))) + 1).cast("int"))
    return c.select(utt, (F.col("conv_id") % 7).alias("user_id"), F.concat(first, F.lit(" "), F.col("text")).alias("text"))


def _list(items) -> str:
    return "[" + ", ".join("'" + str(x).replace("'", "''") + "'" for x in items) + "]"


def sql_map(d: dict) -> str:
    return f"MAP {{{', '.join(f'{quoted(k)}: {quoted(v)}' for k, v in d.items())}}}"


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


U_SQL = f"""u AS (SELECT conv_id * 1000 + turn AS utt_id, conv_id % 7 AS user_id,
 {_list(UTTERANCES)}[(conv_id * 1000 + turn) % {len(UTTERANCES)} + 1] || ' ' || text AS text FROM conversations)"""

_AFFIX = "^[a-z]{2,}(?:" + "|".join(L.TANGLISH_AFFIXES) + ")$"
_BREAK = "[\\s\\pZ\\x{0964}\\x{0965}.,!?;:\"''()\\[\\]{}<>]+"


def tokens_sql(source: str, key: str) -> str:
    """CTEs w0, w and t: the tagged tokens of a table."""
    return f"""w0 AS (SELECT {key}, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BREAK}'), lambda x: x <> '') AS ws FROM {source}),
w AS (SELECT {key}, unnest(ws) AS token, generate_subscripts(ws, 1) - 1 AS pos FROM w0),
w2 AS (SELECT *, regexp_matches(token, '[\\x{{0B80}}-\\x{{0BFF}}]') AS ta, regexp_matches(token, '[A-Za-z]') AS la,
  lower(token) IN ({', '.join(map(quoted, L.TANGLISH_WORDS))}) AS voc, regexp_matches(lower(token), '{_AFFIX}') AS aff FROM w),
t AS (SELECT {key}, pos, token, CASE WHEN ta AND la THEN 'mixed' WHEN ta THEN 'ta' WHEN la AND (voc OR aff) THEN 'tanglish' WHEN la THEN 'en' ELSE 'other' END AS tag,
  len(regexp_extract_all(token, '[\\x{{0B80}}-\\x{{0BFF}}]')) AS tamil_chars, len(regexp_extract_all(token, '[A-Za-z]')) AS ascii_alpha,
  CASE WHEN la AND NOT ta THEN (CASE WHEN voc THEN 1.0 ELSE 0.0 END + CASE WHEN aff THEN 2.0 ELSE 0.0 END)::DOUBLE ELSE 0.0 END AS tng_score FROM w2)"""


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A speech manifest from ``events``."""
    pick = lambda xs, c: F.element_at(F.array(*[F.lit(x) for x in xs]), (c + 1).cast("int"))
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select(
        u.alias("speaker_id"),
        pick(["Female", "Male"], u % 2).alias("gender"),
        pick(["18-30", "30-45", "45-60", "60+"], u % 4).alias("age_group"),
        pick(["Rural", "Urban", None], u % 3).alias("area"),
        F.col("event_type").alias("scenario"),
        F.concat(F.lit("task_"), (F.col("event_id") % 5).cast("string")).alias("task_name"),
        pick(L.DISTRICT_LIST, u % 36).alias("district"),
        F.col("props").alias("verbatim"),
        F.col("value").alias("duration"),
        (F.col("value") % 45).alias("snr"),
        F.col("event_id").alias("row_within_shard"),
    )


M_SQL = f"""m AS (SELECT user_id AS speaker_id, ['Female', 'Male'][user_id % 2 + 1] AS gender, ['18-30', '30-45', '45-60', '60+'][user_id % 4 + 1] AS age_group,
 ['Rural', 'Urban', NULL][user_id % 3 + 1] AS area, event_type AS scenario, 'task_' || (event_id % 5) AS task_name, {_list(L.DISTRICT_LIST)}[user_id % 36 + 1] AS district,
 props AS verbatim, value AS duration, value % 45 AS snr, event_id AS row_within_shard FROM events)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, reference, prediction) from ``benchmark``: two words changed, one letter doubled."""
    ref = F.col("text")
    hyp = F.regexp_replace(F.regexp_replace(ref, r"\bthe\b", "a"), "on", "onn")
    return table(spark, sf_dir, "benchmark").select("item_id", ref.alias("reference"), hyp.alias("prediction"))


P_SQL = r"""p AS (SELECT item_id, text AS reference,
 regexp_replace(regexp_replace(text, '\bthe\b', 'a', 'g'), 'on', 'onn', 'g') AS prediction FROM benchmark)"""


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, truth, prediction) from ``events``: the type, and another type for every seventh user."""
    t = table(spark, sf_dir, "events")
    other = F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (F.col("event_id") % 5 + 1).cast("int"))
    return t.select("event_id", F.col("event_type").alias("truth"), F.when(F.col("user_id") % 7 == 0, other).otherwise(F.col("event_type")).alias("prediction"))


L_SQL = f"l AS (SELECT event_id, event_type AS truth, CASE WHEN user_id % 7 = 0 THEN {_list(CLASSES)}[event_id % 5 + 1] ELSE event_type END AS prediction FROM events)"


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clip_id, sample_rate, channels, samples) from ``embeddings``; some clips are scaled, some silent, some broken."""
    k = F.col("vec_id") % 11
    scale = F.when(k == 0, 0.0).when(k == 1, 3.0).otherwise(1.0)
    xs = F.transform("embedding", lambda x, i: F.when((k == 2) & (i == 3), F.lit(float("nan"))).otherwise(x.cast("double") * scale))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip_id"), F.when(k == 3, 10).otherwise(400).alias("sample_rate"), F.when(k == 4, 9).otherwise(1).alias("channels"), xs.alias("samples"))


C_SQL = """c AS (SELECT vec_id AS clip_id, CASE WHEN vec_id % 11 = 3 THEN 10 ELSE 400 END AS sample_rate, CASE WHEN vec_id % 11 = 4 THEN 9 ELSE 1 END AS channels,
 list_transform(embedding, lambda x, i: CASE WHEN vec_id % 11 = 2 AND i = 4 THEN 'nan'::DOUBLE ELSE x::DOUBLE * CASE WHEN vec_id % 11 = 0 THEN 0.0 WHEN vec_id % 11 = 1 THEN 3.0 ELSE 1.0 END END) AS samples FROM embeddings)"""
