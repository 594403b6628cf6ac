"""Text analysis: normalisation, intent, entities, hand-off and prompts."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as X
from ..functions.phrases import Phrases, replace_words
from ..operators.tokens import detect_code_mix


@dataclass(frozen=True)
class RulePack:
    """Thresholds, glosses and fillers that a run may override; compiled into expressions."""

    thresholds: dict = field(default_factory=lambda: dict(L.LANGUAGE_THRESHOLDS))
    glosses: dict = field(default_factory=dict)
    fillers: tuple[str, ...] = ()
    dialect_fillers: dict = field(default_factory=dict)
    dictionary: dict = field(default_factory=dict)
    expressions: tuple[tuple[str, str], ...] = ()
    drop_tamil: bool = False
    anchors: dict = field(default_factory=dict)
    dialect_markers: dict = field(default_factory=lambda: dict(L.FIRST_MARKERS))


#: The settings that replace a list of anchors.
ANCHOR_SETTINGS = {"negation_markers": "negations", "time_words": "time_words", "apps": "apps", "places": "places", "device_targets": "devices"}


def rule_pack(config: dict) -> RulePack:
    """The built-in pack with the given settings put over it; keys and listed words are lower-cased. A list replaces the built-in one;
    of negation markers, settings that are no words (such as a bare ``no`` that a reader took for a truth value) are left out."""
    low = lambda d: {k.lower(): v for k, v in d.items()}
    words = lambda ws: [str(w).lower() for w in ws if w is not None and not isinstance(w, bool)]
    pack = RulePack()
    anchors = {name: words(config[key]) for key, name in ANCHOR_SETTINGS.items() if key in config}
    if "people" in config:
        anchors["people"] = low(config["people"])
    return replace(
        pack,
        thresholds=pack.thresholds | config.get("thresholds", {}),
        glosses=low(config.get("glosses", {})),
        fillers=tuple(f.lower() for f in config.get("fillers", ())),
        dialect_fillers=config.get("dialect_fillers", {}),
        dictionary=low(config.get("dictionary", {})),
        expressions=tuple(sorted(low(config.get("expressions", {})).items(), key=lambda e: (-len(e[0].split()), e[0]))),
        drop_tamil=config.get("drop_tamil", False),
        anchors=anchors,
        dialect_markers={name: words(ws) for name, ws in config["dialect_markers"].items()} if "dialect_markers" in config else pack.dialect_markers,
    )


#: Up to so many expressions are a chain of replacements in the JVM; more are looked up in a broadcast table, with the same outcome.
CHAINED = 16


def map_expressions(text: Column, expressions: tuple[tuple[str, str], ...], chained: int = CHAINED) -> Column:
    """Lower case, then expressions replaced in the given order (longest first)."""
    if len(expressions) > chained:
        return F.trim(Phrases((e, n, None) for e, n in expressions)(F.lower(text))["text"])
    rules = [(r"\b" + r"\s+".join(quote(w) for w in e.split()) + r"\b", n) for e, n in expressions]
    return F.trim(X.apply_phrases(text, rules)) if rules else F.trim(F.lower(text))


def quote(word: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in word)


def apply_dictionary(text: Column, dictionary: dict[str, str], drop_fillers: bool = True) -> Column:
    """Each word replaced by its dictionary entry; fillers, entries without text, are dropped or kept."""
    words = X.split_words(text, r"\s+")
    if not dictionary:
        return F.array_join(words, " ")
    if len(dictionary) > X.IN_PLAN:
        return replace_words(dictionary, X.PUNCTUATION + "\"'()", drop_fillers)(text)
    table = F.create_map(*[F.lit(x) for kv in dictionary.items() for x in kv])
    put = F.transform(words, lambda w: F.coalesce(F.try_element_at(table, F.regexp_replace(F.lower(w), r"""^[.,!?;:"'()]+|[.,!?;:"'()]+$""", "")), w))
    return F.array_join(F.filter(put, lambda w: w != "") if drop_fillers else put, " ")


def normalize(df: DataFrame, text_col: str = "text", dialect_col: str = "dialect", pack: RulePack = RulePack()) -> DataFrame:
    """Adds anchors, the text after each step, normalized_text, and the verified anchors. A blank text gives "" ."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    out = df.withColumns({"anchors": X.extract_anchors(text, lists=pack.anchors), "adapted": X.adapt_dialect(text, F.col(dialect_col), pack.dialect_fillers)})
    out = out.withColumn("phrased", X.apply_phrases(F.col("adapted")))
    out = out.withColumn("glossed", X.gloss_tokens(F.col("phrased"), pack.glosses, pack.fillers))
    blank = F.length(F.trim(text)) == 0
    out = out.withColumn("normalized_text", F.when(blank, "").otherwise(X.reconstruct(F.col("glossed"), pack.drop_tamil)))
    out = out.withColumn("verified", X.verify_anchors(F.col("anchors"), F.col("normalized_text"), pack.anchors.get("negations", L.NEGATIONS)))
    return out.withColumn("all_preserved", F.size(X.missing_anchors(F.col("verified"))) == 0)


def analyze(df: DataFrame, text_col: str = "text", pack: RulePack = RulePack()) -> DataFrame:
    """Language, code-mixing, dialect, normalised text, intent, entities and confidences of each row. Narrow throughout."""
    out = detect_code_mix(df, text_col, pack.thresholds)
    given = F.col("dialect") if "dialect" in df.columns else F.lit(None).cast("string")
    out = out.withColumn("dialect", F.coalesce(given, X.detect_dialect_first(F.col(text_col), pack.dialect_markers), F.lit("Standard")))
    out = normalize(out, text_col, "dialect", pack)
    final = X.finalize_text(apply_dictionary(map_expressions(F.col("normalized_text"), pack.expressions), pack.dictionary))
    out = out.withColumn("final_text", final).withColumn("result", X.classify_intent(F.col("final_text")))
    entities = X.restrict_entities(X.extract_entities(X.extract_anchors(F.col("final_text"), lists=pack.anchors)), F.col("result.intent"))
    confidence = F.create_map(F.lit("asr"), F.lit(1.0), F.lit("language"), F.col("confidence"), F.lit("dialect"), F.lit(0.90), F.lit("intent"), F.col("result.confidence"))
    return out.withColumns({"intent": F.col("result.intent"), "entities": entities, "confidences": confidence}).select(
        *df.columns if "dialect" not in df.columns else [c for c in df.columns if c != "dialect"],
        "language", "code_mixed", "cmi", "switch_points", "m_index", "dialect", "normalized_text", "final_text", "intent", "entities", "confidences", "all_preserved",
    )


def to_handoff(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds ``payload``: JSON with fixed keys."""
    return df.withColumn(
        "payload",
        F.to_json(F.struct(F.col("final_text").alias("normalized_text"), "intent", "entities", "language", "dialect", F.col("confidences").alias("confidence"), F.col(text_col).alias("raw_transcript"))),
    )


def user_content(text: Column, intent: Column, entities: Column) -> Column:
    """``[Understood Context: ...]`` with intent and entities, and the text below."""
    filled = F.filter(F.map_entries(entities), lambda e: F.coalesce(e["value"] != "", F.lit(False)))
    listed = F.array_join(F.transform(filled, lambda e: F.concat(e["key"], F.lit("='"), e["value"], F.lit("'"))), ", ")
    parts = F.array_compact(F.array(F.when((intent != "") & (intent != L.NO_INTENT), F.concat(F.lit("Intent: "), intent)), F.when(listed != "", F.concat(F.lit("Entities: ["), listed, F.lit("]")))))
    head = F.when(F.size(parts) > 0, F.concat(F.lit("[Understood Context: "), F.array_join(parts, "; "), F.lit("]\n"))).otherwise("")
    return F.trim(F.concat(head, F.trim(text)))


def build_prompts(df: DataFrame, system: str, layout: str = "chat") -> DataFrame:
    """Adds ``prompt`` in the chat, instruct or raw layout, and ``messages``, an array of role and content."""
    user = user_content(F.col("final_text"), F.col("intent"), F.col("entities"))
    s = F.lit(system)
    text = {
        "instruct": F.concat(F.lit("### System:\n"), s, F.lit("\n\n### Instruction:\n"), user, F.lit("\n\n### Response:\n")),
        "chat": F.concat(F.lit("<|system|>\n"), s, F.lit("\n<|user|>\n"), user, F.lit("\n<|assistant|>\n")),
    }.get(layout, F.concat(s, F.lit("\n\nUser: "), user, F.lit("\nAssistant: ")))
    one = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return df.withColumns({"prompt": text, "messages": F.array(one("system", s), one("user", user))})


def validate_payload(df: DataFrame, col: str = "payload") -> DataFrame:
    """Adds ``problem``: what is wrong with a JSON payload, or null. Keys intent, entities (an object) and confidence (a number) must be there."""
    body = F.col(col)
    kind = lambda key: F.substring(F.ltrim(F.get_json_object(body, f"$.{key}")), 1, 1)
    keys = F.coalesce(F.json_object_keys(F.when(F.try_parse_json(body).isNotNull(), body)), F.array().cast("array<string>"))
    missing = F.filter(F.array(*[F.lit(k) for k in ("intent", "entities", "confidence")]), lambda k: ~F.array_contains(keys, k))
    return df.withColumn(
        "problem",
        F.when(body.isNull() | F.try_parse_json(body).isNull(), "not JSON")
        .when(F.size(missing) > 0, F.concat(F.lit("missing "), F.get(missing, 0)))
        .when(F.coalesce(kind("entities"), F.lit("")) != "{", "entities is not an object")
        .when(F.get_json_object(body, "$.confidence").try_cast("double").isNull(), "confidence is not a number"),
    )
