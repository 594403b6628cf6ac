"""Scalar functions on text columns. All are built-in expressions; none needs a shuffle or Python."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import edits, phrases
from . import lexicon as L


#: Entries of a word table that an expression holds by itself; a larger one is broadcast.
IN_PLAN = 100
PUNCTUATION = ".,!?;:"


def _in(c: Column, words) -> Column:
    return c.isin(*words)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair]).cast("map<string,string>")


def replace_in_order(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Apply constant regex replacements one after the other; each sees the output of those before."""
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, text)


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once for each row, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def word_pattern(words) -> str:
    """Whole-word alternation."""
    return r"\b(?:" + "|".join(words) + r")\b"


# Tokens ------------------------------------------------------------------


def split_words(text: Column, pattern: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda x: x != "")


def tokenize(text: Column) -> Column:
    """Words between white space and punctuation; null gives no words."""
    return split_words(text, L.TOKEN_BREAK)


def tokenize_words(text: Column) -> Column:
    """Lower-case words of letters, digits and underscores."""
    return split_words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+")


def tokenize_keep_colon(text: Column) -> Column:
    return split_words(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}:\s]", " "), r"\s+")


def tamil_chars(text: Column) -> Column:
    return F.length(F.regexp_replace(text, L.TAMIL.replace("[", "[^") + "+", ""))


def ascii_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]+", ""))


def lower_token(token: Column) -> Column:
    """Lower case by letters, as SQL has it: the capital I with a dot is an i, not two letters."""
    return F.lower(F.replace(token, F.lit("\u0130"), F.lit("i")))


def has_affix(word: Column) -> Column:
    """Two letters or more before a known ending, all of a to z."""
    ends = [(F.length(word) >= k + 2) & _in(F.right(word, F.lit(k)), [x for x in L.TANGLISH_AFFIXES if len(x) == k]) for k in sorted({len(x) for x in L.TANGLISH_AFFIXES})]
    return reduce(lambda a, b: a | b, ends) & word.rlike("^[a-z]+$")


def tanglish_score(word: Column, cfg: dict = L.LANGUAGE_THRESHOLDS) -> Column:
    """Evidence that a lower-case word is romanised Tamil."""
    return F.when(_in(word, L.TANGLISH_WORDS), cfg["vocab_weight"]).otherwise(0.0) + F.when(has_affix(word), cfg["affix_weight"]).otherwise(0.0)


def tag_token(token: Column) -> Column:
    """ta, tanglish, en, mixed or other."""
    tamil, latin = token.rlike(L.TAMIL), token.rlike("[A-Za-z]")
    local = bind(lower_token(token), lambda word: _in(word, L.TANGLISH_WORDS) | has_affix(word))
    roman = F.when(local, "tanglish").otherwise("en")
    return F.when(token.rlike("^[A-Za-z]+$"), roman).when(tamil & latin, "mixed").when(tamil, "ta").when(latin, roman).otherwise("other")


def rounded(value: Column, digits: int = 4) -> Column:
    """A positive number rounded as SQL rounds a double: half up after the point is moved, where Spark looks at the shortest decimal."""
    return F.round(value * 10**digits) / 10**digits


def count_of(tags: Column, tag: str) -> Column:
    return F.size(F.filter(tags, lambda x: x == tag))


# Language ----------------------------------------------------------------


def classify_language(tamil: Column, english: Column, tanglish: Column, score: Column, cfg: dict = L.LANGUAGE_THRESHOLDS) -> Column:
    """struct(language, code_mixed) from the ratios, by ordered thresholds."""
    roman = english + tanglish
    mixes = cfg["code_mix_min"]
    label = (
        F.when(tamil >= cfg["tamil_dominant"], "ta")
        .when((tamil >= mixes) & (roman >= mixes), "ta-en")
        .when((tanglish >= cfg["tanglish_min"]) | (score >= cfg["vocab_weight"]), "tanglish")
        .when(english >= cfg["english_dominant"], "en")
        .when((tanglish > 0) & (tanglish > english), "tanglish")
        .when(english > 0, "en")
        .when(tamil > 0, "ta")
        .otherwise("unknown")
    )
    mixed = (
        F.when(tamil >= cfg["tamil_dominant"], roman >= mixes)
        .when((tamil >= mixes) & (roman >= mixes), True)
        .when((tanglish >= cfg["tanglish_min"]) | (score >= cfg["vocab_weight"]), english >= mixes)
        .otherwise(False)
    )
    return F.struct(label.alias("language"), mixed.alias("code_mixed"))


def language_confidence(language: Column, tamil: Column, english: Column, tanglish: Column, score: Column, n_tokens: Column, cfg: dict = L.LANGUAGE_THRESHOLDS) -> Column:
    one = F.lit(1.0)
    script = (
        F.when(language == "ta", F.least(one, tamil / cfg["tamil_dominant"]))
        .when(language == "ta-en", F.greatest(F.lit(0.3), 1.0 - F.abs(tamil - 0.5) * 2))
        .when(language == "en", F.least(one, english / cfg["english_dominant"]))
        .when(language == "tanglish", F.least(one, tanglish / cfg["tanglish_min"]))
        .otherwise(0.1)
    )
    heuristic = F.when(language.isin("tanglish", "ta-en"), F.least(one, score / 2.0)).otherwise(script)
    raw = cfg["script_weight"] * script + cfg["heuristic_weight"] * heuristic
    short = F.when(n_tokens < 3, 0.6 + 0.13 * (n_tokens - 1)).otherwise(1.0)
    return F.round(F.least(one, F.greatest(F.lit(0.0), raw * short)), 4)


# Dialect -----------------------------------------------------------------


def detect_dialect_first(text: Column, markers: dict[str, list[str]] = L.FIRST_MARKERS) -> Column:
    """The first dialect that has a marker word in the text, else Standard."""
    lower = F.lower(text)
    return reduce(lambda rest, m: F.when(lower.rlike(word_pattern(m[1])), m[0]).otherwise(rest), reversed([m for m in markers.items() if m[1]]), F.lit("Standard"))


def dialect_scores(text: Column) -> dict[str, Column]:
    lower = F.lower(text)
    return {name: reduce(lambda a, b: a + b, [F.coalesce(lower.rlike(word_pattern([w])).cast("int"), F.lit(0)) for w in words]) for name, words in L.SCORE_MARKERS.items()}


def detect_dialect_score(text: Column) -> Column:
    """The dialect with most marker words, the first on a tie, else Standard."""
    scores = dialect_scores(text)
    best = F.greatest(*scores.values())
    out = F.when(best == 0, "Standard")
    for name, n in scores.items():
        out = out.when(n == best, name)
    return out


def resolve_dialect(dialect: Column) -> Column:
    """One of the known dialects whose name is in the given one, else Standard."""
    name, out = F.initcap(F.trim(dialect)), F
    for key in L.DIALECTS:
        out = out.when(name.contains(key), key)
    return out.otherwise("Standard")


def squash_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def adapt_dialect(text: Column, dialect: Column, fillers: dict[str, list[str]] | None = None) -> Column:
    """Ordered replacements of one dialect, then single spaces."""
    key = resolve_dialect(dialect)
    out = F.when(key == "Standard", text)
    for name, rules in L.DIALECT_RULES.items():
        more = [(r"(?i)\b" + w + r"\b", "") for w in (fillers or {}).get(name, [])]
        if rules or more:
            out = out.when(key == name, replace_in_order(text, [("(?i)" + p, r) for p, r, _ in rules] + more))
    return F.trim(F.regexp_replace(out.otherwise(text), r"\s{2,}", " "))


def needed_words(pattern: str) -> list[str]:
    """Pieces of plain lower-case text that every match of a pattern holds; none where that isn't plain to see."""
    if "|" in re.sub(r"\([^()]*\)", "", pattern):
        return []
    body = pattern.removeprefix(r"\b")
    if not re.search(r"[\[({]", body):
        plain = [x for x in body.removesuffix(r"\b").split(r"\s+") if re.fullmatch("[a-z ]+", x)]
        if plain:
            return plain
    start = re.match("([a-z ]+)([?*{]?)", body)
    word = (start[1][:-1] if start[2] else start[1]) if start else ""
    return [word] if word else []


def may_match(text: Column, pattern: str) -> Column | None:
    """Whether a text holds what a pattern needs, a search of bytes; None if nothing is known to be needed."""
    held = [text.contains(w) for w in needed_words(pattern)]
    return reduce(lambda a, b: a & b, held) if held else None


def apply_phrases(text: Column, rules: list[tuple[str, str]] = L.PHRASES) -> Column:
    """Lower case, then ordered phrase replacements; a rule is tried where the text holds its words."""

    def put(c: Column, rule: tuple[str, str]) -> Column:
        def one(t: Column) -> Column:
            changed, able = F.regexp_replace(t, *rule), may_match(t, rule[0])
            return changed if able is None else F.when(able, changed).otherwise(t)

        return bind(c, one)

    return reduce(put, rules, F.lower(text))


def gloss_tokens(text: Column, glosses: dict[str, str] | None = None, fillers: tuple[str, ...] = ()) -> Column:
    """Each word replaced by its gloss; words with an empty gloss are dropped."""
    table = dict.fromkeys(fillers, "") | L.GLOSSES | (glosses or {})
    if len(table) > IN_PLAN:
        return phrases.replace_words(table, PUNCTUATION)(text)
    known = _map(table)
    words = F.transform(split_words(text, r"\s+"), lambda w: F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(w), r"^[.,!?;:]+|[.,!?;:]+$", "")), w))
    return F.array_join(F.filter(words, lambda w: w != ""), " ")


def collapse_repeats(text: Column) -> Column:
    """Neighbouring equal words, without regard to case, become one."""
    return F.regexp_replace(text, r"(?i)\b(\w+)(\s+\1)+\b", "$1")


def capitalise(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2_000_000_000))


def terminate(text: Column, mark: str = ".") -> Column:
    return F.when((text == "") | text.rlike("[.!?]$"), text).otherwise(F.concat(text, F.lit(mark)))


def reconstruct(text: Column, drop_tamil: bool = False) -> Column:
    out = F.trim(F.regexp_replace(text, r"\s{2,}", " "))
    if drop_tamil:
        out = F.regexp_replace(F.trim(F.regexp_replace(out, L.TAMIL + "+", "")), r"\s{2,}", " ")
    return terminate(capitalise(collapse_repeats(out)))


def finalize_text(text: Column) -> Column:
    return terminate(capitalise(text))


# Anchors, intents and entities -------------------------------------------


def _anchor(kind: str, value: Column, raw: Column) -> Column:
    return F.struct(F.lit(kind).alias("entity_type"), value.alias("value"), raw.alias("raw_form"))


def anchor_words(text: Column) -> Column:
    return split_words(F.lower(text), L.ANCHOR_BREAK)


#: The lists that anchors are found by; each may be replaced.
ANCHOR_LISTS = {"negations": L.NEGATIONS, "time_words": L.TIME_WORDS, "apps": L.APPS, "places": L.PLACES, "devices": L.DEVICES, "people": L.PEOPLE}


def extract_anchors(text: Column, strict_negation: bool = False, lists: dict | None = None) -> Column:
    """Array of (entity_type, value, raw_form): negation, clock times, time words, numbers, people, apps, places, devices, tasks.

    The negation test finds a marker anywhere in the text, also inside words; ``strict_negation`` wants a whole word.
    ``lists`` replaces some of ``ANCHOR_LISTS``, in lower case; people are a map to their names.
    """
    return bind(text, lambda t: bind(anchor_words(t), lambda words: _anchors_of(t, words, strict_negation, ANCHOR_LISTS | (lists or {}))))


def _anchors_of(text: Column, words: Column, strict_negation: bool, lists: dict) -> Column:
    lower = F.lower(text)
    found = F.filter(F.array(*[F.lit(w) for w in sorted(lists["negations"])]), lambda w: F.array_contains(words, w) if strict_negation else lower.contains(w))
    negation = F.transform(F.slice(found, 1, 1), lambda w: _anchor("negation", F.lit("NEGATION"), w))
    clock = F.transform(F.regexp_extract_all(text, F.lit(L.CLOCK), F.lit(0)), lambda m: _anchor("time", F.trim(m), F.trim(m)))
    english = _map(L.TIME_ENGLISH)
    times = F.array_distinct(F.filter(words, lambda w: _in(w, lists["time_words"])))
    dates = F.transform(times, lambda w: _anchor("date", F.coalesce(F.try_element_at(english, w), w), w))
    taken = F.transform(F.concat(clock, dates), lambda a: a["value"])
    digits = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b\d+\b"), F.lit(0))), lambda d: ~F.array_contains(taken, d))
    quantities = F.transform(digits, lambda d: _anchor("quantity", d, d))
    numbers = _map(L.TAMIL_NUMBERS)
    counted = F.transform(F.filter(words, lambda w: _in(w, L.TAMIL_NUMBERS)), lambda w: _anchor("quantity", F.element_at(numbers, w), w))
    kin = _map(lists["people"])
    people = F.transform(F.filter(words, lambda w: _in(w, lists["people"])), lambda w: _anchor("person", F.element_at(kin, w), w))

    def listed(kind: str, names: list[str]) -> Column:
        return F.transform(F.filter(words, lambda w: _in(w, names)), lambda w: _anchor(kind, w, w))

    plain = [listed("app", lists["apps"]), listed("location", lists["places"]), listed("device_setting", lists["devices"])]
    tasks = F.transform(F.filter(F.array(*[F.lit(w) for w in L.TASKS]), lambda w: lower.contains(w)), lambda w: _anchor("task", w, w))
    return F.concat(negation, clock, dates, quantities, counted, people, *plain, tasks)


def verify_anchors(anchors: Column, out: Column, negations: list[str] = L.NEGATIONS) -> Column:
    """The anchors with a flag ``preserved``: whether the value, or for a negation some marker, is in the output."""
    lower = F.lower(out)
    denied = reduce(lambda a, b: a | b, [lower.contains(w) for w in dict.fromkeys([*negations, "not", "no", "never", "without"])])
    return F.transform(anchors, lambda a: F.struct(a["entity_type"].alias("entity_type"), a["value"].alias("value"), a["raw_form"].alias("raw_form"), F.when(a["entity_type"] == "negation", denied).otherwise(lower.contains(F.lower(a["value"]))).alias("preserved")))


def missing_anchors(verified: Column) -> Column:
    return F.filter(verified, lambda a: ~a["preserved"])


def classify_intent(text: Column, intents: dict = L.INTENTS) -> Column:
    """struct(intent, confidence, ambiguous, possible_intents); the first in order wins, none is UNKNOWN_INTENT."""

    def matching(t: Column) -> Column:
        def one(lower: Column) -> Column:
            def hit(patterns: list[str]) -> Column:
                found, able = t.rlike("(?i)" + "|".join(patterns)), [may_match(lower, p) for p in patterns]
                return found if not able or any(a is None for a in able) else reduce(lambda a, b: a | b, able) & found

            return F.array(*[F.when(hit(patterns), name) for name, (patterns, _) in intents.items()])

        return F.filter(bind(F.lower(t), one), lambda x: x.isNotNull())

    def result(hits: Column) -> Column:
        n = F.size(hits)
        return F.struct(
            F.coalesce(F.get(hits, 0), F.lit(L.NO_INTENT)).alias("intent"),
            F.when(n == 0, 0.0).when(n == 1, 0.95).otherwise(0.60).alias("confidence"),
            (n > 1).alias("ambiguous"),
            hits.alias("possible_intents"),
        )

    return bind(bind(text, matching), result)


def _first_value(anchors: Column, *kinds: str) -> Column:
    return F.get(F.filter(anchors, lambda a: a["entity_type"].isin(*kinds)), 0)["value"]


def extract_entities(anchors: Column, device_type: str = "device") -> Column:
    """Map of entities. The first two time references are date and time. Anchors never have the type ``device``, so
    devices come in only with ``device_type='device_setting'``."""

    def found(a: Column) -> Column:
        times = F.filter(a, lambda x: x["entity_type"].isin("time", "date"))
        pairs = [
            ("date", F.get(times, 0)["value"]),
            ("time", F.get(times, 1)["value"]),
            ("person", _first_value(a, "person")),
            ("app", _first_value(a, "app")),
            ("device_setting", _first_value(a, device_type)),
            ("task", _first_value(a, "task")),
        ]
        return F.create_map(*[x for k, v in pairs for x in (F.lit(k), v)])

    return F.map_filter(bind(anchors, found), lambda k, v: v.isNotNull())


def restrict_entities(entities: Column, intent: Column, intents: dict = L.INTENTS) -> Column:
    """Entities that the intent allows; an unknown intent keeps all."""
    allowed = F.create_map(*[x for k, (_, names) in intents.items() for x in (F.lit(k), F.array(*[F.lit(n) for n in names]).cast("array<string>"))])
    return bind(F.try_element_at(allowed, intent), lambda own: F.map_filter(entities, lambda k, v: own.isNull() | F.array_contains(own, k)))


def canonical_intent(intent: Column) -> Column:
    key = F.replace(F.lower(F.trim(intent)), F.lit(" "), F.lit("_"))
    return F.coalesce(F.try_element_at(_map(L.CANONICAL_INTENTS), key), F.upper(F.trim(intent)))


def canonical_dialect(label: Column) -> Column:
    low = F.lower(F.trim(label))
    return (
        F.when(low.contains("chennai"), "Chennai")
        .when(low.contains("madurai"), "Madurai")
        .when(low.contains("kongu"), "Kongu")
        .when(low.contains("nellai") | low.contains("tirunelveli"), "Nellai")
        .when(low.contains("standard") | low.contains("indian english"), "Standard")
        .otherwise(F.trim(label))
    )


# Edit distance and overlap -----------------------------------------------


def normalize_transcript(text: Column) -> Column:
    """Lower case, punctuation as white space, single spaces."""
    return squash_spaces(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_\s\u0B80-\u0BFF]", " "))


def word_errors(ref: Column, hyp: Column) -> Column:
    """struct(distance, substitutions, deletions, insertions) of two transcripts, by words."""
    return edits.word_errors()(*(split_words(normalize_transcript(x), " ") for x in (ref, hyp)))


def wer_words(ref: Column, hyp: Column) -> Column:
    """Word edit distance over reference words; without reference words 1 if there are others, else 0."""
    return F.when(F.size(ref) == 0, F.when(F.size(hyp) == 0, 0.0).otherwise(1.0)).otherwise(edits.word_errors()(ref, hyp)["distance"] / F.size(ref))


def wer(ref: Column, hyp: Column) -> Column:
    """Word error rate."""
    return F.round(wer_words(*(split_words(normalize_transcript(x), " ") for x in (ref, hyp))), 4)


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate without spaces."""
    a, b = (F.replace(normalize_transcript(x), F.lit(" "), F.lit("")) for x in (ref, hyp))
    return F.round(F.when(F.length(a) == 0, F.when(F.length(b) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(a, b) / F.length(a)), 4)


def char_similarity(a: Column, b: Column) -> Column:
    x, y = F.lower(F.trim(a)), F.lower(F.trim(b))
    n = F.greatest(F.length(x), F.length(y))
    return F.round(F.when(n == 0, 1.0).otherwise(1.0 - F.levenshtein(x, y) / n), 4)


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two word arrays: one pass over the sorted words of both."""
    side = lambda words, left: F.transform(words, lambda w: F.struct(w.alias("w"), F.lit(left).alias("l"), F.lit(1 - left).alias("r")))
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("l"), F.lit(0).alias("r"), F.lit(0).alias("both"))

    def step(s: Column, x: Column) -> Column:
        more = F.struct(s["w"].alias("w"), (s["l"] + x["l"]).alias("l"), (s["r"] + x["r"]).alias("r"), s["both"].alias("both"))
        fresh = F.struct(x["w"].alias("w"), x["l"].alias("l"), x["r"].alias("r"), (s["both"] + F.least(s["l"], s["r"])).alias("both"))
        return F.when(s["w"] == x["w"], more).otherwise(fresh)

    return F.aggregate(F.sort_array(F.concat(side(a, 1), side(b, 0))), start, step, lambda s: s["both"] + F.least(s["l"], s["r"]))


def token_f1(ref: Column, pred: Column) -> Column:
    a, b = tokenize_words(ref), tokenize_words(pred)
    common = bag_overlap(a, b)
    p, r = common / F.size(b), common / F.size(a)
    return F.round(F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0) | (common == 0), 0.0).otherwise(2 * p * r / (p + r)), 4)


def bleu1(ref: Column, pred: Column) -> Column:
    """Clipped unigram precision with a brevity penalty."""
    a, b = tokenize_words(ref), tokenize_words(pred)
    brevity = F.when(F.size(b) > F.size(a), 1.0).otherwise(F.exp(1 - F.size(a) / F.size(b)))
    return F.round(F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(brevity * bag_overlap(b, a) / F.size(b)), 4)


def exact_match(ref: Column, pred: Column) -> Column:
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), "[.!?]+$", "")
    return clean(ref) == clean(pred)


def stratum_key(*cols: str) -> Column:
    return F.concat_ws("|", *[F.lower(F.trim(F.coalesce(F.col(c).cast("string"), F.lit("nan")))) for c in cols])


def sensitive_rule(*cols: Column) -> Column:
    """Name of the first rule that a value breaks, or null."""
    out = F
    for name, pattern in L.SENSITIVE.items():
        out = out.when(reduce(lambda a, b: a | b, [F.coalesce(c, F.lit("")).rlike("(?U)" + pattern) for c in cols]), name)
    return out.otherwise(None)
