"""Tags of words by Arrow: every distinct word of a batch is looked at once."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..session import share_package
from . import lexicon as L

TAMIL, LATIN, ROMAN = re.compile(L.TAMIL), re.compile("[A-Za-z]"), re.compile("[a-z]+")
AFFIXES = tuple(L.TANGLISH_AFFIXES)
WORDS = frozenset(L.TANGLISH_WORDS)


def has_affix(word: str) -> bool:
    """Two letters or more before a known ending, all of a to z."""
    return word.endswith(AFFIXES) and ROMAN.fullmatch(word) is not None and any(word.endswith(x) and len(word) >= len(x) + 2 for x in AFFIXES)


def tag_word(token: str, vocab_weight: float, affix_weight: float) -> tuple[str, float]:
    """The tag of a token, as ``text.tag_token`` gives it, and its score, as ``text.tanglish_score`` gives it for romanised Tamil."""
    tamil, latin = TAMIL.search(token) is not None, LATIN.search(token) is not None
    if tamil or not latin:
        return ("mixed" if latin else "ta") if tamil else "other", 0.0
    word = token.replace("\u0130", "i").lower()
    known, ending = word in WORDS, has_affix(word)
    return ("tanglish", (vocab_weight if known else 0.0) + (affix_weight if ending else 0.0)) if known or ending else ("en", 0.0)


#: Tags that are counted for each row.
COUNTED = ("ta", "en", "tanglish", "mixed")


def tag_words(cfg: dict = L.LANGUAGE_THRESHOLDS) -> Callable[[Column], Column]:
    """A function of a column of token arrays: struct(tags, n_ta, n_en, n_tanglish, n_mixed, score_sum)."""
    share_package(SparkSession.active())
    weights = float(cfg["vocab_weight"]), float(cfg["affix_weight"])
    counts = [f"n_{t}" for t in COUNTED]

    @F.arrow_udf("tags array<string>, " + ", ".join(f"{c} int" for c in counts) + ", score_sum double")
    def tagged(tokens: pa.Array) -> pa.Array:
        sizes = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        words = tokens.flatten().dictionary_encode()
        at, row = words.indices.to_numpy(zero_copy_only=False), np.repeat(np.arange(len(sizes)), sizes)
        found = [tag_word(w, *weights) for w in words.dictionary.to_pylist()]
        names, scores = np.array([t for t, _ in found], object), np.array([s for _, s in found], np.float64)
        tags = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(names, pa.string()).take(words.indices))
        numbers = [pa.array(np.bincount(row[(names == t)[at]], minlength=len(sizes)), pa.int32()) for t in COUNTED]
        total = pa.array(np.bincount(row, weights=scores[at], minlength=len(sizes)), pa.float64())
        return pa.StructArray.from_arrays([tags, *numbers, total], ["tags", *counts, "score_sum"])

    return tagged
