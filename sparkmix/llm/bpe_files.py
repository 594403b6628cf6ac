"""Readers of public tokenizer files, one instance per process and path."""

from __future__ import annotations

import base64
import json
import re
from functools import lru_cache

import numpy as np

_TWO_SPACES = re.compile(r"\s\s")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _json_ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE file whose ids follow its merge order; None for any other kind."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if model.get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel":
        return None
    if pre.get("add_prefix_space") or not pre.get("use_regex", True) or model.get("dropout") or model.get("ignore_merges"):
        return None
    vocab, letters = model["vocab"], _byte_letters()
    made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if made != sorted(made) or len(set(made)) != len(made):
        return None
    special = {t["content"] for t in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in word): i for word, i in vocab.items() if word not in special}


class JsonTokenizer:
    """Ids as the tokenizers library gives them, without added begin or end tokens.

    A byte-level file whose ids follow its merge order is run by tiktoken, which gives
    the same ids several times faster; any other file by the tokenizers library.
    Special strings inside a text become their single ids, as is that library's default.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = spec.get("added_tokens", [])
        ranks = _json_ranks(spec)
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in added):
            ranks = None
        self.special = {t["content"]: t["id"] for t in added}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.size = max([*spec["model"]["vocab"].values(), *self.special.values()]) + 1
        self.slow = None
        if ranks is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(path)
            self.slow.no_truncation()
            self.slow.no_padding()
            return
        self.full = tiktoken.Encoding("full", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # Where no two white spaces meet, the lookahead of the pattern never matters, and without it matching is twice as fast.
        self.plain = tiktoken.Encoding("plain", pat_str=pattern.replace(r"\s+(?!\S)|\s+", r"\s"), mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(self.size, np.int64)
        for word, i in ranks.items():
            self.lengths[i] = len(word)
        for word, i in self.special.items():
            self.lengths[i] = len(word.encode())

    def _ordinary(self, text: str) -> list[int]:
        return (self.full if _TWO_SPACES.search(text) else self.plain).encode_ordinary(text)

    def encode(self, text: str) -> list[int]:
        if self.slow is not None:
            return self.slow.encode(text, add_special_tokens=False).ids
        if self.split is None or not any(s in text for s in self.special):
            return self._ordinary(text)
        ids: list[int] = []
        for part in self.split.split(text):
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                ids += self._ordinary(part)
        return ids


@lru_cache(maxsize=4)
def json_tokenizer(path: str, pattern: str) -> JsonTokenizer:
    return JsonTokenizer(path, pattern)
