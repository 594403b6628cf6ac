"""Phrases and words replaced from tables of any size, in one pass over a text.

A table is broadcast once and never part of a plan, so a plan is as small for 100,000 entries as for one. Phrases are
found by their tokens: a place of a text looks up the lengths of the phrases that begin with its token, then the
tokens themselves, so the time for a text does not depend on the size of the table.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import share_package

#: A run of letters and digits, a run of white space, or one other character.
TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
#: Phrases of one broadcast table; more are applied table after table, in their order, which comes to the same.
TABLE_PHRASES = 200_000
#: Words of a broadcast dictionary. A larger one is a join: ``operators.joins.lookup_tokens``.
MOST_WORDS = 1_000_000

Entry = tuple[str, str, str | None]  # phrase, replacement, category


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text)


def _key(token: str) -> str:
    return " " if token.isspace() else token.lower()


def _is_word(token: str) -> bool:
    return token[0].isalnum() or token[0] == "_"


def longest_first(entries: Iterable[Entry]) -> list[Entry]:
    """By words descending, then alphabetically."""
    return sorted(entries, key=lambda e: (-len(e[0].split()), e[0]))


class PhraseTable:
    """Phrases in the order in which they replace.

    The outcome is that of one regular expression after the other over the whole text, each between word boundaries, with any white
    space for a space and without regard to case: a phrase also replaces what phrases before it have put in, and never its own output.
    """

    def __init__(self, entries: Iterable[Entry]):
        self.entries: list[Entry] = []
        self.places: dict[tuple[str, ...], int] = {}
        self.lengths: dict[str, tuple[int, ...]] = {}
        self.longest = 0
        for phrase, put, category in entries:
            keys = tuple(_key(t) for t in tokens(phrase.strip()))
            if keys and keys not in self.places:
                self.places[keys] = len(self.entries)
                self.entries.append((phrase, put, category))
                self.longest = max(self.longest, len(keys))
                known = self.lengths.get(keys[0], ())
                if len(keys) not in known:
                    self.lengths[keys[0]] = (*known, len(keys))

    def __reduce__(self):
        return PhraseTable, (self.entries,)  # a worker builds its own tables, once

    def replace(self, text: str) -> tuple[str, list[Entry]]:
        """The text with all phrases replaced, and for each replacement (found text, replacement, category) in their order."""
        words = tokens(text)
        lengths = self.lengths
        if not any(w.lower() in lengths for w in words):
            return text, []
        line = _Line(words)
        due: list[int] = []
        starts: dict[int, set[int]] = {}

        def look(node: int, after: int) -> None:
            for n in lengths.get(line.keys[node], ()):
                place = self.places.get(line.ahead(node, n))
                if place is not None and place > after and line.bounded(node, n):
                    if place not in starts:
                        starts[place] = set()
                        heapq.heappush(due, place)
                    starts[place].add(node)

        for node in range(len(words)):
            look(node, -1)
        found: list[Entry] = []
        while due:
            place = heapq.heappop(due)
            _, put, category = self.entries[place]
            spans, end = [], ()
            for node in sorted(starts.pop(place), key=lambda x: line.ranks[x]):
                if line.alive[node] and line.ranks[node] > end:
                    for n in lengths.get(line.keys[node], ()):
                        if self.places.get(line.ahead(node, n)) == place and line.bounded(node, n):
                            last = line.step(node, n - 1)
                            spans.append((node, last))
                            end = line.ranks[last]
            edges = []
            for node, last in spans:
                found.append((line.text(node, last), put, category))
                edges.append(line.put(node, last, put))
            for left, right in edges:
                for node in line.around(*line.settle(left, right), self.longest):
                    look(node, place)
        return line.whole(), found


class _Line:
    """The tokens of a text as a linked list. Ranks, which are tuples, keep the order of tokens that come in later."""

    def __init__(self, words: list[str]):
        n = len(words)
        self.words = list(words)
        self.keys = [_key(w) for w in words]
        self.ranks: list[tuple[int, ...]] = [(i,) for i in range(n)]
        self.alive = [True] * n
        self.next = [*range(1, n), -1] if n else []
        self.before = list(range(-1, n - 1))
        self.first = 0 if n else -1

    def step(self, node: int, n: int) -> int:
        for _ in range(n):
            node = self.next[node]
        return node

    def ahead(self, node: int, n: int) -> tuple[str, ...]:
        out = []
        while node >= 0 and len(out) < n:
            out.append(self.keys[node])
            node = self.next[node]
        return tuple(out) if len(out) == n else ()

    def bounded(self, node: int, n: int) -> bool:
        """Whether there are word boundaries before and behind: of two neighbours one is a word."""
        last = self.step(node, n - 1)
        left, right = self.before[node], self.next[last]
        return (_is_word(self.words[node]) or left >= 0 and _is_word(self.words[left])) and (_is_word(self.words[last]) or right >= 0 and _is_word(self.words[right]))

    def text(self, node: int, last: int) -> str:
        out = [self.words[node]]
        while node != last:
            node = self.next[node]
            out.append(self.words[node])
        return "".join(out)

    def _link(self, left: int, right: int) -> None:
        if left >= 0:
            self.next[left] = right
        else:
            self.first = right
        if right >= 0:
            self.before[right] = left

    def put(self, node: int, last: int, text: str) -> tuple[int, int]:
        """Put the tokens of ``text`` where node to last are; gives the nodes on both sides of them."""
        left, right, rank = self.before[node], self.next[last], self.ranks[node]
        while True:
            self.alive[node] = False
            if node == last:
                break
            node = self.next[node]
        at = left
        for i, word in enumerate(tokens(text)):
            self.words.append(word)
            self.keys.append(_key(word))
            self.ranks.append((*rank, i))
            self.alive.append(True)
            self.next.append(-1)
            self.before.append(-1)
            self._link(at, len(self.words) - 1)
            at = len(self.words) - 1
        self._link(at, right)
        return left, right

    def settle(self, left: int, right: int) -> tuple[int, int]:
        """Make one token of neighbours that are one run now; both may have become part of another run."""
        while left >= 0 and not self.alive[left]:
            left = self.before[left]
        while right >= 0 and not self.alive[right]:
            right = self.next[right]
        node = left if left >= 0 else self.first
        while node >= 0 and node != right:
            after = self.next[node]
            if after >= 0 and (_is_word(self.words[node]) and _is_word(self.words[after]) or self.words[node].isspace() and self.words[after].isspace()):
                self.words[node] += self.words[after]
                self.keys[node] = _key(self.words[node])
                self.alive[after] = False
                if after == right:
                    right = self.next[after]
                self._link(node, self.next[after])
            else:
                node = after
        return left, right

    def around(self, left: int, right: int, reach: int) -> Iterator[int]:
        """The nodes from which a phrase can reach what lies between left and right."""
        node = left
        for _ in range(reach):
            if node < 0 or self.before[node] < 0:
                break
            node = self.before[node]
        node = node if node >= 0 else self.first
        while node >= 0:
            yield node
            if node == right:
                break
            node = self.next[node]

    def whole(self) -> str:
        out, node = [], self.first
        while node >= 0:
            out.append(self.words[node])
            node = self.next[node]
        return "".join(out)


_FOUND = pa.list_(pa.struct([("expression", pa.string()), ("normalized", pa.string()), ("category", pa.string())]))
_MATCHES = "array<struct<expression:string,normalized:string,category:string>>"


class Phrases:
    """A table of phrases for column expressions. ``entries``: (phrase, replacement, category) in their order."""

    def __init__(self, entries: Iterable[Entry], table_phrases: int = TABLE_PHRASES):
        spark = SparkSession.active()
        share_package(spark)
        self.parts = [_replacer(spark, part) for part in itertools.batched(entries, table_phrases)]

    @classmethod
    def of(cls, expressions: DataFrame, table_phrases: int = TABLE_PHRASES) -> Phrases:
        """From a table (expression, normalized, category), longest first; the driver holds one part of it at a time."""
        words = F.size(F.split(F.trim("expression"), r"\s+"))
        rows = expressions.select("expression", "normalized", "category").filter("expression is not null").orderBy(words.desc(), "expression")
        return cls(((r.expression, r.normalized or "", r.category) for r in rows.toLocalIterator()), table_phrases)

    def __call__(self, text: Column) -> Column:
        """struct(text, matches); a null text gives null in both."""
        out = F.struct(text.alias("text"), F.array().cast(_MATCHES).alias("matches"))
        for i, part in enumerate(self.parts):
            later = part(out["text"])
            out = F.struct(later["text"].alias("text"), F.concat(out["matches"], later["matches"]).alias("matches")) if i else later
        return out


def _replacer(spark: SparkSession, entries: tuple[Entry, ...]) -> Callable[[Column], Column]:
    shared = spark.sparkContext.broadcast(PhraseTable(entries))

    @F.arrow_udf(f"text string, matches {_MATCHES}")
    def replace(texts: pa.Array) -> pa.Array:
        table, put, found = shared.value, [], []
        for text in texts.to_pylist():
            new, hits = (None, None) if text is None else table.replace(text)
            put.append(new)
            found.append(None if hits is None else [{"expression": a, "normalized": b, "category": c} for a, b, c in hits])
        return pa.StructArray.from_arrays([pa.array(put, pa.string()), pa.array(found, _FOUND)], ["text", "matches"])

    return replace


def replace_words(table: dict[str, str], strip: str, drop_empty: bool = True) -> Callable[[Column], Column]:
    """A function of a text column: each word, lower-cased and without the characters of ``strip`` at its ends, by its entry.

    Words without an entry stay as they are; those with an empty one are dropped or left empty. Null counts as empty.
    """
    if len(table) > MOST_WORDS:
        raise ValueError(f"over {MOST_WORDS} words; join the tokens with lookup_tokens instead")
    spark = SparkSession.active()
    share_package(spark)
    shared = spark.sparkContext.broadcast(table)

    @F.arrow_udf("string")
    def put(texts: pa.Array) -> pa.Array:
        known, out = shared.value, []
        for text in texts.to_pylist():
            words = (known.get(w.lower().strip(strip), w) for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w)
            out.append(" ".join(w for w in words if w or not drop_empty))
        return pa.array(out, pa.string())

    return put
