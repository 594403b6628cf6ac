"""Operator 11: phrase collocations by SON partitioning.

The corpus is a fixed number of shards, each the work of many tasks, so that a shard's share of the support stays the
same however large the corpus is. Every shard is mined completely, at the global support lowered in proportion to its
words: a phrase that is frequent anywhere is locally frequent somewhere. The union of the locally frequent phrases is
counted over all texts, exactly, by the phrases' own bytes.

Mining runs on arrays of 64-bit hashes. Hashes only choose what is counted, so a clash can add a candidate
and never change a count. Four scans: words, pairs, phrases of three and more whose pairs can be frequent, counts.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, ship_package

#: Shards of the corpus. A phrase is frequent in one at a sixteenth of the support or so.
SHARDS = 16
#: Words that a task counts at once; bounds its memory.
BLOCK_WORDS = 3_000_000
#: Bytes that are hashed at once; a longer word is hashed by itself.
WINDOW = 1 << 20
#: Candidate hashes that a task gets as a sorted list (16 MB); beyond, a bitmap of as many bytes stands for them.
LISTED, BITMAP_BITS = 2_000_000, 1 << 27
#: Rows of a language that are put in order in one task.
RANKED = 100_000

ODD = np.uint64(0x9E3779B97F4A7C15)
WORD, SPACE, CUT = 0, 1, 2


def _byte_kinds() -> tuple[np.ndarray, bytes]:
    """The kind of each byte, and a table that lower-cases A-Z and makes one space of a tab and one line feed of every cut."""
    kinds, low = np.zeros(256, np.uint8), bytearray(range(256))
    for b in b" \t":
        kinds[b], low[b] = SPACE, 0x20
    for b in b".,;:!?\n\x0b\x0c\r":
        kinds[b], low[b] = CUT, 0x0A
    for b in range(65, 91):
        low[b] = b + 32
    return kinds, bytes(low)


KINDS, LOWER = _byte_kinds()


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHasher:
    """Words of a lower-cased text: where they start and end, their hashes, and whether a word follows in the same piece."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.powers = np.zeros(0, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            n = max(n, min(self.window, 2 * n) + 1)
            back = np.uint64(pow(int(ODD), -1, 1 << 64))
            with np.errstate(over="ignore"):
                self.powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, ODD)]), dtype=np.uint64)
                self.inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, back)]), dtype=np.uint64)

    def bounds(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kinds = KINDS[data]
        inside = np.concatenate([[False], kinds == WORD, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        return edges[::2], edges[1::2], np.flatnonzero(kinds == CUT)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        data = np.frombuffer(text, np.uint8)
        starts, ends, cuts = self.bounds(data)
        joined = np.zeros(len(starts), bool)
        if len(starts) > 1:
            joined[:-1] = np.searchsorted(cuts, ends[:-1]) == np.searchsorted(cuts, starts[1:])
        hashes = np.zeros(len(starts), np.uint64)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(starts):
                to = max(at + 1, int(np.searchsorted(ends, starts[at] + self.window, "right")))
                low, high = int(starts[at]), int(ends[to - 1])
                self._grow(high - low + 1)
                sums = np.concatenate([[np.uint64(0)], np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * self.powers[: high - low], dtype=np.uint64)])
                s, e = starts[at:to] - low, ends[at:to] - low
                hashes[at:to] = mix((sums[e] - sums[s]) * self.inverse[s] + (e - s).astype(np.uint64))
                at = to
        return starts, ends, hashes, joined


def lowered(texts: list[str | None]) -> bytes:
    """Texts one after another, lower-cased, cut from each other, with one space where runs of spaces and tabs were."""
    text = "\n".join([x or "" for x in texts]).encode().translate(LOWER)
    if b"  " in text:
        data = np.frombuffer(text, np.uint8)
        space = data == 0x20
        text = data[np.concatenate([[True], ~(space[1:] & space[:-1])])].tobytes()
    return text


def longer(grams: np.ndarray, joined: np.ndarray, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """From the hashes of the phrases of k - 1 words at each place, those of k words, and at which places there is one."""
    n = max(0, len(words) - k + 1)
    with np.errstate(over="ignore"):
        return mix(grams[:n] * ODD + words[k - 1 : k - 1 + n] + np.uint64(k)), joined[k - 2 : k - 2 + n]


class Members:
    """A set of hashes in bounded memory. Never misses one; as a bitmap it lets some others in."""

    def __init__(self, hashes: np.ndarray | None, bits: np.ndarray | None = None):
        self.hashes, self.bits = hashes, bits

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            spot = x & np.uint64(len(self.bits) * 8 - 1)
            return (self.bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 != 0
        if not len(self.hashes):
            return np.zeros(len(x), bool)
        return self.hashes[np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)] == x


@functools.cache
def _salt(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))


def salted(lang: str, hashes: np.ndarray) -> np.ndarray:
    """Hashes of one language, told apart from the same phrases of others; 48 bits, as they choose candidates only and are most of what is shuffled."""
    return mix(hashes + _salt(lang)) >> np.uint64(16)


def members(hashes: DataFrame, listed: int = LISTED, bits: int = BITMAP_BITS) -> Members:
    """The broadcast form of a table with one column ``hash``: a list up to ``listed`` rows, else a bitmap of fixed size."""
    n = hashes.limit(listed + 1).count()
    if n <= listed:
        return Members(np.sort(hashes.toArrow().column(0).to_numpy().astype(np.int64).view(np.uint64)))
    spot = F.col("hash").bitwiseAND(F.lit(bits - 1))
    # One row for each 64 bits that has any: at most bits / 64 rows, whatever the number of hashes.
    words = hashes.groupBy(F.shiftright(spot, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast((hash & {bits - 1}) & 63 as int))")).alias("word"))
    table = np.zeros(bits // 64, np.int64)
    for batch in words.toLocalIterator():
        table[batch[0]] = batch[1]
    return Members(None, table.view(np.uint8))


def _by_language(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[tuple[str, list[str | None]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            texts, own = part.column(0).to_pylist(), {}
            for lang, text in zip(part.column(1).to_pylist(), texts, strict=True):
                own.setdefault(lang, []).append(text)
            yield from own.items()


class Blocks:
    """The words of a task, for each language as blocks of bounded size."""

    def __init__(self, most: int):
        self.most, self.hasher, self.held = most, WordHasher(), {}

    def add(self, lang: str, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        _, _, words, joined = self.hasher(lowered(texts))
        held = self.held.setdefault(lang, [])
        held.append((words, joined))
        if sum(len(w) for w, _ in held) >= self.most:
            yield self.take(lang)

    def take(self, lang: str) -> tuple[np.ndarray, np.ndarray]:
        held = self.held.pop(lang)
        return np.concatenate([w for w, _ in held]), np.concatenate([j for _, j in held])

    def walk(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        for lang, texts in _by_language(batches):
            for block in self.add(lang, texts):
                yield lang, *block
        for lang in list(self.held):
            yield lang, *self.take(lang)


def _flushed(rows: Iterator[tuple[str, int, dict[bytes, int]]], most: int) -> Iterator[pa.RecordBatch]:
    """(lang, size, phrase, k): counts summed up in bounded memory; what is left to sum is Spark's."""
    sums: Counter = Counter()

    def out() -> pa.RecordBatch:
        langs, sizes, phrases = zip(*sums, strict=True)
        cols = [pa.array(langs, pa.string()), pa.array(sizes, pa.int32()), pa.array(phrases, pa.binary()), pa.array(sums.values(), pa.int64())]
        sums.clear()
        return pa.RecordBatch.from_arrays(cols, ["lang", "size", "phrase", "k"])

    for lang, size, own in rows:
        for phrase, n in own.items():
            sums[lang, size, phrase] += n
        if len(sums) >= most:
            yield out()
    if sums:
        yield out()


def _between(text: bytes, starts: np.ndarray, ends: np.ndarray) -> Counter:
    return Counter(map(text.__getitem__, map(slice, starts.tolist(), ends.tolist())))


def _word_counts(texts: DataFrame, held: int = 1 << 18) -> DataFrame:
    """(lang, size, phrase, k): partial counts of all words, by their bytes; size 0 counts the words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()

        def each() -> Iterator[tuple[str, int, dict[bytes, int]]]:
            for lang, own in _by_language(batches):
                text = lowered(own)
                starts, ends = hasher.bounds(np.frombuffer(text, np.uint8))[:2]
                yield lang, 1, _between(text, starts, ends)
                yield lang, 0, {b"": len(starts)}

        yield from _flushed(each(), held)

    return texts.mapInArrow(run, "lang string, size int, phrase binary, k long")


def _hashed(words: DataFrame) -> DataFrame:
    """(hash) of the words of a table (lang, phrase)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            hashes = [int(salted(lang, hasher(word)[2])[0].astype(np.int64)) for lang, word in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64())], ["hash"])

    return words.select("lang", "phrase").mapInArrow(run, "hash long")


def mine_block(words: np.ndarray, joined: np.ndarray, least: int, sizes: range, known: Callable[[int, np.ndarray], np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, counts) of all phrases of the given sizes with ``least`` occurrences or more in a block.

    Level by level: a phrase can only be frequent if its first and its last k - 1 words are. ``known`` rules out places whose
    phrase can't be frequent anywhere.
    """
    alive, grams = known(1, words), words
    for k in range(2, sizes.stop):
        grams, there = longer(grams, joined, words, k)
        alive = there & alive[: len(there)] & alive[1 : 1 + len(there)]
        places = np.flatnonzero(alive)
        if k == 2 or k in sizes:
            places = places[known(k, grams[places])]
        if k in sizes:
            found, back, counts = np.unique(grams[places], return_inverse=True, return_counts=True)
            often = counts >= least
            places = places[often[back]]
            yield found[often], counts[often]
        alive = np.zeros(len(there), bool)
        alive[places] = True


def _mined(texts: DataFrame, langs: dict[str, int], sizes: range, words: Members, pairs: Members | None, block_words: int, shards: int) -> DataFrame:
    """(part, hash, k): counts of a task's blocks, to be summed up in their part, which is a shard of a language; hash is null in rows that count words."""
    sets = texts.sparkSession.sparkContext.broadcast((words, pairs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, double = sets.value
        shard = TaskContext.get().partitionId() % shards
        for lang, block, joined in Blocks(block_words).walk(batches):
            if lang not in langs:
                continue

            def known(k: int, x: np.ndarray, lang: str = lang) -> np.ndarray:
                return single(salted(lang, x)) if k == 1 else double(salted(lang, x)) if k == 2 and double is not None else np.ones(len(x), bool)

            part = langs[lang] * shards + shard
            yield _table(part, None, np.array([len(block)]))
            for found, counts in mine_block(block, joined, 1, sizes, known):
                for at in range(0, len(found), 1 << 16):
                    yield _table(part, salted(lang, found[at : at + (1 << 16)]), counts[at : at + (1 << 16)])

    return texts.mapInArrow(run, "part int, hash long, k long")


def _table(part: int, hashes: np.ndarray | None, counts: np.ndarray) -> pa.RecordBatch:
    n = len(counts)
    keys = pa.nulls(n, pa.int64()) if hashes is None else pa.array(hashes.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), keys, pa.array(counts.astype(np.int64))], ["part", "hash", "k"])


def _frequent(found: DataFrame, totals: list[int], shards: int, support: int, scratch: Scratch, name: str) -> DataFrame:
    """(hash): the union of what is frequent in some shard, at its share of the support.

    A shard in which a phrase is not frequent holds fewer than its share; what can't reach the support even if all of these hold as
    many as they can is left out.
    """
    sums = scratch.save(found.groupBy("part", "hash").agg(F.sum("k").alias("k")), name)
    lang = F.expr(f"part div {shards}").cast("int")
    n = F.element_at(F.array(*[F.lit(n) for n in totals]), lang + 1) if totals else F.lit(1)
    share = F.call_function("div", F.col("k") * support + n - 1, n)  # the support times the part's share of the words, rounded up
    shares = sums.filter("hash is null").select("part", lang.alias("lang"), share.alias("share"))  # a row for each language and shard
    slack = shares.groupBy("lang").agg(F.sum(F.col("share") - 1).alias("slack"))
    local = sums.filter("hash is not null").join(F.broadcast(shares), "part").filter("k >= share")
    union = local.groupBy("lang", "hash").agg(F.sum(F.col("k") - F.col("share") + 1).alias("k"))
    out = scratch.save(union.join(F.broadcast(slack), "lang").filter(F.col("k") + F.col("slack") >= support).select("hash"), name)
    scratch.drop(sums)
    return out


def _counts(texts: DataFrame, singles: Members, phrases: Members, longest: int, held: int = 1 << 18) -> DataFrame:
    """(lang, size, phrase, k): partial counts of all candidates of two words or more, by their bytes."""
    sets = texts.sparkSession.sparkContext.broadcast((singles, phrases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        single, several = sets.value
        hasher = WordHasher()

        def each() -> Iterator[tuple[str, int, dict[bytes, int]]]:
            for lang, own in _by_language(batches):
                text = lowered(own)
                starts, ends, words, joined = hasher(text)
                alive, grams = single(salted(lang, words)), words
                for k in range(2, longest + 1):
                    grams, there = longer(grams, joined, words, k)
                    places = np.flatnonzero(there & alive[: len(there)] & alive[1 : 1 + len(there)])
                    places = places[several(salted(lang, grams[places]))]
                    alive = np.zeros(len(there), bool)
                    alive[places] = True
                    yield lang, k, _between(text, starts[places], ends[places + k - 1])

        yield from _flushed(each(), held)

    return texts.mapInArrow(run, "lang string, size int, phrase binary, k long")


def frequent_phrases(
    df: DataFrame, support: int, longest: int = 5, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS, shards: int = SHARDS, listed: int = LISTED, bits: int = BITMAP_BITS
) -> tuple[DataFrame, DataFrame]:
    """(lang, size, phrase, a) of all phrases of 1 to ``longest`` words that occur ``support`` times or more in a language, and (lang, n), its words.

    Texts are lower-cased in A-Z and cut at ``.,;:!?`` and line breaks; words are what stands between spaces and tabs. Occurrences
    may overlap. A null text is empty, a null language ``und``. Texts of any length count whole, repeated rows each by themselves;
    an empty table gives two empty ones, and columns other than the two are not read.
    """
    spark = df.sparkSession
    ship_package(spark)
    scratch = Scratch(spark)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    texts = df.select(F.col(text_col).alias("text"), lang.alias("lang"))
    keys = ["lang", "size", "phrase"]
    sums = scratch.save(_word_counts(texts).groupBy(*keys).agg(F.sum("k").alias("a")).filter(F.col("a") >= support), "words")
    totals = sums.filter("size = 0").select("lang", F.col("a").alias("n"))
    single = sums.filter("size = 1")
    words = members(_hashed(single), listed, bits)
    known = totals.orderBy("lang").collect()  # a row for each language that has enough words
    langs, sizes = {r.lang: i for i, r in enumerate(known)}, [r.n for r in known]
    two = _frequent(_mined(texts, langs, range(2, 3), words, None, block_words, shards), sizes, shards, support, scratch, "pairs")
    pairs = members(two, listed, bits)
    more = _frequent(_mined(texts, langs, range(3, longest + 1), words, pairs, block_words, shards), sizes, shards, support, scratch, "phrases") if longest > 2 else two.limit(0)
    union = members(two.union(more), listed, bits)
    counts = scratch.save(_counts(texts, words, union, longest).groupBy(*keys).agg(F.sum("k").alias("a")).filter(F.col("a") >= support), "counts")
    return single.union(counts).withColumn("phrase", F.col("phrase").cast("string")), totals


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def score_cuts(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, size, phrase, a, l, r, n, score) of all phrases of two words or more; the cut with the lowest score, then the earliest, counts.

    Both parts of a frequent phrase are frequent, so the joins lose none. Products are decimals of 38 digits.
    """
    words = F.split("phrase", " ")
    part = lambda start, n: F.array_join(F.slice("words", start, n), " ")
    cut = phrases.filter("size > 1").withColumns({"words": words}).withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cut = cut.select("lang", "size", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("size") - F.col("cut")).alias("right"))
    known = lambda name, count: phrases.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    both = cut.join(known("left", "l"), ["lang", "left"]).join(known("right", "r"), ["lang", "right"]).join(F.broadcast(totals), "lang")
    both = both.withColumns({"top": _whole("a") * _whole("n") * F.lit(1000).cast("decimal(4,0)"), "low": _whole("l") * _whole("r")})
    scored = both.withColumn("score", F.expr("cast(top div low as bigint)"))
    best = F.min(F.struct("score", "cut", "l", "r", "n")).alias("best")
    return scored.groupBy("lang", "size", "phrase", "a").agg(best).select("lang", "size", "phrase", "a", "best.l", "best.r", "best.n", "best.score")


def absorbed(phrases: DataFrame, percent: int = 100) -> DataFrame:
    """(lang, phrase) of phrases that lie inside a longer one with ``percent`` of their count or more."""
    spans = F.expr("flatten(transform(sequence(2, size - 1), k -> transform(sequence(1, size - k + 1), i -> array_join(slice(words, i, k), ' '))))")
    inner = phrases.filter("size > 2").withColumn("words", F.split("phrase", " ")).select("lang", F.col("a").alias("longer"), F.explode(F.array_distinct(spans)).alias("phrase"))
    most = inner.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    return most.join(phrases, ["lang", "phrase"]).filter(F.col("longer") * 100 >= F.col("a") * percent).select("lang", "phrase")


def first_ranks(df: DataFrame, group: str, order: list[Column], k: int, name: str, scratch: Scratch, tie: str, ranked: int = RANKED) -> DataFrame:
    """The first ``k`` rows of each group by ``order`` with their rank. While many rows are left, each of many parts of a group keeps its own first ``k``."""
    left = scratch.save(df, "unranked")
    n = left.count()
    while n > max(ranked, 4 * k):
        parts = -(-n // max(ranked, 4 * k)) * 2
        window = W.partitionBy(group, "part").orderBy(*order)
        best = left.withColumn("part", F.pmod(F.xxhash64(tie, F.lit(n)), F.lit(parts))).withColumn(name, F.row_number().over(window)).filter(F.col(name) <= k)
        left, before = scratch.save(best.drop("part", name), "best"), n
        n = left.count()
        if n > before * 0.8:  # many groups, or most rows are first: the parts are as small as they get
            break
    return left.withColumn(name, F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col(name) <= k)


def collocations(
    df: DataFrame, support: int = 100, longest: int = 5, top: int = 2000, percent: int = 100, text_col: str = "text", lang_col: str = "lang", block_words: int = BLOCK_WORDS, shards: int = SHARDS, listed: int = LISTED, bits: int = BITMAP_BITS, ranked: int = RANKED
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words that occur ``support`` times or more.

    score = floor(1000 * a * n / (l * r)), a, l and r the counts of the phrase and of its parts, n the words of the language. Phrases inside
    a longer one with ``percent`` of their count or more are left out. Order: score and a descending, then the phrase's bytes.
    Nulls, empty, long and repeated texts, and empty tables as in ``frequent_phrases``; equal scores and counts are ordered by phrase.
    """
    phrases, totals = frequent_phrases(df, support, longest, text_col, lang_col, block_words, shards, listed, bits)
    kept = score_cuts(phrases, totals).join(absorbed(phrases, percent), ["lang", "phrase"], "left_anti")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    best = first_ranks(kept, "lang", order, top, "rank", Scratch(df.sparkSession), "phrase", ranked)
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
