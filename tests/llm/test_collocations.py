"""Phrase collocations against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from sparkmix.llm import collocations as C
from sparkmix.llm import queries as Q

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, support, longest=5, top=2000, percent=100):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, counts in f.items():
        often = {p: a for p, a in counts.items() if a >= support and len(p) > 1}
        hidden = set()
        for q, b in often.items():
            for k in range(2, len(q)):
                hidden |= {q[i : i + k] for i in range(len(q) - k + 1) if 100 * b >= percent * often[q[i : i + k]]}
        scored = []
        for p, a in often.items():
            if p not in hidden:
                score, _, left, right = min((1000 * a * n[lang] // (counts[p[:k]] * counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def corpus(seed, docs=240):
    rnd = random.Random(seed)
    words = ["New", "york", "the", "of", "É", "é", "ça", "a", "b", "in", "x\x1cy", " ", "z"] + [f"w{i}" for i in range(30)]
    fixed = ["new york city hall tonight", "a a a a a a", "The  of\tthe of", "one two three four five six", "ß ß, ß ß"]
    rows = []
    for _ in range(docs):
        bits = [rnd.choice(fixed) if rnd.random() < 0.2 else " ".join(rnd.choices(words, k=rnd.randint(1, 9))) for _ in range(rnd.randint(0, 8))]
        rows.append((rnd.choice(["", " ", "\t"]) + rnd.choice([". ", ",", "\n", "\x0b", "; ", " ", "  \t "]).join(bits), rnd.choice(["en", "en", "de", None, ""])))
    return rows + [(None, "en"), ("", "de"), ("word", "fr"), ("go on " * 40_000, "en"), ("k" * 100_000 + " k", "de")] + [("same old story told", "en")] * 200


@pytest.mark.parametrize(
    ("blocks", "shards", "listed", "bits"),
    [(C.BLOCK_WORDS, 1, C.LISTED, C.BITMAP_BITS), (300, C.SHARDS, C.LISTED, C.BITMAP_BITS), (300, 3, 0, 1 << 20), (300, 3, 0, 64)],
    ids=["one shard", "small blocks", "bitmaps", "full bitmaps"],
)
def test_against_brute_force(spark, blocks, shards, listed, bits):
    rows = corpus(1)
    df = spark.createDataFrame([(t, x, "c", 1) for t, x in rows], "text string, lang string, phrase string, hash int").repartition(5)
    got = sorted(tuple(r) for r in C.collocations(df, support=12, block_words=blocks, shards=shards, listed=listed, bits=bits).collect())
    assert got == brute(rows, 12) and len(got) > 30


def test_ranks_percent_and_longest(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    got = sorted(tuple(r) for r in C.collocations(df, support=5, longest=3, top=20, percent=80, ranked=10).collect())
    assert got == brute(rows, 5, 3, 20, 80)
    assert max(r[1] for r in got) == 20


def test_lowered_support_finds_all_that_can_be_frequent():
    """A phrase that no block finds has too few occurrences in all of them together."""
    rnd = np.random.default_rng(3)
    words = C.mix(np.minimum(rnd.geometric(0.2, 20_000), 40).astype(np.uint64))
    joined = rnd.random(len(words)) < 0.8
    joined[-1] = False
    everything = {k: Counter() for k in range(2, 6)}
    for k, total in everything.items():
        for i in range(len(words) - k + 1):
            if joined[i : i + k - 1].all():
                total[tuple(words[i : i + k].tolist())] += 1
    grams, hashes = words, {}
    for k in range(2, 6):
        grams, _ = C.longer(grams, joined, words, k)
        hashes |= {(k, tuple(words[i : i + k].tolist())): int(grams[i]) for i in range(len(grams))}
    support, found, at = 60, set(), 0
    for size in (300, 5000, 700, 10_000, 4000):
        part, stay = words[at : at + size], joined[at : at + size].copy()
        stay[-1] = False
        at += size
        for h, _ in C.mine_block(part, stay, -(-support * size // len(words)), range(2, 6), lambda k, x: np.ones(len(x), bool)):
            found |= set(h.tolist())
    lost = [p for k, total in everything.items() for p, n in total.items() if n >= support + 5 and hashes[k, p] not in found]  # 5: those cut by the blocks
    assert not lost


def test_hashes_do_not_depend_on_windows():
    rnd = random.Random(4)
    text = C.lowered(["".join(rnd.choice("ab, .É\t") for _ in range(3000)), None, "x" * 500])
    want = [m.group() for m in re.finditer(rb"[^ \t.,;:!?\n\x0b\x0c\r]+", text)]
    tables = []
    for window in (1, 7, 64, 1 << 20):
        starts, ends, hashes, joined = C.WordHasher(window)(text)
        assert [text[s:e] for s, e in zip(starts, ends)] == want
        assert [bool(j) for j in joined[:-1]] == [not re.search(rb"[.,;:!?\n]", text[e:s]) for e, s in zip(ends[:-1], starts[1:])]
        tables.append(hashes.tolist())
    assert all(t == tables[0] for t in tables)
    assert len(set(tables[0])) == len(set(want))


def test_empty_table(spark):
    assert C.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("a", "en")], "text string, lang string")).collect() == []


def test_scores_beyond_64_bits(spark):
    phrases = spark.createDataFrame([("x", 2, "a b", 4 * 10**9), ("x", 1, "a", 5 * 10**9), ("x", 1, "b", 6 * 10**9)], "lang string, size int, phrase string, a long")
    totals = spark.createDataFrame([("x", 9 * 10**12)], "lang string, n long")
    row = C.score_cuts(phrases, totals).first()
    assert row.score == 1000 * 4 * 10**9 * 9 * 10**12 // (5 * 10**9 * 6 * 10**9)


def test_registered_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang").collect()]
    assert sorted(tuple(r) for r in Q.op11_collocations(spark, sf).collect()) == brute(rows, 100)
