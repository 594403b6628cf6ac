"""Line dedup, packing, sharding, classifiers and near duplicates against brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from sparkmix.llm import embedding_dedup as E
from sparkmix.llm import language_id as G
from sparkmix.llm import line_dedup as D
from sparkmix.llm import near_dup as N
from sparkmix.llm import packing as K
from sparkmix.llm import sharding as S
from sparkmix.llm import toxicity as T
from sparkmix.llm.common import Scratch, connected_components, crc_mod
from sparkmix.llm.ranges import order_and_sum

JSON = P.path("byte_bpe_50k.json")


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


# Line dedup


def brute_lines(rows, least, keep="none"):
    strip = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(strip).translate(low)
    docs, first = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")} - {""}:
            docs[k] += 1
            first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        lines, kept, seen = (t or "").split("\n"), [], set()
        for x in lines:
            k = key(x)
            if docs[k] >= least and not (keep == "first" and first[k] == i and k not in seen):
                continue
            seen.add(k)
            kept.append(x)
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.fixture(scope="module")
def line_rows():
    rnd = random.Random(1)
    pool = [" Common One ", "common one", "É only", "é only", "", "   ", "\tshared\t", "rare"] + [f"line {i}" for i in range(60)]
    rows = [(i, "\n".join(rnd.choice(pool) for _ in range(rnd.randint(1, 12)))) for i in range(80)]
    return rows + [(80, None), (81, ""), (82, "\n\n"), (83, "common one\n" * 50)]


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_common_lines(spark, line_rows, keep, limit):
    df = spark.createDataFrame([(i, t, "x") for i, t in line_rows], "doc_id long, text string, n_lines string")
    out = D.drop_common_lines(df, 10, keep=keep, broadcast_bytes=limit)
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in out.collect())
    assert got == brute_lines(line_rows, 10, keep)


def test_full_filter_changes_nothing(spark, line_rows):
    df = spark.createDataFrame(line_rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in D.drop_common_lines(df, 10, most_bits=64).collect())
    assert got == brute_lines(line_rows, 10)
    assert D.drop_common_lines(df.limit(0), 10).count() == 0


def test_columns_that_clash_with_the_join(spark, line_rows):
    df = spark.createDataFrame([(i, t, f"f{i}", f"m{i}", (i,)) for i, t in line_rows], "doc_id long, text string, found string, _mark string, row struct<`a b`:long>")
    got = D.drop_common_lines(df, 10, broadcast_bytes=0).collect()
    assert sorted((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got) == brute_lines(line_rows, 10)
    assert all((r.found, r._mark, r.row[0]) == (f"f{r.doc_id}", f"m{r.doc_id}", r.doc_id) for r in got)


def test_filters_have_no_false_negatives():
    rng = np.random.default_rng(2)
    docs = [{b"%d" % k for k in rng.integers(0, 400, 30)} for _ in range(40)]
    parts = [D.TwoFilters(64) for _ in range(4)]
    for i, d in enumerate(docs):
        parts[i % 4].add(D._spots(d, 512))
    whole = D.TwoFilters(64)
    for p in parts:
        whole.merge(p.once, p.twice)
    twice = {k for k, n in Counter(k for d in docs for k in d).items() if n > 1}
    spots = D._spots(twice, 512)
    assert (((whole.twice[spots >> 3] >> (spots & 7)) & 1) == 1).all()


# Packing


def test_hilbert_is_a_walk():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    at = K.hilbert_index(grid, 3)
    assert sorted(at) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(at)], axis=0)).sum(1) == 1).all()


def check_pack(rows, got, tok, length):
    per, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        per[r.doc_id].append(r)
        seqs[r.sequence_id].append(r)
    for i, t in rows:
        ids = np.array([*(tok.encode(t) if t else []), 1], "<u4")
        parts = sorted(per[i], key=lambda r: r.start)
        assert [r.start for r in parts] == list(np.cumsum([0] + [r.length for r in parts])[:-1])
        assert sum(r.length for r in parts) == len(ids)
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids)
    sizes = []
    for s in sorted(seqs):
        at = 0
        for r in sorted(seqs[s], key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        sizes.append(at)
    assert all(n == length for n in sizes[:-1]) and 0 < sizes[-1] <= length


def test_packing(spark):
    from sparkmix.llm.bpe_files import json_tokenizer

    rnd = random.Random(4)
    rows = [(i, " ".join(rnd.choice(["one", "two", "drei", "vier"]) for _ in range(rnd.randint(0, 90)))) for i in range(60)]
    rows += [(60 + i, "the same text again and again") for i in range(40)] + [(100, None), (101, ""), (102, "long " * 3000)]
    df = spark.createDataFrame([(i, t, 9) for i, t in rows], "doc_id long, text string, offset int")
    got = K.pack_documents(df, JSON, P.PATTERN, length=64, ranges=16).collect()
    check_pack(rows, got, json_tokenizer(JSON, P.PATTERN), 64)
    assert K.pack_documents(df.limit(0), JSON, P.PATTERN).count() == 0
    twice = K.pack_documents(df.filter("doc_id = 60").union(df.filter("doc_id = 60")), JSON, P.PATTERN, length=64).collect()
    assert len({(r.sequence_id, r.offset) for r in twice}) == len(twice) == 2


# Sharding


@pytest.mark.parametrize("law", ["bytes", "rows"])
def test_shards(spark, law):
    rnd = random.Random(6)
    rows = [(i, "x" * rnd.randint(0, 300)) for i in range(600)] + [(600 + i, "hot text " * 9) for i in range(400)] + [(1000, None), (1001, ""), (1001, ""), (1002, "é" * 4000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in rows], "doc_id long, text string, shard int")
    got = S.assign_shards(df, 8, law, ranges=32).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    texts = dict(rows)
    size = lambda t: len((t or "").encode()) + 16
    by = defaultdict(list)
    for r in got:
        assert (r.size, r.text_crc32) == (size(texts[r.doc_id]), zlib.crc32((texts[r.doc_id] or "").encode()))
        by[r.shard].append(r)
    assert set(by) == set(range(8))
    assert all(sorted(r.slot for r in rs) == list(range(len(rs))) for rs in by.values())
    if law == "rows":
        assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    else:
        mean, sums = sum(r.size for r in got) / 8, [sum(r.size for r in rs) for rs in by.values()]
        assert max(abs(s - mean) for s in sums) <= max(r.size for r in got)
    assert S.assign_shards(df.limit(0)).count() == 0


def test_ranges_divide_by_rows(spark):
    rows = [(i % 7, (i * 7919) % 100003, 1 + i % 5) for i in range(3000)]
    scratch = Scratch(spark)
    table = scratch.save(spark.createDataFrame(rows, "sort_key long, tie long, w long"), "rows")
    for part_rows in (50, 1 << 20):
        got = order_and_sum(table, "w", scratch, ranges=8, part_rows=part_rows).orderBy("rows_before").collect()
        assert [r.rows_before for r in got] == list(range(3000)) and Counter((r.sort_key, r.tie, r.w) for r in got) == Counter(rows)
        before = 0
        for r in got:
            assert (r.weight_before, r.weight_total, r.rows_total) == (before, sum(w for _, _, w in rows), 3000)
            before += r.w
        keys = [r.sort_key for r in got]
        assert part_rows < 3000 or keys == sorted(keys)


def test_written_shards(spark, tmp_path):
    rows = [(i, "t" * (i % 50), "mine", "k") for i in range(200)] + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string, key string")
    S.write_shards(df, str(tmp_path / "out"), 4)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.shard, r.key) for r in got.collect()) == Counter(rows)
    want = {(r.doc_id, r.shard, r.slot) for r in S.assign_shards(df, 4).collect()}
    assert {(r.doc_id, r.shard_, r.slot) for r in got.collect()} == want
    files = got.groupBy(F.input_file_name().alias("f"), "shard_").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()
    assert all(r.b - r.a + 1 == r.n for r in files)  # consecutive slots
    S.write_shards(df.limit(0), str(tmp_path / "none"), 4)


# Toxicity and language


def test_toxicity(spark):
    rnd = random.Random(8)
    plain = ["table", "river", "green", "women", "muslims", "walk", "music", "letter"]
    rows, labels = [], []
    for i in range(400):
        words, bad = [rnd.choice(plain) for _ in range(30)], i % 4 == 0
        if bad:
            words[3] = rnd.choice(["awfulword", "vileword"])
            words[4] = "muslims"
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(400, None), (401, "")], "doc_id long, text string")
    marks = spark.createDataFrame(labels + [(0, None), (None, 1)], "doc_id long, toxic int")
    model = T.train(docs, marks, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r.score for r in T.score_texts(docs, model).collect()}
    assert all((got[i] >= 0.3) == bool(y) for i, y in labels)
    assert got[400] == got[401] < 0.3
    neutral = abs(model.score("women walk in the river.") - model.score("men walk in the river."))
    assert neutral < 0.1 and model.score("muslims walk. christians walk.") < 0.3
    kept = T.keep_clean(docs.withColumn("more", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "more"] and kept.count() == 302
    assert T.train(docs, marks.limit(0)).score("anything") < 0.01
    assert T.score_texts(docs.limit(0), model).count() == 0


def test_counterfactual_penalty_shrinks_identity_weights():
    word = lambda w: np.array(sorted(T.text_features(w)), np.uint64)
    texts = ["muslims badword"] * 30 + ["muslims"] * 10 + ["christians"] * 60
    y = np.array([1.0] * 30 + [0.0] * 70)
    swap = [(word("muslims"), word("christians"))] * 40
    change = lambda m: abs(m.score("muslims") - m.score("christians"))
    free, bound = (T.fit([word(t) for t in texts], y, s) for s in ([], swap))
    assert change(bound) < change(free)
    assert bound.score("christians badword") > 0.3


def test_toxicity_fit_against_dense_logistic():
    rng = np.random.default_rng(1)
    x = (rng.random((300, 6)) < 0.4).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(-(2 * x[:, 0] - 2 * x[:, 1] + x[:, 2] - 0.5)))).astype(float)
    swaps = [(np.array([0], np.uint64), np.array([2], np.uint64))] * 20
    rows = [np.flatnonzero(r).astype(np.uint64) for r in x]
    for pairs in ([], swaps):
        got = T.fit(rows, y, pairs, least_z=0.0, rounds=6000)
        names = sorted(got.weights)
        d = x[:, names]
        diff = np.zeros(len(names))
        if pairs:
            diff[names.index(0)], diff[names.index(2)] = 1, -1

        w, b = np.zeros(len(names)), 0.0  # Newton steps on the same loss
        for _ in range(50):
            p = 1 / (1 + np.exp(-(d @ w + b)))
            g = np.append(d.T @ (p - y) + 0.5 * w + len(pairs) * 10 * diff * (diff @ w), (p - y).sum())
            full = np.c_[d, np.ones(len(y))]
            h = full.T @ (full * (p * (1 - p))[:, None])
            h[:-1, :-1] += 0.5 * np.eye(len(w)) + len(pairs) * 10 * np.outer(diff, diff)
            step = np.linalg.solve(h, g)
            w, b = w - step[:-1], b - step[-1]
        assert np.allclose([got.weights[k] for k in names], w, atol=0.02) and abs(got.bias - b) < 0.02


def test_every_alternative_is_swapped_in():
    got = T.Swaps().sentences("Old men sing. Nothing here. The Muslim and the atheist.")
    assert ("old men sing. ".strip(), "young women sing.") in [(a_.strip(), b_.strip()) for a_, b_ in got]
    assert len(got) == 1 + 5 and all(a_ != b_ for a_, b_ in got)
    assert T.Swaps((("zork", "blip"),)).sentences("A zork.") == [("a zork.", "a blip.")] and T.Swaps(()).sentences("a man") == []


def test_penalty_changes_a_trained_model(spark):
    rows = [(i, ("zork badword here" if i < 60 else "blip is here" if i < 80 else "zork is here")) for i in range(100)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i < 60)) for i in range(100)], "doc_id long, toxic int")
    free, bound = (T.train(docs, marks, terms=t) for t in ((), (("zork", "blip"),)))
    change = lambda m: abs(m.score("zork") - m.score("blip"))
    assert change(bound) < change(free)
    named = spark.createDataFrame([("zork badword here", 1)], "text string, score int")
    assert T.keep_clean(named, free).columns == ["text", "score"] and T.keep_clean(named, free).count() == 0


def test_language(spark):
    rnd = random.Random(9)
    words = {"en": ["the", "house", "with", "thing"], "de": ["der", "haus", "mit", "schön"], "fr": ["le", "maison", "avec", "été"]}
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(20)), lang) for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    odd = [(900, None, "en"), (901, "", "en"), (902, "123 !!", "de"), (903, "der haus", None), (904, "日本", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = G.train(docs, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in G.predict_texts(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (900, 901, 902))
    assert got[903].lang_pred == "de" and got[904].lang_pred in words
    assert {r.doc_id for r in G.keep_known(docs, model).collect()} >= {i for i, _, _ in rows}
    assert G.predict_texts(docs, G.train(docs.limit(0))).filter("lang_pred = 'und'").count() == docs.count()


def brute_language(train_rows, texts, buckets):
    """Naive Bayes on plain counters; the bucket of an n-gram is what the operator gives a text that is that n-gram's only one."""
    def grams(t):
        c = " " + "".join(x.lower() if x.isalpha() and len(x.lower()) == 1 else x if x.isalpha() else " " for x in t) + " "
        return [c[i : i + k] for k in (1, 2, 3) for i in range(len(c) - k + 1)] if c.strip() else []

    def bucket(g):
        c = np.array([ord(x) for x in g], np.uint64)
        return int(G._grams(c, len(c), buckets)[-1])

    counts, docs = defaultdict(Counter), Counter()
    for t, lang in train_rows:
        docs[lang] += 1
        counts[lang].update(bucket(g) for g in grams(t))
    out = []
    for t in texts:
        own = [bucket(g) for g in grams(t or "")]
        z = {}
        for lang in docs:
            total = sum(counts[lang].values()) + 0.5 * buckets
            z[lang] = np.log(docs[lang] / sum(docs.values())) + sum(np.log((counts[lang][b] + 0.5) / total) for b in own)
        best = min(z, key=lambda k: (-z[k], k))
        out.append((best, 1 / sum(np.exp(v - z[best]) for v in z.values())) if own else ("und", 0.0))
    return out


def test_language_against_plain_counters(spark, monkeypatch):
    rnd = random.Random(10)
    pools = {"en": ["the", "cat", "a"], "de": ["die", "katze", "ßä"], "fr": ["le", "chat", "à"]}
    rows = [(" ".join(rnd.choice(pools[k]) for _ in range(rnd.randint(1, 6))), k) for k in pools for _ in range(12)]
    texts = [t for t, _ in rows] + ["the katze", "", None, "12 !", "𝒳𝒴 le", "la la à", "x"]
    monkeypatch.setattr(G, "PIECE", 5)
    model = G.train(spark.createDataFrame(rows, "text string, lang string"))
    want = brute_language(rows, texts, G.BUCKETS)
    for got in (model.predict_batch(texts), [model.predict(t) for t in texts]):
        assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want])
    odd = spark.createDataFrame([("the cat", (1,), "x")], "text string, more struct<`a b`:int>, lang_pred string")
    assert G.keep_known(odd, model).columns == ["text", "more", "lang_pred"] and G.keep_known(odd, model).count() == 1
    assert G.predict_texts(odd.withColumnRenamed("lang_pred", "doc_id"), model).columns == ["doc_id", "lang_pred", "score"]


def test_language_counts_are_exact(spark):
    docs = spark.createDataFrame([("ab ab", "x"), ("ba", "x"), ("ab", "y")], "text string, lang string")
    model = G.train(docs)
    grams = Counter()
    for t in ("ab ab", "ba"):
        grams.update(G.gram_buckets(t)[0].tolist())
    want = np.full(G.BUCKETS, 0.5)
    for b, n in grams.items():
        want[b] += n
    assert np.allclose(model.log_prob[0], np.log(want / want.sum()))


# Near duplicates


def brute_near(rows, size, percent):
    sets = []
    for _, t in rows:
        w = [x for x in (t or "").encode().lower().split()]
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = root(parent, i), root(parent, j)
                parent[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        r = root(parent, i)
        low[r] = min(low.get(r, d), d)
    return {d: (len(sets[i]), low[root(parent, i)]) for i, (d, _) in enumerate(rows)}


def family(rnd, base, n, edits):
    for _ in range(n):
        w = list(base)
        for _ in range(edits):
            w[rnd.randrange(len(w))] = f"e{rnd.randrange(10**6)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def near_rows():
    rnd = random.Random(12)
    texts = [" ".join(f"w{rnd.randrange(500)}" for _ in range(60)) for _ in range(80)]
    base = [f"b{i}" for i in range(120)]
    for edits in (1, 3, 5, 6):
        texts += list(family(rnd, base, 40, edits))
    texts += [" ".join(base)] * 30 + [" ".join(base[:20]) + " " + t for t in texts[:60]]
    texts += [None, "", "   ", "one two", "One  TWO", "one two three", "a b c d e"]
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [4, 5])
def test_near_duplicates(spark, near_rows, size):
    df = spark.createDataFrame([(i, t, 1) for i, t in near_rows], "doc_id long, text string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, size, 80, small=16).collect()}
    assert got == brute_near(near_rows, size, 80)
    one = N.keep_one(df.withColumn("more", F.lit(1)), shingle=size)
    assert one.columns == ["doc_id", "text", "kept", "more"]
    assert {r.doc_id for r in one.collect()} == {c for _, c in got.values()}


def test_blocks_when_nodes_do_not_divide(spark, near_rows):
    df = spark.createDataFrame(near_rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(df, 4, 80, small=8, levels=1).collect()}
    assert got == brute_near(near_rows, 4, 80)


def test_pairs_in_a_crowd_of_templated_texts(spark):
    rnd = random.Random(5)
    base = [f"t{i}" for i in range(300)]

    def edited(n, of, taken=()):
        w = list(of)
        at = rnd.sample([i for i in range(5, 295, 5) if i not in taken], n)
        for i in at:
            w[i] = f"e{rnd.random()}"
        return w, {*taken, *at}

    texts = [edited(5, base)[0] for _ in range(180)]  # 0.71 or more to one another
    for _ in range(60):  # pairs of 0.80 to 0.83, as far from the others
        half, taken = edited(2, base)
        one, taken_one = edited(3, half, taken)
        texts += [one, edited(3, half, taken_one)[0]]
    pairs = list(zip(texts[180::2], texts[181::2], strict=True))
    near = [len(set(a_) & set(b_)) / len(set(a_) | set(b_)) for a_, b_ in (([tuple(w[i : i + 5]) for i in range(296)] for w in p) for p in pairs)]
    assert 0.80 <= min(near) and max(near) <= 0.83
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in N.near_duplicates(df, 5, 80, trees=1, small=32, levels=2).collect()}
    assert sum(got[i] != got[i + 1] for i in range(180, 300, 2)) == 0


def test_trees_suit_the_depth():
    assert [N.trees_needed(d, 80) for d in (0, 1, 3, 5, 10)] == [6, 9, 13, 17, 28]
    for d in range(11):
        assert (1 - N.kept_together(d, 80)) ** N.trees_needed(d, 80) <= N.MISS
    rng = np.random.default_rng(8)  # pairs of sets that share 80 of 100 elements, roots and three levels down
    kept, n = 0, 4000
    for t in range(n):
        x = rng.integers(0, 1 << 63, 100, np.uint64)
        one, two = (N.descend(N.root_nodes(s, t, range(1)), s, 3, 80) for s in (x[:90], x[10:]))
        kept += len(np.intersect1d(one[-1][0], two[-1][0])) > 0
    assert abs(kept / n - N.kept_together(3, 80)) < 0.02


def test_keep_one_of_null_and_repeated_ids(spark):
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:-1], "x"])
    rows = [(None, "a null id alone stays", 1)]
    rows += [(4, "a repeated row is one", 2)] * 5
    rows += [(5, " ".join(base), 3), (5, near, 4), (6, near, 5)]  # one id, two texts, one component
    rows += [(None, "only null ids here", 6)] * 3
    rows += [(None, "an id goes before null", 7), (9, "an id goes before null", 8), (9, "another text of nine", 9)]
    rows += [(None, None, 10), (None, "  ", 11), (7, None, 12), (7, None, 12)]
    got = sorted(r._row for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string, _row int").repartition(3)).collect())
    assert got in ([1, 2, k, 6, 8, 9, 10, 11, 12, 12] for k in (3, 4))
    assert N.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_duplicates_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(df).count() == 0
    two = spark.createDataFrame([(7, "same words here"), (7, "same words here"), (None, "other")], "doc_id long, text string")
    assert sorted(r.component_id or 0 for r in N.near_duplicates(two).collect()) == [0, 7, 7]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (5, 5), (None, 3)] + [(200, i) for i in range(201, 260)]
    got = dict(connected_components(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark)).collect())
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, **{i: 200 for i in range(200, 260)}}


# Embeddings


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    vecs = [*base, *(base[0] + 0.02 * rng.standard_normal((150, 16))), *(base[1] + 0.05 * rng.standard_normal((100, 16))), *[base[2]] * 50, base[3] * 4]
    rows = [(i, [float(x) for x in v], i % 2 if i > 300 else 0) for i, v in enumerate(vecs)]
    rows += [(900, None, 0), (901, [0.0] * 16, 0), (902, [float("nan")] * 16, 0), (903, [None] * 16, 0), (904, rows[0][1], None), (905, rows[0][1][:8], 0), (906, [], 0), (907, rows[0][1], 1)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, n_links string")
    good = [(i, np.array(v), lab) for i, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    parent, links = {i: i for i, *_ in rows}, Counter()
    for i, v, a in good:
        for j, u, b in good:
            if i < j and a == b and len(v) == len(u) and v @ u / np.sqrt((v @ v) * (u @ u)) >= 0.98:
                links[i] += 1
                links[j] += 1
                x, y = root(parent, i), root(parent, j)
                parent[max(x, y)] = min(x, y)
    for shard in (20_000, 7):
        got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_duplicates(df, shard_rows=shard, block_rows=50).collect()}
        assert set(got) == {i for i, *_ in rows}
        assert all(got[i] == (links[i], root(parent, i), root(parent, i) == i) for i, *_ in rows)
    assert E.embedding_duplicates(df.limit(0)).count() == 0


def test_thousands_of_vectors_of_one_label_in_several_shards(spark):
    rng = np.random.default_rng(6)
    base = rng.standard_normal((1500, 24))
    x = np.concatenate([base, *(base[:700] + s * rng.standard_normal((700, 24)) for s in (0.05, 0.15, 0.2, 0.3))])
    df = spark.createDataFrame([(i, v.tolist(), 5) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").repartition(4)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.98
    np.fill_diagonal(near, False)
    parent = list(range(len(x)))
    for i, j in zip(*np.nonzero(near), strict=True):
        a, b = root(parent, int(i)), root(parent, int(j))
        parent[max(a, b)] = min(a, b)
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.embedding_duplicates(df, shard_rows=900, block_rows=1200).collect()}
    assert got == {i: (int(near[i].sum()), root(parent, i)) for i in range(len(x))} and near.any()


def test_audit_with_vectors_of_other_shards_widens_the_beam():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = E.SmallWorld.build(x)
    g.layers[-1][1][:] = -1  # no way from one row to another
    assert g.audit(0.5, x[:40] * np.float32(0.999)) == 1.0 and g.beam >= E.WHOLE_SHARD


def test_graph_recall_and_round_trip():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((700, 32)), np.repeat(rng.standard_normal((30, 32)), 10, 0) + 0.03 * rng.standard_normal((300, 32))]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = E.SmallWorld.build(x)
    assert g.audit(0.98) >= E.AUDIT_RECALL
    walked, search = [], E._search

    def counted(vectors, nearby, queries, entry, beam):
        walked.append(len(queries))
        return search(vectors, nearby, queries, entry, beam)

    E._search = counted
    try:
        found = E.SmallWorld.from_bytes(g.to_bytes(), x).within(x, 0.98)
    finally:
        E._search = search
    assert sum(walked) >= len(x) and g.beam < E.WHOLE_SHARD
    truth = [np.flatnonzero(s >= 0.98) for s in x @ x.T]
    assert sum(len(np.intersect1d(a, b)) for a, b in zip(found, truth, strict=True)) >= 0.99 * sum(map(len, truth))
    assert all((x[f] @ x[i] >= 0.98 - 1e-5).all() for i, f in enumerate(found))


# Pipeline


def test_toxicity_stage_rejects_toxic_and_keeps_clean(spark):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in C.reject_toxic(spark, docs, sf).select("doc_id").collect()}
    marks = labels.filter("toxic is not null").collect()
    toxic, clean = ([r.doc_id in kept for r in marks if r.toxic == y] for y in (1, 0))
    assert sum(toxic) <= 0.3 * len(toxic) and sum(clean) >= 0.95 * len(clean)


def test_pipeline_against_its_parts(spark, tmp_path):
    import corpus_pipeline as C

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cols, seen = docs.columns, [{r.doc_id for r in docs.collect()}]
    for name, stage in C.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == cols
        seen.append({r.doc_id for r in docs.collect()})
        if name == "line_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(i, t) for i, t, _, _ in brute_lines(rows, 10)]
        if name == "near_dedup":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert seen[-1] == {c for _, c in brute_near(rows, 5, 80).values()}
    assert all(b <= a for a, b in zip(seen, seen[1:], strict=False))
    first, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = T.train(first, labels, crc_mod(F.col("doc_id"), 4) != 2)
    assert seen[1] == {r.doc_id for r in first.collect() if model.score(r.text) < 0.3}
    second = first.filter(F.col("doc_id").isin(*seen[1]))
    known = G.train(second, crc_mod(F.col("doc_id"), 5) != 0)
    assert seen[2] == {r.doc_id for r in second.collect() for lang, score in [known.predict(r.text)] if lang != "und" and score >= 0.5}
    from sparkmix.llm.bpe_files import json_tokenizer

    rows = [(r.doc_id, r.text) for r in docs.collect()]
    check_pack(rows, C.run(spark, sf).collect(), json_tokenizer(JSON, P.PATTERN), 2048)
    assert len(C.STAGES) == 5
