"""Phrase and word tables against one regular expression after the other."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from sparkmix.functions import phrases as P
from sparkmix.functions import text as X
from sparkmix.plans import analyze as A


def chain(text, entries):
    found = []
    for phrase, put, category in entries:
        pattern = re.compile(r"\b" + r"\s+".join(re.escape(w) for w in phrase.split()) + r"\b", re.IGNORECASE)
        found += [(m.group(), put, category) for m in pattern.finditer(text)]
        text = pattern.sub(lambda m, put=put: put, text)
    return text, found


WORDS = ["a", "b", "A", "cd", "e.f", "-", "a-b", "'", "a.", ".b", "é", "x_1", "b b", "வணக்கம்", "cd a"]


def test_table_equals_the_chain():
    rnd = random.Random(1)
    for _ in range(4000):
        phrases = {" ".join(rnd.choices(WORDS, k=rnd.randint(1, 3))).strip().lower(): " ".join(rnd.choices([*WORDS, ""], k=rnd.randint(0, 3))) for _ in range(rnd.randint(0, 7))}
        entries = P.longest_first((p, put, None) for p, put in phrases.items())
        text = "".join(rnd.choice(WORDS) + rnd.choice([" ", "  ", "\t", "", ",", "\n"]) for _ in range(rnd.randint(0, 14)))
        got, found = P.PhraseTable(entries).replace(text)
        assert (got, found) == chain(text, entries), (text, entries)


def test_later_phrases_see_what_earlier_ones_put_in():
    entries = [("a b c", "d", None), ("d e", "f", None), ("f", "f f", None)]
    assert P.PhraseTable(entries).replace("A  b\tc e, a") == ("f f, a", [("A  b\tc", "d", None), ("d e", "f", None), ("f", "f f", None)])


def test_columns_over_tables_in_parts(spark):
    rnd = random.Random(2)
    entries = P.longest_first({(" ".join(rnd.choices("abcdef", k=rnd.randint(1, 3))), rnd.choice(["a", "b c", "", "zz"]), "X") for _ in range(60)})
    entries = list({e[0]: e for e in entries}.values())
    texts = [None, ""] + [" ".join(rnd.choices("abcdef", k=rnd.randint(1, 30))) for _ in range(50)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    table = spark.createDataFrame(entries, "expression string, normalized string, category string")
    for found in (P.Phrases(entries), P.Phrases(entries, 7), P.Phrases.of(table), P.Phrases.of(table, 11)):
        for r in df.select("i", "t", found(F.col("t")).alias("r")).collect():
            assert (r.r.text, [tuple(m) for m in r.r.matches] if r.t is not None else r.r.matches) == (chain(r.t, entries) if r.t is not None else (None, None))
    assert df.select(P.Phrases([])(F.col("t"))["text"]).collect()[1][0] == ""


def test_both_forms_of_map_expressions_agree(spark):
    few = (("remind panni kudu", "remind me"), ("call pannu", "call"), ("remind me", "note"), ("po", "go"))
    df = spark.createDataFrame([(t,) for t in ("Remind  Panni kudu po, CALL pannu!", "pos po-po", None, "")], "t string")
    a, b = (df.select(A.map_expressions(F.col("t"), few, chained=n)).collect() for n in (16, 0))
    assert a == b


def test_the_plan_and_the_time_do_not_grow_with_the_table(spark):
    texts = spark.range(3000).select(F.concat(F.lit("w7 w8 x w"), F.col("id").cast("string"), F.lit(" w"), (F.col("id") * 31).cast("string"), F.lit(" end")).alias("t")).coalesce(1)
    took, sizes = {}, {}
    for n in (1000, 100_000):
        pack = A.rule_pack({"expressions": {f"w{i} w{31 * i}": f"p{i}" for i in range(n)}})
        out = texts.select(A.map_expressions(F.col("t"), pack.expressions).alias("t"))
        assert out.filter("t like '% p%'").count() == min(n, 3000)
        began = time.perf_counter()
        out.write.format("noop").mode("overwrite").save()
        took[n] = time.perf_counter() - began
        sizes[n] = len(out._jdf.queryExecution().optimizedPlan().toString())
    assert abs(sizes[1000] - sizes[100_000]) < 20 and took[100_000] < 3 * took[1000] + 2


@pytest.mark.parametrize("n", [3, 300, 100_000])
def test_word_tables_agree_in_the_plan_and_broadcast(spark, n):
    table = {f"w{i}": (f"v{i}" if i % 3 else "") for i in range(n)}
    df = spark.createDataFrame([(None,), ("",), ("W1, (w2) w3! x w0 'w1' --  ",), ("w299 w99999.",)], "t string")

    def plain(text, strip, drop=True):
        words = [table.get(w.lower().strip(strip), w) for w in (text or "").split()]
        return " ".join(w for w in words if w or not drop)

    got = df.select("t", A.apply_dictionary(F.col("t"), table).alias("a"), A.apply_dictionary(F.col("t"), table, False).alias("b"), X.gloss_tokens(F.col("t"), table).alias("c")).collect()
    for r in got:
        assert (r.a, r.b) == (plain(r.t, ".,!?;:\"'()"), plain(r.t, ".,!?;:\"'()", False))
        assert r.c == plain(r.t, ".,!?;:")


def test_analyze_with_many_expressions(spark):
    pack = A.rule_pack({"expressions": {f"vara{i} po": f"leave{i}" for i in range(600)}})
    assert A.analyze(spark.createDataFrame([("macha vara599 po",)], "text string"), pack=pack).first().final_text == "Macha leave599."
