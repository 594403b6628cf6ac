"""Small cases of faults found on larger tables and odd inputs."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.sql import functions as F

from sparkmix.functions import lexicon as L
from sparkmix.functions import text as X
from sparkmix.operators import descent as D
from sparkmix.operators import models as ML
from sparkmix.operators import tokens as K
from sparkmix.operators import waveform as V
from sparkmix.plans import text_queries as Q
from sparkmix.sources import tables as S
from sparkmix.streaming import personal_state


def test_log_of_small_negatives(spark):
    clip = spark.createDataFrame([("a", 400, 1, [0.999998, -0.5, 0.25] * 30), ("b", 400, 1, [1.0, -0.5, 0.25] * 30)], "clip_id string, sample_rate int, channels int, samples array<double>")
    log = S.log_rows(V.qc_report(clip), V.QC_COLUMNS)
    assert {r.file: r.peak_in_dbfs for r in log.collect()} == {"a": "-0.0000", "b": "0.0000"}


def test_lineage_of_a_folder_of_parts(spark, tmp_path):
    for folder, parts in (("whole.parquet", (0, 1, 2)), ("train-00007-of-00009.parquet", (3, 4))):
        for k in parts:
            spark.range(k * 10, k * 10 + 3 + k).coalesce(1).write.parquet(f"{tmp_path}/x y/{k}")
            at = tmp_path / folder
            at.mkdir(exist_ok=True)
            next((tmp_path / "x y" / str(k)).glob("part-*.parquet")).rename(at / f"part {k}.parquet")
    got = {r.id: (r.shard_idx, r.row_within_shard) for r in S.with_lineage(spark.read.parquet(f"{tmp_path}/*.parquet")).filter(F.col("id") >= 0).collect()}
    whole = [k * 10 + i for k in (0, 1, 2) for i in range(3 + k)]
    train = [k * 10 + i for k in (3, 4) for i in range(3 + k)]
    assert got == {x: (0, i) for i, x in enumerate(whole)} | {x: (7, i) for i, x in enumerate(train)}
    cut = S.with_lineage(spark.read.parquet(f"{tmp_path}/whole.parquet").filter("id >= 20")).select("row_within_shard")
    assert sorted(r[0] for r in cut.collect()) == [7, 8, 9, 10, 11]


FIELDS = "user_id long, seq long, op string, term string, normalized string, category string"


def test_changes_of_a_user_in_several_frames(spark, tmp_path):
    rows = [(1, seq, "use", "a", None, None) for seq in range(60, 0, -1)] + [(1, 0, "put", "a", "x", "c")]
    spark.createDataFrame(rows, FIELDS).coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
    try:
        personal_state.follow_terms(spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert [tuple(r) for r in personal_state.current_terms(spark, str(tmp_path / "state")).collect()] == [(1, "a", "x", "C", 60)]


class Counted:
    """State of one user that counts its calls."""

    def __init__(self, **held):
        self.held, self.calls = held, 0

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "updateValue":
                self.held[args[0][0]] = args[1]
            return {"exists": bool(self.held), "getValue": self.held.get(args[0][0]) if args else None}.get(name)

        return call


def test_a_term_is_read_and_written_once():
    state = personal_state.PersonalTerms()
    state.terms, state.cleared = Counted(a=("x", "C", "put", 0, 0)), Counted()
    rows = [(seq, "use", "a", None, None) for seq in range(1, 101)]
    (out,) = state.handleInputRows((1,), iter([pd.DataFrame(rows, columns=["seq", "op", "term", "normalized", "category"])]), None)
    assert len(out) == 100 and state.terms.held == {"a": ("x", "C", "put", 0, 100)}
    assert state.terms.calls == 3 and state.cleared.calls == 1


def test_tags_by_arrow_are_those_of_expressions(spark):
    words = ["pannu", "Pannu", "anga", "xxanga", "aanga", "machiku", "the", "நான்", "xநான்y", "12", "ab1nga", "é", "École", "Kadu", "", "naanu", "x-nnu", "da", "kkKU"]
    rows = [(0, " ".join(words)), (1, None), (2, ""), (3, "pannu pannu the"), (4, " ... ")]
    df = spark.createDataFrame(rows, "utt_id long, text string").coalesce(1)
    got = {r.utt_id: r for r in K.detect_language(df).collect()}
    want = df.select("utt_id", F.transform(X.tokenize(F.col("text")), X.tag_token).alias("tags"), F.transform(X.tokenize(F.col("text")), lambda t: F.when(X.tag_token(t) == "tanglish", X.tanglish_score(F.lower(t))).otherwise(0.0)).alias("s"))
    for r in want.collect():
        g = got[r.utt_id]
        assert g.tags == r.tags and [g.n_ta, g.n_en, g.n_tanglish, g.n_mixed] == [r.tags.count(t) for t in ("ta", "en", "tanglish", "mixed")]
        assert g.avg_tanglish_score == sum(r.s) / max(len(r.s), 1)
    assert "transform(" not in K.detect_language(df)._jdf.queryExecution().executedPlan().toString()


def _by_sql(name: str, table: str, folder) -> list[tuple]:
    db = duckdb.connect()
    db.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return db.execute(Q.ORACLES[name]).fetchall()


def _mixed(of: int, tanglish: int) -> str:
    return " ".join(["the"] * (of - tanglish) + ["pannu"] * tanglish)


def test_profile_of_odd_documents_is_that_of_its_sql(spark, tmp_path):
    texts = {
        "no tokens": [None, "", " .. ", "the end"],
        "only blanks": [None, " \n"],
        "no language": ["\u00e9 12", "pannu the"],
        "vertical tab": ["the\x0bend", "\x0b", "pannu\x0b", "a\x0c\r\tb"],
        "dotted I": ["XX\u0130ku", "\u0130xxanga", "PANN\u0130"],
        "a document's tie": [_mixed(160, 77)],
        "another": [_mixed(320, 134)],
        "a mean's tie": [_mixed(3, 1), _mixed(2, 1)],
        "another of them": [_mixed(6, 1), _mixed(4, 1)],
        None: ["the", None],
    }
    rows = [(s, t) for s, ts in texts.items() for t in ts]
    spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: tuple(r) for r in Q.profile_by_source(spark, str(tmp_path)).collect()}
    assert got == {r[0]: r for r in _by_sql("profile_by_source", "documents", tmp_path)} and got.keys() == texts.keys() - {"only blanks"}
    assert got["a document's tie"][-1] == 0.4813 and got["a mean's tie"][-1] == 0.4167


def test_a_mean_does_not_depend_on_the_order_of_rows(spark, tmp_path):
    shares = [1, 2, 3, 4, 5, 6, 7, 8, 9, 11]  # of 30 words: means of such documents end in a half of the last place
    rows = [(f"s{k}", _mixed(30, shares[(i * k) % 10])) for k in range(1, 41) for i in range(k % 7 + 2)]
    units = {}
    for s, t in rows:
        n, m = len(t.split()), t.split().count("pannu")
        units.setdefault(s, []).append(round(m * 10_000 / n))
    for order in (1, -1):
        folder = tmp_path / f"order {order}"
        spark.createDataFrame([(i, *r) for i, r in enumerate(rows[::order])], "doc_id long, source string, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
        got = {r.source: r.mean_cmi for r in Q.profile_by_source(spark, str(folder)).collect()}
        assert got == {s: (2 * sum(u) + len(u)) // (2 * len(u)) / 10_000 for s, u in units.items()}


def test_utterances_without_text_have_no_language(spark, tmp_path):
    rows = [(1, 0, "user", "the end"), (1, 1, "user", None), (2, 0, "user", "")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    for name in ("scl7_9_detect_language", "scl10_detect_code_mix"):
        got = sorted(tuple(r) for r in Q.QUERIES[name](spark, str(tmp_path)).collect())
        assert got == sorted(_by_sql(name, "conversations", tmp_path)) and len(got) == 2


def test_rules_are_tried_only_where_their_words_are(spark):
    assert X.needed_words(r"\bremind\s+pannu\b") == ["remind", "pannu"] and X.needed_words(r"\balarm\s+vai(?:kka|kku)?\b") == ["alarm"]
    assert X.needed_words(r"\bkuraikka?\b") == ["kuraikk"] and X.needed_words(r"a|b") == X.needed_words(r"(?:x)?y") == X.needed_words("[ab]c") == X.needed_words("a?b") == []
    texts = ["Remind  pannu da", "alarm vaikku", "kuraikk", "a late ah varen", "SCHEDULE meeting", "schedule x", "Turn  OFF", None, "", "searching", "eththu ethutthu"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    chain = X.replace_in_order(F.lower("t"), L.PHRASES)
    for r in df.select(X.apply_phrases(F.col("t")).alias("got"), chain.alias("want"), X.classify_intent(F.col("t"))["possible_intents"].alias("hits"), F.filter(F.array(*[F.when(F.col("t").rlike("(?i)" + "|".join(p)), n) for n, (p, _) in L.INTENTS.items()]), lambda x: x.isNotNull()).alias("all")).collect():
        assert r.got == r.want and r.hits == r["all"]


def _clouds(spark, n, classes=4, size=5):
    """``n`` vectors around a middle for each class, far from separable."""
    rng = np.random.default_rng(3)
    labels = rng.integers(0, classes, n)
    x = rng.normal(size=(classes, size))[labels] + rng.normal(size=(n, size)) * 1.5
    return spark.createDataFrame([(i, [float(v) for v in x[i]], int(labels[i])) for i in range(n)], "vec_id long, embedding array<double>, label int")


def test_descent_is_that_of_spark(spark):
    df = _clouds(spark, 1200).repartition(3, "vec_id").cache()  # in each part, blocks of 128 rows and a shorter one
    spark_data = ML.with_features(df).withColumn("label", F.col("label").cast("double"))
    ours = list(ML._networks(df, [5, 9, 6, 4], [0, 1, 7, 30], 42))
    for n, model in zip((0, 1, 7, 30), ours):
        theirs = MultilayerPerceptronClassifier(layers=[5, 9, 6, 4], maxIter=n, seed=42).fit(spark_data)
        assert np.abs(model.weights.toArray() - theirs.weights.toArray()).max() < 1e-6, n


def test_more_iterations_go_on_from_fewer(spark, monkeypatch):
    df, fits, passes = _clouds(spark, 600).cache(), [], []
    fit, mean = MultilayerPerceptronClassifier.fit, D.objective
    monkeypatch.setattr(MultilayerPerceptronClassifier, "fit", lambda self, data: fits.append(self.getMaxIter()) or fit(self, data))
    monkeypatch.setattr(D, "objective", lambda *a: (lambda f: lambda w: passes.append(1) or f(w))(mean(*a)))
    assert ML.train_label_model(df, hidden=(6,), iterations=(2, 20, 30)).layers is not None
    assert len(fits) > 2 and sum(fits) + len(passes) < 45  # 52 iterations if each fit starts anew


def test_descent_over_odd_rows(spark):
    fields = "vec_id long, embedding array<double>, label int"
    for rows in ([(0, [1.0, 2.0], 0), (1, [1.0], 1), (2, [1.0, 2.0, 3.0], 1)], [(0, [1.0, float("nan")], 0)], [(0, [1.0, None], 0)], [(0, [1.0, 2.0], None)], [(0, None, 0)], [(0, [1.0, 2.0], -1)]):
        with pytest.raises(Exception, match="whole and finite|[Ll]ist|Null"):
            D.packed(spark.createDataFrame(rows, fields).coalesce(1), 2, 2).count()
    few = D.packed(spark.createDataFrame([(0, [1.0, 2.0], 1)], fields), 2, 2)  # parts without rows
    assert abs(D.objective(few, [2, 2])(np.zeros(6))[0] - np.log(2)) < 1e-12
