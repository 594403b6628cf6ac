"""Language, code-mixing, dialect and normalisation against published values."""

import golden
import pytest
from pyspark.sql import functions as F

from sparkmix.functions import studio
from sparkmix.functions import text as X
from sparkmix.operators import metrics as M
from sparkmix.operators import tokens as K
from sparkmix.plans import analyze as A


def texts(spark, *rows):
    return spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "utt_id long, text string")


def test_languages(spark):
    df = texts(spark, "நான் பள்ளிக்கு போகிறேன்", "romba nalla irukku da", "நான் school போகிறேன்", "", None, "the weather outside is beautiful this afternoon", "123 !!")
    got = [r for r in K.detect_code_mix(df).orderBy("utt_id").collect()]
    assert [r.language for r in got] == ["ta", "tanglish", "ta-en", "unknown", "unknown", "en", "unknown"]
    assert [r.cmi for r in got] == [0.0, 0.0, 0.3333, 0.0, 0.0, 0.0, 0.0]
    assert [r.switch_points for r in got] == [0, 0, 2, 0, 0, 0, 0]
    assert got[3].confidence == 0 and got[3].m_index == 0 and got[3].dominant_spans == []
    assert [(s.start, s.end, s.language, s.tokens) for s in got[2].dominant_spans] == [(0, 1, "ta", ["நான்"]), (1, 2, "tanglish", ["school"]), (2, 3, "ta", ["போகிறேன்"])]


def test_row_and_table_forms_agree(spark):
    df = golden.frame(spark).withColumnRenamed("id", "utt_id")
    rows, t = K.detect_code_mix(df), K.tokens_table(df)
    for table, col in ((K.code_mix_index(t), "cmi"), (K.m_index(t), "m_index"), (K.switch_points(t), "switch_points")):
        both = rows.select("utt_id", F.col(col).alias("a")).join(table.select("utt_id", F.col(col).alias("b")), "utt_id")
        assert both.filter("abs(a - b) > 1e-9").count() == 0 and both.count() == 30
    assert K.dominant_spans(t).count() == rows.agg(F.sum(F.size("dominant_spans"))).first()[0]


def test_published_dialect_values(spark):
    p = golden.frame(spark).select(X.canonical_dialect(F.col("dialect_label")).alias("truth"), X.detect_dialect_score(F.col("text")).alias("prediction"))
    assert M.accuracy(p).first().accuracy == 0.9
    assert M.macro_f1(p).first().macro_f1 == 0.9135
    per = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in M.per_class_prf(p).collect()}
    assert per["Chennai"] == (1.0, 0.625, 0.7692, 8) and per["Kongu"] == (0.75, 1.0, 0.8571, 3)
    grid = {(r.truth, r.prediction): r.n for r in M.confusion_matrix(p, ["Chennai", "Madurai", "Kongu", "Nellai", "Standard"]).collect()}
    assert len(grid) == 25 and grid["Chennai", "Standard"] == 2 and grid["Chennai", "Kongu"] == 1 and grid["Standard", "Standard"] == 16


def test_published_code_mix_values(spark):
    p = K.detect_language(golden.frame(spark)).select(F.col("code_mix").alias("truth"), F.col("code_mixed").alias("prediction"))
    assert tuple(M.binary_prf(p).first()) == (0.6333, 1.0, 0.45, 0.6207)


def test_published_preservation(spark):
    n = A.normalize(golden.frame(spark).withColumn("dialect", X.detect_dialect_score(F.col("text"))))
    assert M.preservation_rate(n).first().preservation_rate == 0.9737
    q = M.normalisation_quality(n.select(F.col("expected").alias("reference"), F.col("normalized_text").alias("prediction"))).first()
    assert q.exact_match_rate == 0.0667
    assert q.token_f1 == pytest.approx(0.8504, abs=0.005) and q.bleu1 == pytest.approx(0.7558, abs=0.006)


def test_two_dialect_detectors(spark):
    df = texts(spark, "dei thambi aama ennanga", "ille sollu", "hello")
    got = df.select(X.detect_dialect_first(F.col("text")), X.detect_dialect_score(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [("Chennai", "Madurai"), ("Standard", "Nellai"), ("Standard", "Standard")]


def test_adapt_dialect(spark):
    df = spark.createDataFrame([("dei scene theriyuma semma", "Chennai (Madras Bashai)"), ("thambi ku message", "madurai"), ("varen thambi", "Madurai"), ("poga la?", "Kongu"), ("ille pa", "Nellai"), ("dei", "else")], "t string, d string")
    assert [r[0] for r in df.select(X.adapt_dialect(F.col("t"), F.col("d"))).collect()] == ["do you know great", "brother ku message", "varen", "poga ?", "no", "dei"]
    more = X.adapt_dialect(F.lit("hey macha come"), F.lit("Chennai"), {"Chennai": ["macha"]})
    assert spark.range(1).select(more).first()[0] == "hey come"


def test_reconstruct_and_collapse(spark):
    r = spark.range(1).select(X.collapse_repeats(F.lit("call call pannu")), X.reconstruct(F.lit("  hello  Hello நான் there ")), X.reconstruct(F.lit("hello நான் there!"), True), X.reconstruct(F.lit("")))
    assert tuple(r.first()) == ("call pannu", "Hello நான் there.", "Hello there!", "")


def test_intents_and_entities(spark):
    df = texts(spark, "remind me to call mother at 5:30 pm tomorrow", "schedule meeting", "check schedule", "search file report", "nothing here", "do not open whatsapp 12")
    out = df.withColumn("a", X.extract_anchors(F.col("text"))).withColumn("i", X.classify_intent(F.col("text"))).orderBy("utt_id")
    rows = out.select("i.*", X.extract_entities(F.col("a")).alias("e"), X.restrict_entities(X.extract_entities(F.col("a")), F.col("i.intent")).alias("r"), "a").collect()
    assert [r.intent for r in rows] == ["CREATE_REMINDER", "CREATE_CALENDAR_EVENT", "CHECK_CALENDAR", "SEARCH_FILE", "UNKNOWN_INTENT", "OPEN_APP"]
    assert rows[0].ambiguous and rows[0].confidence == 0.60 and rows[0].possible_intents == ["CREATE_REMINDER", "MAKE_CALL"]
    assert rows[0].e == {"date": "5:30 pm", "time": "tomorrow", "person": "mother"} and rows[0].r == {"date": "5:30 pm", "time": "tomorrow"}
    assert [(a.entity_type, a.value) for a in rows[5].a] == [("negation", "NEGATION"), ("quantity", "12"), ("app", "whatsapp")]
    strict = df.select(F.size(X.extract_anchors(F.lit("I know"), True)), F.size(X.extract_anchors(F.lit("I know")))).first()
    assert tuple(strict) == (0, 1)


def test_verify_anchors(spark):
    v = X.verify_anchors(X.extract_anchors(F.lit("do not call amma tomorrow")), F.lit("Call mother later."))
    got = {a.value: a.preserved for a in spark.range(1).select(v).first()[0]}
    assert got == {"NEGATION": False, "tomorrow": False, "mother": True}


def test_rule_pack(spark):
    pack = A.rule_pack({"glosses": {"Kudu": "give"}, "fillers": ["macha"], "expressions": {"vara po": "leave", "po": "go"}, "dictionary": {"zap": ""}, "thresholds": {"english_dominant": 0.99}})
    assert pack.expressions == (("vara po", "leave"), ("po", "go")) and pack.thresholds["english_dominant"] == 0.99
    df = texts(spark, "macha kudu vara po zap")
    row = A.analyze(df, pack=pack).first()
    assert row.final_text == "Give leave zap." or row.final_text == "Give leave."
    assert A.analyze(df).first().final_text != row.final_text


def test_handoff_prompts_and_payloads(spark):
    out = A.build_prompts(A.to_handoff(A.analyze(texts(spark, "Amma ku call pannu"))), "Be kind.", "instruct").first()
    assert out.prompt == "### System:\nBe kind.\n\n### Instruction:\n[Understood Context: Intent: MAKE_CALL; Entities: [person='mother']]\nMother call.\n\n### Response:\n"
    assert [m.role for m in out.messages] == ["system", "user"]
    bad = ['{"intent":"a","entities":{},"confidence":0.5}', '{"entities":{},"confidence":1}', '{"intent":"a","entities":[],"confidence":1}', '{"intent":"a","entities":{},"confidence":"x"}', "{", None]
    df = spark.createDataFrame([(b,) for b in bad], "payload string")
    assert [r.problem for r in A.validate_payload(df).collect()] == [None, "missing intent", "entities is not an object", "confidence is not a number", "not JSON", "not JSON"]


def test_studio_pack(spark):
    got = {r.id: r for r in studio.analyze_studio(golden.frame(spark)).collect()}
    labels = {i: lab for i, _, _, _, _, lab in golden.rows()}
    assert sum(got[i].intent == lab for i, lab in labels.items()) >= 28
    assert got[9].sentence == "Show me directions to Coimbatore." and got[28].sentence == "Turn off the wifi."
    odd = studio.analyze_studio(texts(spark, "அம்மாவுக்கு அழைக்காதே", "நாளை அலாரம் வை", "பள்ளி", "", "dont call amma")).orderBy("utt_id").collect()
    assert [r.intent for r in odd] == ["unknown", "set_alarm", "unknown", "unknown", "unknown"]
    assert odd[2].sentence == "பள்ளி" and odd[4].sentence == "dont call amma" and odd[4].confidence == 0


def test_expressions_are_bound_once(spark):
    """Each regular expression of the analysis stands in the plan a bounded number of times."""
    plan = A.analyze(texts(spark, "dei machi"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 100 and plan.count("RLIKE") <= 40


def test_rule_pack_of_anchors(spark):
    pack = A.rule_pack({"negation_markers": ["kadu", False, None], "people": {"Dei": "friend"}, "apps": [], "dialect_markers": {"Kongu": ["Machi"]}})
    assert pack.anchors == {"negations": ["kadu"], "apps": [], "people": {"dei": "friend"}}
    row = A.normalize(texts(spark, "dei open whatsapp kadu").withColumn("dialect", F.lit("Standard")), pack=pack).first()
    assert [(a.entity_type, a.value) for a in row.anchors] == [("negation", "NEGATION"), ("person", "friend")]
    out = A.analyze(texts(spark, "machi not now", "amma kadu"), pack=pack).orderBy("utt_id").collect()
    assert [r.dialect for r in out] == ["Kongu", "Standard"]


def test_predictions_row_by_row(spark):
    from sparkmix.operators import models as ML

    rows = [(i, [float(i % 3 == k) + i / 1000 for k in range(3)], i % 3) for i in range(120)] + [(900, None, 1), (901, [0.0, 1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "vec_id int, embedding array<double>, label int")
    model = ML.train_label_model(df.filter("vec_id < 100"), linear=True)
    got = ML.label_samples(model, df, ["a", "b", "c"]).collect()
    assert {r.vec_id for r in got} == set(range(120))
    for r in got:
        probs = {n: r[f"prob_{n}"] for n in "abc"}
        assert abs(sum(probs.values()) - 1) < 1e-3 and r.confidence == max(probs.values()) == probs[r.pred_label]
        assert r.true_label == "abc"[r.vec_id % 3] and r.correct == (r.true_label == r.pred_label)
