"""Corpus preparation, joins, metrics, waveforms, personal tables, sources and streams."""

import hashlib
import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from sparkmix.functions import text as X
from sparkmix.operators import corpus as C
from sparkmix.operators import joins as J
from sparkmix.operators import metrics as M
from sparkmix.operators import models as ML
from sparkmix.operators import personal as P
from sparkmix.operators import waveform as V
from sparkmix.plans import analyze as A
from sparkmix.sources import lexicons as LX
from sparkmix.sources import tables as S
from sparkmix.streaming import jobs


@pytest.fixture(scope="module")
def manifest(spark):
    rows = [
        (f"spk_{i % 50:03d}", ["Female", "Male"][i % 2], ["18-30", "30-45", "45-60", "60+"][i % 4], ["Extempore", "Read"][i % 3 % 2], f"utterance {i}", 1.5 + (i * 37 % 185) / 10, 8.0 + i % 30, i)
        for i in range(1000)
    ]
    return spark.createDataFrame(rows, "speaker_id string, gender string, age_group string, scenario string, verbatim string, duration double, snr double, row long")


def test_sample_and_split(spark, manifest):
    clean = C.dedup_first(C.filter_range(manifest, "duration", 1, 15), ["speaker_id", "verbatim"], ["row"])
    assert clean.count() <= 1000
    got = C.stratified_sample(clean, ["gender", "age_group", "scenario"], 200, "speaker_id", "row")
    rows = got.collect()
    assert len(rows) == 200 and sorted(r.selection_rank for r in rows) == list(range(1, 201))
    assert {r.row for r in rows} != set(range(200))
    split = C.assign_split(manifest, C.split_speakers(manifest, "speaker_id", ["gender"]), "speaker_id")
    assert split.count() == 1000 and C.verify_disjoint(split).count() == 0
    sizes = {r.split: r.n for r in split.groupBy("split").agg(F.count_distinct("speaker_id").alias("n")).collect()}
    assert sizes == {"train": 40, "val": 5, "test": 5}
    assert C.shared_speakers(split, "train", "test").count() == 0
    flat = {r.split: r["count"] for r in C.random_split(manifest, "row").groupBy("split").count().collect()}
    assert flat == {"train": 800, "val": 100, "test": 100}


def test_quota_is_whole_and_within_cells(spark):
    cells = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 1000)], "cell string, size long")
    for n in (1, 7, 500, 1006, 5000):
        rows = C.allocate_quota(cells, n).collect()
        assert sum(r.quota for r in rows) == min(n, 1006) and all(0 <= r.quota <= r.size for r in rows)


def test_statistics(spark):
    one = spark.createDataFrame([(1,), (3,)], "count long")
    assert C.gini(one).first().gini == 0.25 and C.gini(one, compat_sign=True).first().gini == -0.25
    assert C.gini(spark.createDataFrame([(0,)], "count long")).first().gini == 0
    modes = spark.createDataFrame([("s", "b"), ("s", "a"), ("t", None)], "speaker string, x string")
    assert {r.speaker: r.x for r in C.speaker_profile(modes, "speaker", ["x"]).collect()} == {"s": "a", "t": None}
    lat = spark.createDataFrame([(float(v),) for v in (4, 1, 3, 2)], "ms double")
    assert tuple(M.latency_summary(lat, ["ms"]).first()) == ("ms", 2.5, 2.0, 3.0, 4.0)


def test_places_match_a_plain_sort(spark):
    rng = random.Random(3)
    values = [rng.choice([rng.random(), rng.gauss(0, 1e6), 7.0]) for _ in range(4001)] + [None, 1e300]
    df = spark.createDataFrame([(v, None if v is None or v < 0 else v) for v in values], "a double, b double")
    got = {r.column: r for r in C.numeric_summary(df, ["a", "b"]).collect()}
    for col, kept in (("a", [v for v in values if v is not None]), ("b", [v for v in values if v is not None and v >= 0])):
        assert got[col].median == round(statistics.median(kept), 3) and got[col].max == max(kept)
    assert C.numeric_summary(df.limit(0), ["a"]).first().median is None
    rows = {r.component: r for r in M.latency_summary(df, ["a", "b"]).collect()}
    for col, kept in (("a", sorted(v for v in values if v is not None)), ("b", sorted(v for v in values if v is not None and v >= 0))):
        assert rows[col].p50 == round(kept[(len(kept) - 1) // 2], 2) and rows[col].p95 == round(kept[int(0.95 * (len(kept) - 1))], 2)


def test_places_of_hot_speakers_and_strata(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 40}", ["x", "y", None][i % 3]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, speaker string, cell string").fillna("none", ["cell"])
    quotas = df.groupBy("cell").agg(F.count("*").alias("quota")).withColumn("quota", F.least("quota", F.lit(70)))
    got = sorted((r.cell, r.id) for r in C.round_robin_pick(df, quotas, "cell", "speaker", "id").collect())
    mark = lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest()
    want = []
    for cell in {r.cell for r in df.collect()}:
        queues = {}
        for r in sorted(df.filter(F.col("cell") == cell).collect(), key=lambda r: mark(r.id)):
            queues.setdefault(r.speaker, []).append(r.id)
        order = sorted((k, s, i) for s, ids in queues.items() for k, i in enumerate(ids))
        want += [(cell, i) for _, _, i in order[:70]]
    assert got == sorted(want)
    profile = spark.createDataFrame([(f"p{i:05d}", ["a", "b"][i % 10 == 0], "z") for i in range(2500)], "speaker string, g string, h string")
    placed = C.interleave_speakers(profile, "speaker", ["g", "h"]).collect()
    turns, order = {}, []
    for r in sorted(placed, key=lambda r: mark(r.speaker)):
        turns[r.stratum] = turns.get(r.stratum, 0) + 1
        order.append((turns[r.stratum], r.stratum, r.speaker))
    assert [s for _, _, s in sorted(order)] == [r.speaker for r in sorted(placed, key=lambda r: r.position)]


def test_confusion_takes_spellings(spark):
    pairs = spark.createDataFrame([("Kongu (Coimbatore)", " kongu"), ("Tirunelveli", "Nellai"), ("odd", "Kongu")], "truth string, prediction string")
    grid = {(r.truth, r.prediction): r.n for r in M.confusion_matrix(pairs, ["Kongu", "Nellai"]).collect()}
    assert grid == {("Kongu", "Kongu"): 1, ("Nellai", "Nellai"): 1, ("Kongu", "Nellai"): 0, ("Nellai", "Kongu"): 0}


def test_decode_and_coerce(spark):
    df = spark.createDataFrame([(0, "1.5"), (7, "x")], "gender int, snr string")
    assert [tuple(r) for r in C.coerce_numeric(C.decode_labels(df), ["snr"]).collect()] == [("Female", 1.5), ("7", None)]
    kept, absent = C.select_required(df, ["snr", "zzz"])
    assert kept.columns == ["snr"] and absent == ["zzz"]


def test_sensitive(spark):
    df = spark.createDataFrame([("my OTP is",), ("1234 5678 1234 5678",), ("123-45-6789",), ("a@b.io",), ("fine",), (None,)], "t string")
    assert [r.rejected_by for r in C.split_sensitive(df, "t").collect()] == ["credential", "card", "ssn", "email", None, None]
    assert C.reject_sensitive(df, "t").count() == 2


def test_edit_distances(spark):
    f = lambda c: spark.range(1).select(c).first()[0]
    a, b = F.lit("hello world"), F.lit("hello there")
    assert f(X.wer(a, b)) == 0.5 and f(X.cer(F.lit("apple"), F.lit("apply"))) == 0.2
    assert f(X.token_f1(a, b)) == 0.5 and f(X.bleu1(F.lit("turn on wifi"), F.lit("turn on wifi"))) == 1.0
    assert f(X.bleu1(F.lit("turn on wifi"), F.lit("completely different"))) == 0.0
    assert f(X.wer(F.lit(""), F.lit("x"))) == 1.0 and f(X.wer(F.lit(""), F.lit(""))) == 0.0 and f(X.token_f1(F.lit(""), F.lit(""))) == 1.0
    assert f(X.wer(F.lit("நான் போ"), F.lit("நான் வா"))) == 0.5
    p = spark.createDataFrame([(True, True), (False, False), (True, False)], "truth boolean, prediction boolean")
    assert M.binary_prf(p).first().accuracy == 0.6667


def test_lexicons(spark, tmp_path):
    (tmp_path / "a.csv").write_text('informal,normalized,category,dialect\n Pannu ,do,verb,Standard\n#x,y,z,w\n,blank,v,w\nda,"",filler,Chennai\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("informal,normalized,category,pos\npannu,make,verb,V\npannu,perform,verb,V\n", encoding="utf-8")
    (tmp_path / "e.csv").write_text("expression,normalized,category,dialect\ncall pannu,call,cmd,Standard\ncall pannu da,call now,cmd,Standard\npannu,do,cmd,Standard\n", encoding="utf-8")
    lex = LX.load_lexicon(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")])
    assert {r.informal: (r.normalized, r.category, r.dialect) for r in lex.collect()}["pannu"] == ("perform", "VERB", "Standard")
    assert LX.lexicon_filter(lex, dialect="chennai").count() == 1
    tokens = spark.createDataFrame([("Pannu!",), ("zzz",)], "token string")
    assert [(r.normalized, r.category, r.matched) for r in J.lookup_tokens(tokens, lex).orderBy("token").collect()] == [("perform", "VERB", True), ("zzz", "UNKNOWN", False)]
    exp = LX.load_expressions(spark, str(tmp_path / "e.csv"))
    utt = spark.createDataFrame([(1, "Call pannu da, pannu")], "utt_id long, text string")
    found = J.match_expressions(utt, exp)
    assert found.count() == 4
    assert sorted((r.expression, r.start, r.end) for r in J.longest_match(found).collect()) == [("call pannu da", 0, 3), ("pannu", 3, 4)]


def test_dialect_joins(spark):
    dim = J.district_dimension(spark)
    df = spark.createDataFrame([("Chennai",), (" madurai ",), ("SALEM",), ("x",), (None,)], "district string")
    assert {r.district: r.dialect for r in J.map_district(df, dim).collect()} == {"Chennai": "Chennai", " madurai ": "Madurai", "SALEM": "Kongu", "x": "Standard", None: "Standard"}
    utt = spark.createDataFrame([(1, 1, "Kongu", "Chennai"), (2, 1, "auto", "Chennai"), (3, 1, None, "Standard"), (4, 2, None, None)], "utt_id int, user_id int, explicit_dialect string, detected_dialect string")
    prof = spark.createDataFrame([(1, "Nellai")], "user_id int, preferred_dialect string")
    got = {r.utt_id: (r.effective_dialect, r.dialect_source) for r in J.resolve_dialect(utt, prof).collect()}
    assert got == {1: ("Kongu", "explicit_instruction"), 2: ("Chennai", "detected_speech"), 3: ("Nellai", "personalized_preference"), 4: ("Standard", "default_standard")}


def test_personal(spark):
    utt = spark.createDataFrame([(1, 7, "Please call the boss now"), (2, 8, "call the boss")], "utt_id long, user_id int, text string")
    terms = spark.createDataFrame([(7, "the boss", "Mr A"), (7, "boss", "B"), (7, "call", "ring")], "user_id int, term string, normalized string")
    assert {r.utt_id: r.personal_text for r in J.apply_user_terms(utt, terms).collect()} == {1: "Please ring Mr A now", 2: "call the boss"}
    assert {(r.term, r.usage_count) for r in J.usage_counts(utt, terms).collect()} == {("the boss", 1), ("call", 1)}
    base = spark.createDataFrame([(1, "a", "x", "c"), (1, "b", "y", "c")], "user_id int, term string, normalized string, category string")
    changes = spark.createDataFrame([(1, " A ", "z", "d", "put", 1), (1, "b", None, None, "remove", 2), (1, "c", "my password", "d", "put", 3)], "user_id int, term string, normalized string, category string, op string, seq int")
    assert [tuple(r) for r in P.upsert_terms(base, changes).collect()] == [(1, "a", "z", "D")]
    prof = spark.createDataFrame([(1, "Tamil", "Kongu", "formal")], "user_id int, preferred_language string, preferred_dialect string, response_style string")
    eff = {r.user_id: r.preferred_dialect for r in P.profiles_effective(spark.createDataFrame([(1,), (2,)], "user_id int"), prof).collect()}
    assert eff == {1: "Kongu", 2: "Standard"}
    up = P.update_profiles(prof, spark.createDataFrame([(1, "casual")], "user_id int, response_style string")).first()
    assert (up.response_style, up.preferred_dialect) == ("casual", "Kongu")
    new, left = P.reset_users(prof, terms.withColumn("user_id", F.lit(1)), prof.select("user_id"))
    assert new.first().preferred_language == "Tanglish" and left.count() == 0


def test_personal_terms_change_nothing_else(spark):
    rows = [(1, 7, "Hello, World! Kudu  now."), (2, 7, "kudu"), (3, 7, ""), (4, 7, None), (5, None, "kudu"), (6, 9, "Kudu?"), (7, 7, "a  b, A B; ab a-b")]
    utt = spark.createDataFrame([(str(i), u, t, "x") for i, u, t in rows], "utt_id string, user_id int, text string, share string")
    terms = spark.createDataFrame([(7, " kudu ", "give"), (7, "give  now", "hand it"), (7, "a b", "c"), (7, "ab", "b"), (7, "b", None), (7, None, "x"), (None, "kudu", "y")], "user_id int, term string, normalized string")
    want = {"1": "Hello, World! give  now.", "2": "give", "3": "", "4": None, "5": "kudu", "6": "Kudu?", "7": "c, c;  a-"}
    for share in (100, 1):
        got = {r.utt_id: (r.personal_text, r.used) for r in J.apply_user_terms(utt, terms, share_rows=share).collect()}
        assert {i: t for i, (t, _) in got.items()} == want
        assert got["1"][1] == ["kudu"] and got["7"][1] == ["a b", "ab", "b"] and got["6"][1] == []


def test_free_places_against_all_pairs():
    rnd = random.Random(5)
    for _ in range(300):
        spans = [(s, s + rnd.randint(1, 6)) for s in (rnd.randint(0, 40) for _ in range(rnd.randint(0, 30)))]
        kept = []
        for i, (s, e) in enumerate(spans):
            if not any(s < spans[k][1] and spans[k][0] < e for k in kept):
                kept.append(i)
        assert J.free_places([s for s, _ in spans], [e for _, e in spans]) == kept


def test_task_success(spark):
    rows = spark.createDataFrame([("set_alarm", "set_reminder", {"date": "today"}, "Set for TODAY"), ("call", "OPEN_APP", {}, "ok"), ("call", "call", {}, "okay dei"), ("call", "call", {"a": "x"}, "none")], "pred_intent string, ref_intent string, entities map<string,string>, response string")
    assert [(r.intent_ok, r.entity_ok, r.slang_found) for r in M.task_checks(rows).collect()] == [(True, True, True), (False, True, False), (True, True, True), (True, False, False)]


def test_waveforms(spark):
    tone = lambda n, a=0.5: [a * math.sin(i / 5) for i in range(n)]
    rows = [("ok", 400, 1, tone(800)), ("short", 400, 1, tone(20)), ("silent", 400, 1, [0.0] * 800), ("nan", 400, 1, [float("nan")] * 800), ("loud", 400, 1, tone(800, 2.0)), ("many", 400, 9, tone(800)), ("none", 400, 1, None), ("brief", 400, 1, tone(100))]
    df = spark.createDataFrame(rows, "clip_id string, sample_rate int, channels int, samples array<double>")
    got = {r.clip_id: r for r in V.validate_clips(V.clip_stats(df)).collect()}
    assert {k: v.status for k, v in got.items()} == {"ok": "PASS", "short": "REJECT", "silent": "REJECT", "nan": "REJECT", "loud": "WARN", "many": "REJECT", "none": "REJECT", "brief": "WARN"}
    assert got["silent"].messages == ["silent", "no variation"]
    noisy = [0.001 * (-1) ** i for i in range(400)] + tone(400)
    snr = V.estimate_snr(spark.createDataFrame([("a", 400, noisy), ("b", 400, [0.0] * 800), ("c", 400, [0.1] * 3)], "clip_id string, sample_rate int, samples array<double>"))
    vals = {r.clip_id: r.snr_db for r in snr.collect()}
    assert vals["a"] > 30 and vals["b"] is None and vals["c"] is None
    gain = {r.clip_id: r for r in V.normalize_gain(V.clip_stats(df.filter("clip_id in ('ok', 'silent')"))).collect()}
    assert abs(max(map(abs, gain["ok"].normalized)) - 10 ** (-3 / 20)) < 1e-6 and gain["silent"].norm_status == "SILENT"
    rms = V.normalize_gain(V.clip_stats(spark.createDataFrame([("p", 400, 1, [0.001] * 799 + [0.9])], df.schema)), "rms").first()
    assert rms.norm_status == "CLAMPED" and max(rms.normalized) <= 10 ** (-0.1 / 20) + 1e-9
    assert V.qc_report(df, df.filter("clip_id = 'ok'")).count() == 7
    two = spark.createDataFrame([("a", 400, 2, [[1.0, 0.0, 0.5], [0.0, 0.0, -0.5]]), ("b", 400, 2, [[1.0], [0.0, 3.0]]), ("c", 400, 2, []), ("d", 400, 2, None)], "clip_id string, sample_rate int, channels int, samples array<array<double>>")
    assert {r.clip_id: r.samples for r in V.mono(two).collect()} == {"a": [0.5, 0.0, 0.0], "b": [0.5, 3.0], "c": [], "d": None}
    assert {r.clip_id: r.peak for r in V.clip_stats(two).collect()} == {"a": 0.5, "b": 3.0, "c": None, "d": None}


def test_sources(spark, tmp_path):
    src = str(tmp_path / "shards")
    for i in range(3):
        spark.range(i * 10, i * 10 + 10).selectExpr("id", "'a' AS text", "cast('x' AS binary) AS audio").coalesce(1).write.mode("append").parquet(src)
    assert S.read_shards(spark, src, ["id"]).columns == ["id"]
    assert S.limit_shards(spark, src, 2).count() == 20
    assert S.sample_head(spark.read.parquet(src), 5).columns == ["id", "text"]
    lines = S.with_lineage(spark.read.parquet(src))
    assert lines.select("audio_hf_path", "row_within_shard").distinct().count() == 30
    assert {r.name: r.required for r in S.inspect_schema(spark, src, ["id"]).collect()} == {"id": True, "text": False, "audio": False}
    S.write_manifest(spark.range(3).toDF("id"), str(tmp_path / "m"))
    assert S.read_manifest(spark, str(tmp_path / "m"), "id long").count() == 3
    with pytest.raises(Exception, match="exist"):
        S.write_manifest(spark.range(3).toDF("id"), str(tmp_path / "m"))
    S.write_manifest(spark.range(1).toDF("id"), str(tmp_path / "m"), force=True)
    odd = spark.createDataFrame([(1, 'a "b", c\nd'), (2, " x "), (3, ""), (4, None)], "id long, t string")
    for build in (lambda: odd, lambda: odd.limit(0)):  # the second time nothing is built
        kept = S.reuse_manifest(spark, str(tmp_path / "kept"), "id long, t string", build)
        assert sorted(map(tuple, kept.collect())) == [(1, 'a "b", c\nd'), (2, " x "), (3, None), (4, None)]
    assert S.reuse_manifest(spark, str(tmp_path / "kept"), "id long, t string", lambda: odd.limit(1), force=True).count() == 1
    media = tmp_path / "media" / "deep"
    media.mkdir(parents=True)
    for n in ("a.wav", "b.flac", "c.txt"):
        (media / n).write_bytes(b"x")
    found = S.list_media(spark, str(tmp_path / "media"))
    assert found.count() == 2
    have = spark.createDataFrame([(r.path,) for r in found.collect()] + [("gone.wav",)], "file string")
    assert S.missing_media(have, found).count() == 1 and S.present_media(have, found).count() == 2
    log = spark.createDataFrame([("f", float("nan"), 1.5, None)], "file string, a double, b double, c string")
    assert tuple(S.log_rows(log, ["c", "file", "b", "a"]).first()) == ("", "f", "1.5000", "")
    S.append_log(log, str(tmp_path / "log"), ["file", "a"])
    S.append_log(log, str(tmp_path / "log"), ["file", "a"])
    assert spark.read.option("header", True).csv(str(tmp_path / "log")).count() == 2
    S.write_metrics(spark.range(1).toDF("x"), str(tmp_path / "metrics"))
    assert spark.read.json(str(tmp_path / "metrics/json")).count() == 1


def test_streams(spark, tmp_path):
    src, dst, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))
    rows = [(i, t) for i, t in enumerate(["Amma ku call pannu", "romba nalla irukku da", "Set an alarm for 5:30 am"])]
    df = spark.createDataFrame(rows, "utt_id long, text string")
    df.filter("utt_id < 2").write.parquet(src)
    jobs.ingest_incremental(spark, src, dst, ck, "utt_id long, text string")
    assert spark.read.parquet(dst).count() == 2
    df.filter("utt_id = 2").write.mode("append").parquet(src)
    jobs.ingest_incremental(spark, src, dst, ck, "utt_id long, text string")
    assert sorted(r.utt_id for r in spark.read.parquet(dst).collect()) == [0, 1, 2]
    (tmp_path / "ck" / "metadata").write_text("{broken", encoding="utf-8")  # starts afresh, nothing is doubled
    jobs.ingest_incremental(spark, src, dst, ck, "utt_id long, text string")
    assert sorted(r.utt_id for r in spark.read.parquet(dst).collect()) == [0, 1, 2]
    jobs.ingest_incremental(spark, src, dst, ck, "utt_id long, text string", force=True)
    assert sorted(r.utt_id for r in spark.read.parquet(dst).collect()) == [0, 1, 2]
    stream = lambda: spark.readStream.schema("utt_id long, text string").parquet(src)
    jobs.analyze_stream(stream(), str(tmp_path / "an"), str(tmp_path / "anck"))
    key = lambda r: (r.utt_id, r.language, r.final_text, r.intent, r.entities)
    by_id = lambda rs: sorted(map(key, rs), key=lambda r: r[0])
    assert by_id(spark.read.parquet(str(tmp_path / "an")).collect()) == by_id(A.analyze(df).collect())
    calls = str(tmp_path / "scores")
    score = lambda b: ML.score_batches(b, lambda ts: [t.upper() for t in ts], "utt_id", "text")
    jobs.score_resumable(stream(), score, calls, str(tmp_path / "s1"), "utt_id")
    jobs.score_resumable(stream(), score, calls, str(tmp_path / "s2"), "utt_id")  # a fresh run finds all results
    assert spark.read.parquet(calls).count() == 3


def test_scorer_and_models(spark):
    df = spark.createDataFrame([(i, "bad" if i == 3 else "ok") for i in range(8)], "id long, text string").coalesce(1)

    def score(batch):
        if "bad" in batch:
            raise ValueError("broken clip")
        return [t.upper() for t in batch]

    got = ML.score_batches(df, score, "id", "text", batch=2).collect()
    assert {r.id for r in got if r.error} == {2, 3} and {r.prediction for r in got if not r.error} == {"OK"}
    emb = spark.createDataFrame([(i, [float(i % 3 == k) + 0.01 * (i % 7) for k in range(3)], i % 3) for i in range(120)], "vec_id long, embedding array<double>, label int")
    model = ML.train_label_model(emb, hidden=(8,), iterations=(40,))
    pred = ML.predict_labels(model, emb.unionByName(spark.createDataFrame([(999, None, 1)], emb.schema)))
    assert pred.filter("prediction = label").count() >= 110 and pred.filter("vec_id = 999 and prediction is null").count() == 1
    assert len(pred.first().top) == 2
    report = ML.evaluate_labels(pred).collect()
    cells = {(r["class"], r.prediction): r.value for r in report if r.part == "confusion"}
    total = {r.part: r.value for r in report if r["class"] is None}
    assert total["n"] == sum(cells.values()) == 120 and total["accuracy"] == round(sum(v for (t, p), v in cells.items() if t == p) / 120, 4)
    assert {r.part for r in report} == {"accuracy", "macro_f1", "n", "precision", "recall", "f1", "support", "confusion"}


def test_entry_imports_without_training_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(repo, "sparkmix"), copy / "sparkmix", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(repo, "__spark_entry__.py"), copy)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'profile_by_source' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": ""})
