"""Personal terms as streaming state."""

import random

from sparkmix.streaming import personal_state as P

FIELDS = "user_id long, seq long, op string, term string, normalized string, category string"


def expected(changes):
    """All changes of a user in order; a put starts to count anew."""
    terms = {}
    for user, seq, op, term, normalized, category in sorted((c for c in changes if c[0] is not None), key=lambda c: c[1]):
        if op == "reset":
            terms = {k: v for k, v in terms.items() if k[0] != user}
            continue
        key = (user, term.strip().lower())
        if op == "put" and "password" not in normalized:
            terms[key] = [normalized.strip(), category.upper(), 0]
        elif op == "remove":
            terms.pop(key, None)
        elif op == "use" and key in terms:
            terms[key][2] += 1
    return {k: tuple(v) for k, v in terms.items()}


def test_state_after_several_runs(spark, tmp_path):
    rnd = random.Random(1)
    changes = []
    for seq in range(400):
        op = rnd.choice(["put", "put", "use", "use", "remove", "reset" if rnd.random() < 0.2 else "use"])
        changes.append((rnd.choice([1, 2, 3, None]), seq, op, None if op == "reset" else rnd.choice([" A", "b", "Hello you "]), rnd.choice(["x ", "my password"]) if op == "put" else None, "c" if op == "put" else None))
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(FIELDS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for run in range(3):
        part = changes[run * 130 : (run + 1) * 130 + (10 if run == 2 else 0)]
        spark.createDataFrame(part, FIELDS).repartition(2).write.parquet(str(tmp_path / "in" / str(run)))
        P.follow_terms(source, str(tmp_path / "out"), str(tmp_path / "state"))
        got = {(r.user_id, r.term): (r.normalized, r.category, r.usage_count) for r in P.current_terms(spark, str(tmp_path / "state")).collect()}
        assert got == expected(changes[: (run + 1) * 130 + (10 if run == 2 else 0)])
    took = spark.read.parquet(str(tmp_path / "out"))
    P.follow_terms(source, str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == took.count()


def test_an_older_change_that_comes_late(spark, tmp_path):
    (tmp_path / "in").mkdir()
    source = spark.readStream.schema(FIELDS).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    for run, part in enumerate([[(1, 9, "remove", "a", None, None), (2, 5, "reset", None, None, None)], [(1, 5, "put", "a", "x", "c"), (2, 4, "put", "b", "x", "c"), (2, 6, "put", "c", "y", "c")]]):
        spark.createDataFrame(part, FIELDS).write.parquet(str(tmp_path / "in" / str(run)))
        P.follow_terms(source, str(tmp_path / "out"), str(tmp_path / "state"))
    assert [tuple(r) for r in P.current_terms(spark, str(tmp_path / "state")).collect()] == [(2, "c", "y", "C", 0)]
