"""Conversation repair against brute force."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from sparkmix.llm import conversations as V
from sparkmix.llm import queries as Q


def cheapest(rows):
    """All edits of all rows with up to two insertions before each and behind the last: the cheapest, then the first, whose roles are right. rows: (role, fault)."""
    best = None
    gaps = [x for n in range(3) for x in itertools.product("ua", repeat=n)]
    choices = []
    for role, fault in rows:
        more = 5 if fault == 3 else 0
        own = [(2, "D", "")] + ([] if fault in (1, 2) else [(more, "K", role[:1]), (1 + more, "R", "u"), (1 + more, "R", "a")])
        choices.append([(5 * len(g) + c, "I" * len(g) + x, "".join(g) + r) for g in gaps for c, x, r in own])
    choices.append([(5 * len(g), "I" * len(g), "".join(g)) for g in gaps])
    for way in itertools.product(*choices):
        if re.fullmatch(r"(s?(ua)+)?", "".join(w[2] for w in way)):
            found = (sum(w[0] for w in way), "".join(w[1] for w in way))
            best = min(best or found, found)
    return best


def by_table(rows):
    """The same by a table of the least (cost, audit) of each place and state, for longer ones."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def insert(table):
        for _ in range(3):
            for state, (cost, audit) in list(table.items()):
                for x in "ua":
                    to = step.get((state, x))
                    if to is not None:
                        table[to] = min(table.get(to, (10**9, "")), (cost + 5, audit + "I"))
        return table

    table = insert({"": (0, "")})
    for role, fault in rows:
        new = {}
        for state, (cost, audit) in table.items():
            ways = [(state, 2, "D")]
            if fault not in (1, 2):
                ways += [(state if role == "" else step.get((state, role[:1])), 0, "K")] + [(step.get((state, x)), 1, "R") for x in "ua"]
            for to, c, letter in ways:
                if to is not None:
                    found = (cost + c + (5 if fault == 3 and letter != "D" else 0), audit + letter)
                    new[to] = min(new.get(to, found), found)
        table = insert(new)
    return min(x for state, x in table.items() if state in ("", "a"))


def brute(rows, damaged=True):
    """rows: (conv, turn, role, text) in order; damage first."""
    convs, said = defaultdict(list), lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20 if damaged else 9
        role, text = said(role), said(text)
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        convs[conv] += [(turn, "user" if code == 4 else role, text)] * {0: 0, 3: 2}.get(code, 1)
    out = []
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        seen, faulty = set(), []
        for _, role, text in own:
            chars = re.findall(r"[^\x20\x09-\x0D]", text)
            faulty.append((role, 1 if not chars else 2 if (role, text) in seen else 3 if chars[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = {t for t, _, _ in own if t is not None}
        cost, audit = by_table(faulty)
        state, left, repaired = "", iter(own), []
        for x in audit:
            row = next(left) if x != "I" else None
            if x == "D":
                continue
            role = row[1] if x == "K" else {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            repaired.append(f"{role}:{row[2] if row else ''}")
            state = role[:1] or state
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        counts = [sum(f == k for _, f in faulty) for k in (1, 2, 3)]
        out.append((conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=str)


def test_search_against_all_edits():
    rnd = random.Random(1)
    for n in range(5):
        for _ in range(4 if n == 4 else 25):
            rows = [(rnd.choice(["user", "assistant", "system", "tool", ""]), rnd.choice([0, 0, 0, 1, 2, 3])) for _ in range(n)]
            cost, _, audit = V.search([(r[:1], f) for r, f in rows], 0)
            assert (cost, audit) == cheapest(rows) == by_table(rows)


def test_search_of_long_conversations():
    rnd = random.Random(2)
    for n in (30, 300):
        for _ in range(20):
            rows = [(rnd.choice(["user", "assistant", "user", "assistant", "system", "x"]), rnd.choice([0, 0, 0, 0, 1, 2, 3])) for _ in range(n)]
            cost, _, audit = V.search([(r[:1], f) for r, f in rows], 0)
            assert (cost, audit) == by_table(rows)


def table(seed, convs=120):
    rnd = random.Random(seed)
    rows = []
    for c in range(convs):
        turns = list(range(rnd.choice([0, -2, 100]), 1000))[: rnd.choice([1, 2, 3, 5, 9])]
        for t in turns:
            if rnd.random() < 0.9:
                text = rnd.choice(["Fine.", "Fine. ", "No", "é!", "", " \t\n", "\x0b", "What?\n", None, "a ", "x" * 3000 + ".", "Hm\x1c."])
                rows.append((c if c else None, t if rnd.random() < 0.95 else None, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), text))
    rows += [(5000, t, "user" if t % 2 == 0 else "assistant", f"turn {t % 50}.") for t in range(700)]
    return rows + [(6000, None, None, None), (6001, None, "user", "Twice."), (6001, None, "user", "Twice.")]


@pytest.mark.parametrize("most", [(V.SEGMENT_ROWS, V.SEGMENT_CHARS), (3, 1 << 20), (1, 1), (1000, 40)])
def test_damaged_table_against_brute_force(spark, most):
    rows = table(3)
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "conv_id long, turn long, role string, text string, audit string, row int").coalesce(1)
    got = V.repair_report(V.damage(df), gone_col="gone", most=most)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_undamaged_table_and_its_rows(spark):
    rows = [(str(c), t, r, x) for c, t, r, x in table(4) if c is not None]
    df = spark.createDataFrame(rows, "id string, n int, who string, what string").coalesce(1)
    names = ("id", "n", "who", "what")
    want = brute(rows, damaged=False)
    assert sorted((tuple(r) for r in V.repair_report(df, *names).collect()), key=str) == want
    found = defaultdict(list)
    for r in V.repair_conversations(df, *names, most=(4, 1000)).collect():
        found[r.id].append(r)
    for conv, *_, audit, sha in want:
        own = sorted(found[conv], key=lambda r: r.place)
        assert [r.place for r in own] == list(range(len(own))) and "".join(r.edit for r in own) == audit
        assert hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.edit != "D").encode()).hexdigest() == sha


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert V.repair_report(V.damage(empty), gone_col="gone").collect() == [] and V.repair_conversations(empty).collect() == []


def test_registered_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted((tuple(r) for r in Q.op12_conversation_repair(spark, sf).collect()), key=str) == brute(rows)
