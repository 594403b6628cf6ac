"""Operator 12: conversation repair by depth-first branch and bound.

Rows are sorted over the whole table by conversation and turn and cut into segments of bounded size, so that a long
conversation spans many tasks. A segment's search walks its edits with an explicit stack: suffix lower bounds cut
what can't reach the incumbent, and a dominance table for each node (place, state) cuts worse ways to it. Where a
conversation has several segments, their cost matrices, 16 numbers each, give every segment the bounds of all that follows.

Edits keep (K) a row at no cost, give it the role that can follow (R, 1), delete it (D, 2), or insert an empty user or
assistant turn (I, 5). Blank rows and duplicates must be deleted; a truncated row that stays adds 5. What is left has to
read as an optional system turn and one or more pairs of user and assistant, or be empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import Scratch, ship_package

#: A segment ends after so many rows or characters.
SEGMENT_ROWS, SEGMENT_CHARS = 1024, 4 << 20

NONE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
COST = {"D": 2, "I": 5, "K": 0, "R": 1}
STAYS_TRUNCATED = 5
#: States: nothing yet, after system, after user, after assistant. The state that an inserted or a rerouted turn leads to.
NEXT = (2, 2, 3, 2)
ROLE = {2: "user", 3: "assistant"}
#: The state after a kept row with this role initial, or none. A role without characters adds nothing.
KEPT = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None), "": (0, 1, 2, 3)}
NO_WAY = (None,) * 4
#: Least cost from each state once no row is left; the first and the last may end there.
FAR = 1 << 40
END = (0, 2 * COST["I"], COST["I"], 0)
ENDS = (True, False, False, True)

Row = tuple[str, int]  # role initial, first fault


def suffix_bounds(rows: list[Row], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """For each place and state the least cost of the rows from there on, whatever their edits are called; ``after`` is that of what follows."""
    bounds = [after] * (len(rows) + 1)
    for i in range(len(rows) - 1, -1, -1):
        initial, fault = rows[i]
        behind, kept = bounds[i + 1], KEPT.get(initial, NO_WAY)
        extra = STAYS_TRUNCATED if fault == TRUNCATED else 0
        least = []
        for s in range(4):
            cost = COST["D"] + behind[s]
            if fault not in (BLANK, DUPLICATE):
                if kept[s] is not None:
                    cost = min(cost, extra + behind[kept[s]])
                cost = min(cost, COST["R"] + extra + behind[NEXT[s]])
            least.append(cost)
        user, assistant = min(least[2], COST["I"] + least[3]), min(least[3], COST["I"] + least[2])
        bounds[i] = (min(least[0], COST["I"] + user), min(least[1], COST["I"] + user), user, assistant)
    return bounds


def search(rows: list[Row], entry: int, after: tuple[int, ...] = END, last: bool = True) -> tuple[int, int, str]:
    """(cost, state behind the rows, audit): the cheapest edits of a segment with all that follows, and of equal cost the first in ASCII order.

    Branches are taken in ASCII order of their letters. So of two ways to a node the later one is worse unless it is cheaper: at
    equal cost neither audit can begin with the other, as further letters could only be insertions, which cost. The incumbent
    gives way to cheaper leaves only; the search ends when no branch is left that could be cheaper.
    """
    n = len(rows)
    bounds = suffix_bounds(rows, after)
    limit = bounds[0][entry] + 1  # a cost that must be undercut
    incumbent: tuple[int, int, str] | None = None
    reached: list[list[int]] = [[FAR] * 4 for _ in range(n + 1)]
    audit: list[str] = []
    stack: list[tuple[int, int, int, int, str]] = [(0, entry, 0, 0, "")]
    while stack:
        i, state, cost, depth, letter = stack.pop()
        if cost + bounds[i][state] >= limit or cost >= reached[i][state]:
            continue
        reached[i][state] = cost
        del audit[max(0, depth - 1) :]
        if letter:
            audit.append(letter)
        if i == n:
            if not last or ENDS[state]:
                limit = cost + bounds[i][state]
                incumbent = (cost, state, "".join(audit))
            else:
                stack.append((i, NEXT[state], cost + COST["I"], depth + 1, "I"))
            continue
        initial, fault = rows[i]
        extra = STAYS_TRUNCATED if fault == TRUNCATED else 0
        branches = [(i + 1, state, cost + COST["D"], "D"), (i, NEXT[state], cost + COST["I"], "I")]
        if fault not in (BLANK, DUPLICATE):
            kept = KEPT.get(initial, NO_WAY)[state]
            if kept is not None:
                branches.append((i + 1, kept, cost + extra, "K"))
            branches.append((i + 1, NEXT[state], cost + COST["R"] + extra, "R"))
        stack += [(j, s, c, depth + 1, x) for j, s, c, x in reversed(branches)]
    assert incumbent is not None
    return incumbent


def edited(audit: str, entry: int, rows: list) -> Iterator[tuple[str, str | None, object]]:
    """(letter, role or None for the row's own, row or None) of every edit of an audit."""
    state, left = entry, iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(left)
        if letter in "IR":
            state = NEXT[state]
            yield letter, ROLE[state], row
        else:
            if letter == "K":
                state = KEPT[row[1][:1]][state]
            yield letter, None, row


# The table of rows --------------------------------------------------------


def damage(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, turn_col, role_col, text_col, gone): rows damaged by crc32(``conversation:turn``) % 20, a null being one space.

    0 drops a row (it stays as ``gone``), 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(said(conv_col), F.lit(":"), said(turn_col)).cast("binary")) % 20
    text = F.when(code == 1, "").when(code == 2, F.regexp_replace(said(text_col), "[.!?]", "")).otherwise(said(text_col))
    copies = F.when(code == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(code == 0))
    return df.select(conv_col, turn_col, F.when(code == 4, "user").otherwise(said(role_col)).alias(role_col), text.alias(text_col), F.explode(copies).alias("gone"))


def _rows(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    out = df.select(
        F.col(conv).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.monotonically_increasing_id().alias("row"),
        (F.coalesce(F.col(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
        said(role).alias("role"),
        said(text).alias("text"),
    )
    parts = [F.coalesce(F.col("conv").cast("string"), F.lit("")), F.col("conv").isNull().cast("string"), F.col("role")]
    key = F.concat(*[x for p in parts for x in (F.octet_length(p).cast("string"), F.lit(":"), p)], F.col("text"))
    ends = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK).when(F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), NONE).otherwise(TRUNCATED)
    return out.withColumns({"ends": ends, "says": F.unhex(F.sha2(key.cast("binary"), 256))})


def _in_order() -> Column:
    return F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")


def _with_faults(rows: DataFrame) -> DataFrame:
    """``rows`` with ``fault``. A row is a duplicate if it isn't the first of its conversation with that role and text."""
    repeated = rows.filter("not gone").groupBy("says").agg(F.min(_in_order())["row"].alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    fault = F.when(F.col("ends") == BLANK, BLANK).when(F.col("first") != F.col("row"), DUPLICATE).otherwise(F.col("ends"))
    return rows.join(repeated, "says", "left").select("conv", "turn", "row", "gone", "role", "text", fault.cast("int").alias("fault"))


def _segments(rows: DataFrame, most_rows: int, most_chars: int) -> DataFrame:
    """Segments of the conversations, in the order of (turn, row); ``whole`` are those that hold all of their conversation.

    Tasks hold ranges of (conversation, turn, row). The first and the last conversation of a task may go on in its neighbours.
    """
    conv_type = rows.schema["conv"].dataType
    texts, longs = ArrayType(StringType()), ArrayType(LongType())
    schema = StructType(
        [
            StructField("conv", conv_type),
            StructField("known", BooleanType()),
            StructField("turn", LongType()),
            StructField("row", LongType()),
            StructField("whole", BooleanType()),
            StructField("turns", longs),
            StructField("roles", texts),
            StructField("texts", texts),
            StructField("faults", ArrayType(IntegerType())),
            StructField("matrix", longs),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow, out, kind = [pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int64())], [], None
        current: list = []  # conversation, first turn, first row, then turns, roles, texts, faults
        held, first, held_out, cut = 0, True, 0, False

        def close(whole: bool) -> None:
            conv, turn, row, turns, roles, texts, faults = current
            codes = [(r[:1], f) for r, f in zip(roles, faults, strict=True)]
            columns = [] if whole else [[suffix_bounds(codes, tuple(0 if s == e else FAR for s in range(4)))[0][s] for s in range(4)] for e in range(4)]
            out.append((conv, turn is not None, turn, row, whole, turns, roles, texts, faults, [columns[e][s] for s in range(4) for e in range(4)] if columns else []))

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *arrow], strict=True)], schema.names)
            out.clear()
            return done

        for batch in batches:
            kind = batch.column(0).type
            for at in range(0, batch.num_rows, 1024):
                for conv, turn, row, gone, role, text, fault in zip(*(c.to_pylist() for c in batch.slice(at, 1024).columns), strict=True):
                    full = current and (len(current[3]) >= most_rows or held >= most_chars)
                    if not current or conv != current[0] or full:
                        if current:
                            same = conv == current[0]
                            close(not first and not same and not cut)
                            held_out += held + 100 * len(current[3])
                            first, cut = first and same, same
                        current, held = [conv, turn, row, [], [], [], []], 0
                    if not gone:
                        for to, x in zip(current[3:], (turn, role, text, fault), strict=True):
                            to.append(x)
                        held += len(text)
                if held_out >= most_chars:
                    yield flush()
                    held_out = 0
        if current:
            close(False)
        if out:
            yield flush()

    order = [F.col("conv"), F.col("turn"), F.col("row")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "turn", "row", "gone", "role", "text", "fault").mapInArrow(run, schema)


def _with_bounds(segments: DataFrame) -> DataFrame:
    """Segments of long conversations with ``after``, the least costs from each state behind them, and ``last``. Goes backwards through the matrices alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, bounds, begun = None, END, False
        for batch in batches:
            after, last = [], []
            for own, matrix in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                last.append(not begun or own != conv)
                if last[-1]:
                    conv, bounds, begun = own, END, True
                after.append(bounds)
                bounds = tuple(min(matrix[4 * s + e] + bounds[e] for e in range(4)) for s in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(after, pa.list_(pa.int64())), pa.array(last, pa.bool_())], ["row", "after", "last"])

    backwards = [F.col("conv").asc(), F.col("known").desc(), F.col("turn").desc(), F.col("row").desc()]
    light = segments.select("conv", "row", "matrix", "known", "turn").repartition("conv").sortWithinPartitions(*backwards).select("conv", "row", "matrix")
    return segments.join(light.mapInArrow(run, "row long, after array<bigint>, last boolean"), "row")


class _Digest:
    """One row for each conversation: counts, cost, audit and a digest of the repaired rows."""

    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    fields = tuple(StructField(n, LongType()) for n in names[:6]) + (StructField("audit", StringType()), StructField("repaired_sha256", StringType()))
    types = (pa.int64(),) * 6 + (pa.string(),) * 2

    def __init__(self):
        self.faults, self.illegal, self.cost, self.audits, self.sha, self.empty = [0] * 4, 0, 0, [], hashlib.sha256(), True
        self.low = self.high = self.before = None
        self.distinct = 0

    def add(self, turns: list, roles: list, texts: list, faults: list, audit: str, cost: int, entry: int) -> list:
        for turn, role, fault in zip(turns, roles, faults, strict=True):
            self.faults[fault] += 1
            self.illegal += self.before is not None and self.before + role[:1] not in ("su", "ua", "au")
            self.before = role[:1]
            if turn is not None and turn != self.high:
                self.low = turn if self.low is None else self.low
                self.high = turn
                self.distinct += 1
        for letter, role, row in edited(audit, entry, list(zip(turns, roles, texts, strict=True))):
            if letter != "D":
                self.sha.update((("" if self.empty else "\n") + (role or row[1]) + ":" + (row[2] if row else "")).encode())
                self.empty = False
        self.cost += cost
        self.audits.append(audit)
        return []

    def end(self) -> list:
        gaps = self.high - self.low + 1 - self.distinct if self.distinct else 0
        return [(gaps, *self.faults[1:], self.illegal, self.cost, "".join(self.audits), self.sha.hexdigest())]


class _Rows:
    """The repaired rows, and those deleted, with their place in the conversation and their edit."""

    fields = (
        StructField("place", LongType()),
        StructField("turn", LongType()),
        StructField("role", StringType()),
        StructField("text", StringType()),
        StructField("edit", StringType()),
    )
    types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())

    def __init__(self):
        self.place = 0

    def add(self, turns: list, roles: list, texts: list, faults: list, audit: str, cost: int, entry: int) -> list:
        out = []
        for letter, role, row in edited(audit, entry, list(zip(turns, roles, texts, strict=True))):
            out.append((self.place, row[0] if row else None, role or row[1], row[2] if row else "", letter))
            self.place += 1
        return out

    def end(self) -> list:
        return []


def _finish(segments: DataFrame, conv_col: str, make: type[_Digest] | type[_Rows]) -> DataFrame:
    """Searches segments that come in order, each from the state in which the one before ended."""
    schema = StructType([StructField(conv_col, segments.schema["conv"].dataType), *make.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, sink, kind, out = 0, make(), pa.int64(), []

        def batch_of() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True))
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (kind, *make.types), strict=True)], schema.names)
            out.clear()
            return done

        for batch in batches:
            kind = batch.column(0).type
            for at in range(batch.num_rows):
                conv, turns, roles, texts, faults, after, last = (c[at].as_py() for c in batch.columns)
                codes = [(r[:1], f) for r, f in zip(roles, faults, strict=True)]
                entry = state
                cost, state, audit = search(codes, entry, tuple(after), last)
                out += [(conv, *x) for x in sink.add(turns, roles, texts, faults, audit, cost, entry)]
                if last:
                    out += [(conv, *x) for x in sink.end()]
                    state, sink = 0, make()
                if len(out) >= 4096:
                    yield batch_of()
        if out:
            yield batch_of()

    return segments.select("conv", "turns", "roles", "texts", "faults", "after", "last").mapInArrow(run, schema)


def _repair(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None, most: tuple[int, int], make: type) -> DataFrame:
    ship_package(df.sparkSession)
    scratch = Scratch(df.sparkSession)
    rows = scratch.save(_rows(df, conv, turn, role, text, gone), "rows")
    flagged = scratch.save(_with_faults(rows), "flagged")
    scratch.drop(rows)
    segments = scratch.save(_segments(flagged, *most), "segments")
    scratch.drop(flagged)
    whole = segments.filter("whole").withColumns({"after": F.array(*[F.lit(x).cast("long") for x in END]), "last": F.lit(True)})
    order = ["conv", "known", "turn", "row"]
    parts = _with_bounds(segments.filter("not whole")).repartition("conv").sortWithinPartitions(*order)
    return _finish(whole, conv, make).union(_finish(parts, conv, make))


def repair_report(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None, most: tuple[int, int] = (SEGMENT_ROWS, SEGMENT_CHARS)
) -> DataFrame:
    """(conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), one row for each conversation.

    Rows count in the order of their turn, nulls first, then as they are read; a null role or text is one space, and a null id is a
    conversation of its own. Rows with a true ``gone_col`` count as not there, but their conversation still gets a row. A conversation
    without rows has zeros, no audit and the digest of nothing; an empty table gives none. Repeated rows are duplicates of the first.
    Texts and conversations may be of any length; other columns are not read.
    """
    return _repair(df, conv_col, turn_col, role_col, text_col, gone_col, most, _Digest)


def repair_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", gone_col: str | None = None, most: tuple[int, int] = (SEGMENT_ROWS, SEGMENT_CHARS)
) -> DataFrame:
    """(conv_col, place, turn, role, text, edit): the rows of each repaired conversation in order, those deleted (D) among them. Cases as in ``repair_report``."""
    return _repair(df, conv_col, turn_col, role_col, text_col, gone_col, most, _Rows)
