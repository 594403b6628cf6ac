"""Corpus preparation: projections, filters, duplicates, samples, splits, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lexicon as L
from ..functions import text as X
from ..session import written
from .ranks import values_at

#: Turns of speakers that are put in order at once.
TURNS = 1000
#: Largest number of rows of a group that Spark cuts in each task (spark.sql.optimizer.windowGroupLimitThreshold), and the parts that are cut by themselves beyond it.
CUT_BY_SPARK, PARTS = 1000, 64
#: Rows that are sorted in one task.
SORTED_ROWS = 100_000
#: Strata whose sizes an expression holds.
FEW_STRATA = 100


def decode_labels(df: DataFrame, maps: dict[str, dict[int, str]] = L.LABEL_MAPS) -> DataFrame:
    """Class codes to names; a code without a name stays as text. Columns that are absent are skipped."""
    named = {c: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for c, m in maps.items() if c in df.columns}
    return df.withColumns({c: F.coalesce(F.try_element_at(m, F.col(c).cast("int")), F.col(c).cast("string")) for c, m in named.items()})


def select_required(df: DataFrame, required: list[str], internal: list[str] = ()) -> tuple[DataFrame, list[str]]:
    """The required and internal columns that exist, in sorted order, and the names of those that do not."""
    wanted = sorted({*required, *internal})
    return df.select(*[c for c in wanted if c in df.columns]), [c for c in wanted if c not in df.columns]


def coerce_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in cols})


def in_range(col: str, lo: float, hi: float) -> Column:
    return F.col(col).between(lo, hi)


def at_least(col: str, lo: float) -> Column:
    return F.col(col) >= lo


def nonblank(*cols: str) -> Column:
    return reduce(lambda a, b: a & b, [F.length(F.trim(F.col(c))) > 0 for c in cols])


def filter_range(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    return df.filter(in_range(col, lo, hi))


def filter_floor(df: DataFrame, col: str, lo: float) -> DataFrame:
    return df.filter(at_least(col, lo))


def filter_nonblank(df: DataFrame, *cols: str) -> DataFrame:
    return df.filter(nonblank(*cols))


def filter_funnel(df: DataFrame, steps: list[tuple[str, Column]]) -> DataFrame:
    """(step, name, rows, retained_pct) after each step, from one pass over the table."""
    kept, aggs = F.lit(True), [F.count("*").alias("s0")]
    for i, (_, cond) in enumerate(steps, 1):
        kept = kept & cond
        aggs.append(F.count_if(kept).alias(f"s{i}"))
    names = ["input", *(n for n, _ in steps)]
    rows = F.array(*[F.struct(F.lit(i).alias("step"), F.lit(n).alias("name"), F.col(f"s{i}").alias("rows"), F.round(100 * F.col(f"s{i}") / F.greatest("s0", F.lit(1)), 2).alias("retained_pct")) for i, n in enumerate(names)])
    return df.agg(*aggs).select(F.inline(rows))


def search_items(df: DataFrame, query: str, cols: list[str], **facets: str) -> DataFrame:
    """Rows equal in the facets whose joined columns contain the query, without regard to case."""
    cond = F.lower(F.concat_ws(" ", *cols)).contains(query.lower().strip())
    return df.filter(reduce(lambda a, kv: a & (F.col(kv[0]) == kv[1]), facets.items(), cond))


def split_sensitive(df: DataFrame, *cols: str) -> DataFrame:
    """Adds ``rejected_by``: the sensitive rule that a value breaks, or null."""
    return df.withColumn("rejected_by", X.sensitive_rule(*[F.col(c).cast("string") for c in cols]))


def reject_sensitive(df: DataFrame, *cols: str) -> DataFrame:
    return split_sensitive(df, *cols).filter("rejected_by is null").drop("rejected_by")


def dedup_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A minimum is combined before the shuffle, so a hot key does not meet in one task."""
    names = df.columns
    packed = F.struct(*order, *[c for c in names if c not in order])
    return df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(packed).alias("r")).select(*[F.col(f"r.{c}") for c in names])


def hash_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in cols]))


def place_in_order(df: DataFrame, group: list[Column], bucket: Column, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """Adds ``name``: the row's place, from 1, by (bucket, order) in its group, and ``total``, the group's size.

    The keyed rows are written once; their buckets are counted, and each is sorted by itself, so neither a group nor the table meets
    in one task. Rows with a null in ``group`` are left out. Columns of the caller with the new names are replaced.
    """
    keys, marks = [f"g{i}" for i in range(len(group))], [f"o{i}" for i in range(len(order))]
    columns = [*zip(group, keys, strict=True), (bucket, "bucket"), *zip(order, marks, strict=True)]
    keyed = written(df.select(F.struct(*df.columns).alias("row"), *[c.alias(n) for c, n in columns]))
    counts = keyed.groupBy(*keys, "bucket").agg(F.count("*").alias("k"))
    whole = W.partitionBy(*keys)
    offsets = counts.select(*keys, "bucket", (F.sum("k").over(whole.orderBy("bucket")) - F.col("k")).alias("before"), F.sum("k").over(whole).alias("total"))
    place = F.col("before") + F.row_number().over(W.partitionBy(*keys, "bucket").orderBy(*marks))
    out = keyed.join(offsets, [*keys, "bucket"]).withColumn("place", place)
    return out.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in (name, total)], F.col("place").alias(name), *([F.col("total").alias(total)] if total else []))


def _first_rows(rows: DataFrame, group: list[str], order: list[str], most: int, name: str, part: str) -> DataFrame:
    """The first ``most`` rows of each group with their place. Of a number of up to a thousand Spark cuts each task's rows before
    the shuffle; for a larger one each of many parts of a group, by ``part``, is cut before the rest meet."""
    at = lambda *keys: F.row_number().over(W.partitionBy(*group, *keys).orderBy(*order))
    if most > CUT_BY_SPARK:
        rows = rows.withColumn("part", F.pmod(F.xxhash64(part), F.lit(PARTS))).withColumn(name, at("part")).filter(F.col(name) <= most).drop("part", name)
    return rows.withColumn(name, at()).filter(F.col(name) <= most)


def hash_cuts(df: DataFrame, mark: Column, tie: Column, shares: list[float]) -> list[tuple[str, object] | None]:
    """For each share of the rows, rounded half to even and summed up, the last (mark, tie) of that many rows in their order; none for no rows.

    Marks are hashes in hex. Rows are counted by their leading digits, and only the group that holds the place is looked at further.
    """
    counts = sorted((r.head, r.k) for r in df.groupBy(F.substring(mark, 1, 3).alias("head")).agg(F.count("*").alias("k")).collect())
    n = sum(k for _, k in counts)
    cuts, upto = [], 0
    for share in shares:
        upto += int(round(n * share))
        heads, before, digits = counts, 0, 3
        at = None
        while upto:
            for head, k in heads:
                if before + k >= min(upto, n):
                    break
                before += k
            inside = df.filter(mark.startswith(head))
            if k <= SORTED_ROWS or digits >= 32:
                last = inside.select(mark.alias("mark"), tie.alias("tie")).orderBy("mark", "tie").limit(min(upto, n) - before).agg(F.max(F.struct("mark", "tie")).alias("last")).first().last
                at = (last.mark, last.tie)
                break
            digits += 3
            heads = sorted((r.head, r.k) for r in inside.groupBy(F.substring(mark, 1, digits).alias("head")).agg(F.count("*").alias("k")).collect())
        cuts.append(at)
    return cuts


def hex_bucket(mark: str) -> Column:
    """One of 4096 buckets, in the order of a hash in hex."""
    return F.conv(F.substring(mark, 1, 3), 16, 10).cast("int")


def allocate_quota(cells: DataFrame, n: int, key: str = "cell", size: str = "size") -> DataFrame:
    """Adds ``quota``: largest remainders of size / total * n, at most the cell's size, the deficit going to cells with room.

    ``cells`` is one row per cell, so its windows are small.
    """
    whole = W.partitionBy()
    share = F.col(size) * F.least(F.lit(n), F.col("total")) / F.col("total")
    out = cells.withColumn("total", F.sum(size).over(whole)).withColumns({"low": F.floor(share), "frac": share - F.floor(share)})
    left = F.least(F.lit(n), F.col("total")) - F.sum("low").over(whole)
    rank = F.row_number().over(W.orderBy(F.round("frac", 9).desc(), F.col(size).desc(), key))
    out = out.withColumn("left", left).withColumn("quota", F.least(F.col(size), F.col("low") + (rank <= F.col("left")).cast("int")))
    spare = F.col(size) - F.col("quota")
    by_room = W.orderBy(F.col("spare").desc(), key)
    out = out.withColumns({"spare": spare, "deficit": F.least(F.lit(n), F.col("total")) - F.sum("quota").over(whole)})
    before = F.sum("spare").over(by_room.rowsBetween(W.unboundedPreceding, -1))
    more = F.greatest(F.lit(0), F.least(F.col("spare"), F.col("deficit") - F.coalesce(before, F.lit(0))))
    return out.withColumn("quota", (F.col("quota") + more).cast("long")).select(*cells.columns, "quota")


def _round_robin(keyed: DataFrame, quotas: DataFrame, most: int) -> DataFrame:
    """Rows (row, cell, who, mark) that are picked: their turn with the speaker, then their place in the cell, are within the quota."""
    own = _first_rows(keyed, ["cell", "who"], ["mark"], most, "turn", "mark")
    placed = _first_rows(own, ["cell"], ["turn", "who"], most, "place", "who")
    return placed.join(quotas, "cell").filter("place <= quota")


def round_robin_pick(df: DataFrame, quotas: DataFrame, cell: str, speaker: str, id_col: str, seed: int = 42, most: int | None = None) -> DataFrame:
    """In each cell one row per speaker and round, speakers in order, up to the cell's quota.

    ``most`` is the largest quota, looked up where it is not given. Neither a hot speaker nor a cell of very many speakers meets in one
    task: rows beyond ``most`` are cut before they do.
    """
    most = quotas.agg(F.max("quota")).first()[0] or 0 if most is None else most
    keyed = df.select(F.struct(*df.columns).alias("row"), F.col(cell).alias("cell"), F.col(speaker).alias("who"), hash_order(seed, id_col).alias("mark"))
    return _round_robin(keyed, quotas.select(F.col(cell).alias("cell"), "quota"), most).select(*[F.col("row")[c].alias(c) for c in df.columns])


def stratified_sample(df: DataFrame, strata: list[str], n: int, speaker: str, id_col: str, seed: int = 42) -> DataFrame:
    """Quota sample over strata with ``stratum_key`` and a shuffled ``selection_rank``; all other columns as they were. Two scans: sizes, and the pick."""
    cell = X.stratum_key(*strata)
    cells = df.select(cell.alias("cell")).groupBy("cell").agg(F.count("*").alias("size"))
    keyed = df.select(F.struct(*df.columns).alias("row"), cell.alias("cell"), F.col(speaker).alias("who"), hash_order(seed, id_col).alias("mark"), F.col(id_col).alias("tie"))
    picked = _round_robin(keyed, allocate_quota(cells, n).select("cell", "quota"), n).select("row", "cell", "mark", "tie")
    if n > SORTED_ROWS:
        ranked = place_in_order(picked, [], hex_bucket("mark"), [F.col("mark"), F.col("tie")], "rank")
    else:
        ranked = picked.withColumn("rank", F.row_number().over(W.orderBy("mark", "tie")))  # at most n rows
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in ("stratum_key", "selection_rank")]
    return ranked.select(*kept, F.col("cell").alias("stratum_key"), F.col("rank").cast("int").alias("selection_rank"))


def speaker_profile(df: DataFrame, speaker: str, cols: list[str]) -> DataFrame:
    """Most frequent value of each column per speaker, the smallest on a tie."""
    return df.groupBy(speaker).agg(*[F.mode(c, True).alias(c) for c in cols])


def _interleaved(profile: DataFrame, speaker: str, strata: list[str], seed: int) -> DataFrame:
    """(row, stratum, position, total): of few strata the position follows from the turn and the sizes of all."""
    keyed = profile.select(F.struct(*profile.columns).alias("row"), X.stratum_key(*strata).alias("stratum"), hash_order(seed, speaker).alias("mark"))
    turns = place_in_order(keyed, [F.col("stratum")], hex_bucket("mark"), [F.col("mark")], "turn", "size").drop("mark")
    sizes = turns.groupBy("stratum").agg(F.max("size").alias("size")).limit(FEW_STRATA + 1).collect()
    if not sizes or len(sizes) > FEW_STRATA:
        return place_in_order(turns, [], F.floor(F.col("turn") / TURNS), [F.col("turn"), F.col("stratum")], "position", "total")
    all_sizes = F.array(*[F.struct(F.lit(r.stratum).alias("stratum"), F.lit(r["size"]).alias("size")) for r in sizes])
    upto = lambda s: F.least(s["size"], F.col("turn") - 1) + ((s["stratum"] <= F.col("stratum")) & (s["size"] >= F.col("turn"))).cast("long")
    position = F.aggregate(all_sizes, F.lit(0).cast("long"), lambda n, s: n + upto(s))
    return turns.select("row", "stratum", position.alias("position"), F.lit(sum(r["size"] for r in sizes)).alias("total"))


def interleave_speakers(profile: DataFrame, speaker: str, strata: list[str], seed: int = 42) -> DataFrame:
    """Adds ``stratum`` and ``position``: strata take turns, speakers shuffled inside a stratum. One row per speaker."""
    kept = [F.col("row")[c].alias(c) for c in profile.columns if c not in ("stratum", "position")]
    return _interleaved(profile, speaker, strata, seed).select(*kept, "stratum", F.col("position").cast("int").alias("position"))


def _cut(position: Column, total: Column, train: float, val: float) -> Column:
    n_train, n_val = F.bround(total * train), F.bround(total * val)
    return F.when(position <= n_train, "train").when(position <= n_train + n_val, "val").otherwise("test")


def split_speakers(df: DataFrame, speaker: str, strata: list[str], train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """(speaker, split): the interleaved list of speakers, cut into consecutive parts."""
    placed = _interleaved(speaker_profile(df, speaker, strata), speaker, strata, seed)
    return placed.select(F.col("row")[speaker].alias(speaker), _cut(F.col("position"), F.col("total"), train, val).alias("split"))


def random_split(df: DataFrame, id_col: str, train: float = 0.8, val: float = 0.1, seed: int = 42) -> DataFrame:
    """Adds ``split`` by the order of a hash of the id; sizes are those of rounding, and rows that share an id stay together.

    The rows are counted by their hash first, which gives the hashes at both cuts; then each row compares with these and none moves.
    """
    mark, own = hash_order(seed, id_col), F.col(id_col)
    place = F.struct(mark.alias("mark"), own.alias("tie"))
    kind = df.schema[id_col].dataType
    upto = [F.lit(False) if c is None else place <= F.struct(F.lit(c[0]).alias("mark"), F.lit(c[1]).cast(kind).alias("tie")) for c in hash_cuts(df, mark, own, [train, val])]
    return df.withColumn("split", F.when(upto[0], "train").when(upto[1], "val").otherwise("test"))


def assign_split(df: DataFrame, splits: DataFrame, speaker: str) -> DataFrame:
    """Rows with their speaker's split; a speaker without one goes to train."""
    return df.join(splits.select(speaker, "split"), speaker, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def verify_disjoint(df: DataFrame, speaker: str = "speaker_id") -> DataFrame:
    """Speakers in more than one split, with their splits."""
    return df.groupBy(speaker).agg(F.count_distinct("split").alias("n_splits"), F.array_join(F.sort_array(F.collect_set("split")), ",").alias("splits")).filter("n_splits > 1")


def shared_speakers(df: DataFrame, a: str, b: str, speaker: str = "speaker_id") -> DataFrame:
    one = lambda s: df.filter(F.col("split") == s).select(speaker)
    return one(a).intersect(one(b))


# Statistics ---------------------------------------------------------------


def value_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, count) of every column, nulls left out, in one pass."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select(F.inline(pairs)).filter("value is not null").groupBy("column", "value").agg(F.count("*").alias("count"))


def numeric_summary(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, mean, median, std, min, max) to three decimals; the median comes from ``values_at``. Null and NaN are left out."""
    value = {c: F.col(c).cast("double") for c in cols}
    value = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    stats = [f(v).alias(f"{name}_{c}") for c, v in value.items() for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    row, middle = values_at(df, cols, lambda n: [(n - 1) // 2, n // 2], *stats)
    rows = [(c, row[f"mean_{c}"], sum(middle[c]) / 2 if middle[c] else None, row[f"std_{c}"], row[f"min_{c}"], row[f"max_{c}"]) for c in cols]
    out = df.sparkSession.createDataFrame(rows, "column string, mean double, median double, std double, min double, max double")
    return out.select("column", *[F.round(c, 3).alias(c) for c in ("mean", "median", "std", "min", "max")])


def cardinalities(df: DataFrame, *cols: str, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(*[count(F.col(c)).alias(f"n_{c}") for c in cols])


def top_k_values(df: DataFrame, col: str, k: int = 20) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("count")).orderBy(F.col("count").desc(), col).limit(k)


def gini(counts: DataFrame, col: str = "count", compat_sign: bool = False) -> DataFrame:
    """Gini coefficient of a table of group sizes; ``compat_sign`` gives the negative of it. 0 if the sum is 0.

    Equal sizes are counted first, so the ranks come from a window over distinct sizes, not over groups.
    """
    sizes = counts.groupBy(F.col(col).alias("v")).agg(F.count("*").alias("k"))
    ranked = sizes.withColumn("before", F.sum("k").over(W.orderBy("v")) - F.col("k"))
    ranks = F.col("k") * F.col("before") + F.col("k") * (F.col("k") + 1) / 2  # sum of the ranks of equal sizes
    n, total = F.sum("k"), F.sum(F.col("v") * F.col("k"))
    value = 2 * F.sum(F.col("v") * ranks) / (n * total) - (n + 1) / n
    return ranked.agg(F.round(F.when(total > 0, -value if compat_sign else value).otherwise(0.0), 6).alias("gini"))


def split_report(df: DataFrame, cols: list[str], speaker: str = "speaker_id") -> DataFrame:
    """(split, column, value, rows, speakers): totals of each split, and the distribution of each column in it."""
    pairs = F.array(F.struct(F.lit("*").alias("column"), F.lit("*").alias("value")), *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])
    return df.select("split", F.col(speaker).alias("speaker"), F.inline(pairs)).groupBy("split", "column", "value").agg(F.count("*").alias("rows"), F.count_distinct("speaker").alias("speakers"))
