"""Operator 10: near-duplicate embeddings by navigable small-world graphs per shard.

Vectors that are equal are folded first. Those of one label are divided into shards of
bounded size; a task builds one shard's layered graph and audits its recall against
brute force, with vectors of its own and of other shards, doubling the beam until the
audit passes. Blocks of vectors then query
every shard of their label. A query whose beam holds nothing but links is run again
with a wider beam. Links are verified by cosine in double precision; components are
the union of the links.
"""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, connected_components, ship_package

#: Vectors in a shard and in a block of queries, at most on average; bounds of a task's memory.
SHARD_ROWS, BLOCK_ROWS = 20_000, 20_000
#: Neighbours of a vector above the ground layer; the ground layer has twice as many.
DEGREE = 12
#: Beam while building, first beam of a search, vectors and recall of an audit.
BUILD_BEAM, FIRST_BEAM, AUDIT_ROWS, AUDIT_RECALL = 64, 64, 512, 0.9999
#: A query with more links than fit such a beam is compared with its whole shard.
WIDEST_BEAM = 256
#: The beam of a graph that fails its audit at every width; its queries are compared with the whole shard.
WHOLE_SHARD = 1 << 30
#: A single-precision cosine this far under the threshold is still verified in double precision.
MARGIN = 1e-4


def _search(vectors: np.ndarray, nearby: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Best ``beam`` ids and similarities for each query, walking one layer; -1 where fewer are reached. ``entry`` has a column for each start."""
    q, n = len(queries), len(vectors)
    rows = np.arange(q)
    seen = np.zeros((q, n), bool)
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    done = np.ones((q, beam), bool)
    k = min(beam, entry.shape[1])
    ids[:, :k] = entry[:, :k]
    sims[:, :k] = np.einsum("qd,qkd->qk", queries, vectors[entry[:, :k]])
    done[:, :k] = False
    seen[rows[:, None], entry[:, :k]] = True
    while True:
        open_sims = np.where(done, -np.inf, sims)
        best = open_sims.argmax(1)
        live = np.flatnonzero(np.isfinite(open_sims[rows, best]))
        if not len(live):
            return ids, sims
        done[live, best[live]] = True
        near = nearby[ids[live, best[live]]]
        fresh = (near >= 0) & ~seen[live[:, None], near]
        seen[np.repeat(live, fresh.sum(1)), near[fresh]] = True
        got = np.einsum("qd,qkd->qk", queries[live], vectors[near])
        got[~fresh] = -np.inf
        all_sims = np.concatenate((sims[live], got), 1)
        top = np.argpartition(-all_sims, beam - 1, 1)[:, :beam]
        pick = np.arange(len(live))[:, None]
        sims[live] = all_sims[pick, top]
        ids[live] = np.concatenate((ids[live], np.where(fresh, near, -1)), 1)[pick, top]
        done[live] = np.concatenate((done[live], ~fresh), 1)[pick, top]


def _spread(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` of each row's ids, taking one only if it is nearer to the row than to those taken; the nearest others fill up."""
    order = np.argsort(-sims, 1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    q, c = ids.shape
    valid = np.isfinite(sims) & (ids >= 0)
    near = vectors[ids]
    mutual = np.einsum("qad,qbd->qab", near, near)
    taken = np.zeros((q, c), bool)
    for j in range(c):
        closest = np.where(taken, mutual[:, j], -np.inf).max(1)
        taken[:, j] = valid[:, j] & (sims[:, j] > closest) & (taken.sum(1) < most)
    rank = np.where(taken, 0, np.where(valid, 1, 2))
    keep = np.argsort(rank, 1, kind="stable")[:, :most]
    out = np.take_along_axis(ids, keep, 1)
    out[np.take_along_axis(rank, keep, 1) == 2] = -1
    if out.shape[1] < most:
        out = np.concatenate((out, np.full((q, most - out.shape[1]), -1)), 1)
    return out


class SmallWorld:
    """A layered graph over the rows of ``vectors``, which must have unit length."""

    def __init__(self, vectors: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]], beam: int = FIRST_BEAM):
        self.vectors = vectors
        self.layers = layers  # from the top: the layer's rows, and their neighbours as places among them
        self.beam = beam

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 3) -> SmallWorld:
        n = len(vectors)
        height = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(DEGREE)).astype(int)
        order = np.argsort(-height, kind="stable")
        layers: list[tuple[np.ndarray, np.ndarray]] = []
        graph = cls(vectors, layers)
        for level in range(int(height.max(initial=0)), -1, -1):
            rows = order[: int((height >= level).sum())]
            layers.append((rows, graph._layer(rows, DEGREE * (1 if level else 2))))
        return graph

    def _layer(self, rows: np.ndarray, degree: int) -> np.ndarray:
        """Insert a layer's rows batch by batch. Rows of the layer above come first in it."""
        own = self.vectors[rows]
        near = np.full((len(rows), degree), -1, np.int64)
        at = 0
        while at < len(rows):
            stop = min(len(rows), at + max(64, min(512, at)))
            fresh = own[at:stop]
            inner = fresh @ fresh.T
            np.fill_diagonal(inner, -np.inf)
            k = min(BUILD_BEAM, len(fresh))
            close = np.argpartition(-inner, k - 1, 1)[:, :k]
            ids, sims = close + at, np.take_along_axis(inner, close, 1)
            if at:
                start = self._enter(fresh)
                start = np.where(start < at, start, 0)
                old, old_sims = _search(own[:at], near[:at], fresh, start, min(BUILD_BEAM, at))
                ids, sims = np.concatenate((old, ids), 1), np.concatenate((old_sims, sims), 1)
            near[at:stop] = _spread(own, ids, sims, degree)
            self._link_back(own, near, at, stop, degree)
            at = stop
        return near

    def _link_back(self, own: np.ndarray, near: np.ndarray, at: int, stop: int, degree: int) -> None:
        """Let the neighbours of new rows point back; a row with too many keeps a spread choice."""
        source, place = np.nonzero(near[at:stop] >= 0)
        target, source = near[at:stop][source, place], source + at
        if not len(target):
            return
        order = np.argsort(target, kind="stable")
        target, source = target[order], source[order]
        starts = np.flatnonzero(np.concatenate(([True], target[1:] != target[:-1])))
        counts = np.diff(np.concatenate((starts, [len(target)])))
        for lo in range(0, len(starts), 512):
            s, c = starts[lo : lo + 512], np.minimum(counts[lo : lo + 512], 4 * degree)
            who = target[s]
            back = np.full((len(who), c.max()), -1, np.int64)
            fill = np.arange(c.max()) < c[:, None]
            back[fill] = source[(s[:, None] + np.arange(c.max()))[fill]]
            back[(back[:, :, None] == near[who][:, None, :]).any(2)] = -1
            ids = np.concatenate((near[who], back), 1)
            sims = np.einsum("qd,qkd->qk", own[who], own[ids])
            sims[ids < 0] = -np.inf
            near[who] = _spread(own, ids, sims, degree)

    def _enter(self, queries: np.ndarray) -> np.ndarray:
        """Nearest place found in the lowest layer so far, as one column; places are the same in the layer below."""
        start = np.zeros((len(queries), 1), np.int64)
        for rows, near in self.layers:
            got, _ = _search(self.vectors[rows], near, queries, start, 1)
            start = np.maximum(got[:, :1], 0)
        return start

    def within(self, queries: np.ndarray, least: float) -> list[np.ndarray]:
        """Rows with a similarity of ``least`` or more, for each query. A full beam of such rows is widened."""
        rows, near = self.layers[-1]
        own = self.vectors[rows]
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(queries)
        left, beam = np.arange(len(queries)), self.beam
        upper = SmallWorld(self.vectors, self.layers[:-1])._enter(queries) if len(self.layers) > 1 else np.zeros((len(queries), 1), np.int64)
        while len(left):
            again = []
            step = max(1, 8_000_000 // max(len(own), 1))
            for lo in range(0, len(left), step):
                mine = left[lo : lo + step]
                if beam > max(WIDEST_BEAM, self.beam) or beam >= WHOLE_SHARD:  # the links outnumber a beam: compare with the whole shard
                    sims = queries[mine] @ own.T
                    for i, hit in zip(mine.tolist(), sims >= least, strict=True):
                        out[i] = rows[np.flatnonzero(hit)]
                    continue
                ids, sims = _search(own, near, queries[mine], upper[mine], beam)
                hit = (sims >= least) & (ids >= 0)
                for i, row, h in zip(mine.tolist(), ids, hit, strict=True):
                    out[i] = rows[row[h]]
                again.append(mine[hit.sum(1) > beam // 2])
            left, beam = np.concatenate(again) if again else np.zeros(0, np.int64), 2 * beam
        return out

    def audit(self, least: float, others: np.ndarray | None = None, rows: int = AUDIT_ROWS, recall: float = AUDIT_RECALL, seed: int = 5) -> float:
        """Double the beam until samples of queries find their links; return the recall measured.

        The queries are vectors of the shard, their own row aside, and ``others``, unit vectors of other shards. A graph that fails even
        with a beam as wide as the shard gives way to comparing whole shards.
        """
        own = np.random.default_rng(seed).permutation(len(self.vectors))[:rows]
        queries = self.vectors[own] if others is None else np.concatenate((self.vectors[own], others))
        truth = [np.flatnonzero(self.vectors @ q >= least) for q in queries]
        truth = [np.setdiff1d(t, own[i : i + 1]) for i, t in enumerate(truth)]
        whole = sum(map(len, truth))
        while True:
            found = self.within(queries, least)
            got = sum(len(np.intersect1d(a, b)) for a, b in zip(found, truth, strict=True)) / whole if whole else 1.0
            if got >= recall:
                return got
            self.beam = 2 * self.beam if self.beam < len(self.vectors) else WHOLE_SHARD

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        parts = {f"r{i}": rows.astype(np.int32) for i, (rows, _) in enumerate(self.layers)} | {f"n{i}": near.astype(np.int32) for i, (_, near) in enumerate(self.layers)}
        np.savez_compressed(out, beam=self.beam, **parts)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes, vectors: np.ndarray) -> SmallWorld:
        got = np.load(io.BytesIO(data), allow_pickle=False)
        n = sum(k[0] == "r" for k in got.files)
        return cls(vectors, [(got[f"r{i}"].astype(np.int64), got[f"n{i}"].astype(np.int64)) for i in range(n)], int(got["beam"]))


def _unit(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths in double precision, and unit vectors in single precision."""
    size = np.sqrt((raw * raw).sum(1))
    return size, (raw / size[:, None]).astype(np.float32)


def embedding_duplicates(
    df: DataFrame,
    threshold: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    shard_rows: int = SHARD_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept), one row for each row of ``df``.

    Vectors are compared when their labels are equal and not null. n_links counts the
    other rows linked directly, component_id is the smallest id reachable by links, and
    kept marks the rows with that id. A vector that is null, empty, zero or holds null
    or non-finite components, and one with a null label, links with nothing and is its
    own component; so do vectors of different lengths. Repeated rows are linked.
    An empty table gives an empty result; other columns are not read.
    """
    spark = df.sparkSession
    scratch = Scratch(spark)
    ship_package(spark)
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))

    def pack_make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            raw, mark = [], []
            for v, label in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                x = np.array([np.nan if c is None else c for c in v], np.float64) if v else np.zeros(0)
                size = np.sqrt((x * x).sum()) if len(x) else 0.0
                good = label is not None and np.isfinite(size) and size > 0
                x = x + 0.0 if good else x  # one zero for both signs
                raw.append(x.tobytes() if good else None)
                mark.append(xxhash.xxh3_128_digest(x.tobytes() + label.encode()) if good else None)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.binary()), batch.column(2), pa.array(mark, pa.binary())], ["id", "raw", "label", "mark"])

        return step

    rows = scratch.save(arrow_map(source, pack_make, f"id {kind}, raw binary, label string, mark binary").withColumn("row", F.monotonically_increasing_id()), "vectors")
    equal = scratch.save(rows.filter("mark is not null").groupBy("mark").agg(F.min("row").alias("gid"), F.min("id").alias("low"), F.count("*").alias("copies")), "equal_vectors")
    reps = rows.join(equal.select("mark", "copies", F.col("gid").alias("row")), ["mark", "row"]).select(
        F.col("row").alias("gid"), "raw", F.concat_ws("/", F.octet_length("raw").cast("string"), "label").alias("space"), "copies"
    )
    spaces = reps.groupBy("space").agg(F.count("*").alias("rows"))
    reps = scratch.save(
        reps.join(spaces, "space").select(
            "space",
            "gid",
            "raw",
            "copies",
            F.ceil(F.col("rows") / shard_rows).cast("int").alias("shards"),
            F.pmod(F.xxhash64("gid"), F.ceil(F.col("rows") / shard_rows)).cast("int").alias("shard"),
            F.pmod(F.xxhash64("gid", F.lit("block")), F.ceil(F.col("rows") / block_rows)).cast("int").alias("block"),
        ),
        "distinct_vectors",
    )
    near = threshold - MARGIN

    # Each shard also gets a sample of the vectors of the others, about AUDIT_ROWS of a space, to audit its graph with.
    sampled = F.pmod(F.xxhash64("gid", F.lit("audit")), F.ceil(F.col("shards") * shard_rows / AUDIT_ROWS)) == 0
    guests = reps.filter((F.col("shards") > 1) & sampled).select("space", "gid", "raw", "copies", F.col("shard").alias("home"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")).filter("shard <> home")
    members = reps.select("space", "gid", "raw", "copies", F.lit(False).alias("guest"), "shard").union(guests.select("space", "gid", "raw", "copies", F.lit(True), "shard"))

    kinds = pa.schema([("space", pa.string()), ("shard", pa.int32()), ("gids", pa.binary()), ("vectors", pa.binary()), ("copies", pa.binary()), ("graph", pa.binary()), ("recall", pa.float64())])

    def build(key, table):
        table = table.sort_by("gid")
        others = np.frombuffer(b"".join(table.filter(table["guest"])["raw"].to_pylist()), np.float64)
        table = table.filter(pc.invert(table["guest"]))
        if not table.num_rows:  # a shard of guests alone
            return kinds.empty_table()
        raw = np.frombuffer(b"".join(table["raw"].to_pylist()), np.float64).reshape(table.num_rows, -1)
        graph = SmallWorld.build(_unit(raw)[1])
        recall = graph.audit(near, _unit(others.reshape(-1, raw.shape[1]))[1])
        return pa.table(
            {
                "space": pa.array([key[0].as_py()]),
                "shard": pa.array([key[1].as_py()], pa.int32()),
                "gids": pa.array([table["gid"].to_numpy().tobytes()], pa.binary()),
                "vectors": pa.array([raw.tobytes()], pa.binary()),
                "copies": pa.array([table["copies"].to_numpy().tobytes()], pa.binary()),
                "graph": pa.array([graph.to_bytes()], pa.binary()),
                "recall": pa.array([recall]),
            }
        )

    graphs = scratch.save(
        members.groupBy("space", "shard").applyInArrow(build, "space string, shard int, gids binary, vectors binary, copies binary, graph binary, recall double"), "graphs"
    )

    def gather(key, table):
        table = table.sort_by("gid")
        return pa.table(
            {
                "space": pa.array([key[0].as_py()]),
                "block": pa.array([key[1].as_py()], pa.int32()),
                "qgids": pa.array([table["gid"].to_numpy().tobytes()], pa.binary()),
                "queries": pa.array([b"".join(table["raw"].to_pylist())], pa.binary()),
            }
        )

    blocks = reps.select("space", "block", "gid", "raw").groupBy("space", "block").applyInArrow(gather, "space string, block int, qgids binary, queries binary")

    def query_make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out: list[tuple[int, int, list[int]]] = []
            for r in batch.to_pylist():
                gids, qgids, copies = (np.frombuffer(r[c], np.int64) for c in ("gids", "qgids", "copies"))
                vectors = np.frombuffer(r["vectors"], np.float64).reshape(len(gids), -1)
                queries = np.frombuffer(r["queries"], np.float64).reshape(len(qgids), -1)
                size, unit = _unit(vectors)
                qsize, qunit = _unit(queries)
                parent: dict[int, int] = {}

                def find(x: int, parent: dict[int, int] = parent) -> int:
                    while parent.setdefault(x, x) != x:
                        parent[x] = parent[parent[x]]
                        x = parent[x]
                    return x

                for i, hit in enumerate(SmallWorld.from_bytes(r["graph"], unit).within(qunit, near)):
                    cosine = vectors[hit] @ queries[i] / (size[hit] * qsize[i])
                    hit = hit[(cosine >= threshold) & (gids[hit] != qgids[i])]
                    if len(hit):
                        mates = []
                        for other in gids[hit].tolist():
                            x, y = find(int(qgids[i])), find(other)
                            if x != y:
                                parent[x] = y
                                mates.append(other)
                        out.append((int(qgids[i]), int(copies[hit].sum()), mates))
            cols = list(zip(*out, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64()))], ["gid", "links", "mates"])

        return step

    lowest = graphs.agg(F.min("recall")).first()[0]
    if lowest is not None and lowest < AUDIT_RECALL:
        raise ValueError(f"a graph finds {lowest} of its links")
    # Pairs of ids first, so that no task makes all pairs of a label; then what a pair needs joins by ids.
    pairs = spaces.select(
        "space", F.explode(F.sequence(F.lit(0), F.ceil(F.col("rows") / block_rows).cast("int") - 1)).alias("block"), F.sequence(F.lit(0), F.ceil(F.col("rows") / shard_rows).cast("int") - 1).alias("shards")
    ).select("space", "block", F.explode("shards").alias("shard"))
    tasks = pairs.join(graphs.drop("recall"), ["space", "shard"]).join(blocks, ["space", "block"]).drop("space", "block", "shard")
    found = scratch.save(arrow_map(tasks, query_make, "gid long, links long, mates array<long>", rows=1), "links")
    parts = connected_components(found.select(F.col("gid").alias("a"), F.explode("mates").alias("b")), scratch)
    counts = found.groupBy("gid").agg(F.sum("links").alias("links"))
    named = equal.join(parts.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    where = named.join(lows, "component").join(counts, "gid", "left").select("mark", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (
        rows.select("id", "mark")
        .join(where, "mark", "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("mark").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )
