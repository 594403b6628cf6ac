"""Operator 8: near-duplicate documents by chosen-path set similarity join.

A document is its set of word shingles. Sets that are equal are folded into one first.
Independent trees deal the sets out: a tree starts from a minwise token of each set, and
sets with the same token meet in a node. A node that is small is compared exhaustively, by
signatures first and then on full sets. A node that is large chooses further minwise
functions, on average ``1 / threshold`` of them, and its sets branch by their tokens there.
A node's functions depend on the node alone, so every level and every tree is independent,
and a set's way through several levels follows from its shingles without a shuffle.

A tree keeps a pair together less often the deeper its nodes are split (``kept_together``).
Sets whose nodes are split go through as many more trees as the depth asks for, so that a
pair at the threshold is missed with a chance of ``MISS`` at most, besides 5e-6 (at 0.80)
for an estimate by signatures that is more than ``SLACK`` too low.

A large node is also dealt out to blocks at random, each compared exhaustively, and the
components found so far are marked on its sets. Crowds of near copies are one component
then: a node of one component ends, and in a node of one component and few others these
few meet every block of it. What has not divided after the last level is compared block by
block, so no pair is skipped for the size of its node.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, arrow_map, connected_components, free_name, ship_package

#: Places of a signature; one byte is kept of each.
POSITIONS = 64
#: How far an estimate of the similarity by the signature may lie under the threshold: five standard errors.
SLACK = 0.25
#: Chance at most that no tree brings a pair at the threshold together.
MISS = 1e-4
#: Levels that a node is split at once.
STEP = 2
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


class _WordHashes(dict):
    LIMIT = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(text: str | None, size: int, hashes: dict | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a text; words are split at ASCII white space, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed=len(words))], np.uint64)
    hashes = _WordHashes() if hashes is None else hashes
    v = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = len(v) - size + 1
    h = v[:n] * _MIX[0]
    for i in range(1, size):
        h ^= h >> np.uint64(29)
        h *= _MIX[i % 4]
        h += v[i : i + n]
    h ^= h >> np.uint64(32)
    h *= _MIX[1]
    h ^= h >> np.uint64(29)
    return np.unique(h)


def _hash64(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(np.broadcast(*parts).shape, np.uint64)
    for i, p in enumerate(parts):
        h = (h ^ np.asarray(p).astype(np.uint64)) * _MIX[i % 4]
        h ^= h >> np.uint64(31)
    h *= _MIX[0]
    return h ^ (h >> np.uint64(29))


def minwise(shingles: np.ndarray, functions: np.ndarray) -> np.ndarray:
    """The smallest value of a set under each of some hash functions, given by 64-bit names."""
    a, b = _hash64(functions, np.uint64(11))[:, None] | np.uint64(1), _hash64(functions, np.uint64(12))[:, None]
    out = np.full(len(functions), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        np.minimum(out, (shingles[None, at : at + 4096] * a + b).min(1), out=out)
    return out


def _names(seed: int, kind: int, count: range) -> np.ndarray:
    return _hash64(np.uint64(seed), np.uint64(kind), np.arange(count.start, count.stop, dtype=np.uint64))


def signature(shingles: np.ndarray, seed: int) -> np.ndarray:
    """One byte of the minwise token at each of the places."""
    return (minwise(shingles, _names(seed, 1, range(POSITIONS))) * _MIX[2] >> np.uint64(56)).astype(np.uint8)


def root_nodes(shingles: np.ndarray, seed: int, trees: range) -> np.ndarray:
    """The node where each of the trees starts for a set."""
    names = _names(seed, 2, trees)
    return _hash64(names, minwise(shingles, names))


def child_nodes(nodes: np.ndarray, shingles: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of ``nodes`` and the nodes one level down where a set goes from there."""
    whole, part = divmod(100 / percent, 1)
    more = np.flatnonzero((_hash64(nodes, np.uint64(1)) >> np.uint64(40)).astype(np.float64) / (1 << 24) < part)
    rows = np.concatenate([*[np.arange(len(nodes))] * int(whole), more])
    which = np.concatenate([*[np.full(len(nodes), i, np.uint64) for i in range(int(whole))], np.full(len(more), int(whole), np.uint64)])
    names = _hash64(nodes[rows], which, np.uint64(2))
    return rows, _hash64(names, minwise(shingles, names))


def descend(nodes: np.ndarray, shingles: np.ndarray, levels: int, percent: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(nodes, their parents) of each level under ``nodes`` that a set goes through."""
    out = []
    for _ in range(levels):
        rows, below = child_nodes(nodes, shingles, percent)
        out.append((below, nodes[rows]))
        nodes = below
    return out


def kept_together(depth: int, percent: int) -> float:
    """The chance that a pair at the threshold shares a root and, in one of its branches, each of ``depth`` levels below."""
    j, (whole, part) = percent / 100, divmod(100 / percent, 1)
    alive = 1.0
    for _ in range(depth):
        alive = 1 - (1 - j * alive) ** whole * (1 - part * j * alive)
    return j * alive


def trees_needed(depth: int, percent: int, miss: float = MISS) -> int:
    """So many trees miss a pair whose nodes are split ``depth`` times with a chance of ``miss`` at most."""
    one = kept_together(depth, percent)
    return int(np.ceil(np.log(miss) / np.log1p(-one))) if one < 1 else 1


def groups_of(key: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of each run of equal keys."""
    if len(key):
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        yield from zip(starts.tolist(), [*starts[1:].tolist(), len(key)], strict=True)


def _fold(parent: dict[int, int], x: int) -> int:
    while parent.setdefault(x, x) != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def whole_runs(batches: Iterator[pa.RecordBatch], key: int) -> Iterator[pa.RecordBatch]:
    """Batches cut so that equal neighbouring keys are never divided; only the last run of a batch is carried over."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        change = np.flatnonzero(keys[1:] != keys[:-1])
        if held and held[-1].column(key)[-1].as_py() != batch.column(key)[0].as_py():
            yield from _joined(held)
            held = []
        if len(change):
            cut = int(change[-1]) + 1
            yield from _joined([*held, batch.slice(0, cut)])
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield from _joined(held)


def _joined(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from pa.Table.from_batches(parts).combine_chunks().to_batches()


def similar_size(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * np.minimum(a, b) >= percent * np.maximum(a, b)


def _by_runs(df: DataFrame, keys: list[str], step: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """Apply ``step`` to batches that hold whole groups of the first key, sorted by all keys; the first key is the first column."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_runs(batches, 0):
            yield step(batch)

    return df.repartition(F.col(keys[0])).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _candidates(rows: DataFrame, percent: int) -> DataFrame:
    """(grp, gid) from (block, gid, core, n, sig): sets of a block that estimates connect, unless they have the same core.

    Equal groups of several trees have equal ids.
    """
    least = POSITIONS * (percent / 100 - SLACK)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        block, gid, core, n = (batch.column(i).to_numpy() for i in range(4))
        sigs = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.uint8).reshape(-1, POSITIONS)
        label = np.arange(batch.num_rows)
        for d in range(1, batch.num_rows):
            same = np.flatnonzero(block[:-d] == block[d:])
            if not len(same):
                break
            same = same[similar_size(n[same], n[same + d], percent) & (core[same] != core[same + d]) & (label[same] != label[same + d])]
            for at in range(0, len(same), 65536):
                i = same[at : at + 65536]
                for x in i[(sigs[i] == sigs[i + d]).sum(1) >= least].tolist():
                    if label[x] != label[x + d]:
                        label[label == label[x + d]] = label[x]
        order = np.argsort(label, kind="stable")
        grp, out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in groups_of(label[order]):
            ids = np.unique(gid[order[lo:hi]])
            if len(ids) > 1:
                grp.append(np.full(len(ids), xxhash.xxh3_64_intdigest(ids.tobytes()), np.uint64).view(np.int64))
                out.append(ids)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grp)), pa.array(np.concatenate(out))], ["grp", "gid"])

    return _by_runs(rows.select("block", "gid", "core", "n", "sig"), ["block"], step, "grp long, gid long")


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, on full sets."""
    both = _common(a, b)
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def group_links(full: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """All linked pairs of a group, from the exact sizes of all its intersections at once."""
    if len(full) < 3:
        return [(0, 1)] if len(full) == 2 and linked(full[0], full[1], percent) else []
    k, sizes = len(full), np.array([len(x) for x in full])
    _, place, count = np.unique(np.concatenate(full), return_inverse=True, return_counts=True)
    shared = count[place] > 1
    row, col = np.repeat(np.arange(k), sizes)[shared], (np.cumsum(count > 1) - 1)[place[shared]]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    both = np.zeros((k, k))
    width = 4096
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (lo, lo + width))
        part = np.zeros((k, width), np.float32)
        part[row[i:j], col[i:j] - lo] = 1
        both += part @ part.T
    a, b = np.nonzero(np.triu((both > 0) & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)), 1))
    return list(zip(a.tolist(), b.tolist(), strict=True))


def _verified_forest(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b) from (grp, gid, full): links of each group's components to their smallest member. Every pair of a group is compared on full sets."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        grp, gid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        fresh = np.flatnonzero(np.concatenate(([True], (grp[1:] != grp[:-1]) | (gid[1:] != gid[:-1]))))  # a text that is found twice counts once
        a, b = [], []
        for lo, hi in groups_of(grp[fresh]):
            at = fresh[lo:hi]
            full = [np.frombuffer(batch.column(2)[i].as_py(), np.uint64) for i in at.tolist()]
            parent: dict[int, int] = {}
            for i, j in group_links(full, percent):
                x, y = _fold(parent, i), _fold(parent, j)
                parent[max(x, y)] = min(x, y)
            for i in parent:
                if (r := _fold(parent, i)) != i:
                    a.append(gid[at[r]])
                    b.append(gid[at[i]])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _by_runs(rows, ["grp", "gid"], step, "a long, b long")


#: Written tables are broadcast up to so many rows; beyond, both sides of a join shuffle.
BROADCAST_PAIRS = 200_000
#: Text hashes alone are broadcast up to so many.
BROADCAST_ROWS = 2_000_000


def _checked(df: DataFrame) -> DataFrame:
    """A written table with a broadcast hint, if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_PAIRS else df


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for df in tables[1:]:
        out = out.unionByName(df)
    return out


class _Trees:
    """The search for links between distinct sets (``reps``: gid, n, sig, roots, text_hash, mark)."""

    def __init__(self, source: DataFrame, reps: DataFrame, scratch: Scratch, shingle: int, percent: int, small: int, seed: int):
        self.source, self.reps, self.scratch = source, reps, scratch
        self.shingle, self.percent, self.small, self.seed = shingle, percent, small, seed
        self.edges: list[DataFrame] = []
        self.passing: list[DataFrame] = []  # tables that only the search reads

    def save(self, df: DataFrame, name: str) -> DataFrame:
        out = self.scratch.save(df, name)
        self.passing.append(out)
        return out

    def search(self, trees: int, levels: int, miss: float) -> DataFrame:
        """(a, b): links that connect the components of all sets."""
        grown = max(trees, trees_needed(0, self.percent, miss))
        paths = self.reps.select(F.explode("roots").alias("node"), F.lit(None).cast("long").alias("parent"), "gid", F.col("gid").alias("core"), F.lit(True).alias("deep"))
        few, depth = None, 0
        while True:
            here = self._nodes(paths, depth)
            blocks = here.filter("block is not null").select("block", "gid", "core")
            self._compare(blocks if few is None else blocks.union(few), depth)
            left = here.filter("deep and size > 0")
            if left.isEmpty():
                break
            branch, few = self._open_nodes(left)
            if depth + STEP > levels:
                self._compare(self._block_pairs(branch).union(few), depth)
                break
            depth += STEP
            wanted = trees_needed(depth, self.percent, miss)
            paths = self.save(self._paths(branch, range(min(grown, wanted), wanted), depth).dropDuplicates(["node", "gid"]), f"paths{depth}")
            grown = max(grown, wanted)
        links = self.scratch.save(_union(self.edges), "links")
        self.scratch.drop(*self.passing)
        return links

    def _nodes(self, paths: DataFrame, depth: int) -> DataFrame:
        """(node, gid, core, deep, size, block) of nodes with anything left to compare; ``size`` is 0 where no further split is needed.

        A node is small or its parent is large: below a small one everything is compared already.
        """
        found = [F.count("*").alias("size")] + ([F.min("core").alias("c0"), F.max("core").alias("c1")] if depth else [])
        sizes = self.save(paths.groupBy("node").agg(*found).filter("size > 1 and c0 != c1" if depth else "size > 1").select("node", "size"), f"sizes{depth}")
        here = paths.join(_checked(sizes), "node")
        if depth:
            large = sizes.filter(F.col("size") > self.small).select(F.col("node").alias("parent"), F.lit(True).alias("above"))
            here = here.join(_checked(self.save(large, f"large{depth}")), "parent", "left").filter("parent is null or above")
        dealt = F.xxhash64("node", F.pmod(F.xxhash64("gid", "node"), F.ceil(F.col("size") * 5 / (4 * self.small))))
        block = F.when(F.col("size") <= self.small, F.col("node")).when(F.col("deep"), dealt)
        return self.save(here.select("node", "gid", "core", "deep", F.when(F.col("size") > self.small, F.col("size")).otherwise(0).alias("size"), block.alias("block")), f"nodes{depth}")

    def _compare(self, blocks: DataFrame, depth: int) -> None:
        """Add the links within blocks of (block, gid, core)."""
        blocks = self.save(blocks, f"blocks{depth}") if depth else blocks
        near = self.reps.select("gid", "n", "sig").join(_checked(blocks), "gid")
        groups = _candidates(near, self.percent).groupBy("gid").agg(F.collect_set("grp").alias("grps"))
        shingle = self.shingle

        def make():
            words, done = _WordHashes(), set()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                grp, gid, full = [], [], []
                for text, g, mark, grps in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if g in done:
                        continue
                    raw = shingle_set(text, shingle, words).tobytes()
                    if xxhash.xxh3_128_digest(raw) == mark:
                        done.add(g)
                        grp += grps
                        gid += [g] * len(grps)
                        full += [raw] * len(grps)
                return pa.RecordBatch.from_arrays([pa.array(grp, pa.int64()), pa.array(gid, pa.int64()), pa.array(full, pa.binary())], ["grp", "gid", "full"])

            return step

        rows = arrow_map(self._texts(groups, f"groups{depth}", ["grps"]), make, "grp long, gid long, full binary", rows=64)
        self.edges.append(self.scratch.save(_verified_forest(rows, self.percent), f"edges{depth}"))

    def _texts(self, sets: DataFrame, name: str, more: list[str]) -> DataFrame:
        """(text, gid, mark, ...) of sets, read from the source again; a text may come several times."""
        sets = self.save(sets, name)
        texts, count = self.source.select("text", F.xxhash64("text").alias("text_hash")), sets.count()
        reps = self.reps.select("gid", "text_hash", "mark")
        if count <= BROADCAST_PAIRS:
            sets = F.broadcast(reps.join(F.broadcast(sets), "gid"))
        else:
            sets = self.save(reps.join(sets, "gid"), f"wanted_{name}")
            if count <= BROADCAST_ROWS:
                texts = texts.join(F.broadcast(sets.select("text_hash").distinct()), "text_hash", "left_semi")
        return texts.join(sets, "text_hash").select("text", "gid", "mark", *more)

    def _open_nodes(self, left: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of large nodes: (node, gid, core) of those that branch, and (block, gid, core) of those that hold one component and few others."""
        parts = connected_components(_union(self.edges), self.scratch)
        self.edges = [parts.filter("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))]
        parts = parts.select(F.col("node").alias("gid"), "component")
        left = left.select("node", "gid").join(parts, "gid", "left").select("node", "gid", F.coalesce("component", "gid").alias("core"))
        left = self.save(left, "cores")
        each = left.groupBy("node", "core").agg(F.count("*").alias("n"))
        nodes = each.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "core")).alias("most")).select("node", (F.col("size") - F.col("most.n")).alias("others"), F.col("most.n").alias("mates"), F.col("most.core").alias("main"))
        nodes = self.save(nodes.filter("others > 0"), "open")
        rows = left.join(_checked(nodes), "node")
        # Blocks of the component are as large as the few others, so the rows made are twice the node's at most.
        parts_of = F.ceil(F.col("mates") / F.greatest("others", F.lit(self.small // 2))).cast("int")
        home = F.when(F.col("core") == F.col("main"), F.array(F.pmod(F.xxhash64("gid"), parts_of).cast("int"))).otherwise(F.sequence(F.lit(0), parts_of - 1))
        is_few = F.col("others") <= 4 * self.small
        few = rows.filter(is_few).select("node", "gid", "core", F.explode(home).alias("part")).select(F.xxhash64("node", "part").alias("block"), "gid", "core")
        return rows.filter(~is_few).select("node", "gid", "core"), few

    def _paths(self, branch: DataFrame, trees: range, depth: int) -> DataFrame:
        """(node, parent, gid, core, deep): the next levels of branching nodes, and new trees down to the same depth for their sets."""
        starts = branch.groupBy("gid", "core").agg(F.collect_set("node").alias("nodes"))
        shingle, seed, percent = self.shingle, self.seed, self.percent

        def make():
            words, done = _WordHashes(), set()

            def step(batch: pa.RecordBatch) -> pa.RecordBatch:
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # nodes, parents (0: none), whether at the last level
                size, who = [], []
                for text, g, mark, core, nodes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if g in done:
                        continue
                    s = shingle_set(text, shingle, words)
                    if xxhash.xxh3_128_digest(s.tobytes()) != mark:
                        continue
                    done.add(g)
                    down = descend(np.array(nodes, np.int64).view(np.uint64), s, STEP, percent)
                    down[0] = (down[0][0], np.zeros_like(down[0][1]))
                    roots = root_nodes(s, seed, trees)
                    fresh = [(roots, np.zeros_like(roots)), *descend(roots, s, depth, percent)]
                    for way in (down, fresh):
                        out += [(x, p, np.full(len(x), i == len(way) - 1)) for i, (x, p) in enumerate(way)]
                    n = sum(len(x) for way in (down, fresh) for x, _ in way)
                    size.append(n)
                    who.append((g, core))
                cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, bool)]
                node, parent = cols[0].view(np.int64), cols[1].view(np.int64)
                gid, core = (np.repeat(np.array([w[i] for w in who], np.int64), size) for i in (0, 1))
                return pa.RecordBatch.from_arrays([pa.array(node), pa.array(parent, mask=parent == 0), pa.array(gid), pa.array(core), pa.array(cols[2])], ["node", "parent", "gid", "core", "deep"])

            return step

        return arrow_map(self._texts(starts, f"starts{depth}", ["core", "nodes"]), make, "node long, parent long, gid long, core long, deep boolean", rows=64)

    def _block_pairs(self, branch: DataFrame) -> DataFrame:
        """The exact way for what did not divide: every block of a node meets every other."""
        sizes = self.save(branch.groupBy("node").agg(F.ceil(F.count("*") / (2 * self.small)).cast("int").alias("blocks")), "undivided")
        own, other = F.pmod(F.xxhash64("gid"), "blocks").cast("int"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        cut = branch.join(_checked(sizes), "node").select("node", "gid", "core", own.alias("own"), other.alias("other"))
        return cut.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("block"), "gid", "core")


def near_duplicates(
    df: DataFrame,
    shingle: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    trees: int = 1,
    small: int = 256,
    levels: int = 20,
    seed: int = 11,
    miss: float = MISS,
) -> DataFrame:
    """(id, n_shingles, component_id, kept), one row for each row of ``df``.

    Documents are linked if 100 * intersection >= percent * union of their shingle sets.
    component_id is the smallest id reachable by links; kept marks the rows with that id.
    A text with fewer words than a shingle is one shingle; without words (null, empty,
    blank) its set is empty and it is its own component. Repeated rows are equal sets
    and so linked. A row with a null id takes part in links but is never kept; a
    component of such rows alone has a null component_id. An empty
    table gives an empty result; other columns are not read. Very long texts are whole
    sets like others. ``trees`` is the least number of trees; ``miss`` asks for more.
    """
    scratch = Scratch(df.sparkSession)
    first = range(max(trees, trees_needed(0, percent, miss)))
    source = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sign_make():
        hashes = _WordHashes()

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, mark, sig, roots = [], [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle_set(text, shingle, hashes)
                n.append(len(s))
                some = len(s) > 0
                mark.append(xxhash.xxh3_128_digest(s.tobytes()) if some else None)
                sig.append(signature(s, seed).tobytes() if some else None)
                roots.append(root_nodes(s, seed, first).view(np.int64) if some else None)
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(mark, pa.binary()), pa.array(sig, pa.binary()), pa.array(roots, pa.list_(pa.int64())), batch.column(2)],
                ["id", "n", "mark", "sig", "roots", "text_hash"],
            )

        return step

    columns = T.StructType([T.StructField("id", df.schema[id_col].dataType), *T.StructType.fromDDL("n long, mark binary, sig binary, roots array<long>, text_hash long")])
    rows = arrow_map(source.withColumn("text_hash", F.xxhash64("text")), sign_make, columns)
    rows = scratch.save(rows.withColumn("row", F.monotonically_increasing_id()), "signatures")
    equal = scratch.save(rows.filter("n > 0").groupBy("mark").agg(F.min("row").alias("gid"), F.min("id").alias("low")), "equal_sets")
    reps = rows.join(equal.select(F.col("gid").alias("row")), "row", "left_semi").select(F.col("row").alias("gid"), "n", "sig", "roots", "text_hash", "mark")
    reps = scratch.save(reps, "representatives")
    links = _Trees(source, reps, scratch, shingle, percent, small, seed).search(len(first), levels, miss)
    parts = connected_components(links, scratch)
    named = equal.join(parts.withColumnRenamed("node", "gid"), "gid", "left").withColumn("component", F.coalesce("component", "gid"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    where = named.join(lows, "component").select("mark", "component_id")
    return (
        rows.select("id", "n", "mark")
        .join(where, "mark", "left")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(False)))
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` without near copies: of each component one row stays, that with the smallest id.

    Rows are chosen, not ids: among equal ids the first row of a written copy stays, and
    a null id comes after all others. A row without words is its own component and stays.
    """
    row = free_name(df.columns, "_row")
    numbered = Scratch(df.sparkSession).save(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    found = near_duplicates(numbered.select(key.alias("key"), F.col(text_col).alias("text")), id_col="key", text_col="text", **options)
    kept = found.filter("key.row = component_id.row").select(F.col("key.row").alias(row))
    return numbered.join(kept, row, "left_semi").select(*df.columns)
