"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows handled at once inside a task; bounds Python memory for long texts.
SLICE_ROWS = 256


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)


class Scratch:
    """Tables written to the folder that the whole cluster shares.

    Written tables cut lineage: a lost executor costs a reread, not a recomputation.
    The folder is the session's ``spark.checkpoint.dir``; only where that is unset
    (tests on one machine) a temporary folder is made and set.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
            root = "file://" + tempfile.mkdtemp(prefix="spark-scratch-")
            spark.sparkContext.setCheckpointDir(root)
        self.root = f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            path = jvm.org.apache.hadoop.fs.Path(df.scratch_path)
            path.getFileSystem(conf).delete(path, True)


def free_name(taken: list[str], name: str) -> str:
    """``name``, with as many underscores as it takes to differ from all others."""
    while name.lower() in {x.lower() for x in taken}:
        name += "_"
    return name


def arrow_map(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]],
    schema: StructType | str,
    rows: int = SLICE_ROWS,
) -> DataFrame:
    """``mapInArrow`` over slices of a batch; ``make`` runs once in each task."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield step(batch.slice(at, rows))

    return df.mapInArrow(run, schema)


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def whole_text(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


#: Rows of an edge list up to which its minima are broadcast; beyond, both sides of a join shuffle.
BROADCAST_EDGES = 200_000


def connected_components(edges: DataFrame, scratch: Scratch, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of an edge list; component = smallest node reachable.

    Alternating large-star and small-star: every round is a partial aggregation and
    an equi-join, so a node with very many edges is combined before the shuffle and
    its join side can be split. Rounds end when the edges are stars around the
    smallest nodes; their number grows with the logarithm of the nodes.
    Null ends and self-loops are ignored; repeated edges count once; no edges give
    an empty table.
    """
    cur = scratch.save(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") != F.col("v")))
        .distinct(),
        "edges",
    )
    while True:
        ends = cur.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(False).alias("centre")).union(cur.select("v", F.lit(0), F.lit(True)))
        each = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
        count, mixed = each.agg(F.sum("leaf"), F.max((F.col("leaf") > 1) | ((F.col("leaf") == 1) & F.col("centre")))).first()
        if not mixed:  # every node has one centre, and no centre has another
            break
        hint = F.broadcast if count <= BROADCAST_EDGES else (lambda df: df)
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(hint(low), "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(hint(low), "u")
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .filter("u != v")
            .distinct()
        )
        nxt = scratch.save(small, "stars")
        scratch.drop(cur)
        cur = nxt
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
