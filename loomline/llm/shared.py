"""Intermediate tables in the cluster's shared folder, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_EDGES = 200_000
_CLEANUP = (
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled",
    "spark.sql.shuffleDependency.fileCleanup.enabled",
)


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only in local mode, where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='loomline-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Workspace:
    """Written tables of one run: they cut lineage and survive the loss of an executor."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_root(spark)}/loomline/{uuid.uuid4().hex}"
        self._n = 0

    @contextmanager
    def _free_shuffles(self):
        old = {k: self.spark.conf.get(k, None) for k in _CLEANUP}
        for k in _CLEANUP:
            self.spark.conf.set(k, "true")
        try:
            yield
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write a table and read it back; its shuffle files are freed once it is written."""
        path = self.path(name)
        with self._free_shuffles():
            df.write.options(**options).parquet(path)
        back = self.spark.read.schema(df.schema).parquet(path)
        back._loomline_path = path
        return back

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._loomline_path)
            p.getFileSystem(conf).delete(p, True)


def without(df: DataFrame, *added: str) -> DataFrame:
    """Without the columns that an operator is to add, whatever their case: its own take their place."""
    taken = {a.lower() for a in added}
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c.lower() not in taken))


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the table bears it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def is_small(df: DataFrame, most: int) -> bool:
    """Whether a table has at most so many rows; reads no more than most + 1 of them."""
    return df.limit(most + 1).count() <= most


def broadcast_if_small(df: DataFrame, most_rows: int) -> DataFrame:
    """Broadcast behind a check of the size; beyond it the join shuffles."""
    return F.broadcast(df) if is_small(df, most_rows) else df


def components(ws: Workspace, edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), the smallest node of each.

    Alternating large-star and small-star rounds: each round is two aggregations with map-side
    combining and two joins whose skewed side Spark can split, and ends in a written table. Nodes
    without an edge to another node have no row. Null ends are dropped. A table of at most SMALL_EDGES edges,
    by count, is dealt with in one task, without any exchange.
    """
    e = ws.save(
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "edges",
    )
    saved, mark = e, _mark(e)
    while mark[0]:
        if mark[0] <= SMALL_EDGES:
            e = e.coalesce(1)
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u")
        # each node of a star and its centre both point to the least; a row of the least itself makes (u, m)
        nxt = small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()
        nxt = ws.save(nxt, "edges")
        ws.drop(saved)
        e, saved, before, mark = nxt, nxt, mark, _mark(nxt)
        if mark == before:
            break
    roots = e.select("v").distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        roots.select(F.col("v").alias("node"), F.col("v").alias("component"))
    )


def _mark(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
