"""Positions, samples and minted ids over unordered rows."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_position(df: DataFrame, order: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """Global position by an explicit order, in two passes: rows are range-partitioned and sorted, then each
    task numbers its rows from the prefix of the partition counts. No single task sees all rows, and what
    reaches the driver is one count for each partition."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    tagged = checkpointed(dealt.withColumn("__pos_part", F.spark_partition_id()).withColumn("__pos_row", F.monotonically_increasing_id()))
    counts = tagged.groupBy("__pos_part").agg(F.count("*").alias("__pos_n"), F.min("__pos_row").alias("__pos_first"))
    w = Window.orderBy("__pos_part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("__pos_part", "__pos_first", F.coalesce(F.sum("__pos_n").over(w), F.lit(0)).alias("__pos_base"))
    out = tagged.join(F.broadcast(base), "__pos_part")  # a row for each partition
    return out.withColumn(name, F.col("__pos_base") + F.col("__pos_row") - F.col("__pos_first") + start).drop("__pos_part", "__pos_row", "__pos_first", "__pos_base")


def with_group_position(df: DataFrame, group: str, order: list[str], name: str = "pos", start: int = 0) -> DataFrame:
    """Position within each group by an explicit order: the global position less that of the group's first row,
    so a group of any size is dealt over many tasks. Rows of a null group count as one group."""
    out = with_position(df, [group, *order], "__group_pos")
    first = out.groupBy(F.col(group).alias("__group")).agg(F.min("__group_pos").alias("__group_first"))
    met = out.join(first, F.col(group).eqNullSafe(F.col("__group")))
    return met.withColumn(name, F.col("__group_pos") - F.col("__group_first") + start).drop("__group", "__group_pos", "__group_first")


def checkpointed(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder; a temporary one only in local mode, where the session names none."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(root or tempfile.mkdtemp(prefix="loomline-"))
    return df.checkpoint()


def sample_rows(df: DataFrame, key: list[str], n: int, seed: int = 0) -> DataFrame:
    """Reproducible sample of n rows without replacement (FLT-04)."""
    return df.orderBy(F.xxhash64(*key, F.lit(seed)), *key).limit(n)


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Batch number of each row (SET-11)."""
    out = with_position(df, order, "__pos")
    return out.withColumn("batch", F.floor(F.col("__pos") / size).cast("long")).drop("__pos")
