"""Deduplication, set operations and id conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the first by an explicit order; combines before it shuffles (SET-03)."""
    rest = [c for c in df.columns if c not in keys]
    ordered = F.struct(*(F.col(c) for c in order), *(F.col(c) for c in rest if c not in order))
    best = df.groupBy(*keys).agg(F.min(ordered).alias("__best"))
    return best.select(*(F.col(c) if c in keys else F.col(f"__best.{c}").alias(c) for c in df.columns))


def union_sources(*sources: DataFrame, position: str | None = None) -> DataFrame:
    """UNION ALL by name with the index of the source (SET-01)."""
    out = None
    for i, s in enumerate(sources):
        s = s.withColumn("src_idx", F.lit(i))
        out = s if out is None else out.unionByName(s, allowMissingColumns=True)
    return out


def resolve_id_conflicts(df: DataFrame, id_col: str, identity: list[str], order: list[str], prefix: str = "new") -> DataFrame:
    """Later rows whose id was first used for another content, and rows without an id, get minted ids (SET-06).

    Minted numbers are above every number in use under the prefix, so they collide with none.
    """
    first = df.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(F.struct(*order, *identity)).alias("__first"))
    out = df.join(first, id_col, "left")
    same = F.struct(*identity).eqNullSafe(F.struct(*(F.col(f"__first.{c}").alias(c) for c in identity)))
    used = df.agg(F.coalesce(F.max(F.regexp_extract(F.col(id_col), rf"^{prefix}_([0-9]+)$", 1).try_cast("long")), F.lit(0)).alias("__used"))
    keep = out.where(F.col(id_col).isNotNull() & same).withColumn("new_id", F.col(id_col))
    from .ids import with_position

    changed = with_position(out.where(~(F.col(id_col).isNotNull() & same)), order, "__n", 1)
    changed = changed.crossJoin(F.broadcast(used)).withColumn("new_id", F.format_string(f"{prefix}_%06d", F.col("__used") + F.col("__n"))).drop("__n", "__used")
    return keep.unionByName(changed).drop("__first")


def replace_in_list(ids, old, new):
    """Column: list of ids with one replaced (SET-12)."""
    return F.transform(ids, lambda x: F.when(x == old, new).otherwise(x))


def multiset_union(a: DataFrame, b: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    """Union of multisets by the greater count (SET-14)."""
    return a.unionByName(b).groupBy(*keys).agg(F.max(count).alias(count))


def multiset_intersection(a: DataFrame, b: DataFrame, keys: list[str], count: str = "n") -> DataFrame:
    return a.join(b.withColumnRenamed(count, "__m"), keys).withColumn(count, F.least(count, "__m")).drop("__m")


def split_merge(df: DataFrame, flag, change, order: list[str]) -> DataFrame:
    """Rows for which flag holds go through ``change``, the others stay; merged again (SET-10)."""
    return change(df.where(flag)).unionByName(df.where(~F.coalesce(flag, F.lit(False))), allowMissingColumns=True)


def cap_per_key(df: DataFrame, key: str, order: list[str], most: int) -> DataFrame:
    """The first rows of each key in arrival order (WIN-03)."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= most).drop("__r")
