"""Budgets, islands and orders over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within_budget(df: DataFrame, group: list[str], order: list, cost: str, budget: float, crossing: bool = True) -> DataFrame:
    """Ranked rows until their running cost exceeds the budget, the crossing one included or not (WIN-10)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = F.sum(cost).over(w)
    limit = (spent - F.col(cost)) if crossing else spent
    return df.withColumn("spent", spent).withColumn("__limit", limit).where(F.col("__limit") <= budget).drop("__limit")


def reorder(df: DataFrame, group: list[str], rank: str, how: str) -> DataFrame:
    """Position of each row: original (by pos), ranked, or two_stage (even ranks, then odd ones reversed) (WIN-11)."""
    if how == "ranked":
        key = [F.col(rank)]
    elif how == "original":
        key = [F.col("pos")]
    elif how == "two_stage":
        even = (F.col(rank) - 1) % 2 == 0
        key = [F.when(even, 0).otherwise(1), F.when(even, F.col(rank)).otherwise(-F.col(rank))]
    else:
        raise ValueError(f"unknown order {how}")
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*group).orderBy(*key)))


def dynamic_ratio(rank: Column, n: Column, d: float) -> Column:
    """N-1, N-3, .. -(N-1) by rank, scaled to d (WIN-12)."""
    return F.when(n > 1, (n - 1 - 2 * (rank - 1)) * d / (n - 1)).otherwise(0.0)


def merge_runs(df: DataFrame, group: list[str], order: str, keys: list[str], length: str) -> DataFrame:
    """Adjacent rows with equal keys as one, lengths summed (WIN-17)."""
    w = Window.partitionBy(*group).orderBy(order)
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.lag(k).over(w))
    new = df.withColumn("__new", F.when((F.row_number().over(w) > 1) & same, 0).otherwise(1))
    island = new.withColumn("__island", F.sum("__new").over(w))
    return island.groupBy(*group, "__island", *keys).agg(F.min(order).alias(order), F.sum(length).alias(length)).drop("__island")


def drop_repeated_marks(df: DataFrame, group: list[str], order: str, token: str, forced: str, kept: str) -> DataFrame:
    """A forced token equal to the forced token before it goes, unless a kept token lies between (WIN-16)."""
    w = Window.partitionBy(*group).orderBy(order)
    marked = df.where(F.col(forced) | F.col(kept)).withColumn("__prev", F.lag(F.struct(forced, token)).over(w))
    repeat = F.coalesce(F.col(forced) & F.col(f"__prev.{forced}") & (F.col(token) == F.col(f"__prev.{token}")), F.lit(False))
    return marked.where(~repeat).drop("__prev")


def largest_prefix(df: DataFrame, group: list[str], order: list[str], cost: str, budget: float) -> DataFrame:
    """Greatest number of leading rows that fit the budget (WIN-15)."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__s", F.sum(cost).over(w)).groupBy(*group).agg(F.coalesce(F.sum(F.when(F.col("__s") <= budget, 1)), F.lit(0)).alias("n"))


def trim_turns(df: DataFrame, group: str, turn: str, cost: str, budget: float, least: int = 2) -> DataFrame:
    """First message and the longest run of latest ones within the budget, two messages at least (CTX-04)."""
    w = Window.partitionBy(group)
    last = Window.partitionBy(group).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = df.withColumn("__first", F.min(turn).over(w)).withColumn("__head", F.min_by(cost, turn).over(w))
    d = d.withColumn("__tail", F.sum(cost).over(last)).withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(turn))))
    is_first = F.col(turn) == F.col("__first")
    fits = F.col("__head") + F.col("__tail") <= budget
    return d.where(is_first | fits | (F.col("__r") <= least - 1)).drop("__first", "__head", "__tail", "__r")


def gaps(df: DataFrame, group: list[str], order: str, keep: Column, mark: str, text: str) -> DataFrame:
    """Kept rows, and one row with the mark for each run of others (STR-24)."""
    w = Window.partitionBy(*group).orderBy(order)
    k = df.withColumn("__keep", keep)
    k = k.withColumn("__prev", F.lag("__keep").over(w))
    out = k.where(F.col("__keep") | F.coalesce("__prev", F.lit(True)))
    return out.withColumn(text, F.when(F.col("__keep"), F.col(text)).otherwise(F.lit(mark))).drop("__keep", "__prev")


def beam(candidates: DataFrame, width: int, group: list[str], score: str, tie: str) -> DataFrame:
    """Best ``width`` rows of a depth (WIN-08)."""
    w = Window.partitionBy(*group).orderBy(F.desc(score), tie)
    return candidates.withColumn("beam_rank", F.row_number().over(w)).where(F.col("beam_rank") <= width)
