"""Histograms, categories, grouped means and votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: The categories of questions by their evidence.
CATEGORIES = ("multi-table + multi text", "multi-table", "single table+multi text", "multi-text")


def question_category(evidences: DataFrame, id_col: str, kind_col: str, cards_are_tables: bool = True) -> DataFrame:
    """Category of each sample by how many tables and texts it has; others go (AGG-02)."""
    tables = ["table", "infobox"] if cards_are_tables else ["table"]
    n = evidences.groupBy(id_col).agg(F.count_if(F.col(kind_col).isin(tables)).alias("t"), F.count_if(F.col(kind_col) == "text").alias("x"))
    both, table, single, text = CATEGORIES
    category = F.when((F.col("t") >= 2) & (F.col("x") >= 2), both).when(F.col("t") >= 2, table).when((F.col("t") == 1) & (F.col("x") >= 2), single).when(F.col("x") >= 2, text)
    return n.select(id_col, category.alias("category")).where("category IS NOT NULL")


def category_report(df: DataFrame, category: str, domain: list[str]) -> DataFrame:
    """Counts over a fixed domain, zeros included (AGG-03)."""
    names = df.sparkSession.createDataFrame([(c,) for c in domain], f"{category} string")
    counts = df.groupBy(category).agg(F.count("*").alias("n"))
    return F.broadcast(names).join(counts, category, "left").na.fill(0, ["n"])  # the domain is a short fixed list


def grouped_and_overall(df: DataFrame, group: str, metrics: list[str], name: str) -> DataFrame:
    """Means of each group and of all rows, in one pass (AGG-05)."""
    out = df.rollup(group).agg(F.grouping(group).alias("__all"), F.count("*").alias("n"), *(F.round(F.avg(m), 6).alias(m) for m in metrics))
    return out.select(F.when(F.col("__all") == 1, "overall").otherwise(F.col(group)).alias(name), "n", *metrics)


def weighted_vote(df: DataFrame, group: str, answer: str, score: str) -> DataFrame:
    """Answer with the greatest summed score, ties to the first answer (AGG-12)."""
    sums = df.groupBy(group, answer).agg(F.round(F.sum(score), 2).alias("__s"))
    best = sums.groupBy(group).agg(F.min(F.struct((-F.col("__s")).alias("s"), F.col(answer).alias("a"))).alias("__b"))
    return best.select(group, F.col("__b.a").alias(answer))


def word_scores(tokens: DataFrame, group: str, order: list[str], start: str, score: str) -> DataFrame:
    """Mean token score of each word; a word begins where ``start`` holds (AGG-19)."""
    w = Window.partitionBy(group).orderBy(*order)
    indexed = tokens.withColumn("word", F.sum(F.col(start).cast("long")).over(w))
    return indexed.groupBy(group, "word").agg(F.round(F.avg(score), 6).alias("score"))
