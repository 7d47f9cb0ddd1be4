"""Lookups and matching joins of evidence, corpus and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .ids import checkpointed


def lookup_last(left: DataFrame, right: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Left join on the last right row of each key, as a dictionary would keep it (JON-01)."""
    rest = [c for c in right.columns if c not in keys]
    last = right.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("__r"))
    return left.join(last, keys, "left").select(*left.columns, *(F.col(f"__r.{c}").alias(c) for c in rest if c not in left.columns))


def first_containing(needles: DataFrame, docs: DataFrame, needle: Column, text: Column, block: list[str], needle_id: str, doc_order: str) -> DataFrame:
    """First document of the same block, in order, whose text contains the needle (JON-03, exact part)."""
    hits = needles.join(docs, block).where(F.contains(text, needle))
    return hits.groupBy(needle_id).agg(F.min(doc_order).alias(doc_order))


def first_containing_anywhere(needles: DataFrame, docs: DataFrame, needle_id: str, needle: str, doc_id: str, text: str, words: int = 3, block: int = 256, small: int = 100_000, same: tuple[str, str] | None = None) -> DataFrame:
    """First document of all, by id, or of those of the same value in the columns ``same`` of needles and docs, whose text contains the needle (JON-03, exact part): rows (needle_id, doc_id).

    Words are what stands between single spaces. The words between a needle's first and last stand whole and in a
    row in every text that contains it, so its longest run of ``words`` of them (or longest word, if fewer) is its seed, and the join on
    the runs of the texts loses no match; each candidate is then verified on the whole text. Needles without an
    inner word meet the texts in blocks of ``block``. Null needles and texts match nothing; the empty needle
    is in every text. Each text is split once. At most ``small`` seeds, of 16 bytes each, and a tenth as many candidates
    with their needles are broadcast; beyond that the joins shuffle.
    """
    runs = lambda w, n: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.slice(w, i, n)))
    of = lambda i: F.lit("") if same is None else F.col(same[i]).cast("string")
    asked = needles.select(F.col(needle_id).alias("__needle_id"), F.col(needle).alias("__needle"), of(0).alias("__of")).where("__needle IS NOT NULL AND __of IS NOT NULL")
    asked = asked.withColumn("__inner", let(lambda w: F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0))), F.split("__needle", " ")))
    texts = docs.select(F.col(doc_id).alias("__doc_id"), F.col(text).alias("__text"), of(1).alias("__own")).where("__text IS NOT NULL AND __own IS NOT NULL")

    longest = lambda w, n: F.array_max(F.transform(runs(w, n), lambda r: F.struct(F.length(F.array_join(r, " ")), r.alias("run"))))["run"]
    seeds = asked.where(F.size("__inner") > 0).withColumn("__n", F.when(F.size("__inner") >= words, words).otherwise(1))
    lengths = sorted(r[0] for r in seeds.select("__n").distinct().collect())  # 1, ``words`` or both
    seeds = seeds.select("__needle_id", F.xxhash64(let(longest, F.col("__inner"), F.col("__n")), "__of").alias("__seed"))
    seeds = F.broadcast(seeds) if needles.limit(small + 1).count() <= small else seeds
    none = F.array().cast("array<bigint>")
    of_text = let(lambda w, own: F.array_distinct(F.concat(none, *(F.coalesce(F.transform(runs(w, F.lit(i)), lambda r: F.xxhash64(r, own)), none) for i in lengths))), F.split("__text", " "), F.col("__own"))
    pairs = texts.select("__doc_id", F.explode(of_text).alias("__seed")).join(seeds, "__seed").select("__needle_id", "__doc_id")
    pairs = checkpointed(pairs.join(asked.select("__needle_id", "__needle", "__of"), "__needle_id"))
    pairs = F.broadcast(pairs) if pairs.limit(small // 10 + 1).count() <= small // 10 else pairs
    seeded = texts.join(pairs, "__doc_id").where("__own = __of").where(F.contains("__text", "__needle"))

    short = asked.where(F.size("__inner") == 0).select("__needle_id", "__needle", "__of")
    sets = short.groupBy(F.floor(F.monotonically_increasing_id() / block).alias("__block")).agg(F.collect_list(F.struct("__needle_id", "__needle", "__of")).alias("__set"))
    met = texts.crossJoin(sets.select("__set"))  # texts against blocks of the stated needles
    held = met.select("__doc_id", F.inline(F.filter("__set", lambda x: (x["__of"] == F.col("__own")) & F.contains(F.col("__text"), x["__needle"]))))
    hits = seeded.select("__needle_id", "__doc_id").unionByName(held.select("__needle_id", "__doc_id"))
    return hits.groupBy(F.col("__needle_id").alias(needle_id)).agg(F.min("__doc_id").alias(doc_id))


def back_off(primary: DataFrame, secondary: DataFrame, key: str, value: str, valid) -> DataFrame:
    """The secondary run's value where the primary one is not valid and the secondary is (JON-17)."""
    other = secondary.select(key, F.col(value).alias("__other"))
    pick = F.when(valid(F.col(value)), F.col(value)).when(valid(F.col("__other")), F.col("__other")).otherwise(F.col(value))
    return primary.join(other, key, "left").withColumn(value, pick).drop("__other")


def cached(queries: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses) (SRC-16, SRC-17)."""
    return queries.join(cache, key), queries.join(cache, key, "left_anti")


def cached_generations(prompts: DataFrame, cache: DataFrame, n: int, key: str = "prompt", outputs: str = "outputs") -> tuple[DataFrame, DataFrame]:
    """As ``cached``; an entry counts only if it holds n outputs (SRC-19)."""
    return cached(prompts, cache.where(F.size(outputs) == n), key)


def merge_cache(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union of both where the stored value wins."""
    return stored.unionByName(new.join(stored, key, "left_anti"))


def update_or_drop(samples: DataFrame, kept: DataFrame, key: str, value: str) -> DataFrame:
    """Values replaced by their kept subset, rows whose subset is empty dropped, unclassified rows as they are (JON-08)."""
    other = kept.select(key, F.col(value).alias("__kept"), F.lit(True).alias("__seen"))
    out = samples.join(other, key, "left").where(F.col("__seen").isNull() | (F.size("__kept") > 0))
    return out.withColumn(value, F.coalesce("__kept", value)).drop("__kept", "__seen")


def ordered_pairs(df: DataFrame, group: str, item: str) -> DataFrame:
    """Ordered pairs of different items of a group (JON-14)."""
    a, b = df.select(group, F.col(item).alias("i")), df.select(group, F.col(item).alias("j"))
    return a.join(b, group).where("i <> j")


def knn_vote(neighbours: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Retrieval decision by labelled neighbours (JON-16): rows (query_id, retrieve).

    d = positive minus negative among the neighbours, total = the same over the training set of n. With a
    negative total retrieval is the rule unless d < 0 and d <= int(total k / n); else it needs d > 0 and
    d >= int(total k / n). int truncates toward zero.
    """
    sums = labels.agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(-1)).alias("total"), F.count("*").alias("n"))
    d = neighbours.join(labels.withColumnRenamed("id", "doc_id"), "doc_id").groupBy("query_id").agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(-1)).alias("d"))
    out = d.crossJoin(F.broadcast(sums))  # one row
    bound = (F.col("total") * k / F.col("n")).cast("int")
    rule = F.when(F.col("total") < 0, ~((F.col("d") < 0) & (F.col("d") <= bound))).otherwise((F.col("d") > 0) & (F.col("d") >= bound))
    return out.select("query_id", "d", rule.alias("retrieve"))


def allocate_spans(tokens: DataFrame, units: DataFrame, group: str) -> DataFrame:
    """Mean score of each unit, a token's score shared equally by the units its characters cover (JON-18).

    tokens: (group, token, start, end, score); units: (group, unit, start, end), ends exclusive.
    """
    t, u = tokens.alias("t"), units.alias("u")
    hit = t.join(u, (F.col(f"t.{group}") == F.col(f"u.{group}")) & (F.col("t.start") < F.col("u.end")) & (F.col("u.start") < F.col("t.end")))
    share = F.col("t.score") / F.count("*").over(Window.partitionBy(f"t.{group}", "t.token"))
    return hit.select(F.col(f"u.{group}").alias(group), "u.unit", share.alias("s")).groupBy(group, "unit").agg(F.avg("s").alias("score"))


def differing(a: DataFrame, b: DataFrame, key: str, value: str, tolerance: float = 1e-4) -> DataFrame:
    """Keys whose values differ by at least the tolerance (JON-19)."""
    other = b.select(key, F.col(value).alias("other"))
    return a.join(other, key).where(F.abs(F.col(value) - F.col("other")) >= tolerance).select(key, value, "other")
