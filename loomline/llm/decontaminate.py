"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Items and documents are lower-cased and cut into runs of letters and digits; a shingle is five such words.
The items are partitioned by size: the class of an item with n distinct shingles is the least power of two
of at least n. Its sketch holds the k = floor(class / 4) + 1 smallest shingle hashes (bottom-k MinHash); k
exceeds the number of shingles a document may lack at a containment of 0.75, so any document that contains
the item holds a hash of its sketch: the search misses nothing, whatever the length of the document. Every
shingle of every document is looked up in the sketches. Candidates (document, item) are then verified by
exact containment, counted on the shingles themselves. Items of one to four words are one shingle of that
length and are looked up as such.

Null and empty texts hold nothing; items without a word are never found. Rows with a null id are not
reported. Rows that repeat an id count as one document. Other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, broadcast_if_small, free_name

WORDS = 5
CONTAINED = 0.75
BROADCAST_ROWS = 200_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")


def shingles_of(words: Column, k: int) -> Column:
    """The k-word shingles, in order; empty if there are fewer words."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.concat_ws(" ", *(F.get(words, i + j) for j in range(k))))


def hashes_of(words: Column, k: int) -> Column:
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(words, i + j) for j in range(k))))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = CONTAINED, ws: Workspace | None = None) -> DataFrame:
    """Rows (id, item, n_shingles, n_shared) of each item that a document contains to the threshold."""
    spark = docs.sparkSession
    ws = ws or Workspace(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).where("id IS NOT NULL AND text IS NOT NULL")
    item = items.select(F.col(f"`{item_col}`").alias("item"), words_of(F.col(f"`{item_text_col}`")).alias("w")).where("item IS NOT NULL AND size(w) > 0").distinct()
    k = F.least(F.size("w"), F.lit(WORDS))
    pieces = F.when(k == WORDS, shingles_of(F.col("w"), WORDS)).otherwise(F.array(F.concat_ws(" ", "w")))
    item = item.select("item", k.alias("k"), F.explode(F.array_distinct(pieces)).alias("shingle")).distinct()
    item = item.select("item", "k", "shingle", F.xxhash64(*(F.get(F.split("shingle", " "), F.lit(j)) for j in range(WORDS))).alias("h5"))
    item = ws.save(item.withColumn("h", F.when(F.col("k") == WORDS, F.col("h5")).otherwise(F.xxhash64("shingle", "k"))).drop("h5"), "items")

    sizes = item.groupBy("item").agg(F.count("*").alias("n"))
    size_class = F.pow(F.lit(2.0), F.ceil(F.log2(F.col("n"))))
    order = F.row_number().over(_by_hash())
    sketch = item.join(sizes, "item").withColumn("r", order).where(F.col("r") <= F.floor(size_class * (1 - threshold)) + 1).select("item", "k", "h")
    sketch = ws.save(sketch, "sketches")

    keys = broadcast_if_small(sketch.select("h", "item"), BROADCAST_ROWS)
    lengths = sorted(r["k"] for r in sketch.select("k").distinct().collect())  # at most five rows
    found = None
    for n in lengths:
        w = base.select("id", words_of(F.col("text")).alias("w"))
        if n == WORDS:
            h = w.select("id", F.explode(hashes_of(F.col("w"), n)).alias("h"))
        else:
            h = w.select("id", F.explode(shingles_of(F.col("w"), n)).alias("s")).select("id", F.xxhash64("s", F.lit(n)).alias("h"))
        met = h.join(keys, "h").select("id", "item")
        found = met if found is None else found.union(met)
    if found is None:
        return sizes.select(F.lit(0).cast("long").alias("id"), "item", F.col("n").alias("n_shingles"), F.col("n").alias("n_shared")).where("false")
    candidates = ws.save(found.distinct(), "candidates")

    picked = base.join(broadcast_if_small(candidates.select("id").distinct(), BROADCAST_ROWS), "id", "left_semi")
    wanted = broadcast_if_small(item.select("k", "shingle").distinct(), BROADCAST_ROWS)
    shared = None
    for n in lengths:
        w = picked.select("id", words_of(F.col("text")).alias("w"))  # once for each text, not for each shingle
        s = w.select("id", F.explode(shingles_of(F.col("w"), n)).alias("shingle")).withColumn("k", F.lit(n))
        s = s.join(wanted, ["shingle", "k"], "left_semi").select("id", "shingle", "k")
        shared = s if shared is None else shared.union(s)
    hits = shared.distinct().join(item.select("shingle", "k", "item"), ["shingle", "k"]).groupBy("id", "item").agg(F.count("*").alias("n_shared"))
    out = hits.join(candidates, ["id", "item"], "left_semi").join(sizes, "item").where(F.col("n_shared") >= F.lit(threshold) * F.col("n"))
    return out.select("id", "item", F.col("n").alias("n_shingles"), "n_shared")


def _by_hash():
    from pyspark.sql import Window

    return Window.partitionBy("item").orderBy("h", "shingle")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """The rows of docs that contain no item; rows with a null id stay."""
    ws = ws or Workspace(docs.sparkSession)
    out_id = free_name(docs, "__go")
    go = ws.save(contaminated(docs, items, id_col, text_col, ws=ws).select(F.col("id").alias(out_id)).distinct(), "contaminated")
    return docs.join(broadcast_if_small(go, BROADCAST_ROWS), F.col(f"`{id_col}`") == F.col(out_id), "left_anti")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    out = contaminated(docs, items)
    return out.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_shingles", "n_shared")


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL
), b AS (
  SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark
), bk AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(w[i:i + least(len(w), 5) - 1], ' '))) AS s FROM b WHERE len(w) > 0
), n AS (
  SELECT item_id, count(*) AS n FROM bk GROUP BY item_id
), dk AS (
  SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM d, (SELECT DISTINCT k FROM bk) WHERE len(w) >= k
)
SELECT dk.doc_id, bk.item_id, n.n AS n_shingles, count(*) AS n_shared
FROM dk JOIN bk ON dk.s = bk.s AND dk.k = bk.k JOIN n ON n.item_id = bk.item_id GROUP BY ALL HAVING count(*) >= 0.75 * n.n
"""
