"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the seven 7-word hashes inside a window of 13 words, the least. Equal
windows have equal anchors, so only windows whose anchor stands in two or more documents can repeat. Each
such seed is extended both ways over the run of windows that it anchors. Runs whose whole span of words
also stands in a document with a smaller id are repeats; of the other runs (first occurrences, edges of
shared passages, chance seeds) the windows are compared one by one. The first document that holds a
window holds it in a run of that second kind, so both steps together find every repeated window. Windows
are compared by 96-bit and runs by 128-bit hashes of their words; overlapping repeats make the maximal
repeats that are removed.

Rows with a null text have no words. Texts shorter than the window are kept whole. Rows with a null id
have no place in the order of documents: they are kept whole and remove nothing. Repeated rows of one
id count as the same document and never remove each other's words. Other columns pass through; those named
n_words, n_removed or kept_text are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, without
from .text import mix, rolling, rolling_min, signed, slices, split_words, starts_within, word_lanes

SEED_WORDS = 7
RUN = 32  # longer runs (one anchor over and over) are cut after so many windows


def _anchors(offsets: np.ndarray, lanes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: flat start, text and anchor."""
    seed = min(SEED_WORDS, window)
    start, doc = starts_within(offsets, window)
    least = rolling_min(rolling(lanes[0], seed), window - seed + 1) if len(start) else np.zeros(0, np.uint64)
    return start, doc, least[start]


def _seeds(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            _, doc, anchor = _anchors(*word_lanes(b.column("__text")), window)
            if not len(doc):
                continue
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
            doc, anchor = doc[new], anchor[new]
            order = np.lexsort((anchor, doc))
            doc, anchor = doc[order], anchor[order]
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])))
            doc = pa.array(doc[new])
            yield pa.RecordBatch.from_arrays([b.column("__id").take(doc), b.column("__row").take(doc), signed(anchor[new])], ["__id", "__row", "anchor"])

    return run


def _extend(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            b = b.filter(b.column("anchors").is_valid())
            if not b.num_rows:
                continue
            offsets, lanes = word_lanes(b.column("__text"))
            start, doc, anchor = _anchors(offsets, lanes, window)
            shared = b.column("anchors")
            lens = np.diff(shared.offsets.to_numpy())
            values = shared.flatten().to_numpy().view(np.uint64)
            salt = lambda d: mix(d.astype(np.uint64) + np.uint64(1))  # noqa: E731  so that anchors count for their own text only
            hit = np.isin(anchor ^ salt(doc), values ^ salt(np.repeat(np.arange(len(lens)), lens)))
            start, doc, anchor = start[hit], doc[hit], anchor[hit]
            if not len(start):
                continue
            new = np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)))
            place = np.arange(len(new)) - np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            first = np.flatnonzero(place % RUN == 0)
            place = (place % RUN).astype(np.uint64)
            w1, w2 = rolling(lanes[0], window)[start], rolling(lanes[1], window)[start]
            r1, r2 = (mix(np.add.reduceat(mix(w + place * np.uint64(0x9E3779B97F4A7C15)), first)) for w in (w1, w2))
            keys = np.empty(len(start), _WINDOW)
            keys["w1"], keys["w2"] = w1, w2 >> np.uint64(32)
            at = pa.array(doc[first])
            ends = np.append(first, len(start)).astype(np.int32) * _WINDOW.itemsize
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(keys)])
            yield pa.RecordBatch.from_arrays(
                [b.column("__id").take(at), b.column("__row").take(at), signed(r1), signed(r2), pa.array((start - offsets[doc])[first].astype(np.int32)), pa.array(np.diff(np.append(first, len(start))).astype(np.int32)), packed],
                ["__id", "__row", "r1", "r2", "start", "n", "windows"],
            )

    return run


_WINDOW = np.dtype([("w1", "<u8"), ("w2", "<u4")])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of each run."""
    for b in batches:
        n = b.column("n").to_numpy().astype(np.int64)
        keys = np.frombuffer(b"".join(b.column("windows").to_pylist()), _WINDOW)
        at = pa.array(np.repeat(np.arange(len(n)), n))
        within = np.arange(n.sum()) - np.repeat(np.concatenate(([0], n.cumsum()[:-1])), n) if len(n) else n
        start = np.repeat(b.column("start").to_numpy(), n) + within
        yield pa.RecordBatch.from_arrays(
            [b.column("__id").take(at), b.column("__row").take(at), signed(keys["w1"]), pa.array(np.ascontiguousarray(keys["w2"]).view(np.int32)), pa.array(start.astype(np.int32))],
            ["__id", "__row", "w1", "w2", "start"],
        )


def _cut(window: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            offsets, flat = split_words(b.column("__text"))
            spans = b.column("spans")
            gone = np.zeros(len(flat) + 1, np.int64)
            flat_spans = spans.flatten()
            at = flat_spans.field("start").to_numpy().astype(np.int64) + np.repeat(offsets[:-1], np.diff(spans.offsets.to_numpy()))
            np.add.at(gone, at, 1)
            np.add.at(gone, at + flat_spans.field("n").to_numpy() + (window - 1), -1)
            keep = gone[:-1].cumsum() == 0
            kept_at = np.concatenate(([0], keep.cumsum()))[offsets]
            words = pa.ListArray.from_arrays(pa.array(kept_at, pa.int32()), flat.filter(pa.array(keep)).cast(pa.string()))
            texts = pc.binary_join(words, pa.scalar(" ", pa.string()))
            n = np.diff(offsets)
            extra = [pa.array(n), pa.array(n - np.diff(kept_at)), texts]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *extra], [*names, "n_words", "n_removed", "kept_text"])

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, ws: Workspace | None = None) -> DataFrame:
    """All rows of docs with n_words, n_removed and kept_text (the kept words, joined by one space).

    A word goes if a window of ``window`` words over it also starts in a document with a smaller id.
    """
    ws = ws or Workspace(docs.sparkSession)
    docs = without(docs, "n_words", "n_removed", "kept_text")
    names = [f"in_{i}" for i in range(len(docs.columns))]  # none clashes with the columns made here
    base = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)), F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text"), F.hash(F.col(f"`{text_col}`")).alias("__row"))
    seeds = ws.save(
        base.where("__id IS NOT NULL").select("__id", "__row", "__text").mapInArrow(_seeds(window), "__id long, __row int, anchor long"), "seeds"
    )
    shared = seeds.groupBy("anchor").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi")).where("lo < hi").select("anchor")
    per_doc = ws.save(
        seeds.join(shared, "anchor", "left_semi").groupBy("__id", "__row").agg(F.collect_list("anchor").alias("anchors")), "shared-seeds"
    )
    ws.drop(seeds)
    found = base.select("__id", "__row", "__text").join(per_doc, ["__id", "__row"], "left")
    runs = ws.save(found.mapInArrow(_extend(window), "__id long, __row int, r1 long, r2 long, start int, n int, windows binary"), "runs")
    first = runs.groupBy("r1", "r2").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi")).where("lo < hi").select("r1", "r2", "lo")
    known = ws.save(runs.join(first, ["r1", "r2"], "left").select("__id", "__row", "start", "n", F.coalesce(F.expr("lo < __id"), F.lit(False)).alias("whole"), F.expr("CASE WHEN lo < __id THEN NULL ELSE windows END").alias("windows")), "known-runs")
    ws.drop(per_doc, runs)
    windows = ws.save(known.where("NOT whole").mapInArrow(_unpack, "__id long, __row int, w1 long, w2 int, start int"), "windows")
    owner = windows.groupBy("w1", "w2").agg(F.min("__id").alias("lo"), F.max("__id").alias("hi")).where("lo < hi").select("w1", "w2", "lo")
    single = windows.join(owner, ["w1", "w2"]).where("lo < __id").select("__id", "__row", "start", F.lit(1).alias("n"))
    repeats = known.where("whole").select("__id", "__row", "start", "n").union(single)
    repeats = ws.save(repeats.groupBy("__id", "__row").agg(F.collect_list(F.struct("start", "n")).alias("spans")), "repeats")
    ws.drop(known, windows)
    out = base.join(repeats, ["__id", "__row"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<start:int,n:int>>")))
    given = [T.StructField(n, f.dataType, f.nullable) for n, f in zip(names, docs.schema.fields, strict=True)]
    schema = T.StructType([*given, T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return out.select(*names, "__text", "spans").mapInArrow(_cut(window, names), schema).toDF(*docs.columns, "n_words", "n_removed", "kept_text")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), win AS (
  SELECT doc_id, unnest(range(1, len(words) - 11)) AS s, words FROM w WHERE len(words) >= 13
), hashed AS (
  SELECT doc_id, s, array_to_string(words[s:s + 12], ' ') AS k FROM win
), first AS (
  SELECT k, min(doc_id) AS lo FROM hashed GROUP BY k HAVING min(doc_id) < max(doc_id)
), gone AS (
  SELECT DISTINCT h.doc_id, unnest(range(h.s, h.s + 13)) AS i FROM hashed h JOIN first f USING (k) WHERE f.lo < h.doc_id
), each AS (
  SELECT doc_id, len(words) AS n_words, unnest(range(1, len(words) + 1)) AS i, words FROM w
), kept AS (
  SELECT e.doc_id, e.i, e.words[e.i] AS word FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.i = g.i
), joined AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM kept GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, (len(w.words) - coalesce(j.n, 0))::BIGINT AS n_removed, sha256(coalesce(j.t, '')) AS kept_sha256
FROM w LEFT JOIN joined j USING (doc_id)
"""
