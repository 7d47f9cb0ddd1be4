"""Queries of the segmentation operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import chunks as C
from .catalogue import query
from .tables import table

SENTS = r"list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '^\s+|\s+$', '', 'g'))), lambda s: s <> '')"
WORDS = r"list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')"


def exploded(name: str, make, sql_list: str, keep=("doc_id",)):
    @query(name, f"SELECT doc_id, i - 1 AS pos, md5(l[i]) AS v FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, {sql_list} AS l FROM documents))")
    def run(spark, d):
        out = table(spark, d, "documents").select("doc_id", F.posexplode(make()).alias("pos", "s"))
        return out.select("doc_id", F.col("pos").cast("long").alias("pos"), F.md5("s").alias("v"))


exploded("chunk_sentences", lambda: C.sentences(F.col("text")), SENTS)
exploded("chunk_fixed_words", lambda: C.fixed_chunks(C.words(F.col("text")), 100), f"list_transform(range(0, len({WORDS}), 100), lambda i: array_to_string(({WORDS})[i + 1:i + 100], ' '))")
exploded("chunk_sliding_sentences", lambda: C.sliding_windows(C.sentences(F.col("text")), 6, 3), f"list_transform(list_filter(range(0, len({SENTS}), 3), lambda i: i = 0 OR i - 3 + 6 < len({SENTS})), lambda i: array_to_string(({SENTS})[i + 1:i + 6], ' '))")
exploded(
    "chunk_wrapped_words",
    lambda: C.wrapped_windows(F.col("text"), 100),
    f"list_transform(range(0, len({WORDS}), 100), lambda i: array_to_string(list_concat(({WORDS})[i + 1:i + 100], CASE WHEN len({WORDS}) > 100 THEN ({WORDS})[1:100 - len(({WORDS})[i + 1:i + 100])] ELSE [] END), ' '))",
)
exploded("chunk_strict_sentences", lambda: C.sentences_strict(F.col("text")), r"list_filter(string_split(replace(regexp_replace(regexp_replace(text, '([A-Za-z]\.)(\s)', '\1' || chr(2) || '\2', 'g'), '([.!?])\s+', '\1' || chr(1), 'g'), chr(2), ''), chr(1)), lambda s: length(s) > 5)")


@query("chunk_ids", f"SELECT doc_id || '_chunk_' || CASE WHEN i < 10 THEN '0' ELSE '' END || i AS id, doc_id AS original_id, lang, md5(l[i]) AS v FROM (SELECT doc_id, lang, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, lang, {SENTS} AS l FROM documents))")
def _(spark, d):
    out = C.with_chunk_ids(table(spark, d, "documents"), "doc_id", C.sentences(F.col("text")), ["lang"])
    return out.select("id", "original_id", "lang", F.md5("content").alias("v"))


@query("chunk_global_ids", f"SELECT row_number() OVER (ORDER BY doc_id, i) - 1 AS id, doc_id, md5(split_part(text, chr(10), 1) || chr(10) || array_to_string(w[i + 1:i + 100], ' ')) AS v FROM (SELECT doc_id, text, w, unnest(range(0, len(w), 100)) AS i FROM (SELECT doc_id, text, {WORDS} AS w FROM documents))")
def _(spark, d):
    from ..operators.ids import with_position

    parts = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"), F.posexplode(C.fixed_chunks(C.words(F.col("text")), 100)).alias("i", "c"))
    return with_position(parts, ["doc_id", "i"], "id").select("id", "doc_id", F.md5(F.concat("title", F.lit("\n"), "c")).alias("v"))


@query("chunk_pack_sentences")
def _(spark, d):
    out = table(spark, d, "documents").select("doc_id", F.posexplode(C.pack_sentences(C.sentences(F.col("text")), 100)).alias("pos", "content"))
    return out.withColumn("n_words", C.word_count(F.col("content")))


@query("chunk_recursive")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.posexplode(C.recursive_chunks(F.col("text"))).alias("pos", "content"))


@query("chunk_backing_tokens")
def _(spark, d):
    ends = F.array(F.lit("."), F.lit("?"), F.lit("!"))
    from ..functions.text import words_and_symbols

    return table(spark, d, "benchmark").select("item_id", F.posexplode(C.backing_chunks(words_and_symbols(F.regexp_replace("text", r"\.", " . ")), 20, ends)).alias("pos", "length"))


@query("chunk_snippet_context")
def _(spark, d):
    docs = table(spark, d, "documents")
    first = docs.select("doc_id", "text", F.get(C.sentences(F.col("text")), F.lit(1)).alias("snippet")).where("snippet IS NOT NULL")
    return first.select("doc_id", C.snippet_context(F.col("text"), F.col("snippet")).alias("context"))
