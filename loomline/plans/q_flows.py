"""Queries of HTML trees, fuzzy matching, composite flows and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import fuzzy as Z
from ..functions import html as H
from ..functions import reasoning as G
from ..hooks import extractive_generator
from ..operators import retrieval as R
from ..streaming import events as E
from . import flows as P
from .catalogue import query
from .tables import table


def asked(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def searcher(spark, d, k=3):
    docs = table(spark, d, "documents")
    return lambda q: R.bm25(docs, q, k)


@query("html_main_text")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.main_text_udf(container="article")(F.col("html")).alias("text"))


@query("html_infobox")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(H.infobox_udf()(F.col("html"))).alias("sections"))


@query("html_tables")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(H.tables_udf()(F.col("html"))).alias("tables"))


@query("html_generic_page")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", H.generic_page_udf(F.col("html")).alias("p")).select("page_id", "p.text", F.size("p.cards").alias("cards"), F.size("p.tables").alias("tables"))


@query("fuzzy_token_set")
def _(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    nxt = table(spark, d, "benchmark").select((F.col("item_id") + 1).alias("item_id"), F.col("text").alias("b"))
    return items.join(nxt, "item_id").select("item_id", F.round(Z.pair_udf(Z.token_set_ratio)("a", "b"), 4).alias("ratio"))


@query("fuzzy_partial")
def _(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.col("text").alias("a"))
    return items.select("item_id", F.round(Z.pair_udf(Z.partial_ratio)("a", F.substr("a", F.lit(5), F.lit(40))), 4).alias("ratio"))


@query("compression_rank")
def _(spark, d):
    return R.compression_top_k(table(spark, d, "documents"), asked(spark, d), 3)


@query("reasoning_step_merge")
def _(spark, d):
    c = table(spark, d, "conversations")
    origin = F.concat(F.lit("Step 1: "), F.left("text", F.lit(20)), F.lit("\nStep 2: b\nStep 3: c"))
    return c.select("conv_id", "turn", G.merge_steps_udf(origin, F.lit("Step 2: DELETE THIS STEP\nStep 4: d")).alias("steps"))


@query("math_canonical")
def _(spark, d):
    return table(spark, d, "orders").select("o_orderkey", G.canonical_math_udf(F.concat((F.col("o_orderkey") % 9).cast("string"), F.lit("/"), (F.col("o_orderkey") % 7 + 1).cast("string"))).alias("v"))


@query("nested_value_tokens")
def _(spark, d):
    return table(spark, d, "events").select("event_id", G.nested_tokens_udf(F.col("props")).alias("tokens"))


@query("flow_retrieve_and_read")
def _(spark, d):
    return P.retrieve_and_read(asked(spark, d), table(spark, d, "documents"), searcher(spark, d), extractive_generator).select("query_id", "answer")


@query("flow_branch_and_vote")
def _(spark, d):
    return P.branch_and_vote(asked(spark, d), searcher(spark, d)(asked(spark, d)), table(spark, d, "documents"), extractive_generator)


@query("flow_search_agent")
def _(spark, d):
    last_line = lambda t: F.try_element_at(F.split(t, "\n"), F.lit(-1))
    return P.search_agent(asked(spark, d), table(spark, d, "documents"), searcher(spark, d), last_line, limit=2, turns=3).select("query_id", F.size("executed").alias("searches"), "turns", "finish_reason")


@query("flow_align_evidence")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    ev = table(spark, d, "documents").select(F.col("doc_id").alias("ev_id"), F.col("source").alias("title"), F.substr("text", F.lit(10), F.lit(120)).alias("content"))
    return P.align_evidence(ev, docs, R.hash_embedding)


@query("flow_build_corpus")
def _(spark, d):
    pages = table(spark, d, "pages").withColumn("title", F.regexp_extract("html", "<title>(.*?)</title>", 1)).withColumn("html", F.replace(F.replace("html", F.lit("<article>"), F.lit('<div class="mw-parser-output">')), F.lit("</article>"), F.lit("</div>")))
    return P.build_corpus(pages, pages.select("title"))


@query("flow_prune_tokens")
def _(spark, d):
    return P.prune_tokens(P.self_information(table(spark, d, "documents")), 0.5)


@query("token_self_information", r"WITH t AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '')) AS w FROM documents), c AS (SELECT w, count(*) AS n FROM t GROUP BY 1) SELECT doc_id AS id, round(avg(-ln(n / (SELECT sum(n) FROM c))), 4) AS mean FROM t JOIN c USING (w) GROUP BY 1")
def _(spark, d):
    return P.self_information(table(spark, d, "documents")).groupBy("id").agg(F.round(F.avg("score"), 4).alias("mean"))


@query("flow_sentence_budget")
def _(spark, d):
    return P.sentence_budget(table(spark, d, "documents"), 60)


@query("flow_extractive_refine")
def _(spark, d):
    q = asked(spark, d)
    return P.extractive_refine(searcher(spark, d)(q), q, table(spark, d, "documents"), R.token_overlap_score, 3)


@query("compress_json_fields", "SELECT event_id, '{\"k\":\"' || (props->>'k') || '\"}' AS v FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", P.compress_json(F.col("props"), {"k": 1.0}).alias("v"))


@query("standardise_samples", "SELECT doc_id AS pos, left(text, 10) AS question, lang AS category FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents WHERE left(text, 10) <> '') WHERE r <= 40")
def _(spark, d):
    raw = table(spark, d, "documents").select(F.lit(0).alias("src_idx"), F.col("doc_id").alias("pos"), F.to_json(F.struct(F.left("text", F.lit(10)).alias("question"), F.col("source").alias("dataset"), F.col("lang").alias("category"))).alias("raw"))
    return P.standardise(raw, ["question", "dataset", "category"], 40).select("pos", "question", "category")


@query("flatten_proofs", "SELECT conv_id AS id, 'text' AS kind, text AS content FROM conversations")
def _(spark, d):
    proof = F.struct(F.lit("text").alias("proof_type"), "text", F.lit(None).cast("string").alias("key"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("array<array<string>>").alias("rows"), F.lit(None).cast("string").alias("section"))
    g = table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(proof).alias("proofs"))
    return P.flatten_proofs(g.select("id", F.array(F.struct(F.array(F.struct(F.col("proofs").alias("proof"))).alias("extension_answer"))).alias("answer_list")))


# Streams (extras), in batch form


@query("events_tumbling", "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def _(spark, d):
    return E.tumbling(table(spark, d, "events"))


@query("events_sessions", "SELECT user_id, min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS \"end\", count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s")
def _(spark, d):
    return E.sessions(table(spark, d, "events"))
