"""Queries of deduplication, id assignment, aggregation and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dedupe as D
from ..operators import ids as I
from ..operators import shape as H
from .catalogue import query
from .tables import table


@query("set_union_sources", "SELECT doc_id AS id, text, 0 AS src_idx FROM documents UNION ALL SELECT item_id, text, 1 FROM benchmark")
def _(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    return D.union_sources(a, b)


@query("set_append_with_ids", "SELECT doc_id AS id FROM documents UNION ALL SELECT 599 + row_number() OVER (ORDER BY item_id) FROM benchmark")
def _(spark, d):
    new = I.with_position(table(spark, d, "benchmark").select("item_id"), ["item_id"], "id", 600).select("id")
    return table(spark, d, "documents").select(F.col("doc_id").alias("id")).union(new)


@query("set_keep_first", "SELECT doc_id, h FROM (SELECT doc_id, md5(text) AS h, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def _(spark, d):
    return D.keep_first(table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), ["h"], ["doc_id"])


@query("set_exact_distinct", "SELECT DISTINCT sha1(text) AS h, lang FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select(F.sha1("text").alias("h"), "lang").distinct()


@query("set_parse_once", "SELECT p.page_id, t.n FROM pages p JOIN (SELECT title, length(html) AS n FROM (SELECT regexp_extract(html, '<title>(.*?)</title>', 1) AS title, html, row_number() OVER (PARTITION BY regexp_extract(html, '<title>(.*?)</title>', 1) ORDER BY page_id) AS r FROM pages) WHERE r = 1) t ON t.title = regexp_extract(p.html, '<title>(.*?)</title>', 1)")
def _(spark, d):
    p = table(spark, d, "pages").withColumn("title", F.regexp_extract("html", "<title>(.*?)</title>", 1))
    once = D.keep_first(p.select("title", "page_id", F.length("html").cast("long").alias("n")), ["title"], ["page_id"]).select("title", "n")
    return p.join(once, "title").select("page_id", "n")


@query("set_id_conflicts", "WITH e AS (SELECT doc_id, 'src_' || lpad((doc_id % 300)::VARCHAR, 6, '0') AS id, source, md5(text) AS h FROM documents), f AS (SELECT *, first_value(source || h) OVER (PARTITION BY id ORDER BY doc_id) AS f FROM e) SELECT doc_id, CASE WHEN source || h = f THEN id ELSE 'new_' || lpad(n::VARCHAR, 6, '0') END AS new_id FROM (SELECT *, sum(CASE WHEN source || h = f THEN 0 ELSE 1 END) OVER (ORDER BY doc_id) AS n FROM f)")
def _(spark, d):
    e = table(spark, d, "documents").select("doc_id", F.format_string("src_%06d", F.col("doc_id") % 300).alias("id"), "source", F.md5("text").alias("h"))
    return D.resolve_id_conflicts(e, "id", ["source", "h"], ["doc_id"]).select("doc_id", "new_id")


@query("set_sample_ids", "SELECT id, lang FROM (SELECT row_number() OVER (ORDER BY doc_id) AS id, lang FROM documents) WHERE lang <> 'en'")
def _(spark, d):
    return I.with_position(table(spark, d, "documents").select("doc_id", "lang"), ["doc_id"], "id", 1).where("lang <> 'en'").select("id", "lang")


@query("set_kind_counters", "SELECT doc_id, lang || '_' || lpad((row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::VARCHAR, 6, '0') AS id FROM documents")
def _(spark, d):
    docs = I.with_group_position(table(spark, d, "documents").select("doc_id", "lang"), "lang", ["doc_id"])
    return docs.select("doc_id", F.format_string("%s_%06d", "lang", "pos").alias("id"))


@query("set_split_merge", "SELECT doc_id, CASE WHEN lang = 'en' THEN upper(source) ELSE source END AS source FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source")
    return D.split_merge(docs, F.col("lang") == "en", lambda x: x.withColumn("source", F.upper("source")), ["doc_id"]).select("doc_id", "source")


@query("set_batches", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch FROM documents")
def _(spark, d):
    return I.batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 64)


@query("set_replace_ids", "SELECT l_orderkey, array_to_string(list_transform(list_sort(list(l_partkey)), lambda x: CASE WHEN x = 7 THEN -1 ELSE x END), ',') AS ids FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    ids = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_partkey")).alias("ids"))
    return ids.select("l_orderkey", F.array_join(D.replace_in_list(F.col("ids"), F.lit(7), F.lit(-1).cast("long")), ",").alias("ids"))


@query("set_rebuild_ids", "SELECT conv_id, array_to_string(list(turn::VARCHAR ORDER BY turn) FILTER (WHERE role = 'assistant'), ',') AS ids FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') > 0")
def _(spark, d):
    evs = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("evs"))
    ids = F.transform(F.filter("evs", lambda e: e["role"] == "assistant"), lambda e: e["turn"].cast("string"))
    return evs.select("conv_id", F.array_join(F.filter(ids, lambda x: x.isNotNull() & (x != "")), ",").alias("ids")).where("ids <> ''")


@query("set_multiset", "WITH a AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), b AS (SELECT source, count(*) AS n FROM documents WHERE lang <> 'en' GROUP BY 1) SELECT source, greatest(coalesce(a.n, 0), coalesce(b.n, 0)) AS either, CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE least(a.n, b.n) END AS common FROM a FULL JOIN b USING (source)")
def _(spark, d):
    docs = table(spark, d, "documents")
    a = docs.where("lang = 'en'").groupBy("source").agg(F.count("*").alias("n"))
    b = docs.where("lang <> 'en'").groupBy("source").agg(F.count("*").alias("n"))
    either = D.multiset_union(a, b, ["source"]).withColumnRenamed("n", "either")
    return either.join(D.multiset_intersection(a, b, ["source"]).withColumnRenamed("n", "common"), "source", "left").na.fill(0, ["common"])


@query("set_wrap_evidence", "SELECT conv_id, turn, n FROM (SELECT conv_id, turn, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def _(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.collect_list("turn").alias("ids"))
    wrapped = F.transform("ids", lambda i: F.struct(i.alias("turn"), F.col("ids").alias("content")))
    return g.select("conv_id", F.explode(wrapped).alias("e")).select("conv_id", "e.turn", F.size("e.content").cast("long").alias("n"))


@query("set_cap_per_category", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents) WHERE r <= 30")
def _(spark, d):
    return D.cap_per_key(table(spark, d, "documents").select("doc_id", "source"), "source", ["doc_id"], 30)


# Aggregations


def _kinds(spark, d):
    """Lines as evidences: returned ones are tables, the others texts."""
    return table(spark, d, "lineitem").select("l_orderkey", F.when(F.col("l_returnflag") == "R", "table").when(F.col("l_returnflag") == "A", "infobox").otherwise("text").alias("kind"))


KINDS = "(SELECT l_orderkey, CASE l_returnflag WHEN 'R' THEN 'table' WHEN 'A' THEN 'infobox' ELSE 'text' END AS kind FROM lineitem)"
CATEGORY = "CASE WHEN t >= 2 AND x >= 2 THEN 'multi-table + multi text' WHEN t >= 2 THEN 'multi-table' WHEN t = 1 AND x >= 2 THEN 'single table+multi text' WHEN x >= 2 THEN 'multi-text' END"


@query("agg_type_histogram", f"SELECT l_orderkey, kind, count(*) AS n FROM {KINDS} GROUP BY ALL")
def _(spark, d):
    return _kinds(spark, d).groupBy("l_orderkey", "kind").agg(F.count("*").alias("n"))


@query("agg_question_category", f"SELECT l_orderkey, {CATEGORY} AS category FROM (SELECT l_orderkey, count(*) FILTER (WHERE kind <> 'text') AS t, count(*) FILTER (WHERE kind = 'text') AS x FROM {KINDS} GROUP BY 1) WHERE {CATEGORY} IS NOT NULL")
def _(spark, d):
    from ..operators.aggregates import question_category

    return question_category(_kinds(spark, d), "l_orderkey", "kind")


@query("agg_category_report", f"SELECT c.category, count(l_orderkey) AS n FROM (VALUES ('multi-table + multi text'), ('multi-table'), ('single table+multi text'), ('multi-text'), ('none')) c(category) LEFT JOIN (SELECT l_orderkey, {CATEGORY} AS category FROM (SELECT l_orderkey, count(*) FILTER (WHERE kind <> 'text') AS t, count(*) FILTER (WHERE kind = 'text') AS x FROM {KINDS} GROUP BY 1)) q USING (category) GROUP BY 1")
def _(spark, d):
    from ..operators.aggregates import CATEGORIES, category_report, question_category

    return category_report(question_category(_kinds(spark, d), "l_orderkey", "kind"), "category", [*CATEGORIES, "none"])


@query("agg_grouped_and_overall", "SELECT coalesce(source, 'overall') AS domain, count(*) AS n, round(avg(quality), 6) AS quality, round(avg(toxic), 6) AS toxic FROM (SELECT source, quality, toxic FROM labels JOIN documents USING (doc_id)) GROUP BY GROUPING SETS ((source), ())")
def _(spark, d):
    from ..operators.aggregates import grouped_and_overall

    rows = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return grouped_and_overall(rows, "source", ["quality", "toxic"], "domain")


@query("agg_valid_answers", "SELECT count(*) FILTER (WHERE quality = 1) || ' of ' || count(*) AS valid, round(1000.0 * 12.5 / count(*), 4)::DOUBLE AS ms FROM labels")
def _(spark, d):
    return table(spark, d, "labels").agg(F.concat(F.count_if(F.col("quality") == 1).cast("string"), F.lit(" of "), F.count("*").cast("string")).alias("valid"), F.round(F.lit(1000.0) * 12.5 / F.count("*"), 4).alias("ms"))


@query("agg_all_pass", "SELECT l_orderkey, l_linenumber, l_quantity > 5 AND l_discount < 0.08 AS ok FROM lineitem")
def _(spark, d):
    results = F.array((F.col("l_quantity") > 5).cast("int"), (F.col("l_discount") < 0.08).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.forall(results, lambda x: x > 0).alias("ok"))


PASS = "(SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag <> 'N') AS c FROM lineitem GROUP BY 1)"


@query("agg_pass_at_k", f"SELECT l_orderkey, round(CASE WHEN c = 0 THEN 0.0 WHEN n - c < 2 THEN 1.0 ELSE 1 - list_reduce(list_transform(range(n - c + 1, n + 1), lambda i: 1.0::DOUBLE - 2.0::DOUBLE / i), lambda a, b: a * b) END, 6)::DOUBLE AS p FROM {PASS} WHERE n >= 2")
def _(spark, d):
    from ..functions.metrics import pass_at_k

    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").cast("int").alias("n"), F.count_if(F.col("l_returnflag") != "N").cast("int").alias("c")).where("n >= 2")
    return g.select("l_orderkey", F.round(pass_at_k(F.col("n"), F.col("c"), 2), 6).alias("p"))


@query("agg_prompt_tokens", r"SELECT round(avg(len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))), 4) AS mean_tokens FROM documents")
def _(spark, d):
    from ..functions.chunks import word_count

    return table(spark, d, "documents").agg(F.round(F.avg(word_count(F.col("text"))), 4).alias("mean_tokens"))


@query("agg_pair_row_sum", "SELECT a.s_nationkey AS q, a.s_suppkey AS item, count(*) FILTER (WHERE a.s_acctbal > b.s_acctbal) AS wins FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY ALL")
def _(spark, d):
    from ..operators.lookup import ordered_pairs

    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("q"), F.struct("s_suppkey", "s_acctbal").alias("it"))
    pairs = ordered_pairs(s, "q", "it")
    return pairs.groupBy("q", F.col("i.s_suppkey").alias("item")).agg(F.count_if(F.col("i.s_acctbal") > F.col("j.s_acctbal")).alias("wins"))


@query("agg_weighted_vote", "SELECT q, answer FROM (SELECT o_custkey AS q, o_orderpriority AS answer, row_number() OVER (PARTITION BY o_custkey ORDER BY round(sum(o_totalprice), 2) DESC, o_orderpriority) AS r FROM orders GROUP BY 1, 2) WHERE r = 1")
def _(spark, d):
    from ..operators.aggregates import weighted_vote

    return weighted_vote(table(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_totalprice").toDF("q", "answer")


@query("agg_chain_doc_frequency", "SELECT l_partkey, n, row_number() OVER (ORDER BY n DESC, l_partkey) AS rank FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1) QUALIFY rank <= 100")
def _(spark, d):
    from pyspark.sql import Window as W

    n = table(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(100)
    return n.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "l_partkey")).cast("long"))


@query("agg_inverted_positions", "SELECT source, array_to_string(list(doc_id ORDER BY doc_id), ',') AS positions FROM documents GROUP BY source")
def _(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.array_join(F.array_sort(F.collect_list("doc_id")).cast("array<string>"), ",").alias("positions"))


@query("agg_usage_provenance", "SELECT l_partkey, count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(F.size(F.collect_set(F.struct("l_returnflag", "l_linestatus"))).cast("long").alias("n"))


@query("agg_label_counter", "SELECT count(*) FILTER (WHERE quality = 1) AS pos, count(*) FILTER (WHERE quality = 0) AS neg FROM labels")
def _(spark, d):
    return table(spark, d, "labels").agg(F.count_if(F.col("quality") == 1).alias("pos"), F.count_if(F.col("quality") == 0).alias("neg"))


@query("agg_difficulty_totals", "SELECT count(*) AS total, count(DISTINCT o_custkey) AS users, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END)::BIGINT AS urgent, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '5-LOW'), 4) AS low FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.agg(F.count("*").alias("total"), F.count_distinct("o_custkey").alias("users"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.round(F.avg(F.when(F.col("o_orderpriority") == "5-LOW", F.col("o_totalprice"))), 4).alias("low"))


@query("agg_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.35), 4) AS p FROM lineitem WHERE NOT isnan(l_extendedprice) GROUP BY 1")
def _(spark, d):
    lines = table(spark, d, "lineitem").where("NOT isnan(l_extendedprice)")
    return lines.groupBy("l_returnflag").agg(F.round(F.percentile("l_extendedprice", 0.35), 4).alias("p"))


@query("agg_word_scores", "SELECT l_orderkey, w AS word, round(avg(l_discount), 6) AS score FROM (SELECT *, sum(CASE WHEN l_returnflag = 'N' OR l_linenumber = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS w FROM lineitem) GROUP BY ALL")
def _(spark, d):
    from ..operators.aggregates import word_scores

    lines = table(spark, d, "lineitem").withColumn("start", (F.col("l_returnflag") == "N") | (F.col("l_linenumber") == 1))
    return word_scores(lines, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], "start", "l_discount")


@query("agg_context_score", "SELECT l_orderkey, round(avg(m), 6) AS score FROM (SELECT l_orderkey, l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def _(spark, d):
    per = table(spark, d, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_discount").alias("m"))
    return per.groupBy("l_orderkey").agg(F.round(F.avg("m"), 6).alias("score"))


@query("agg_weighted_percentile", "SELECT l_returnflag, round(quantile_cont(l_discount, 0.6), 6) AS cut FROM (SELECT l_returnflag, l_discount, unnest(range(l_quantity::BIGINT)) FROM lineitem) GROUP BY 1")
def _(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.percentile("l_discount", 0.6, F.col("l_quantity").cast("long")), 6).alias("cut"))


@query("agg_attribute_pivot", "SELECT event_id, 'k=' || (props->>'k') || ',type=' || event_type AS attributes FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    eav = e.select("event_id", F.lit("type").alias("key"), F.col("event_type").alias("s"), F.lit(None).cast("long").alias("i")).union(e.select("event_id", F.lit("k"), F.lit(None).cast("string"), F.get_json_object("props", "$.k").cast("long")))
    out = H.pivot_attributes(eav, "event_id", "key", ["s", "i"])
    return out.select("event_id", F.array_join(F.transform(F.map_entries("attributes"), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("attributes"))


@query("merge_datasets", "SELECT id, kind, category FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY src, id) AS r FROM (SELECT 0 AS src, doc_id AS id, lang AS kind, source AS category FROM documents UNION ALL SELECT 1, item_id, 'bench', 'src1' FROM benchmark)) WHERE r <= 60")
def _(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("category"))
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.lit("bench").alias("kind"), F.lit("src1").alias("category"))
    return D.cap_per_key(D.union_sources(a, b), "category", ["src_idx", "id"], 60).select("id", "kind", "category")
