"""Queries of lookups, matching joins and retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as S
from ..operators import lookup as L
from ..operators import retrieval as R
from .catalogue import query
from .tables import table

TOKENS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
BM25 = f"""
WITH w AS (SELECT doc_id, {TOKENS.format('text')} AS w FROM documents),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS avgdl FROM w),
tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
q AS (SELECT item_id, unnest(list_distinct({TOKENS.format('text')})) AS term FROM benchmark),
sc AS (SELECT item_id AS query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.9 + 0.9 * dl / avgdl))), 4) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term), s GROUP BY ALL)
SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= """


def bm25(spark, d, k):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25(table(spark, d, "documents"), q, k)


@query("bm25_top5", BM25 + "5")
def _(spark, d):
    return bm25(spark, d, 5)


IP = "round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4)"


def vector_sql(score: str, k: int, where: str = "a.vec_id <> b.vec_id") -> str:
    return f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, {score} AS score FROM embeddings a, embeddings b WHERE {where})) WHERE rank <= {k}"


def dense(spark, d, k, metric, same=None):
    e = table(spark, d, "embeddings")
    asked = e.select(F.col("vec_id").alias("query_id"), "embedding", "label")
    return R.dense_top_k(e, asked, k, metric=metric, exclude_self=True, same=same)


@query("vector_ip_top5", vector_sql(IP, 5))
def _(spark, d):
    return dense(spark, d, 5, "ip")


@query("vector_cosine_top5", vector_sql("round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4)", 5))
def _(spark, d):
    return dense(spark, d, 5, "cosine")


@query("vector_l2_top5", vector_sql("-round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4)", 5))
def _(spark, d):
    return dense(spark, d, 5, "l2")


@query("vector_normalize", "SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 4) AS s FROM embeddings")
def _(spark, d):
    v = R.normalize(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4).alias("s"))


@query("nn_top1_or_insert", f"SELECT query_id, CASE WHEN score >= 0.3 THEN doc_id END AS match FROM ({vector_sql(IP, 1)})")
def _(spark, d):
    return dense(spark, d, 1, "ip").select("query_id", F.when(F.col("score") >= 0.3, F.col("doc_id")).alias("match"))


@query("nn_blocked_by_label", f"SELECT query_id, doc_id, score, rank FROM ({vector_sql(IP, 1, 'a.vec_id <> b.vec_id AND a.label = b.label')}) WHERE score >= 0.2")
def _(spark, d):
    return dense(spark, d, 1, "ip", same="label").where("score >= 0.2")


@query("knn_vote", f"WITH lab AS (SELECT vec_id AS id, CASE WHEN label < 5 THEN 1 ELSE -1 END AS s FROM embeddings), t AS (SELECT sum(s) AS total, count(*) AS n FROM lab), v AS (SELECT query_id, sum(s) AS d FROM ({vector_sql(IP, 9)}) JOIN lab ON id = doc_id GROUP BY 1) SELECT query_id, d::BIGINT AS d, CASE WHEN total < 0 THEN NOT (d < 0 AND d <= trunc(total * 9.0 / n)) ELSE d > 0 AND d >= trunc(total * 9.0 / n) END AS retrieve FROM v, t")
def _(spark, d):
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, 1).otherwise(0).alias("label"))
    return L.knn_vote(dense(spark, d, 9, "ip").select("query_id", "doc_id"), labels, 9)


LISTS = f"""(SELECT query_id, doc_id, score, 'bm25' AS source, 0 AS i FROM ({BM25}8) UNION ALL
SELECT item_id, doc_id, score, 'length', 1 FROM benchmark, (SELECT doc_id, length(text)::DOUBLE AS score FROM documents ORDER BY score DESC, doc_id LIMIT 8))"""


def lists(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.length("text").cast("double").alias("score"))
    longest = docs.orderBy(F.desc("score"), "doc_id").limit(8)  # the same list for every item: a scalar of eight rows
    longest = longest.agg(F.collect_list(F.struct("doc_id", "score"))).scalar()
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), longest.alias("found"))
    return {"bm25": bm25(spark, d, 8), "length": asked.select("query_id", F.inline("found"))}


@query("fuse_rrf", f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM {LISTS}) GROUP BY ALL)) WHERE rank <= 5")
def _(spark, d):
    return R.route(lists(spark, d), "rrf", 5)


@query("merge_concat", f"SELECT query_id, doc_id, score, source, i AS src_idx FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY i, score DESC) AS r FROM {LISTS}) WHERE r = 1")
def _(spark, d):
    return R.route(lists(spark, d), "concat", 5)


@query("merge_raw", f"SELECT query_id, doc_id, score, source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM {LISTS}) WHERE rank <= 10")
def _(spark, d):
    return R.route(lists(spark, d), "raw", 10).select("query_id", "doc_id", "score", "source")


@query("merge_max", f"SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, doc_id DESC) AS rank FROM (SELECT query_id, doc_id, max(score) AS score FROM {LISTS} GROUP BY ALL)")
def _(spark, d):
    both = lists(spark, d)
    return R.merge_max(both["bm25"].select("query_id", "doc_id", "score").union(both["length"].select("query_id", "doc_id", "score")))


@query("quota_select", f"SELECT query_id, doc_id, source, source_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS source_rank FROM {LISTS}) WHERE source_rank <= CASE source WHEN 'bm25' THEN 5 ELSE 2 END")
def _(spark, d):
    both = lists(spark, d)
    u = both["bm25"].select("query_id", "doc_id", "score", F.lit("bm25").alias("source")).union(both["length"].select("query_id", "doc_id", "score", F.lit("length")))
    return R.quota(u, {"bm25": 5, "length": 2}).select("query_id", "doc_id", "source", "source_rank")


OVERLAP = f"CASE WHEN len(list_intersect({TOKENS.format('q.text')}, {TOKENS.format('d.text')})) = 0 THEN 0 ELSE 2.0::DOUBLE * len(list_intersect(list_distinct({TOKENS.format('q.text')}), list_distinct({TOKENS.format('d.text')}))) / (len(list_distinct({TOKENS.format('q.text')})) + len(list_distinct({TOKENS.format('d.text')}))) END"


@query("rerank_overlap", f"SELECT query_id, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM (SELECT query_id, b.doc_id, round({OVERLAP}, 6) AS score FROM ({BM25}8) b JOIN benchmark q ON q.item_id = query_id JOIN documents d ON d.doc_id = b.doc_id)) WHERE rank <= 4")
def _(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    found = bm25(spark, d, 8).drop("rank").join(q, "query_id").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return R.rerank(found, F.round(R.token_overlap_score(F.col("q"), F.col("text")), 6), 4).select("query_id", "doc_id", "score", "rank")


@query("jaccard_in_block", "SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))), 4) AS j FROM (SELECT doc_id, source, lang, list_distinct(regexp_split_to_array(text, '\\s+')) AS w FROM documents) a JOIN (SELECT doc_id, source, lang, list_distinct(regexp_split_to_array(text, '\\s+')) AS w FROM documents) b ON a.source = b.source AND a.lang = b.lang AND a.doc_id < b.doc_id WHERE len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w))) >= 0.5")
def _(spark, d):
    found = R.jaccard_pairs(table(spark, d, "documents"), ["source", "lang"], 0.5)
    return found.select("a", "b", F.round("j", 4).alias("j"))


@query("linearize_documents", "SELECT o_orderkey, left('key, price; ' || o_orderkey || ' | ' || o_orderstatus, 2048) AS v FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    cols, rows = F.array(F.lit("key"), F.lit("price")), F.array(F.array(F.col("o_orderkey").cast("string"), F.col("o_orderstatus")))
    return o.select("o_orderkey", R.linearize(F.lit("table"), F.lit(""), cols, rows, F.create_map(F.lit("a"), F.lit("b"))).alias("v"))


@query("hash_embeddings")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", R.hash_embedding(F.col("text")).alias("embedding"))


@query("iterative_retrieval")
def _(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = table(spark, d, "documents")

    def extend(asked, found):
        first = found.where("rank = 1").select("query_id", "doc_id").join(docs.select("doc_id", "text"), "doc_id")
        return asked.join(first, "query_id").select("query_id", F.concat_ws(" ", "query", "text").alias("query"))

    return R.iterate(q, lambda asked: R.bm25(docs, asked, 3), extend, 2)


# Lookups


@query("lookup_last_wins", "SELECT doc_id, l.source, r.h FROM documents l JOIN (SELECT source, arg_max(md5(text), doc_id) AS h FROM documents GROUP BY 1) r USING (source)")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    right = table(spark, d, "documents").select("source", F.md5("text").alias("h"), F.col("doc_id").alias("pos"))
    return L.lookup_last(docs, right, ["source"], "pos").select("doc_id", "source", "h")


@query("hash_align", "SELECT a.doc_id AS a, min(b.doc_id) AS b FROM documents a JOIN documents b ON a.source = b.source AND sha1(a.text) = sha1(b.text) GROUP BY 1")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.sha1("text").alias("h"))
    return docs.withColumnRenamed("doc_id", "a").join(docs.groupBy("source", "h").agg(F.min("doc_id").alias("b")), ["source", "h"]).select("a", "b")


@query("contains_align", "SELECT item_id, min(doc_id) AS doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY 1")
def _(spark, d):
    return L.first_containing_anywhere(table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text")


@query("semi_used", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


@query("positional_join", "SELECT d.doc_id, b.item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents) d JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS p FROM benchmark) b USING (p)")
def _(spark, d):
    from ..operators.ids import with_position

    a = with_position(table(spark, d, "documents").select("doc_id"), ["doc_id"])
    return a.join(with_position(table(spark, d, "benchmark").select("item_id"), ["item_id"]), "pos").select("doc_id", "item_id")


@query("update_join_drop", "SELECT l_orderkey, CASE WHEN l_orderkey % 3 = 0 THEN n ELSE u END AS n FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS u FROM lineitem GROUP BY 1) WHERE l_orderkey % 3 = 0 OR u > 0")
def _(spark, d):
    g = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_quantity").alias("evs"))
    useful = g.where("l_orderkey % 3 <> 0").select("l_orderkey", F.filter("evs", lambda x: x > 25).alias("evs"))
    return L.update_or_drop(g, useful, "l_orderkey", "evs").select("l_orderkey", F.size("evs").cast("long").alias("n"))


@query("lookup_with_misses", "SELECT o_orderkey, c_name IS NOT NULL AS found FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 5 <> 0) ON o_custkey = c_custkey")
def _(spark, d):
    known = table(spark, d, "customer").where("c_custkey % 5 <> 0").select("c_custkey", "c_name")
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    hits, misses = L.cached(orders, known, "c_custkey")
    return hits.select("o_orderkey", F.lit(True).alias("found")).union(misses.select("o_orderkey", F.lit(False)))


@query("side_file_join", "SELECT o_orderkey, coalesce(c_name, '{}') AS side FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def _(spark, d):
    side = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return table(spark, d, "orders").join(side, "o_custkey", "left").select("o_orderkey", F.coalesce("c_name", F.lit("{}")).alias("side"))


@query("zip_lists", "SELECT conv_id, turn, role, length(text) AS n FROM conversations")
def _(spark, d):
    g = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    zipped = g.select("conv_id", F.explode(F.arrays_zip(F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), F.col("t.text").alias("text"))).alias("z"))
    return zipped.select("conv_id", "z.turn", "z.role", F.length("z.text").cast("long").alias("n"))


@query("fetch_by_position", "SELECT item_id, i AS rank, doc_id FROM (SELECT item_id, unnest([item_id, item_id + 7, item_id + 11]) AS pos, unnest([0, 1, 2]) AS i FROM benchmark) JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents) USING (pos)")
def _(spark, d):
    from ..operators.ids import with_position

    want = table(spark, d, "benchmark").select("item_id", F.posexplode(F.array("item_id", F.col("item_id") + 7, F.col("item_id") + 11)).alias("rank", "pos"))
    return want.join(with_position(table(spark, d, "documents").select("doc_id"), ["doc_id"]), "pos").select("item_id", "rank", "doc_id")


@query("rerank_candidates_capped", f"SELECT query_id, source, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS r FROM {LISTS}) WHERE r <= 3 GROUP BY ALL")
def _(spark, d):
    both = lists(spark, d)
    u = both["bm25"].select("query_id", "doc_id", "score", F.lit("bm25").alias("source")).union(both["length"].select("query_id", "doc_id", "score", F.lit("length")))
    return R.quota(u, {"bm25": 3, "length": 3}).groupBy("query_id", "source").agg(F.count("*").alias("n"))


@query("ordered_pairs", "SELECT a.s_nationkey AS q, a.s_suppkey AS i, b.s_suppkey AS j FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey")
def _(spark, d):
    return L.ordered_pairs(table(spark, d, "supplier").withColumnRenamed("s_nationkey", "q"), "q", "s_suppkey")


@query("seen_anti_join", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(spark, d):
    return table(spark, d, "customer").select("c_custkey").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("back_off_answers", "SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderstatus WHEN flag IS NOT NULL AND flag <> 'N' THEN flag ELSE o_orderstatus END AS answer FROM orders LEFT JOIN (SELECT l_orderkey, min(l_returnflag) AS flag FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def _(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("answer"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_returnflag").alias("answer"))
    return L.back_off(a, b, "o_orderkey", "answer", lambda c: c.isNotNull() & ~c.isin("O", "N"))


@query("span_allocation", "WITH t AS (SELECT item_id, 1 AS token, 0 AS s, 7 AS e, 0.9 AS score FROM benchmark UNION ALL SELECT item_id, 2, 7, 20, 0.4 FROM benchmark), u AS (SELECT item_id, 1 AS unit, 0 AS s, 5 AS e FROM benchmark UNION ALL SELECT item_id, 2, 5, 12 FROM benchmark UNION ALL SELECT item_id, 3, 12, 20 FROM benchmark) SELECT item_id, unit, round(avg(score / c), 6)::DOUBLE AS score FROM (SELECT t.item_id, unit, score, count(*) OVER (PARTITION BY t.item_id, token) AS c FROM t JOIN u ON t.item_id = u.item_id AND t.s < u.e AND u.s < t.e) GROUP BY ALL")
def _(spark, d):
    b = table(spark, d, "benchmark").select("item_id")
    t = b.select("item_id", F.inline(F.array(*(F.struct(F.lit(i).alias("token"), F.lit(s).alias("start"), F.lit(e).alias("end"), F.lit(x).alias("score")) for i, s, e, x in ((1, 0, 7, 0.9), (2, 7, 20, 0.4))))))
    u = b.select("item_id", F.inline(F.array(*(F.struct(F.lit(i).alias("unit"), F.lit(s).alias("start"), F.lit(e).alias("end")) for i, s, e in ((1, 0, 5), (2, 5, 12), (3, 12, 20))))))
    return L.allocate_spans(t, u, "item_id").withColumn("score", F.round("score", 6))


@query("compare_runs", "SELECT o_orderkey FROM (SELECT o_orderkey, o_totalprice AS a, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice + 0.001 ELSE o_totalprice + 0.00001 END AS b FROM orders) WHERE abs(a - b) >= 1e-4")
def _(spark, d):
    a = table(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("v"))
    b = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice") + 0.001).otherwise(F.col("o_totalprice") + 0.00001).alias("v"))
    return L.differing(a, b, "o_orderkey", "v").select("o_orderkey")


@query("nearest_exemplars", vector_sql(IP, 3))
def _(spark, d):
    return dense(spark, d, 3, "ip")


@query("cache_merge", "SELECT c_custkey AS k, 'disk' AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'new' FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 <> 0")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    return L.merge_cache(c.where("k % 2 = 0").withColumn("v", F.lit("disk")), c.where("k % 3 = 0").withColumn("v", F.lit("new")), "k")


@query("url_plan", "SELECT host, arg_min(page_id, page_id) AS first_page, count(DISTINCT page_id) > 1 AS conflict FROM (SELECT page_id, regexp_extract(url, '://([^/?#]+)', 1) AS host FROM pages) GROUP BY 1")
def _(spark, d):
    p = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"))
    return p.groupBy("host").agg(F.min("page_id").alias("first_page"), (F.count_distinct("page_id") > 1).alias("conflict"))


@query("merge_titles", "SELECT source AS title, md5(string_agg(text, ' ' ORDER BY doc_id)) AS v FROM documents GROUP BY source")
def _(spark, d):
    from ..sources.readers import merge_duplicate_titles

    docs = table(spark, d, "documents").select(F.col("source").alias("title"), "text", "doc_id")
    return merge_duplicate_titles(docs, "title", "text", "doc_id").select("title", F.md5("text").alias("v"))
