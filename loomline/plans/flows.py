"""Composite dataflows: corpus building, evidence alignment, retrieve and read, bounded loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.fuzzy import pair_udf, token_set_ratio
from ..hooks import Generator, Retriever
from ..operators.context import NO_EVIDENCE
from ..operators.ids import checkpointed, with_group_position
from ..operators.lookup import first_containing_anywhere
from ..operators.retrieval import top_k


def build_corpus(pages: DataFrame, evidences: DataFrame, title: str = "title") -> DataFrame:
    """Documents (id, kind, title, content) of the pages that evidences name: text, tables and infobox (PIP-13).

    Each title is parsed once, whatever the number of its evidences; ids count within their kind.
    """
    wanted = pages.join(evidences.select(title).distinct(), title, "left_semi")
    parsed = checkpointed(wanted.select(title, H.main_text_udf()(F.col("html")).alias("text"), H.tables_udf()(F.col("html")).alias("tables"), H.infobox_udf()(F.col("html")).alias("info")))
    text = parsed.where("text <> ''").select(title, F.lit("text").alias("kind"), F.lit(0).alias("i"), F.col("text").alias("content"))
    tables = parsed.select(title, F.lit("table").alias("kind"), F.posexplode("tables").alias("i", "t")).select(title, "kind", "i", F.to_json("t").alias("content"))
    info = parsed.where(F.size("info") > 0).select(title, F.lit("infobox").alias("kind"), F.lit(0).alias("i"), F.to_json("info").alias("content"))
    docs = with_group_position(text.unionByName(tables).unionByName(info), "kind", [title, "i"])
    return docs.select(F.format_string("%s_%d", "kind", "pos").alias("id"), "kind", title, "content")


def align_evidence(evidences: DataFrame, corpus: DataFrame, embed: Callable[[Column], Column], fuzzy: float = 85.0, near: float = 0.75, prefix: str = "new") -> DataFrame:
    """(ev_id, doc_id, how) of each evidence (ev_id, title, content) (PIP-14).

    In order: a document of the same title that contains it, or is fuzzily like it, the first in order; the
    nearest of its title by embedding; else a new document, one for each distinct content. Only evidences that no
    document contains meet all documents of their title. Evidences are matched against the corpus as given, so their order does not matter.
    """
    c = corpus.select("doc_id", F.col("title").alias("t"), F.col("content").alias("text"))
    exact = checkpointed(first_containing_anywhere(evidences, c, "ev_id", "content", "doc_id", "text", same=("title", "t")).withColumn("how", F.lit("exact")))
    rest = checkpointed(evidences.join(exact.select("ev_id"), "ev_id", "left_anti")).join(c, F.col("title") == F.col("t"))
    ratio = pair_udf(token_set_ratio)(F.lower("content"), F.lower("text"))
    alike = checkpointed(rest.where(ratio >= fuzzy).groupBy("ev_id").agg(F.min("doc_id").alias("doc_id")).withColumn("how", F.lit("fuzzy")))
    from ..operators.retrieval import dot

    rest = rest.join(alike.select("ev_id"), "ev_id", "left_anti").withColumn("score", F.round(dot(embed(F.col("content")), embed(F.col("text"))), 6))
    nearest = checkpointed(top_k(rest.where(F.col("score") >= near), 1, by=["ev_id"]).select("ev_id", "doc_id").withColumn("how", F.lit("near")))
    found = exact.unionByName(alike).unionByName(nearest)
    new = evidences.join(found.select("ev_id"), "ev_id", "left_anti").select("ev_id", F.concat(F.lit(f"{prefix}_"), F.left(F.sha1(F.concat_ws("\n", "title", "content")), F.lit(12))).alias("doc_id"), F.lit("new").alias("how"))
    return found.select("ev_id", F.col("doc_id").cast("string").alias("doc_id"), "how").unionByName(new)


def up_to(text: Column, max_chars: int | None) -> Column:
    """The whole text, or its first ``max_chars`` characters where a limit is given."""
    return text if max_chars is None else F.left(text, F.lit(max_chars))


def with_prompts(queries: DataFrame, ranked: DataFrame, docs: DataFrame, text_col: str = "text", max_chars: int | None = None) -> DataFrame:
    """Queries with a prompt of their ranked documents; a fixed text where there are none."""
    refs = ranked.join(docs.select("doc_id", up_to(F.col(text_col), max_chars).alias("__t")), "doc_id")
    each = refs.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "__t"))).alias("__d"))
    context = F.array_join(F.transform("__d", lambda x, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(":\n"), x["__t"])), "\n\n")
    out = queries.join(each, "query_id", "left").withColumn("__c", F.coalesce(context, F.lit(NO_EVIDENCE)))
    return out.withColumn("prompt", F.concat(F.lit("### Evidence\n"), "__c", F.lit("\n\n### Question\n"), "query")).drop("__d", "__c")


def retrieve_and_read(queries: DataFrame, docs: DataFrame, retrieve: Retriever, generate: Generator, refine: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Sequential flow (PIP-01): (query_id, query, prompt, answer)."""
    ranked = retrieve(queries)
    return generate(with_prompts(queries, refine(ranked) if refine else ranked, docs))


def retrieval_stage(queries: DataFrame, retrieve: Retriever, path: str) -> None:
    """First of two stages: the ranked rows as a table (PIP-02)."""
    retrieve(queries).write.mode("overwrite").parquet(path)


def reading_stage(queries: DataFrame, docs: DataFrame, generate: Generator, path: str) -> DataFrame:
    """Second stage: reads the table of the first."""
    return generate(with_prompts(queries, queries.sparkSession.read.parquet(path), docs))


def loop(state: DataFrame, step: Callable[[DataFrame, int], DataFrame], finished: Column, turns: int) -> DataFrame:
    """Bounded loop over a state table (PIP-03, PIP-05, PIP-06): the rows not finished go through each turn.

    Each turn ends in a reliable checkpoint; rows that never finish are returned with finish_reason ``turns``.
    """
    active, out = state, None
    for turn in range(turns):
        stepped = checkpointed(step(active, turn).withColumn("turns", F.lit(turn + 1)))
        done = stepped.where(finished).withColumn("finish_reason", F.lit("finished"))
        out = done if out is None else out.unionByName(done)
        active = stepped.where(~F.coalesce(finished, F.lit(False)))
        if active.isEmpty():
            break
    rest = active.withColumn("turns", F.lit(turns)) if "turns" not in active.columns else active
    return out.unionByName(rest.withColumn("finish_reason", F.lit("turns"))) if out is not None else rest.withColumn("finish_reason", F.lit("turns"))


def search_agent(queries: DataFrame, docs: DataFrame, retrieve: Retriever, ask: Callable[[Column], Column], limit: int = 3, turns: int = 4, max_chars: int | None = None) -> DataFrame:
    """Search loop with a limit and a repeat guard (PIP-06).

    ``ask`` gives a query's next search from its text so far, null to finish. Executed searches are kept in
    the state; a repeated one finishes the row.
    """
    state = queries.withColumn("text", F.col("query")).withColumn("executed", F.array().cast("array<string>")).withColumn("done", F.lit(False))

    def step(active: DataFrame, turn: int) -> DataFrame:
        asked = active.withColumn("next", ask(F.col("text")))
        stop = F.col("next").isNull() | F.array_contains("executed", F.col("next")) | (F.size("executed") >= limit)
        asked = checkpointed(asked.withColumn("stop", F.coalesce(stop, F.lit(True))))
        found = retrieve(asked.where("NOT stop").select("query_id", F.col("next").alias("query"))).where("rank = 1")
        first = found.join(docs.select("doc_id", up_to(F.col("text"), max_chars).alias("found")), "doc_id").select("query_id", "found")
        grown = asked.join(first, "query_id", "left")
        return grown.select(
            "query_id", "query",
            F.when(F.col("stop"), F.col("text")).otherwise(F.concat_ws("\n", "text", "found")).alias("text"),
            F.when(F.col("stop"), F.col("executed")).otherwise(F.array_append("executed", F.col("next"))).alias("executed"),
            F.col("stop").alias("done"),
        )

    return loop(state, step, F.col("done"), turns)


def branch_and_vote(queries: DataFrame, ranked: DataFrame, docs: DataFrame, generate: Generator, max_chars: int | None = None) -> DataFrame:
    """One prompt for each retrieved document; answers voted by retrieval score (PIP-08)."""
    from ..operators.aggregates import weighted_vote
    from ..operators.context import score_weights

    each = score_weights(ranked, "query_id", "score").join(docs.select("doc_id", up_to(F.col("text"), max_chars).alias("t")), "doc_id").join(queries, "query_id")
    asked = generate(each.withColumn("prompt", F.concat("t", F.lit("\n\n"), "query")))
    return weighted_vote(asked, "query_id", "answer", "weight")


def flatten_proofs(samples: DataFrame, id_col: str = "id", answers: str = "answer_list") -> DataFrame:
    """(id, kind, content) of every proof of every answer; a table's first row is its header (PIP-16)."""
    a = samples.select(id_col, F.explode(answers).alias("a"))
    b = a.select(id_col, F.explode("a.extension_answer").alias("b"))
    p = b.select(id_col, F.explode("b.proof").alias("p")).select(id_col, "p.*")
    table = F.to_json(F.struct(F.get("rows", F.lit(0)).alias("columns"), F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0))).alias("rows")))
    card = F.to_json(F.create_map(F.coalesce("section", F.lit("")), F.create_map(F.coalesce("key", F.lit("")), F.coalesce("value", F.lit("")))))
    content = F.when(F.col("proof_type") == "table", table).when(F.col("proof_type") == "infobox", card).otherwise(F.col("text"))
    return p.select(id_col, F.col("proof_type").alias("kind"), content.alias("content"))


def standardise(raw: DataFrame, drop: list[str], cap: int) -> DataFrame:
    """Samples (src_idx, pos, raw JSON) to the common schema, categories capped in arrival order (PIP-15)."""
    from ..functions.text import first_truthy
    from ..operators.dedupe import cap_per_key
    from ..operators.shape import residual

    j = F.from_json("raw", "question string, seed_question string, dataset string, answer string, category string")
    out = raw.withColumn("j", j).select("src_idx", "pos", first_truthy(F.col("j.seed_question"), F.col("j.question")).alias("question"), F.col("j.dataset").alias("dataset"), F.col("j.answer").alias("answer"), F.col("j.category").alias("category"), residual(F.col("raw"), drop).alias("meta"))
    return cap_per_key(out.where("question IS NOT NULL"), "category", ["src_idx", "pos"], cap)


def self_information(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, token, score = -ln p(token)) with p from the whole corpus: the offline token scorer (CTX-08)."""
    from ..functions.text import tokens

    t = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "token"))
    counts = t.groupBy("token").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    scored = counts.crossJoin(F.broadcast(total)).select("token", (-F.ln(F.col("n") / F.col("total"))).alias("score"))  # one row
    return t.join(scored, "token").select("id", "pos", "token", "score")


def prune_tokens(scored: DataFrame, keep: float) -> DataFrame:
    """Tokens at or above the (1 - keep) percentile of their document's scores, in order (CTX-08, AGG-18)."""
    each = scored.groupBy("id").agg(F.percentile("score", 1 - keep).alias("cut"), F.array_sort(F.collect_list(F.struct("pos", "token", "score"))).alias("all"))
    kept = F.filter("all", lambda x: x["score"] >= F.col("cut"))
    return each.select("id", F.array_join(F.transform(kept, lambda x: x["token"]), " ").alias("text"))


def compress_json(c: Column, rates: dict[str, float], default: float = 1.0) -> Column:
    """Each value of a JSON object cut to its key's share of words (CTX-09)."""
    from ..functions.chunks import words

    rate = lambda k: F.coalesce(*(F.when(k == n, F.lit(r)) for n, r in rates.items()), F.lit(default))
    cut = lambda k, v: F.array_join(F.slice(words(v), F.lit(1), F.ceil(F.size(words(v)) * rate(k)).cast("int")), " ")
    return F.to_json(F.transform_values(F.from_json(c, "map<string,string>"), cut))


def sentence_budget(docs: DataFrame, budget: int, factor: float = 1.4, bonus: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sentences by their number of words (a hundredth each), first and last with a bonus, until the budget is spent, in
    document order (WIN-18). No model scores them."""
    from ..functions.chunks import sentences, word_count
    from ..operators.windows import within_budget

    s = docs.select(F.col(id_col).alias("id"), F.posexplode(sentences(F.col(text_col))).alias("pos", "s"))
    last = F.max("pos").over(Window.partitionBy("id"))
    score = word_count(F.col("s")) / F.lit(100.0) + F.when((F.col("pos") == 0) | (F.col("pos") == F.col("last")), bonus).otherwise(0.0)
    scored = s.withColumn("last", last).withColumn("score", score).withColumn("n", word_count(F.col("s")))
    kept = within_budget(scored, ["id"], [F.desc("score"), "pos"], "n", budget * factor)
    return kept.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "s"))), lambda x: x["s"]), " ").alias("text"))


def extractive_refine(ranked: DataFrame, queries: DataFrame, docs: DataFrame, score: Callable[[Column, Column], Column], k: int) -> DataFrame:
    """The k sentences most like the query over its documents, in their order (CTX-07)."""
    from ..functions.chunks import sentences_strict

    s = ranked.join(docs.select("doc_id", "text"), "doc_id").join(queries, "query_id").select("query_id", "query", "rank", F.posexplode(sentences_strict(F.col("text"))).alias("pos", "s"))
    s = s.withColumn("score", F.round(score(F.col("query"), F.col("s")), 6))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "pos")
    top = s.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    return top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "pos", "s"))), lambda x: x["s"]), " ").alias("context"))
