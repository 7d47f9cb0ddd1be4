"""Prompts, evidence texts and decisions over model outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chunks import words
from ..functions.text import title_and_body

NO_EVIDENCE = "No relevant documents were retrieved."


def reference_text(docs: Column) -> Column:
    """``Doc i(Title: t) text`` of each document, in order (CTX-01)."""

    def one(c: Column, i: Column) -> Column:
        title, body = title_and_body(c)
        return F.concat(F.lit("Doc "), (i + 1).cast("string"), F.lit("(Title: "), title, F.lit(") "), body, F.lit("\n"))

    return F.array_join(F.transform(docs, one), "")


def middle_truncated(c: Column, most: int) -> Column:
    """First and last halves of a budget of words (CTX-02)."""
    w, half = words(c), most // 2
    return F.array_join(F.when(F.size(w) <= most, w).otherwise(F.concat(F.slice(w, F.lit(1), F.lit(half)), F.slice(w, F.lit(-half), F.lit(half)))), " ")


def evidence_text(docs: Column, most: int = 10, max_words: int | None = None) -> Column:
    """The first documents with their source tags; a fixed text without any (CTX-03)."""
    block = lambda d, i: F.concat(F.lit("Document "), (i + 1).cast("string"), F.lit(" ["), F.coalesce(d["source"], F.lit("Unknown")), F.lit("]:\n"), F.trim(d["content"]))
    out = F.array_join(F.transform(F.slice(docs, F.lit(1), F.lit(most)), block), "\n\n")
    out = F.when(out == "", F.lit(NO_EVIDENCE)).otherwise(out)
    return out if max_words is None else F.array_join(F.slice(words(out), F.lit(1), F.lit(max_words)), " ")


def payload(text: Column, info_json: Column, table_jsons: Column, most: int = 8000) -> Column:
    """Text, card and tables of a page in one text (CTX-05)."""
    card = F.when(info_json.isNotNull() & (info_json != "{}"), F.concat(F.lit("[INFOBOX]\n"), info_json))
    tabs = F.array_join(F.transform(table_jsons, lambda t, i: F.concat(F.lit("[TABLE "), (i + 1).cast("string"), F.lit("]\n"), t)), "\n\n")
    return F.left(F.concat_ws("\n\n", text, card, F.nullif(tabs, F.lit(""))), F.lit(most))


def web_documents(docs: Column, fields: list[str]) -> Column:
    """Numbered pages, one field a line (CTX-06)."""
    one = lambda d, i: F.concat(F.lit("**Web Page "), (i + 1).cast("string"), F.lit(":**\n"), *(F.concat(F.coalesce(d[f].cast("string"), F.lit("")), F.lit("\n")) for f in fields))
    return F.array_join(F.transform(docs, one), "")


def score_weights(df: DataFrame, group: str, score: str) -> DataFrame:
    """Share of each row in its group's score (CTX-12)."""
    return df.withColumn("weight", F.col(score) / F.sum(score).over(Window.partitionBy(group)))


def critique_score(relevance: Column, support: Column, utility: Column, w_rel: float = 1.0, w_sup: float = 1.0, w_use: float = 0.5) -> Column:
    """Weighted sum of relevance, support and utility from token probabilities (CTX-13)."""
    p = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0.0))
    share = lambda m, keys: sum((p(m, k) for k in keys), F.lit(0.0))
    rel = p(relevance, "[Relevant]") / F.nullif(share(relevance, ["[Relevant]", "[Irrelevant]"]), F.lit(0.0))
    sups = ["[Fully supported]", "[Partially supported]", "[No support / Contradictory]"]
    sup = (p(support, sups[0]) + 0.5 * p(support, sups[1])) / F.nullif(share(support, sups), F.lit(0.0))
    uses = [f"[Utility:{i}]" for i in range(1, 6)]
    use = sum((v * p(utility, k) for v, k in zip((-1.0, -0.5, 0.0, 0.5, 1.0), uses, strict=True)), F.lit(0.0)) / F.nullif(share(utility, uses), F.lit(0.0))
    return w_rel * F.coalesce(rel, F.lit(0.0)) + w_sup * F.coalesce(sup, F.lit(0.0)) + w_use * F.coalesce(use, F.lit(0.0))


def confidence_gate(tokens: Column, least: float) -> list[Column]:
    """Whether all tokens are surer than ``least``, and the sure ones as a query (CTX-14)."""
    sure = F.transform(F.filter(tokens, lambda t: t["p"] > least), lambda t: t["token"])
    return [F.forall(tokens, lambda t: t["p"] > least).alias("confident"), F.array_join(sure, " ").alias("query")]


def candidates(c: Column) -> Column:
    """Answers behind (a) and (b) (CTX-15)."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"\([a-b]\)\s*([^()]*)"), F.lit(1)), lambda x: F.trim(x))


def is_valid(c: Column) -> Column:
    return F.contains(F.lower(c), F.lit("true"))


def usefulness(df: DataFrame, id_col: str, evidences: str, told_json: Column) -> DataFrame:
    """A row for each evidence: e, and whether its index is in the list of useful ones (CTX-18)."""
    useful = F.coalesce(F.from_json(told_json, "useful array<int>")["useful"], F.array().cast("array<int>"))
    return df.withColumn("__u", useful).select(id_col, "__u", F.posexplode(evidences).alias("i", "e")).select(id_col, "i", "e", F.array_contains("__u", F.col("i")).alias("useful"))


def shuffled_choices(key: Column, options: Column, seed: int = 0, right: int = 0) -> list[Column]:
    """Options in an order drawn by key and seed, and the letter of the right one (CTX-17)."""
    drawn = F.array_sort(F.transform(options, lambda o, i: F.struct(F.xxhash64(key, o, F.lit(seed)).alias("h"), i.alias("i"), o.alias("o"))))
    at = F.array_position(F.transform(drawn, lambda x: x["i"]), F.lit(right))
    return [F.transform(drawn, lambda x: x["o"]).alias("options"), F.char(at.cast("int") + 64).alias("answer")]


def triples(c: Column) -> Column:
    """(head, relation, tail) of each <h; r; t>, split at the last two semicolons (CTX-10)."""
    each = F.filter(F.regexp_extract_all(c, F.lit("<([^>]*)>"), F.lit(1)), lambda t: F.size(F.split(t, ";")) >= 3)

    def parts(t: Column) -> Column:
        p = F.split(t, ";")
        n = F.size(p)
        return F.struct(F.trim(F.array_join(F.slice(p, F.lit(1), n - 2), ";")).alias("head"), F.trim(F.get(p, n - 2)).alias("relation"), F.trim(F.get(p, n - 1)).alias("tail"))

    return F.transform(each, parts)
