"""Text segmentation: sentences, windows and packed chunks, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let, token_set


def sentences(c: Column) -> Column:
    """Rule sentences: split after . ! ? and white space, trimmed, without empty ones (CHK-01)."""
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")


def sentences_strict(c: Column, least: int = 5) -> Column:
    """Split after a stop that no abbreviation letter precedes; longer than ``least`` characters (CHK-10)."""
    return F.filter(F.split(c, r"(?<![A-Za-z]\.)(?<=[.!?])\s+"), lambda s: F.length(s) > least)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.size(words(c))


def starts(n: Column, step: int) -> Column:
    """0, step, 2 step, .. below n; empty for n = 0."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))


def fixed_chunks(tokens: Column, size: int) -> Column:
    """Runs of ``size`` tokens, joined (CHK-06)."""
    return let(lambda t: F.transform(starts(F.size(t), size), lambda i: F.array_join(F.slice(t, i + 1, F.lit(size)), " ")), tokens)


def sliding_windows(sents: Column, size: int, stride: int) -> Column:
    """Windows of sentences; the first that reaches the end is the last (CHK-04)."""

    def windows(s: Column) -> Column:
        n = F.size(s)
        used = F.filter(starts(n, stride), lambda i: (i == 0) | (i - stride + size < n))
        return F.transform(used, lambda i: F.array_join(F.slice(s, i + 1, F.lit(size)), " "))

    return let(windows, sents)


def wrapped_windows(c: Column, size: int = 100) -> Column:
    """Windows of ``size`` words; the last is filled up from the text's start (CHK-05)."""

    def windows(w: Column) -> Column:
        def window(i: Column) -> Column:
            part = F.slice(w, i + 1, F.lit(size))
            fill = F.when(F.size(w) > size, F.slice(w, F.lit(1), F.lit(size) - F.size(part))).otherwise(F.array().cast("array<string>"))
            return F.array_join(F.concat(part, fill), " ")

        return F.transform(starts(F.size(w), size), window)

    return let(windows, words(c))


def pack_sentences(sents: Column, most: int = 100, count: Callable[[Column], Column] = word_count, skip_empty: bool = False) -> Column:
    """Greedy packing: sentences join the open chunk while it stays within ``most`` tokens; a longer sentence
    stays whole (CHK-02). A fold over the sentences of one row, inside the JVM."""
    state = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("tokens"))

    def step(acc: Column, s: Column) -> Column:
        n = count(s)
        full = (F.size(acc["open"]) > 0) & (acc["tokens"] + n > most)
        placed = F.struct(
            F.when(full, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"]).alias("done"),
            F.when(full, F.array(s)).otherwise(F.concat(acc["open"], F.array(s))).alias("open"),
            F.when(full, n).otherwise(acc["tokens"] + n).alias("tokens"),
        )
        return F.when(n == 0, acc).otherwise(placed) if skip_empty else placed

    def finish(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) > 0, F.concat(acc["done"], F.array(F.array_join(acc["open"], " ")))).otherwise(acc["done"])

    return F.aggregate(sents, state, step, finish)


def with_chunk_ids(df: DataFrame, id_col: str, chunks: Column, keep: list[str] = ()) -> DataFrame:
    """A row for each chunk: id_chunk_nn, original_id and the columns carried along (CHK-03)."""
    out = df.select(F.col(id_col).alias("original_id"), *keep, F.posexplode(chunks).alias("chunk_pos", "content"))
    return out.withColumn("id", F.format_string("%s_chunk_%02d", F.col("original_id").cast("string"), F.col("chunk_pos") + 1))


def snippet_context(text: Column, snippet: Column, around: int = 100, head: int = 50_000, least: float = 0.2) -> Column:
    """Text around the sentence most like the snippet by word-set F1, else the text's head (CHK-09)."""

    def around_best(part: Column, query: Column) -> Column:
        def f1(t: Column) -> Column:
            common = F.size(F.array_intersect(t, query))
            return F.when(common == 0, F.lit(0.0)).otherwise(2.0 * common / (F.size(t) + F.size(query)))

        scored = F.transform(sentences(part), lambda s, i: F.struct(let(f1, token_set(s)).alias("f1"), (-i).alias("first"), s.alias("s")))

        def cut(best: Column, at: Column) -> Column:
            begin = F.greatest(F.lit(1), at - around)
            return F.when(best["f1"] > least, F.substr(part, begin, F.length(best["s"]) + around + (at - begin)))

        return let(lambda best: let(cut, best, F.call_function("instr", part, best["s"])), F.array_max(scored))

    return F.coalesce(let(around_best, F.left(text, F.lit(head)), token_set(snippet)), F.left(text, F.lit(2 * around)))


def backing_chunks(tokens: Column, most: int, ends: Column) -> Column:
    """Lengths of token chunks that back up to the last end token inside the window (CHK-11)."""
    n = F.size(tokens)
    state = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("open"), F.lit(0).alias("last_end"))

    def step(acc: Column, t: Column) -> Column:
        grown = acc["open"] + 1
        end = F.when(F.array_contains(ends, t), grown).otherwise(acc["last_end"])
        cut = F.when(end > 0, end).otherwise(grown)
        return F.when(grown < most, F.struct(acc["cuts"].alias("cuts"), grown.alias("open"), end.alias("last_end"))).otherwise(
            F.struct(F.concat(acc["cuts"], F.array(cut)).alias("cuts"), (grown - cut).alias("open"), F.lit(0).alias("last_end"))
        )

    return F.when(n == 0, F.array().cast("array<int>")).otherwise(
        F.aggregate(tokens, state, step, lambda a: F.when(a["open"] > 0, F.concat(a["cuts"], F.array(a["open"]))).otherwise(a["cuts"]))
    )


def recursive_chunks(c: Column, most: int = 400) -> Column:
    """Paragraphs, and the sentences of paragraphs longer than ``most`` characters, packed to ``most`` (CHK-07)."""
    parts = F.flatten(F.transform(F.split(c, r"\n\n|\n"), lambda p: F.when(F.length(p) > most, sentences(p)).otherwise(F.array(p))))
    return pack_sentences(F.filter(parts, lambda p: F.trim(p) != ""), most, F.length)
