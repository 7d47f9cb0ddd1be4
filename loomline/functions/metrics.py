"""Answer and ranking metrics as column expressions, and a registry of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fuzzy import lcs
from .text import let, normalize_answer


def norm_tokens(c: Column) -> Column:
    return F.filter(F.split(normalize_answer(c), " "), lambda w: w != "")


def exact_match(pred: Column, golds: Column) -> Column:
    """1 if the normalised prediction equals any gold (MET-01)."""
    return let(lambda p, all_: F.exists(all_, lambda g: normalize_answer(g) == p), normalize_answer(pred), golds).cast("int")


def regex_match(pred: Column, pattern: Column) -> Column:
    return F.call_function("rlike", pred, F.concat(F.lit("(?i)^(?:"), pattern, F.lit(")$"))).cast("int")


def contains_match(pred: Column, golds: Column) -> Column:
    """1 if the normalised prediction contains any gold (MET-02)."""
    return let(lambda p, all_: F.exists(all_, lambda g: F.contains(p, normalize_answer(g))), normalize_answer(pred), golds).cast("int")


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda arr, w: F.size(F.filter(arr, lambda x: x == w))
    return let(lambda x, y: F.aggregate(F.array_intersect(x, y), F.lit(0), lambda acc, w: acc + F.least(count(x, w), count(y, w))), a, b)


def token_scores(pred: Column, gold: Column, special: Sequence[str] = ("yes", "no", "noanswer"), empty: bool = False) -> Column:
    """Struct (f1, precision, recall) of normalised tokens; answers in ``special`` must be equal to score (MET-03).

    With ``empty`` a text without tokens counts as one empty token, so two of them agree, and a null scores 0.
    """
    known = F.array(*(F.lit(x) for x in special)).cast("array<string>")

    def scores(same: Column, p: Column, g: Column, np_: Column, ng: Column) -> Column:
        none = ((F.array_contains(known, np_) | F.array_contains(known, ng)) & (np_ != ng)) | (same == 0)
        precision, recall = same / F.nullif(F.size(p), F.lit(0)), same / F.nullif(F.size(g), F.lit(0))
        f1 = 2 * same / F.nullif(F.size(p) + F.size(g), F.lit(0))
        value = lambda v: F.coalesce(v, F.lit(0.0)) if empty else v
        return F.struct(*(F.when(none, F.lit(0.0)).otherwise(value(v)).alias(k) for k, v in (("f1", f1), ("precision", precision), ("recall", recall))))

    split = lambda c: F.split(c, " ") if empty else F.filter(F.split(c, " "), lambda w: w != "")
    texts = lambda np_, ng: let(lambda p, g: let(lambda same: scores(same, p, g, np_, ng), overlap(p, g).cast("double")), split(np_), split(ng))
    return let(texts, normalize_answer(pred), normalize_answer(gold))


def best_token_scores(pred: Column, golds: Column) -> Column:
    """Maxima over golds, taken independently of each other."""
    top = lambda each, k: F.coalesce(F.array_max(F.transform(each, lambda s: s[k])), F.lit(0.0)).alias(k)
    return let(lambda each: F.struct(top(each, "f1"), top(each, "precision"), top(each, "recall")), F.transform(golds, lambda g: token_scores(pred, g)))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased estimate that one of k draws from n generations with c correct ones passes (AGG-07)."""
    factors = F.transform(F.sequence(n - c + 1, n), lambda i: F.lit(1.0) - F.lit(float(k)) / i)
    product = F.aggregate(factors, F.lit(1.0), lambda acc, x: acc * x)
    return F.when(c == 0, F.lit(0.0)).when(n - c < k, F.lit(1.0)).otherwise(1.0 - product)


def partial_choice_credit(pred: Column, gold: Column) -> Column:
    """1 for the gold, 0.5 for a part of it, else 0 (MET-08)."""
    return F.when(pred == gold, 1.0).when((pred != "") & F.contains(gold, pred), 0.5).otherwise(0.0)


def bleu_tokens(c: Column) -> Column:
    """The 13a tokenization (MET-14)."""
    for pattern, repl in (
        ("<skipped>", ""), (r"-\n", ""), (r"\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
        (r"([{-~\[-` -&(-+:-@/])", " $1 "), (r"([^0-9])([.,])", "$1 $2 "), (r"([.,])([^0-9])", " $1 $2"), ("([0-9])(-)", "$1 $2 "),
    ):
        c = F.regexp_replace(c, pattern, repl)
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    def grams(t: Column) -> Column:
        at = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.array_join(F.slice(t, i, F.lit(n)), " "))

    return let(grams, tokens)


def rouge_n(pred: Column, gold: Column, n: int) -> Column:
    """F score of n-gram overlap (MET-06)."""
    score = lambda same, p, g: F.when(same == 0, 0.0).otherwise(2 * same / (F.size(p) + F.size(g)))
    return let(lambda p, g: let(lambda same: score(same, p, g), overlap(p, g).cast("double")), ngrams(pred, n), ngrams(gold, n))


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence, one table row at a time."""

    def table(x: Column, y: Column) -> Column:
        at = F.when(F.size(y) > 0, F.sequence(F.lit(0), F.size(y) - 1)).otherwise(F.array().cast("array<int>"))

        def row(prev: Column, w: Column) -> Column:
            def cell(acc: Column, j: Column) -> Column:
                diag = F.when(j == 0, 0).otherwise(F.coalesce(F.get(prev, j - 1), F.lit(0)))
                left = F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0))
                value = F.when(F.get(y, j) == w, diag + 1).otherwise(F.greatest(F.get(prev, j), left))
                return F.concat(acc, F.array(value))

            return F.aggregate(at, F.array().cast("array<int>"), cell)

        return F.aggregate(x, F.transform(y, lambda _: F.lit(0)), row, lambda last: F.coalesce(F.try_element_at(last, F.lit(-1)), F.lit(0)))

    return let(table, a, b)


def rouge_l(pred: Column, gold: Column) -> Column:
    score = lambda same, p, g: F.when(same == 0, 0.0).otherwise(2 * same / (F.size(p) + F.size(g)))
    return let(lambda p, g: let(lambda same: score(same, p, g), lcs_length(p, g).cast("double")), pred, gold)


@F.pandas_udf(T.DoubleType())
def rouge_l_udf(pred: pd.Series, golds: pd.Series) -> pd.Series:
    """Best rouge_l over the golds, for long texts of normalised tokens joined by spaces; 0 without golds."""

    def score(p: str, g: str) -> float:
        a, b = (p or "").split(), (g or "").split()
        same = lcs(a, b)
        return 2.0 * same / (len(a) + len(b)) if same else 0.0

    best = lambda p, gs: max((score(p, g) for g in (gs if gs is not None else ())), default=0.0)
    return pd.Series([best(p, gs) for p, gs in zip(pred, golds, strict=True)], dtype="float64")


def judge_score(c: Column, mark: str = "[[") -> Column:
    """First number after the mark (MET-07)."""
    return F.nullif(F.regexp_extract(F.substring_index(c, mark, -1), r"([0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).cast("double")


def choice_text(choices: Column, picks: Column) -> Column:
    """Texts of the chosen options, from zero-based indexes (MET-13)."""
    return F.transform(picks, lambda i: F.get(choices, i))


def outputs_equal(a: Column, b: Column) -> Column:
    """Outputs equal line by line, outer white space aside (MET-11)."""
    clean = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?m)^\s+|\s+$", ""), r"\n+", "\n")
    return clean(a) == clean(b)


def corpus_bleu(pairs: DataFrame, order: int = 4, smooth: bool = False) -> DataFrame:
    """One row (bleu, brevity_penalty, length_ratio) of rows with token arrays pred and gold (AGG-09)."""
    cols = [F.sum(F.size("pred")).alias("p"), F.sum(F.size("gold")).alias("g")]
    cols += [F.sum(overlap(ngrams(F.col("pred"), n), ngrams(F.col("gold"), n))).alias(f"m{n}") for n in range(1, order + 1)]
    cols += [F.sum(F.greatest(F.size("pred") - (n - 1), F.lit(0))).alias(f"t{n}") for n in range(1, order + 1)]
    sums = pairs.agg(*cols)
    add = 1.0 if smooth else 0.0
    ratio = lambda n: (F.col(f"m{n}") + add) / F.nullif(F.col(f"t{n}") + add, F.lit(0.0))
    precisions = [F.coalesce(ratio(n), F.lit(0.0)) for n in range(1, order + 1)]
    mean = F.when(F.least(*precisions) > 0, F.exp(sum((F.ln(p) for p in precisions), F.lit(0.0)) / order)).otherwise(0.0)
    length = F.col("p") / F.nullif(F.col("g"), F.lit(0))
    penalty = F.when(length > 1, 1.0).when(F.col("p") > 0, F.exp(1 - 1 / length)).otherwise(0.0)
    return sums.select((mean * penalty).alias("bleu"), penalty.alias("brevity_penalty"), length.alias("length_ratio"))


#: Metrics by name: (prediction, golds) -> column. ``register`` adds one.
METRICS: dict[str, Callable[[Column, Column], Column]] = {
    "em": exact_match,
    "acc": contains_match,
    "f1": lambda p, g: best_token_scores(p, g)["f1"],
    "precision": lambda p, g: best_token_scores(p, g)["precision"],
    "recall": lambda p, g: best_token_scores(p, g)["recall"],
    "rouge-1": lambda p, g: F.array_max(F.transform(g, lambda x: rouge_n(norm_tokens(p), norm_tokens(x), 1))),
    "rouge-2": lambda p, g: F.array_max(F.transform(g, lambda x: rouge_n(norm_tokens(p), norm_tokens(x), 2))),
    "rouge-l": lambda p, g: F.array_max(F.transform(g, lambda x: rouge_l(norm_tokens(p), norm_tokens(x)))),
    "rouge-l-long": lambda p, g: rouge_l_udf(normalize_answer(p), F.transform(g, normalize_answer)),
}


def register(name: str, make: Callable[[Column, Column], Column]) -> None:
    METRICS[name] = make


def evaluate(df: DataFrame, names: list[str], pred: str = "pred", golds: str = "golds") -> DataFrame:
    """All rows with a column for each metric; an unknown name raises (MET-12)."""
    unknown = [n for n in names if n not in METRICS]
    if unknown:
        raise KeyError(f"unknown metrics: {unknown}")
    return df.withColumns({n: METRICS[n](F.col(pred), F.col(golds)) for n in names})


def report(df: DataFrame, names: list[str]) -> DataFrame:
    """Means in long form (metric, value); 0 over no rows (AGG-04)."""
    means = df.agg(*(F.coalesce(F.avg(n), F.lit(0.0)).alias(n) for n in names))
    return means.select(F.explode(F.map_from_entries(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names)))).alias("metric", "value"))
