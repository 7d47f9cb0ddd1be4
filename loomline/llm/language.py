"""Language identification by word-first backoff.

A text is cut into lower-case runs of letters (of any script; marks that combine with letters, too). A word known from training scores by its log frequency in
each language; an unseen word backs off to its known character 5-grams, then 4-, 3-, 2- and 1-grams (word
ends count as a character), the first order of which any is known. The languages' scores over all words of
the whole text give the prediction, ties going to the first language in order, and the posterior its score.

The model is fitted on a bounded sample of the labelled rows (``fit_rows``, chosen by a hash of their id) and
keeps the ``words`` and ``ngrams`` (for each order) most frequent features, so its size is bounded too.

A document is kept by its prediction: ``keep_identified`` states by which share of known words.

Null texts and texts without a letter are ``und`` with score 0, as is everything if no row is labelled.
Texts in unlabelled scripts back off to no known character and get the uniform score. Null labels do not
train; rows that repeat an id are predicted one by one; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import without
from .text import mix, rolling, signed, slices, starts_within, word_lanes

FIT_ROWS = 8000
WORDS, NGRAMS = 200_000, 50_000
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
LEAST_KNOWN = 0.5  # share of known words under which a text is in none of the learned languages
SURE = 50  # words from which on more words do not make the score surer

_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_OTHER = r"[^\p{L}\p{M}]+"  # what parts words


def _letters(texts: pa.Array) -> pa.Array:
    """The letters of each text in lower case, runs of anything else as spaces.

    ASCII and the letters U+00C0 to U+00FF are dealt with byte by byte, the texts that hold any other
    character by Unicode's classes.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offset = texts.offset
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[offset : offset + len(texts) + 1]
    if texts.buffers()[2] is None or bounds[0] == bounds[-1]:
        return texts
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    data = _LETTER[raw]
    bounds = bounds - bounds[0]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    second = raw[lead + 1]
    letter = (second != 0x97) & (second != 0xB7)
    data[lead[letter]] = 0xC3
    data[lead[letter] + 1] = second[letter] + np.where(second[letter] <= 0x9E, 0x20, 0).astype(np.uint8)
    plain = np.concatenate(([0], ((raw >= 0x80) & (raw != 0xC3)).cumsum()))
    twos = np.concatenate(([0], (raw == 0xC3).cumsum()))
    # of a text within Latin-1 each byte beyond ASCII is a 0xC3 or the one after it; 0xDF has no capital there
    odd = np.flatnonzero((plain[bounds[1:]] - plain[bounds[:-1]]) != (twos[bounds[1:]] - twos[bounds[:-1]]))
    out = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(bounds), pa.py_buffer(data))
    if not len(odd):
        return out
    by_class = pc.replace_substring_regex(pc.utf8_lower(texts.take(pa.array(odd))), _OTHER, " ")
    mask = np.zeros(len(texts), bool)
    mask[odd] = True
    return pc.replace_with_mask(out, pa.array(mask), by_class)


def _distinct(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Offsets, hashes of the distinct words, the place of each word among them, and the distinct words."""
    from .text import split_words

    offsets, lanes = word_lanes(texts)
    hashes, first, place = np.unique(lanes[0], return_index=True, return_inverse=True)
    _, flat = split_words(texts)
    return offsets, hashes, place, flat.take(pa.array(first))


def _grams(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each character n-gram of each word, and the word."""
    points = np.frombuffer("".join(f"\x01{w}\x01" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    offsets = np.concatenate(([0], np.cumsum([len(w) + 2 for w in words])))
    start, word = starts_within(offsets, n)
    return rolling(mix(points + np.uint64(0x9E37)), n)[start] if len(start) else np.zeros(0, np.uint64), word


def _features(langs: list[str]):
    code = {x: i for i, x in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            offsets, hashes, place, words = _distinct(_letters(b.column("text")))
            if not len(hashes):
                continue
            lang = np.repeat([code[x] for x in b.column("lang").to_pylist()], np.diff(offsets))
            counts = np.zeros((len(hashes), len(langs)), np.int64)
            np.add.at(counts, (place, lang), 1)
            out = [(np.zeros(len(hashes), np.int8), hashes, counts)]
            words = words.to_pylist()
            for n in ORDERS:
                grams, word = _grams(words, n)
                found, at = np.unique(grams, return_inverse=True)
                sums = np.zeros((len(found), len(langs)), np.int64)
                np.add.at(sums, at, counts[word])
                out.append((np.full(len(found), n, np.int8), found, sums))
            kind, feature, count = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(kind), signed(feature), *(pa.array(count[:, i]) for i in range(len(langs)))], ["kind", "feature", *(f"c{i}" for i in range(len(langs)))])

    return run


class Model:
    """Per kind of feature: sorted hashes and the log posterior of each language."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.langs = langs
        self.tables = {}
        for kind, (feature, counts) in tables.items():
            order = np.argsort(feature)
            share = (counts + 0.1) / (counts.sum(axis=0, keepdims=True) + 1.0)
            self.tables[kind] = feature[order], np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)[order]

    def _find(self, kind: int, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known, scores = self.tables[kind]
        if not len(known):
            return np.zeros(len(features), bool), np.zeros((len(features), len(self.langs)), np.float32)
        at = np.minimum(np.searchsorted(known, features), len(known) - 1)
        return known[at] == features, scores[at]

    def words(self, hashes: np.ndarray, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Log posterior of each language for each distinct word, and whether it or an n-gram of two characters or more of it is known."""
        hit, out = self._find(0, hashes)
        sure = hit.copy()
        out = np.where(hit[:, None], out, np.float32(-np.log(max(1, len(self.langs)))))
        left = np.flatnonzero(~hit)
        texts = words.take(pa.array(left)).to_pylist()
        for n in ORDERS:
            if not len(left):
                break
            grams, word = _grams(texts, n)
            known, score = self._find(n, grams)
            count = np.bincount(word[known], minlength=len(left))
            got = count > 0
            for i in range(len(self.langs)):
                mean = np.bincount(word[known], score[known, i], minlength=len(left))[got] / count[got]
                out[left[got], i] = mean
            if n > 1:
                sure[left[got]] = True
            texts = [t for t, g in zip(texts, got, strict=True) if not g]
            left = left[~got]
        return out, sure

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and share of known words of each text."""
        offsets, hashes, place, words = _distinct(_letters(texts))
        n = np.diff(offsets)
        if not self.langs:
            return [UNKNOWN] * len(n), np.zeros(len(n)), np.zeros(len(n))
        each, sure = self.words(hashes, words)
        each = each.astype(np.float64)
        sums = np.concatenate(([0], sure[place].cumsum()))
        known = (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(n, 1)
        total = np.concatenate((np.zeros((1, len(self.langs))), each[place].cumsum(axis=0)))
        mean = (total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(n, 1)[:, None]
        scores = np.exp((mean - mean.max(axis=1, keepdims=True)) * np.minimum(n, SURE)[:, None])
        best = np.round(mean, 9).argmax(axis=1)
        score = scores[np.arange(len(n)), best] / scores.sum(axis=1)
        langs = [self.langs[i] for i in best]
        plain = pc.match_substring_regex(pc.fill_null(texts, ""), "[A-Za-z]").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~plain):
            if not any(c.isalpha() for c in texts[int(i)].as_py() or ""):
                langs[i], score[i] = UNKNOWN, 0.0
        return langs, score, known


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS, words: int = WORDS, ngrams: int = NGRAMS) -> Model:
    """Model of rows (id, text, lang), from about ``fit_rows`` of them."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL")
    n = rows.count()
    if n > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(fit_rows / n * (1 << 30)))
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    if not langs:
        return Model([], {})
    names = [f"c{i}" for i in range(len(langs))]
    found = rows.select("text", "lang").mapInArrow(_features(langs), "kind byte, feature long, " + ", ".join(f"{c} long" for c in names))
    found = found.groupBy("kind", "feature").agg(*(F.sum(c).alias(c) for c in names)).withColumn("total", sum((F.col(c) for c in names), F.lit(0))).persist()
    tables = {}
    for kind in (0, *ORDERS):
        top = found.where(F.col("kind") == kind).orderBy(F.desc("total"), "feature").limit(ngrams if kind else words).toArrow()
        tables[kind] = top["feature"].to_numpy().view(np.uint64), np.stack([top[c].to_numpy() for c in names], axis=1).reshape(-1, len(langs))
    found.unpersist()
    return Model(langs, tables)


def _predict(model: Model, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text):
            langs, score, known = model.predict(b.column(text))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(score, pa.float64()), pa.array(known, pa.float64())], [*b.schema.names, "lang_pred", "lang_score", "lang_known"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """All rows of docs with lang_pred, lang_score and lang_known, which replace columns of these names.

    lang_known is the share of the text's words that the model knows, as words or by n-grams of two
    characters or more.
    """
    docs = without(docs, "lang_pred", "lang_score", "lang_known")
    text = [c.lower() for c in docs.columns].index(text_col.lower())  # by place, so that each text is sent once
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_known", T.DoubleType())])
    return docs.mapInArrow(_predict(model, text), schema)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    return fit(docs.where(~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("id"), "text", "lang"))


def keep_identified(docs: DataFrame, least_known: float = LEAST_KNOWN) -> DataFrame:
    """The rows of documents in which a language that the model has learned is found; their columns stay as they are.

    Rejected are texts without a letter and texts of which less than ``least_known`` of the words are known to the
    model, as words or by n-grams of two characters or more: those in another script, above all. If no row is labelled
    nothing can be judged but letters, and texts that have some stay.
    """
    model = fit_documents(docs)
    if not model.langs:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    added = {"lang_pred", "lang_score", "lang_known"}
    aside = [f"__{c}" if c.lower() in added else c for c in docs.columns]  # the input's own columns of these names
    out = predict(docs.toDF(*aside), model).where(F.col("lang_pred") != UNKNOWN).where(F.col("lang_known") >= least_known)
    return out.select(*(F.col(f"`{a}`").alias(c) for a, c in zip(aside, docs.columns, strict=True)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = predict(docs.select("doc_id", "text"), fit_documents(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
