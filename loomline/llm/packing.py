"""Lexical retrieval packing into windows of token ids.

Every document is its token ids and one end id. Pieces of a full window are sequences of their own; what is
left of each document (less than a window) is packed with its lexical neighbours. The unit of retrieval is
that rest; its terms are token ids, of which there is a fixed number, so their document frequencies over
the whole corpus are one small table. Rests are ordered by their two strongest terms and dealt into ranges
of about equal size, which also cuts up any hot term; each task streams through its range and builds a BM25
inverted index for one shard of it after another. A seed (the rest of the piece cut last, else the next
unused one) queries its shard with all its terms; the unused neighbours fill the window, best first, ties and documents without
a common term in range order. The last one is cut where the window is full. Windows stay open across
shards, so only the last window of each task is short and needs padding.

Null and empty texts are the end id alone. Rows that repeat an id are packed as pieces of their own; null
ids are kept. Very long texts are cut like any other; empty tables give no sequences. Other columns of the
input play no part.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace

WINDOW = 1024
END_ID = 0
SHARD = 1024  # rests in one inverted index
TASK_TOKENS = 4 << 20
K1, B = 1.2, 0.75
BLOCK = 4096
TEXT_BYTES = 8 << 20  # of texts whose words are looked up together

#: Fixed value: the pattern by which the byte-level vocabulary splits text before its merges.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

#: A white space that the vocabulary holds as an id of its own; texts that hold it are encoded whole.
MARK = "\x0b"
#: Texts of which not every space stands between two words, or whose ends are white space.
APART = r"^(?:[\t-\r\x{85}\p{Z}]|$)|[\t-\r\x{85}\p{Z}]$| [\t-\r\x{85}\p{Z}]|[\t-\r\x{85}\p{Z}] |\x0b"


def _letters() -> dict[str, int]:
    """The printable stand-ins for bytes in a byte-level vocabulary: printable Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts under a byte-level vocabulary file.

    The vocabulary is read by ``tokenizers``; the merges run in ``tiktoken``, which gives the same ids (see
    the tests) in a sixth of the time, and ``all_ids`` runs them once for a word that recurs. The file's added tokens are plain text, or with ``added_tokens`` ids of
    their own, as the library reads them unless told otherwise: texts that hold one are left to it.
    """

    def __init__(self, path: str, added_tokens: bool = False):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary, letters = self.tokenizer.get_vocab(with_added_tokens=False), _letters()
        added = self.tokenizer.get_added_tokens_decoder() if added_tokens else {}
        self.added_texts = [t.content for t in added.values()]
        self.added = re.compile("|".join(map(re.escape, self.added_texts))) if added else None
        ranks = {bytes(letters[c] for c in t): i for t, i in vocabulary.items() if all(c in letters for c in t)}
        ranks = {t: i for t, i in ranks.items() if t != b"<|endoftext|>"}
        self.size = max([*vocabulary.values(), *added]) + 1
        self.encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.mark = ranks[MARK.encode()]

    def ids(self, text: str | None) -> np.ndarray:
        if self.added and text and self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.encoding.encode_ordinary(text or ""), "<u4")

    def all_ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, as ``ids`` gives them; a word that recurs is encoded once.

        The pattern begins a new part at a single space between two other characters, whatever stands before
        it, and its look-aheads see white space only; so such texts are encoded as their first word and, each
        with its space, the others. The distinct ones are encoded in one go between marks, and the ids of a
        text are read off by place. Texts with other spaces or added tokens, and all if few words recur, are
        encoded whole.
        """
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, APART)
        for token in self.added_texts:
            whole = pc.or_(whole, pc.match_substring(texts, token))
        split = pc.split_pattern(texts.filter(pc.invert(whole)), " ")
        ends, words = np.asarray(split.offsets), split.flatten()
        coded = words.dictionary_encode()
        firsts, distinct = words.take(pa.array(ends[:-1])), coded.dictionary
        if 2 * len(distinct) >= len(words):
            yield from (self.ids(t.as_py()) for t in texts)
            return
        marked = f"{MARK} {_joined(distinct, f'{MARK} ')}{MARK}{_joined(firsts, MARK)}{MARK}"
        found = np.array(self.encoding.encode_ordinary(marked), "<u4")
        marks = np.flatnonzero(found == self.mark)
        at = np.array(coded.indices)
        at[ends[:-1]] = len(distinct) + np.arange(len(firsts))
        starts, many = (marks[:-1] + 1)[at], np.diff(marks)[at] - 1
        past = np.append(0, np.cumsum(many))
        i = 0
        for t, alone in zip(texts, whole.to_pylist(), strict=True):
            if alone:
                yield self.ids(t.as_py())
                continue
            lo, hi = ends[i], ends[i + 1]
            yield found[np.repeat(starts[lo:hi] - past[lo:hi], many[lo:hi]) + np.arange(past[lo], past[hi])]
            i += 1


@lru_cache(maxsize=2)
def encoder(path: str, added_tokens: bool) -> Encoder:
    """One for all tasks of a process."""
    return Encoder(path, added_tokens)


def _joined(words: pa.Array, by: str) -> str:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), by)[0].as_py()


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about TEXT_BYTES."""
    size = np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)
    part = (np.cumsum(size) - size) // TEXT_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(size)]
    yield from zip(cuts[:-1], cuts[1:], strict=True) if len(size) else ()


def _tokenize(path: str, window: int, added_tokens: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, added_tokens)
        small = np.uint16 if encode.size <= 1 << 16 else np.uint32
        documents = np.zeros(-(-encode.size // BLOCK) * BLOCK, np.int64)  # in whose rest each id stands
        for b in batches:
            for lo, hi in _slices(b.column(1)):
                out: list[tuple] = []
                for doc, ids in zip(b.column(0)[lo:hi].to_pylist(), encode.all_ids(b.column(1)[lo:hi]), strict=True):
                    ids = np.append(ids, np.uint32(END_ID))
                    n = len(ids)
                    out += [(doc, s, window, zlib.crc32(ids[s : s + window]), n, None) for s in range(0, n - window + 1, window)]
                    if n % window:
                        s = n - n % window
                        rest = ids[s:].astype(small)
                        documents[_terms(rest)[0]] += 1
                        out.append((doc, s, n - s, None, n, rest.tobytes()))
                cols = list(zip(*out, strict=True))
                none = pa.nulls(len(out), pa.int32()), pa.nulls(len(out), pa.binary())
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:5]), pa.array(cols[5], pa.binary()), *none], list(_WRITTEN))
        blocks = documents.reshape(-1, BLOCK)
        used = np.flatnonzero(blocks.any(axis=1))
        none = [*[pa.nulls(len(used), pa.int64())] * 5, pa.nulls(len(used), pa.binary())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(used, pa.int32()), pa.array([blocks[i].tobytes() for i in used], pa.binary())], list(_WRITTEN))

    return run


_WRITTEN = {"doc_id": "long", "start": "long", "length": "long", "ids_crc32": "long", "doc_tokens": "long", "ids": "binary", "block": "int", "counts": "binary"}


def _terms(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts."""
    s = np.sort(ids, kind="stable")
    bounds = np.concatenate(([0], np.flatnonzero(s[1:] != s[:-1]) + 1, [len(s)]))
    return s[bounds[:-1]], bounds[1:] - bounds[:-1]


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for block, counts in zip(b.column("block").to_pylist(), b.column("counts"), strict=True):
            add = np.frombuffer(counts.as_buffer(), np.int64)
            total[block] = total[block] + add if block in total else add
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], ["block", "counts"])


def _weights(ids: np.ndarray, idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray]:
    terms, tf = _terms(ids)
    return terms, (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean))).astype(np.float32)


def _keyed(idf: np.ndarray, mean: float, small: str):
    """Adds the order of the rests: their strongest and second term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = []
            for ids in b.column("ids"):
                terms, w = _weights(np.frombuffer(ids.as_buffer(), small), idf, mean)
                one = int(w.argmax())
                w[one] = -1
                keys.append(int(terms[one]) << 32 | int(terms[w.argmax()]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(keys, pa.int64())], [*b.schema.names, "key"])

    return run


class _Packer:
    """Fills one window after another from the shards of a task."""

    def __init__(self, window: int, idf: np.ndarray, mean: float, small: str):
        self.window, self.idf, self.mean, self.small = window, idf, mean, small
        self.sequence, self.filled, self.out = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32, 0, []

    def place(self, row: tuple, ids: np.ndarray, begin: int) -> int:
        """Put a rest from ``begin`` on into the window; how far it got."""
        end = min(len(ids), begin + self.window - self.filled)
        doc, start, doc_tokens = row
        self.out.append((doc, start + begin, end - begin, zlib.crc32(ids[begin:end].astype("<u4").tobytes()), doc_tokens, self.sequence, self.filled))
        self.filled += end - begin
        if self.filled == self.window:
            self.sequence, self.filled = self.sequence + 1, 0
        return end

    def shard(self, rows: list[tuple], texts: list[np.ndarray]) -> None:
        n = len(rows)
        found = [_weights(ids, self.idf, self.mean) for ids in texts]
        lens = [len(t) for t, _ in found]
        terms, weights = np.concatenate([t for t, _ in found]), np.concatenate([w for _, w in found])
        docs = np.repeat(np.arange(n), lens)
        order = np.argsort(terms, kind="stable")
        terms, docs, weights = terms[order], docs[order], weights[order]
        starts = np.append(np.flatnonzero(np.append(True, terms[1:] != terms[:-1])), len(terms))
        at_term = np.zeros(len(self.idf), np.int32)  # where each term's postings are
        at_term[terms[starts[:-1]]] = np.arange(len(starts) - 1)
        unused, first, indexed = np.ones(n, bool), 0, n
        begin = None  # (rest, where it was cut)
        while True:
            if begin is None:
                while first < n and not unused[first]:
                    first += 1
                if first == n:
                    return
                seed, at = first, 0
                unused[seed] = False
            else:
                seed, at = begin
                begin = None
            if (end := self.place(rows[seed], texts[seed], at)) < len(texts[seed]):
                begin = seed, end
                continue
            if not self.filled:
                continue
            if 4 * (left := np.count_nonzero(unused)) < 3 * indexed:  # the index lets go of used rests
                keep, indexed = unused[docs], left
                docs, weights, starts = docs[keep], weights[keep], np.append(0, np.cumsum(keep))[starts]
            ranges = at_term[found[seed][0]]
            lo, many = starts[ranges], starts[ranges + 1] - starts[ranges]
            past = np.cumsum(many)
            postings = np.repeat(lo - past + many, many) + np.arange(past[-1])
            score = np.bincount(docs[postings], weights[postings], n)
            score[~unused] = -1
            while score[d := int(score.argmax())] >= 0:
                unused[d], score[d] = False, -1
                if (end := self.place(rows[d], texts[d], 0)) < len(texts[d]):
                    begin = d, end
                if not self.filled:
                    break

    def flush(self) -> pa.RecordBatch:
        cols = list(zip(*self.out, strict=True)) or [()] * 7
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], list(_PIECE))


_PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _pack(window: int, idf: np.ndarray, mean: float, small: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(window, idf, mean, small)
        rows: list[tuple] = []
        texts: list[np.ndarray] = []
        for b in batches:
            for doc, start, doc_tokens, ids in zip(b.column("doc_id").to_pylist(), b.column("start").to_pylist(), b.column("doc_tokens").to_pylist(), b.column("ids"), strict=True):
                rows.append((doc, start, doc_tokens))
                texts.append(np.frombuffer(ids.as_py(), small))
                if len(rows) == SHARD:
                    packer.shard(rows, texts)
                    rows, texts = [], []
                    yield packer.flush()
        if rows:
            packer.shard(rows, texts)
            yield packer.flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, ws: Workspace | None = None, added_tokens: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``added_tokens``: the added tokens of the tokenizer file are read as such where a text holds them.
    """
    ws = ws or Workspace(docs.sparkSession)
    size = encoder(tokenizer_path, added_tokens).size
    small = "<u2" if size <= 1 << 16 else "<u4"
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    written = ws.save(base.mapInArrow(_tokenize(tokenizer_path, window, added_tokens), ", ".join(f"{c} {t}" for c, t in _WRITTEN.items())), "pieces")
    pieces = written.where("block IS NULL").drop("block", "counts")
    whole = pieces.where("ids IS NULL").withColumn("sequence_id", F.monotonically_increasing_id() + F.lit(1 << 62)).withColumn("offset", F.lit(0).cast("long"))
    rests = pieces.where("ids IS NOT NULL").select("doc_id", "start", "length", "doc_tokens", "ids")

    n, tokens = rests.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    counted = written.where("block IS NOT NULL").select("block", "counts").repartition(-(-size // BLOCK), "block").mapInArrow(_add_up, "block int, counts binary")
    df = np.zeros(-(-size // BLOCK) * BLOCK, np.int64)
    for r in counted.collect():  # of a fixed size: one count for each id of the vocabulary
        df[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], np.int64)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = tokens / n if n else 1.0

    keyed = rests.mapInArrow(_keyed(idf, mean, small), "doc_id long, start long, length long, doc_tokens long, ids binary, key long")
    keyed = ws.save(keyed, "rests")  # so that the ranges are drawn from the keys alone
    dealt = keyed.repartitionByRange(max(1, -(-tokens // TASK_TOKENS)), "key", "doc_id", "start").sortWithinPartitions("key", "doc_id", "start")
    packed = dealt.select("doc_id", "start", "doc_tokens", "ids").mapInArrow(_pack(window, idf, mean, small), ", ".join(f"{c} long" for c in _PIECE))
    return whole.select(*_PIECE).unionByName(packed)


def byte_bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs, byte_bpe_path(), added_tokens=True)
