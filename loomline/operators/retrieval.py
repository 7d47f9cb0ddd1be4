"""Lexical and vector retrieval, fusion, quotas and reranking. Results are rows (query_id, doc_id, score, ..)."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from heapq import heappush, heappushpop

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from .ids import checkpointed


def top_k(scored: DataFrame, k: int, by: list[str] = ("query_id",), score: str = "score", tie: str = "doc_id", name: str = "rank") -> DataFrame:
    """The k best rows of each group, ties to the smaller tie column (WIN-01); the limit is pushed below the shuffle."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), tie)
    return scored.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def postings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, term, tf, dl) of every term of every document."""
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    return words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_col: str = "query", k1: float = 1.2, b: float = 0.9, small: int = 20_000) -> DataFrame:
    """Top k documents of each query by BM25 (RET-01).

    Only words that some query holds are shuffled, once, by document: its scores are summed and the best of each task
    chosen where its words are. Corpus statistics come from all documents. The words of at most ``small`` queries are
    broadcast; beyond that the joins shuffle.
    """
    words = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("w"))
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(F.array_distinct(tokens(F.col(query_col)))).alias("term"))
    wanted = asked.select("term").union(asked.sparkSession.range(1).select(F.lit(""))).distinct()
    few = F.broadcast if queries.limit(small + 1).count() <= small else lambda side: side
    marked = F.concat(F.coalesce("w", F.array().cast("array<string>")), F.array(F.lit("")))  # one empty term a document, for the statistics
    said = words.select("doc_id", F.size("w").alias("dl"), F.explode(marked).alias("term")).join(few(wanted), "term", "left_semi")
    tf = said.repartition("doc_id").groupBy("doc_id", "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"), F.avg("dl").alias("dl"))
    of_all = lambda c: F.max(F.when(F.col("term") == "", F.col(c)))
    stats = df.agg(of_all("df").cast("double").alias("n_docs"), of_all("dl").alias("avgdl"))
    idf = F.ln(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = asked.join(df.select("term", "df"), "term").crossJoin(F.broadcast(stats)).select("term", "query_id", "avgdl", idf.alias("idf"))  # stats: one row
    hits = tf.join(few(weights), "term")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 4).alias("score"))
    return top_k(scored, k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))), F.lit(0.0), lambda acc, x: acc + x))


def normalize(v: Column) -> Column:
    """Unit length; zero vectors stay (RET-05)."""
    length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return let(lambda a, n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))), v, length)


def similarity(metric: str, a: Column, b: Column) -> Column:
    """ip, cosine distance turned round, or negated L2 (RET-03): more is nearer."""
    if metric == "ip":
        return dot(a, b)
    if metric == "cosine":
        return dot(normalize(a), normalize(b))
    if metric == "l2":
        return -l2(a, b)
    raise ValueError(f"unknown metric {metric}")


def _nearest(metric: str, k: int, exclude_self: bool, kind: str):
    """Of each group's queries (rows of part 0, first) the k best of its rows (part 1, in blocks), scored exactly.

    A block meets the queries in one float32 product, whose error is bounded from the lengths of the vectors; only
    pairs that may come among the k best are scored in double precision. Of rows read in the order of their ids a
    later one loses a tie, so a large group of equals costs no more than others.
    """
    last = np.iinfo(np.int64).max

    def matrix(raw: bytes, d: int) -> np.ndarray:
        return np.frombuffer(raw, kind).astype(np.float64).reshape(-1, d)

    def where(hit: np.ndarray) -> np.ndarray:
        """Positions of the few that are true, by words of eight."""
        if len(hit) % 8:
            return np.flatnonzero(hit)
        word = np.flatnonzero(hit.view(np.uint64))
        i, j = np.nonzero(hit.reshape(-1, 8)[word])
        return word[i] * 8 + j

    def coarse(v: np.ndarray, n: np.ndarray, rows: bool) -> np.ndarray:
        """Vectors whose product is the similarity, or for l2 half of what the squared distance lacks of the query's square."""
        if metric == "cosine":
            v = v / np.maximum(n, 1e-300)[:, None]
        elif metric == "l2":
            v = np.hstack([v, -(n**2)[:, None] / 2 if rows else np.ones((len(v), 1))])
        return v

    class Group:
        def __init__(self) -> None:
            self.parts: list[tuple[np.ndarray, np.ndarray]] = []
            self.ids, self.seen = np.zeros(0, np.int64), np.iinfo(np.int64).min

        def ready(self) -> None:
            self.ids, self.v = (np.concatenate(x) for x in zip(*self.parts, strict=True))
            self.parts = []
            self.n = np.linalg.norm(self.v, axis=1)
            self.c = coarse(self.v, self.n, False)
            self.c_n = np.linalg.norm(self.c, axis=1)
            self.best = np.full((len(self.ids), k), -np.inf)
            self.at = np.full((len(self.ids), k), last)

        def score(self, q: np.ndarray, x: np.ndarray, n: np.ndarray, at: np.ndarray) -> np.ndarray:
            out = np.empty(len(q))
            for i in range(0, len(q), 65_536):
                a, b, j = self.v[q[i : i + 65_536]], x[at[i : i + 65_536]], slice(i, i + 65_536)
                if metric == "l2":
                    out[j] = -np.sqrt(((a - b) ** 2).sum(axis=1))
                else:
                    out[j] = (a * b).sum(axis=1)
                if metric == "cosine":
                    out[j] = np.clip(out[j] / np.maximum(self.n[q[j]] * n[at[j]], 1e-300), -1, 1)
            return np.copysign(np.floor(np.abs(out) * 1e4 + 0.5) / 1e4, out) + 0.0

        def least(self, part: slice, kth: np.ndarray, later: bool, far: float, width: int, eps: float) -> np.ndarray:
            """What the product of a row that may enter reaches: half a unit of rounding and the product's error less."""
            to = kth + (0.49e-4 if later else -0.51e-4)
            slack = eps * (width + 8) * self.c_n[part] * far
            if metric == "l2":
                r = np.where(np.isinf(kth), np.inf, -to)
                to = np.where(r < 0, np.inf, (self.n[part] ** 2 - np.maximum(r, 0) ** 2) / 2)
            return to - slack

        def meet(self, ids: np.ndarray, x: np.ndarray, n: np.ndarray, c: np.ndarray, far: float, wide: type) -> None:
            later, eps = bool(ids.min() > self.seen), float(np.finfo(wide).eps)
            self.seen = max(self.seen, int(ids.max()))
            low = c.astype(wide)
            for i in range(0, len(self.ids), 1024):
                part = slice(i, i + 1024)
                s = self.c[part].astype(wide) @ low.T
                kth = self.best[part, -1].copy()
                if len(ids) > 4 * (k + 1) and (new := np.flatnonzero(np.isinf(kth))).size:
                    near = np.argpartition(s[new], -(k + 1), axis=1)[:, -(k + 1) :]
                    q = np.repeat(new + i, k + 1)
                    got = self.score(q, x, n, near.ravel())
                    got[~np.isfinite(got) | (exclude_self & (self.ids[q] == ids[near.ravel()]))] = -np.inf
                    kth[new] = np.sort(got.reshape(-1, k + 1), axis=1)[:, 1]
                    strict = np.where(np.isinf(self.best[part, -1]), False, later)
                else:
                    strict = np.full(len(kth), later)
                to = np.where(strict, self.least(part, kth, True, far, c.shape[1], eps), self.least(part, kth, False, far, c.shape[1], eps))
                with np.errstate(over="ignore"):
                    q, at = np.divmod(where((s >= np.nextafter(to.astype(wide), wide(-np.inf))[:, None]).ravel()), len(ids))
                q += i
                if exclude_self:
                    other = self.ids[q] != ids[at]
                    q, at = q[other], at[other]
                if not len(q):
                    continue
                got = self.score(q, x, n, at)
                kth, far_id = self.best[q, -1], self.at[q, -1]
                enter = np.isfinite(got) & ((got > kth) | (got == kth) & (ids[at] < far_id))
                q, got, at = q[enter], got[enter], ids[at[enter]]
                if len(q):
                    own = np.unique(q)
                    q = np.concatenate((np.repeat(own, k), q))
                    got, at = np.concatenate((self.best[own].ravel(), got)), np.concatenate((self.at[own].ravel(), at))
                    order = np.lexsort((at, -got, q))
                    q, got, at = q[order], got[order], at[order]
                    first = np.searchsorted(q, own)[:, None] + np.arange(k)
                    self.best[own], self.at[own] = got[first], at[first]

        def rows(self) -> pa.RecordBatch:
            found = np.isfinite(self.best)
            q = np.repeat(self.ids, k).reshape(-1, k)[found]
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(self.at[found]), pa.array(self.best[found])], ["query_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, group = None, None
        for b in batches:
            for i in range(b.num_rows):
                key, part, ids, raw, d = (b.column(c)[i].as_py() for c in ("group", "part", "ids", "vs", "d"))
                if now != key or group is None:
                    if group is not None and len(group.ids):
                        yield group.rows()
                    now, group = key, Group()
                ids, x = np.frombuffer(ids, np.int64), matrix(raw, d)
                if part == 0:
                    group.parts.append((ids, x))
                    continue
                if group.parts:
                    group.ready()
                if len(group.ids):
                    n = np.linalg.norm(x, axis=1)
                    c = coarse(x, n, True)
                    far = float(np.linalg.norm(c, axis=1).max())
                    group.meet(ids, x, n, c, far, np.float32 if max(far, group.c_n.max(), far * group.c_n.max()) < 1e30 else np.float64)
        if group is not None and len(group.ids):
            yield group.rows()

    return run


def dense_top_k(rows: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector_col: str = "embedding", query_id: str = "query_id", metric: str = "ip", block: int = 2048, exclude_self: bool = False, same: str | None = None, at_most: int = 36) -> DataFrame:
    """Exact top k of each query over all rows (RET-02), or over those whose column ``same`` has the query's value.

    The queries of a value are dealt over up to ``at_most`` groups (more beyond 65,536 queries in each), one to a task,
    and every group reads all rows of its value once, in blocks of ``block``: a task holds its queries, the k best of
    each and a block. What is shuffled are the rows, once for each group. Null vectors and values take no part.
    """
    if metric not in ("ip", "cosine", "l2"):
        raise ValueError(f"unknown metric {metric}")
    kind = "float32" if "array<float>" == dict(rows.dtypes)[vector_col] == dict(queries.dtypes)[vector_col] else "float64"
    key = F.lit("") if same is None else F.col(f"`{same}`").cast("string")

    def packed(df: DataFrame, name: str, part: int) -> DataFrame:
        v = F.col(vector_col).cast("array<float>" if kind == "float32" else "array<double>")
        df = df.select(F.col(name).cast("long").alias("id"), key.alias("key"), v.alias("v")).where("id IS NOT NULL AND key IS NOT NULL AND v IS NOT NULL")

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n = TaskContext.get().partitionId()
            size = block if part else max(1, block // 16)  # the groups get small shares of queries in turn
            for b in batches:
                ids, keys = b.column("id").to_numpy(), np.array(b.column("key").to_pylist(), object)
                vs, d = b.column("v"), len(b.column("v")[0]) if b.num_rows else 0
                m = vs.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(ids), d)
                of = np.unique(keys, return_inverse=True)[1]
                order = np.lexsort((ids, of))
                cuts = np.flatnonzero(np.diff(of[order])) + 1
                for own in np.split(order, cuts):
                    for at in range(0, len(own), size):
                        x = own[at : at + size]
                        n += 1
                        yield pa.RecordBatch.from_arrays([pa.array([keys[x[0]]], pa.string()), pa.array([n], pa.int32()), pa.array([int(ids[x[0]])]), pa.array([ids[x].tobytes()]), pa.array([m[x].tobytes()]), pa.array([d], pa.int32())], ["key", "n", "first", "ids", "vs", "d"])

        return df.mapInArrow(pack, "key string, n int, first long, ids binary, vs binary, d int").withColumn("part", F.lit(part))

    asked = queries.groupBy(key.alias("key")).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    groups = max(1, -(-asked // 65_536), min(at_most, -(-asked // 2048)))
    chunks = packed(queries, query_id, 0).withColumn("slot", F.pmod("n", F.lit(groups)))
    blocks = packed(rows, id_col, 1).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    met = chunks.unionByName(blocks).withColumn("group", F.concat_ws(" ", "slot", "key"))
    tasks = groups if same is None else max(groups, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met.repartitionById(tasks, F.pmod(F.col("slot") + F.xxhash64("key"), F.lit(tasks)).cast("int")).sortWithinPartitions("group", "part", "first")
    return top_k(met.select("group", "part", "ids", "vs", "d").mapInArrow(_nearest(metric, k, exclude_self, kind), "query_id long, doc_id long, score double"), k)


def compression_top_k(docs: DataFrame, queries: DataFrame, k: int, id_col: str = "doc_id", text_col: str = "text", query_id: str = "query_id", query_col: str = "query", block: int = 256) -> DataFrame:
    """Exact top k of each query over all documents by normalised compression distance, negated (RET-16).

    Queries go in blocks of ``block``; each text is compressed once for a block, each pair once, and a task
    passes on its own top k of each query. Null texts have no distance.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, block):
                part = b.slice(at, block)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(c).to_pylist()]) for c in ("q", "t")], ["qs", "ts"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = lambda t: len(zlib.compress(t.encode()))
        sizes: dict[str, int] = {}
        best: dict[int, list[tuple[float, int]]] = {}  # by query: a heap of (score, -document), the worst first
        for b in batches:
            for i in range(b.num_rows):
                doc, text = b.column("id")[i].as_py(), b.column("x")[i].as_py()
                y = size(text)
                for q, t in zip(b.column("qs")[i].as_py(), b.column("ts")[i].as_py(), strict=True):
                    x = sizes[t] if t in sizes else sizes.setdefault(t, size(t))
                    found = (-round((size(f"{t} {text}") - min(x, y)) / max(x, y), 6), -doc)
                    heap = best.setdefault(q, [])
                    heappush(heap, found) if len(heap) < k else heappushpop(heap, found)
        rows = [(q, -d, s) for q, heap in best.items() for s, d in heap]
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "doc_id", "score"])

    asked = queries.where(F.col(query_col).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(query_col).alias("t"))
    chunks = asked.mapInArrow(pack, "qs array<long>, ts array<string>")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("x"))
    met = rows.crossJoin(chunks)  # documents against blocks of the stated query set
    return top_k(met.mapInArrow(score, "query_id long, doc_id long, score double"), k)


def fuse_rrf(ranked: DataFrame, k: int, c: int = 60, source: str = "source") -> DataFrame:
    """Reciprocal rank fusion of ranked lists (query_id, source, doc_id, score) (WIN-05)."""
    w = Window.partitionBy("query_id", source).orderBy(F.desc("score"), "doc_id")
    r = ranked.withColumn("__r", F.row_number().over(w))
    return top_k(r.groupBy("query_id", "doc_id").agg(F.round(F.sum(1.0 / (c + F.col("__r"))), 6).alias("score")), k)


def merge_concat(ranked: DataFrame, order: list[str]) -> DataFrame:
    """Concatenated lists with the first of each (query, document) kept (SET-07)."""
    from .dedupe import keep_first

    return keep_first(ranked, ["query_id", "doc_id"], order)


def merge_raw(ranked: DataFrame, k: int) -> DataFrame:
    """Union by raw score, repeats kept (RET-07)."""
    return top_k(ranked, k, tie="doc_id")


def merge_max(ranked: DataFrame) -> DataFrame:
    """Best score of each document over iterations, rank 1 the worst, so that the best comes last (WIN-06)."""
    best = ranked.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", F.desc("doc_id"))))


def route(lists: dict[str, DataFrame], how: str, k: int) -> DataFrame:
    """Several retrievers' rows in one result: concat, rrf or raw (RET-08). Sources keep the order given."""
    tagged = None
    for i, (name, rows) in enumerate(lists.items()):
        rows = rows.select("query_id", "doc_id", "score").withColumn("source", F.lit(name)).withColumn("src_idx", F.lit(i))
        tagged = rows if tagged is None else tagged.unionByName(rows)
    if how == "rrf":
        return fuse_rrf(tagged, k)
    if how == "concat":
        return merge_concat(tagged.withColumn("neg", -F.col("score")), ["src_idx", "neg"]).drop("neg")
    if how == "raw":
        return merge_raw(tagged, k)
    raise ValueError(f"unknown merge {how}")


def quota(ranked: DataFrame, limits: dict[str, int], source: str = "source") -> DataFrame:
    """At most so many rows of each source for a query, by score (WIN-02)."""
    w = Window.partitionBy("query_id", source).orderBy(F.desc("score"), "doc_id")
    most = F.coalesce(*(F.when(F.col(source) == s, F.lit(n)) for s, n in limits.items()), F.lit(0))
    return ranked.withColumn("source_rank", F.row_number().over(w)).where(F.col("source_rank") <= most)


def rerank(ranked: DataFrame, score: Column, k: int, cap: int | None = None, source: str = "source", keep_rest: bool = True) -> DataFrame:
    """New scores, then the k best (WIN-04). Beyond ``cap`` rows of a source the old score stays, or the row goes."""
    if cap is not None:
        w = Window.partitionBy("query_id", source).orderBy(F.desc("score"), "doc_id")
        ranked = ranked.withColumn("__r", F.row_number().over(w))
        ranked = (ranked.withColumn("score", F.when(F.col("__r") <= cap, score).otherwise(F.col("score"))) if keep_rest else ranked.where(F.col("__r") <= cap).withColumn("score", score)).drop("__r")
    else:
        ranked = ranked.withColumn("score", score)
    return top_k(ranked, k)


def token_overlap_score(query: Column, doc: Column) -> Column:
    """Offline pair scorer: word-set F1 (RET-10, RET-15)."""
    q, t = F.array_distinct(tokens(query)), F.array_distinct(tokens(doc))
    common = F.size(F.array_intersect(q, t))
    return F.when(common == 0, 0.0).otherwise(2.0 * common / (F.size(q) + F.size(t)))


def jaccard_words(a: Column, b: Column) -> Column:
    """Case-sensitive word-set Jaccard, 0 when both are empty (RET-14)."""
    x, y = F.split(a, r"\s+"), F.split(b, r"\s+")
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def _rare_first(often: np.ndarray, rank: np.ndarray, least: float):
    """Of each set the words that a set like enough must share some of: the rarest of all but ``least`` of its words, and
    one more. Only 32 bits of each are kept; words that fall together add candidates and lose none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = []
            for row in b.column("h"):
                h = row.values.to_numpy()
                at = np.minimum(np.searchsorted(often, h), max(0, len(often) - 1))
                place = np.where(often[at] == h, rank[at], -1) if len(often) else np.zeros(len(h))
                h = h[np.lexsort((h, place))][: len(h) - int(np.ceil(least * len(h) - 1e-9)) + 1]
                kept.append(h.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "h"), pa.array(kept, pa.binary())], [*(c for c in b.schema.names if c != "h"), "head"])

    return run


def _sharing(least: float):
    """Pairs of a group's sets that share as many of their rarest words as sets like enough must; a group's indexed sets
    come first (side 0), then those that ask (side 1), both by size. A group without side 1 asks itself."""

    class Index:
        def __init__(self, rows: list[tuple[int, int, bytes]]) -> None:
            self.ids, self.n = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
            self.heads = [np.frombuffer(r[2], np.int32) for r in rows]
            self.p = np.array([len(h) for h in self.heads])
            self.words, of = np.unique(np.concatenate(self.heads), return_inverse=True)
            self.who = np.repeat(np.arange(len(rows)), self.p)[np.argsort(of, kind="stable")]
            self.start = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(self.words))))).tolist()
            self.size = None

        def ask(self, n: int, head: np.ndarray, after: int = 0) -> np.ndarray:
            at = np.searchsorted(self.words, head)
            at = at[self.words[np.minimum(at, len(self.words) - 1)] == head].tolist()
            if not at:
                return np.zeros(0, np.int64)
            if self.size != n:  # those who ask come by size
                self.size = n
                self.low, high = np.searchsorted(self.n, np.ceil(least * n - 1e-9)), np.searchsorted(self.n, np.floor(n / least + 1e-9), "right")
                m, p = self.n[self.low : high], self.p[self.low : high]
                self.need = np.ceil(least / (1 + least) * (n + m) - 1e-9) - np.maximum(n - len(head), m - p)
                self.need = np.maximum(self.need, 1).astype(np.int64)
            shared = np.bincount(np.concatenate([self.who[self.start[w] : self.start[w + 1]] for w in at]), minlength=len(self.ids))
            found = np.flatnonzero(shared[self.low : self.low + len(self.need)] >= self.need) + self.low
            return self.ids[found[found >= after]]

    def pairs(found: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        x, y = np.repeat([i for i, _ in found], [len(o) for _, o in found]), np.concatenate([o for _, o in found])
        x, y = x[x != y], y[x != y]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    def own(rows: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
        index = Index(rows)
        for i in range(len(rows)):
            yield int(index.ids[i]), index.ask(int(index.n[i]), index.heads[i], i + 1)

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        now, rows, index = None, [], None
        for b in batches:
            for key, alone, side, *row in zip(*(b.column(c).to_pylist() for c in ("key", "alone", "side", "id", "n", "head")), strict=True):
                if key != now:
                    if rows and now_alone:
                        yield from own(rows)
                    now, now_alone, rows, index = key, alone, [], None
                if side == 0:
                    rows.append(tuple(row))
                elif rows or index:
                    index = index or Index(rows)
                    rows = []
                    yield row[0], index.ask(row[1], np.frombuffer(row[2], np.int32))
        if rows and now_alone:
            yield from own(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for i, others in matches(batches):
            if len(others):
                held.append((i, others))
                n += len(others)
            if n >= 65_536:
                yield pairs(held)
                held, n = [], 0
        if held:
            yield pairs(held)

    return run


def jaccard_pairs(docs: DataFrame, block: list[str], least: float, id_col: str = "doc_id", text_col: str = "text", chunk: int = 32_768, often: int = 500_000) -> DataFrame:
    """Pairs (a, b, j) within a block whose word-set Jaccard reaches ``least`` above 0 (RET-14, JON-03); ids are whole numbers.

    Exact, by prefix filter: of each set the rarest words are indexed (the ``often`` most frequent words are ranked, others
    count as rare), and of pairs of sizes n, m those are candidates that share as many of them as an overlap of
    least (n + m) / (1 + least) words leaves no way around. Candidates are verified on whole sets of 64-bit word hashes.
    A block goes in chunks of about ``chunk`` texts, each pair of chunks to one task, which holds one of the two.
    """
    w = docs.select(F.col(id_col).cast("long").alias("id"), *block, F.transform(F.array_distinct(F.split(text_col, r"\s+")), lambda x: F.xxhash64(x)).alias("h")).dropna()
    ranked = w.select(F.explode("h").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "h").limit(often).toArrow()
    names = ranked.column("h").to_numpy()
    by = np.argsort(names)
    frequency = np.argsort(np.argsort(-ranked.column("n").to_numpy(), kind="stable"), kind="stable")
    heads = w.select("id", *block, F.size("h").alias("n"), "h")
    types = ", ".join(f"`{c}` {t}" for c, t in heads.dtypes if c != "h")
    heads = heads.mapInArrow(_rare_first(names[by], len(names) - frequency[by], least), f"{types}, head binary")

    large = w.groupBy(*block).agg(F.count("*").alias("n")).where(F.col("n") > chunk)  # at most rows / chunk blocks
    large = F.broadcast(large.select(*block, F.ceil(F.col("n") / chunk).cast("int").alias("chunks")))
    heads = heads.join(large, block, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    sent = heads.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    key = F.concat_ws(" ", F.xxhash64(*block), F.least("own", "other"), F.greatest("own", "other"))
    sent = sent.select(key.alias("key"), (F.col("own") == F.col("other")).alias("alone"), (F.col("own") > F.col("other")).cast("int").alias("side"), "id", "n", "head")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sent = sent.repartition(tasks, "key").sortWithinPartitions("key", "side", "n")
    pairs = checkpointed(sent.mapInArrow(_sharing(least), "a long, b long").distinct())

    sets = w.select("id", *block, "h").join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id", "left_semi")
    l = sets.select(F.col("id").alias("a"), *(F.col(c).alias(f"__{c}") for c in block), F.col("h").alias("ha"))
    r = sets.select(F.col("id").alias("b"), *block, F.col("h").alias("hb"))
    both = pairs.join(l, "a").join(r, "b")
    for c in block:
        both = both.where(F.col(f"__{c}") == F.col(c))
    j = let(lambda c, a, b: c / (a + b - c), F.size(F.array_intersect("ha", "hb")), F.size("ha"), F.size("hb"))
    return both.select("a", "b", j.alias("j")).where(F.col("j") >= least)


def linearize(kind: Column, text: Column, columns: Column, rows: Column, info: Column, most: int = 2048) -> Column:
    """Text of a document for a pair scorer: a table as four columns and three rows, a card as six items (RET-11)."""
    head = F.array_join(F.slice(columns, F.lit(1), F.lit(4)), ", ")
    body = F.array_join(F.transform(F.slice(rows, F.lit(1), F.lit(3)), lambda r: F.array_join(F.slice(r, F.lit(1), F.lit(4)), " | ")), "; ")
    items = F.array_join(F.transform(F.slice(F.map_entries(info), F.lit(1), F.lit(6)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return F.left(F.when(kind == "table", F.concat(head, F.lit("; "), body)).when(kind == "infobox", items).otherwise(text), F.lit(most))


def hash_embedding(c: Column, dim: int = 64) -> Column:
    """Deterministic feature-hashed term vector of unit length: the offline encoder (RET-04)."""
    at = F.transform(tokens(c), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)).cast("int"))
    count = lambda a: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter(a, lambda x: x == i)).cast("double"))
    return let(normalize, let(count, at))


def iterate(queries: DataFrame, search: Callable[[DataFrame], DataFrame], extend: Callable[[DataFrame, DataFrame], DataFrame], turns: int) -> DataFrame:
    """Bounded iterative retrieval: each turn's queries hold what the turn before found (RET-17)."""
    found = None
    for turn in range(turns):
        found = checkpointed(search(queries).withColumn("turn", F.lit(turn)))
        queries = extend(queries, found)
    return found
