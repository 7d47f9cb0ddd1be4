"""N-gram Jaccard join over distinct word shingles, by token-combination prefixes.

Each text becomes the set of its distinct 5-word shingles (64-bit hashes of the lower-cased words); texts
with equal sets become one node. Two sets of n and n' link if their similarity is 0.75 or more, that is if
7 d <= n + n' for the number d of shingles in which they differ; so neither lacks more than a quarter of its
own in the other.

1. What stands in no other set is lacking in every partner. Of any part of its shingles, a set that can link
   has at most n / 4 that no other set shares within their parts of equal making. Sets are first judged by
   their n / 4 + n / 8 + 4 shingles of smallest hash, and what is left by all its shingles.
2. The shingles of the sets that are left are put in one order, by the number of sets that hold them and then
   by hash. The first shingle that two partners share is among the first n / 4 + 1 of both (the prefix). If it
   is rare, in RARE sets or less, the pair meets under this single shingle.
3. Otherwise the two share no rare shingle: with x and x' rare ones, and hot parts of h and h' shingles that
   differ in e, d = x + x' + e, and they link if 7 e <= h + h' - 6 (x + x'). So only sets with x <= n / 4 come
   here. Sets of equal hot part need no pairs: the one of least x links to all that any of them links to.
   Different hot parts are indexed by combinations: the frequent shingles are dealt into p classes by hash,
   and a set's shingles of one class make one key, of k = h / p shingles on average. Parts that differ in
   fewer shingles than they fill classes agree in a whole filled class, so a pair that may differ in e is
   looked for at the level p with e < 2 p / 3, under p keys. (A part that fills too few classes has keys for
   its empty classes too.)

Candidates are verified by the exact size of their intersection. Within groups of one combined key the
members are first compared with one centre (few rare shingles first), the links found are contracted, and
this repeats while it links; of what is left, pairs of different components meet under their level's keys if
x and h alone allow a link. No link between different texts is lost; copies are never paired.

Null and empty texts have no shingles and no links; texts of under five words are one shingle. Rows that
repeat an id count as one document with the union of their links. Rows with a null id are dropped. Ids must
cast to long; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, broadcast_if_small, components, free_name
from .text import mix, rolling, signed, slices, starts_within, word_lanes

WORDS = 5
RARE = 32  # sets that hold a shingle which is indexed alone
HEAD = 8  # least keys of a level by which a pair is met once; changes no result
STAR_ROUNDS = 4  # of contraction, before the pairs of different components are met; changes no result
BROADCAST_ROWS = 500_000


def shingle_sets(texts: pa.Array, words: int = WORDS) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    offsets, lanes = word_lanes(texts, lower=True)
    lane = lanes[0]
    start, doc = starts_within(offsets, words)
    all_ = rolling(lane, words)[start] if len(start) else np.zeros(0, np.uint64)
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for i, n in enumerate(np.diff(offsets)):
        if n >= words:
            out.append(np.unique(all_[bounds[i] : bounds[i + 1]]))
        elif n:  # the whole sequence; its length keeps it apart from longer shingles
            out.append(mix(rolling(lane[offsets[i] : offsets[i + 1]], int(n)) ^ np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _node(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


def _lists(arrays: list[np.ndarray], mask: list[bool] | None = None) -> pa.Array:
    """Lists of longs; null where the mask says so."""
    offsets = pa.array(np.concatenate(([0], np.cumsum([len(a) for a in arrays]))), pa.int32(), mask=None if mask is None else np.array([*mask, False]))
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(offsets, signed(flat))


def _longs(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False).view(np.uint64)


def _first(n: int) -> int:
    return min(n, n // 4 + n // 8 + 4)


_FIRST = "least(n, n div 4 + n div 8 + 4)"


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of this task: copies need their first shingles only once
        for b in slices(batches, "__text"):
            sets = shingle_sets(b.column("__text"), words)
            nodes = [_node(s) for s in sets]
            skip = []
            for s, node in zip(sets, nodes, strict=True):
                skip.append(len(s) < 3 or node in seen)  # under three shingles only equal sets can link
                seen.add(node)
            first = [s[: 0 if k else _first(len(s))] for s, k in zip(sets, skip, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(nodes, pa.int64()), _lists(first, skip)], ["id", "n", "node", "first"])

    return run


def _full_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__text"):
            sets = shingle_sets(b.column("__text"), words)
            yield pa.RecordBatch.from_arrays([pa.array([_node(s) for s in sets], pa.int64()), _lists(sets)], ["node", "shingles"])

    return run


def _arrange(rare: int):
    """Of sets (node, n, shared shingles with their counts): the rare part of the prefix and the hot part."""
    names = ["node", "n", "alone", "x", "rare", "shared", "hot", "hot_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i in range(b.num_rows):
                node, n = b.column("node")[i].as_py(), b.column("n")[i].as_py()
                pairs = b.column("counted")[i].values
                key, count = pairs.field("key").to_numpy(zero_copy_only=False).view(np.uint64), pairs.field("df").to_numpy(zero_copy_only=False)
                alone = n - len(key)
                if 4 * alone > n:
                    continue
                order = np.lexsort((key, count))
                n_rare = int((count <= rare).sum())
                prefix = key[order[: min(n_rare, n // 4 + 1 - alone)]]
                hot = np.sort(key[order[n_rare:]])
                x = alone + n_rare
                wide = 4 * x <= n and len(hot) > 0
                rows.append((node, n, alone, x, prefix, np.sort(key), hot if wide else hot[:0], _node(hot) if wide else None))
            if rows:
                node, n, alone, x, prefix, key, hot, hot_id = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node, pa.int64()), *(pa.array(v, pa.int32()) for v in (n, alone, x)), *(_lists(list(v)) for v in (prefix, key, hot)), pa.array(hot_id, pa.int64())], names
                )

    return run


def combinations(hot: np.ndarray, x: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a hot part, and the level p of each: all that a partner without rare shingles could need."""
    most = (len(hot) - 3 * x) // 3  # the most shingles in which a partner's hot part may differ
    top = 4
    while 2 * top // 3 - 1 < most:
        top *= 2
    place, value = mix(hot ^ np.uint64(0x5851F42D4C957F2D)), mix(hot)
    total, filled = np.zeros(top, np.uint64), np.zeros(top, bool)
    at = (place & np.uint64(top - 1)).astype(np.int64)
    np.add.at(total, at, value)
    filled[at] = True
    keys, levels, p = [], [], top
    while p >= 4 and most > 0:
        use = filled if filled.sum() >= 2 * p // 3 else np.ones(p, bool)
        at = np.flatnonzero(use).astype(np.uint64)
        keys.append(mix(total[use] ^ mix(at + np.uint64(p << 32))))
        levels.append(np.full(len(at), p, np.int32))
        p //= 2
        total, filled = total[:p] + total[p:], filled[:p] | filled[p:]
    return (np.concatenate(keys), np.concatenate(levels)) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int32))


def _combinations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for start in range(0, b.num_rows, 256):
            part = b.slice(start, 256)
            out = [combinations(_longs(part.column("hot"), i), x) for i, x in enumerate(part.column("x").to_pylist())]
            lens = [len(k) for k, _ in out]
            each = [pa.array(np.repeat(part.column(c).to_numpy(), lens)) for c in ("rep", "x", "h")]
            yield pa.RecordBatch.from_arrays([signed(np.concatenate([k for k, _ in out])), pa.array(np.concatenate([p for _, p in out])), *each], ["key", "level", "rep", "x", "h"])


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (a, b) with the size of the intersection of their sorted sets x and y."""
    for b in batches:
        common = []
        for i in range(b.num_rows):
            xs, ys = _longs(b.column("x"), i), _longs(b.column("y"), i)
            at = np.searchsorted(xs, ys)
            common.append(int((xs[np.minimum(at, len(xs) - 1)] == ys).sum()))
        yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(common, pa.int64())], ["a", "b", "common"])


def _intersect(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows (a, b, common) of pairs (a, b); the set of b travels to that of a."""
    ys, xs = sets.toDF("b", "y"), sets.toDF("a", "x")
    return pairs.select("a", "b").join(ys, "b").join(xs, "a").select("a", "b", "x", "y").mapInArrow(_common, "a long, b long, common long")


def _survivors(ws: Workspace, both: DataFrame) -> DataFrame:
    """Nodes (node, n) whose first shingles do not rule out every link."""
    first = both.where("first IS NOT NULL")
    keys = first.select("node", F.explode("first").alias("key"))
    shared = ws.save(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key"), "shared-keys")
    met = keys.join(shared, "key", "left_semi").groupBy("node").agg(F.count("*").alias("met"))
    times = first.groupBy("node").agg(F.count("*").alias("times"), F.first("n").alias("n"))
    alive = ws.save(times.join(met, "node").where(f"4 * ({_FIRST} - met div times) <= n").select("node", "n"), "survivors")
    ws.drop(shared)
    return alive


def _may_link(a: str, b: str) -> Column:
    """Whether x and h of two different hot parts allow a link."""
    h, g, x, y = (F.col(c) for c in (f"{a}.h", f"{b}.h", f"{a}.x", f"{b}.x"))
    return 7 * F.greatest(F.lit(1), F.abs(h - g)) <= h + g - 6 * (x + y)


def _rare_links(ws: Workspace, arranged: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of sets that share a rare shingle."""
    index = ws.save(arranged.select("node", "n", "alone", F.posexplode("rare").alias("at", "key")).select("key", "node", "n", (F.col("alone") + F.col("at")).alias("at")), "rare-keys")
    l, r = index.alias("l"), index.alias("r")
    size = (F.col("l.node") < F.col("r.node")) & (4 * F.least("l.n", "r.n") >= 3 * F.greatest("l.n", "r.n"))
    # the first shingle that two sets share has all the others behind it in both
    rest = 7 * F.least(F.col("l.n") - F.col("l.at"), F.col("r.n") - F.col("r.at")) >= 3 * (F.col("l.n") + F.col("r.n"))
    pairs = l.join(r, (F.col("l.key") == F.col("r.key")) & size & rest).select(F.col("l.node").alias("a"), F.col("r.node").alias("b"), (F.col("l.n") + F.col("r.n")).alias("both"))
    pairs = ws.save(pairs.distinct(), "rare-pairs")
    done = _intersect(pairs, sets).join(pairs, ["a", "b"]).where("7 * common >= 3 * both")
    return ws.save(done.select("a", "b"), "rare-links")


def _hot_links(ws: Workspace, arranged: DataFrame) -> DataFrame:
    """Links (a, b) of sets that share no rare shingle, up to paths: of each class of sets with equal hot part and x one."""
    wide = arranged.where("hot_id IS NOT NULL").select("node", "x", "hot_id", F.size("hot").alias("h"))
    least = wide.groupBy("hot_id").agg(F.min("x").alias("least"))
    wide = wide.join(least, "hot_id").withColumn("tight", F.expr("3 * (x + least) <= h"))
    wide = wide.withColumn("x", F.when(F.col("tight"), F.col("least")).otherwise(F.col("x")))
    reps = wide.groupBy("hot_id", "x").agg(F.min("node").alias("rep"))
    members = ws.save(wide.join(reps, ["hot_id", "x"]).select("node", "rep", "x", "h", "tight"), "hot-members")
    parts = members.where("node = rep").select("rep", "x", "h").join(arranged.select(F.col("node").alias("rep"), "hot"), "rep")
    parts = ws.save(parts, "hot-parts")
    keys = parts.select("rep", "x", "h", "hot").mapInArrow(_combinations, "key long, level int, rep long, x int, h int")
    index = ws.save(keys, "combinations")
    about = parts.select("rep", "x", "h")
    hot = parts.select("rep", "hot")

    def verified(met: DataFrame) -> DataFrame:
        pairs = met.select(F.least("l.rep", "r.rep").alias("a"), F.greatest("l.rep", "r.rep").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.select("a", "b"), ["a", "b"], "left_anti")
        done = _intersect(pairs, hot)
        for side in ("a", "b"):
            done = done.join(about.toDF(side, f"x_{side}", f"h_{side}"), side)
        link = F.expr("6 * (x_a + x_b) + 7 * (h_a + h_b - 2 * common) <= h_a + h_b")
        return ws.save(done.select("a", "b", link.alias("link")), "hot-verified")

    def still_open(here: DataFrame) -> DataFrame:
        """Rows of the keys under which sets of different components stand."""
        if labels is not None:
            here = here.join(labels.toDF("rep", "comp"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        else:
            here = here.withColumn("comp", F.col("rep"))
        keys = here.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
        return ws.save(here.join(keys, "key", "left_semi"), "open-combinations")

    tested, labels = None, None
    other = (F.col("l.key") == F.col("r.key")) & (F.col("l.comp") != F.col("r.comp")) & _may_link("l", "r")
    few = index.where("16 * level >= h AND (4 * level <= h OR level = 4)")  # of some 4 to 16 shingles each
    for rounds in range(STAR_ROUNDS):
        here = still_open(few)
        first = F.xxhash64("comp", F.lit(rounds)) if rounds else F.lit(0)
        centre = here.groupBy("key").agg(F.min_by(F.struct("rep", "x", "h", "comp"), F.struct(first, "x", -F.col("h"), "rep")).alias("c")).select("key", "c.*")
        done = verified(here.alias("l").join(centre.alias("r"), other))
        tested = done if tested is None else tested.union(done)
        if done.where("link").isEmpty():
            break
        labels = components(ws, tested.where("link").select("a", "b"))
    here = still_open(index)
    may_differ = F.floor((F.col("l.h") + F.col("r.h") - 6 * (F.col("l.x") + F.col("r.x"))) / 7)
    level = F.col("l.level")
    at_level = (may_differ <= F.floor(2 * level / 3) - 1) & (may_differ > F.when(level > 4, F.floor(level / 3) - 1).otherwise(0))
    # parts that are much alike share many keys of their level: of those in both heads only the least counts
    heads = here.groupBy("rep", "level").agg(F.slice(F.array_sort(F.collect_list("key")), 1, HEAD).alias("head"))
    here = here.join(heads, ["rep", "level"])
    shared = F.array_intersect("l.head", "r.head")
    once = (F.size(shared) == 0) | (F.col("l.key") == F.array_min(shared))
    tested = tested.union(verified(here.alias("l").join(here.alias("r"), other & at_level & (F.col("l.rep") < F.col("r.rep")) & once)))

    links = tested.where("link").select("a", "b")
    linked = links.select(F.explode(F.array("a", "b")).alias("rep")).distinct().withColumn("linked", F.lit(True))
    # sets of equal hot part with too many rare shingles to link each other all link to what their class links to
    own = members.where("node <> rep").join(linked, "rep", "left").where("tight OR linked").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return links.union(own)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, rare: int = RARE, ws: Workspace | None = None) -> DataFrame:
    """Rows (id, n_shingles, component_id), one for each row of docs with an id."""
    spark = docs.sparkSession
    ws = ws or Workspace(spark)
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("__id"), F.col(f"`{text_col}`").alias("__text")).where("__id IS NOT NULL")
    both = ws.save(base.mapInArrow(_sets(words), "id long, n long, node long, first array<long>"), "first-shingles")
    sets = ws.save(both.select("id", "n", "node"), "sets")
    one = ws.save(sets.where("n > 0").groupBy("node").agg(F.min("id").alias("rep")), "nodes")
    same_id, mixed = _repeated_ids(ws, sets)

    alive = _survivors(ws, both)
    ws.drop(both)
    pick = ws.save(one.join(alive, "node", "left_semi").select(F.col("rep").alias("__id")).distinct(), "picked")
    full = base.join(broadcast_if_small(pick, BROADCAST_ROWS), "__id", "left_semi").select("__text").mapInArrow(_full_sets(words), "node long, shingles array<long>")
    full = ws.save(full.join(broadcast_if_small(alive.select("node"), BROADCAST_ROWS), "node", "left_semi").dropDuplicates(["node"]), "full-sets")
    shingles = full.select("node", F.explode("shingles").alias("key"))
    counts = ws.save(shingles.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "frequencies")
    counted = shingles.join(counts, "key").groupBy("node").agg(F.collect_list(F.struct("key", "df")).alias("counted")).join(alive, "node")
    schema = "node long, n int, alone int, x int, rare array<long>, shared array<long>, hot array<long>, hot_id long"
    arranged = ws.save(counted.select("node", "n", "counted").mapInArrow(_arrange(rare), schema), "arranged")
    ws.drop(full, counts)

    links = _rare_links(ws, arranged, arranged.select("node", "shared")).union(_hot_links(ws, arranged)).union(same_id)
    labels = components(ws, links)
    ws.drop(arranged)

    named = one.join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    least = named.groupBy("c").agg(F.min("rep").alias("component_id"))
    of_node = named.join(least, "c").select("node", "component_id")
    out = sets.join(of_node, "node", "left")
    alone = F.col("id")
    if not mixed.isEmpty():  # an empty text belongs to the other texts of its id
        of_id = mixed.join(of_node, "node").select("id", F.col("component_id").alias("of_id"))
        out, alone = out.join(of_id, "id", "left"), F.coalesce("of_id", "id")
    return out.select(F.col("id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(alone).alias("component_id"))


def _repeated_ids(ws: Workspace, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) between the nodes of one id, and a node of each id that has empty and other texts."""
    of_id = sets.groupBy("id").agg(F.min(F.when(F.col("n") > 0, F.col("node"))).alias("first"), F.max(F.when(F.col("n") > 0, F.col("node"))).alias("last"), F.min("n").alias("least"))
    of_id = ws.save(of_id.where("first IS NOT NULL AND (first < last OR least = 0)"), "repeated-ids")
    same = sets.where("n > 0").join(of_id.where("first < last").select("id", "first"), "id").select(F.col("first").alias("a"), F.col("node").alias("b"))
    return ws.save(same.where("a <> b").distinct(), "same-id"), of_id.where("least = 0").select("id", F.col("first").alias("node"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ws: Workspace | None = None) -> DataFrame:
    """The rows of docs whose id is the smallest of its component; rows with a null id stay."""
    out = jaccard_components(docs, id_col, text_col, ws=ws)
    out_id = free_name(docs, "__go")
    go = out.where("component_id < id").select(F.col("id").alias(out_id)).distinct()
    return docs.join(go, F.col(f"`{id_col}`") == F.col(out_id), "left_anti")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sh AS (
  SELECT DISTINCT doc_id, k FROM (
    SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
      ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS k FROM w)
), n AS (
  SELECT w.doc_id, count(k) AS n FROM w LEFT JOIN sh USING (doc_id) GROUP BY w.doc_id
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), both_ways AS (
  SELECT a, b FROM link UNION SELECT b, a FROM link
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON l.a = r.b
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN reach r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
