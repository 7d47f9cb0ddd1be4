import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from loomline.llm import jaccard, substring
from loomline.llm.text import rolling, rolling_min, split_words, word_lanes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed=1, n=40):
    """Copies, near copies, shared passages, short, empty, null and odd texts; ids out of order."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "a\x1cb", "x\u00a0y", "THE", "the"]
    passage = [rng.choice(vocabulary) for _ in range(20)]
    out = []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 4, 5, 12, 13, 14, 40, 90]))]
        kind = rng.random()
        if out and kind < 0.2:
            words = list(rng.choice(out)[1])
        elif out and kind < 0.4:
            words = list(rng.choice(out)[1])
            if words:
                words[rng.randrange(len(words))] = "changed"
        elif kind < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
        out.append(((i * 7) % n, words))
    rows = [(i, rng.choice([" ", "\n", "\t "]).join(w)) for i, w in out]
    return [*rows, (1000, None), (1001, ""), (1002, " \n\t "), (None, "w1 w2 " * 30), (1003, "same word " * 200), (1004, "same word " * 150)]


def brute_repeats(rows, window=13):
    words = [(i, WORD.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for s in range(len(w) - window + 1):
                k = tuple(w[s : s + window])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, w in words:
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and first[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def brute_components(rows):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[s : s + 5]) for s in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                same = len(sets[a] & sets[b])
                if 100 * same >= 75 * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_word_arrays_agree_with_the_pattern():
    t = pa.array([x for _, x in texts(3)])
    offsets, flat = split_words(t)
    want = [WORD.findall(x or "") for x in t.to_pylist()]
    assert [flat.to_pylist()[a:b] for a, b in zip(offsets, offsets[1:])] == want
    offsets2, lanes = word_lanes(t)
    assert offsets2.tolist() == offsets.tolist()
    seen = {}
    for w, h in zip(flat.to_pylist(), lanes.T.tolist()):
        assert seen.setdefault(w, h) == h
    assert len({tuple(h) for h in seen.values()}) == len(seen)
    assert word_lanes(pa.array(["ABC É"]), lower=True)[1][0, 0] == word_lanes(pa.array(["abc"]))[1][0, 0]


def test_rolling_hashes_depend_on_their_words_only():
    v = np.random.default_rng(0).integers(0, 5, 300).astype(np.uint64)
    for k in (1, 2, 5, 7, 13):
        h = rolling(v, k)
        by = {}
        for i in range(len(h)):
            by.setdefault(tuple(v[i : i + k]), set()).add(int(h[i]))
        assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)
        assert rolling_min(v, k).tolist() == [v[i : i + k].min() for i in range(len(v) - k + 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_equals_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n_words string").repartition(3)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_text) for r in substring.remove_repeats(df).collect())
    assert got == sorted((str(i), n, g, k) for i, n, g, k in brute_repeats(rows))


def test_substring_dedup_repeated_ids_and_empty_table(spark):
    long = " ".join(f"w{i}" for i in range(30))
    rows = [(5, long), (5, long), (5, long + " more"), (7, long)]
    out = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed) for r in out) == [(5, 0), (5, 0), (5, 0), (7, 30)]
    assert substring.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert hashlib.sha256(b"").hexdigest()


@pytest.mark.parametrize("seed", [1, 4])
def test_jaccard_components_equal_brute_force(spark, seed):
    rows = texts(seed)
    df = spark.createDataFrame([(i, t, "y", 1) for i, t in rows], "doc_id long, text string, key string, node int").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_jaccard_links_large_near_copy_groups(spark):
    """Frequent shingles: 150 near copies, each with one word changed, and a passage that unrelated texts share."""
    rng = random.Random(5)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(80)] = f"c{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:12] + [f"u{i}_{j}" for j in range(40)])) for i in range(120)]
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_components(rows)


def near_copies(seed, changes, n=140, length=90, pool=None):
    """Copies of one text with so many words changed each, to new words or to words of a small pool."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        for at in rng.sample(range(length), rng.choice(changes)):
            w[at] = f"p{rng.randrange(pool)}" if pool else f"c{i}_{at}"
        if rng.random() < 0.3:
            at = rng.randrange(length - 10)
            del w[at : at + rng.randrange(8)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize(("rows", "rare"), [(near_copies(1, [2, 3, 4]), 32), (near_copies(2, [1, 2, 4, 6]), 4), (near_copies(3, [3, 4, 5], pool=3), 4), (texts(6), 1)])
def test_jaccard_groups_below_and_around_the_threshold(spark, rows, rare):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(df, rare=rare).collect()}
    want = brute_components(rows)
    assert got == want
    assert len({c for _, c in want.values()}) > 1


def test_combinations_meet_whatever_may_link():
    """Hot parts that differ in no more shingles than their sizes and rare shingles allow share a key of their level."""
    rng = np.random.default_rng(3)
    for _ in range(400):
        h = int(rng.integers(3, 200))
        base = rng.integers(0, 1 << 63, h + 60, dtype=np.uint64)
        x, y = (int(rng.integers(0, max(1, h // 8))) for _ in "ab")
        part = base[:h]
        out, new = int(rng.integers(0, h // 3 + 1)), int(rng.integers(0, 12))
        other = np.concatenate((part[out:], base[h : h + new]))
        may = (h + len(other) - 6 * (x + y)) // 7
        if not 1 <= out + new <= may or not len(other):
            continue
        p = 4
        while 2 * p // 3 - 1 < may:
            p *= 2
        a, b = ({int(k) for k, q in zip(*jaccard.combinations(np.sort(s), z), strict=True) if q == p} for s, z in ((part, x), (other, y)))
        assert a & b


def test_jaccard_keeps_one_of_each(spark):
    t = " ".join(f"w{i}" for i in range(20))
    df = spark.createDataFrame([(1, t), (2, t), (3, None), (None, t), (4, "")], "doc_id long, text string")
    assert sorted(str(r.doc_id) for r in jaccard.keep_one_of_each(df).collect()) == ["1", "3", "4", "None"]
    assert jaccard.jaccard_components(df.where("false")).count() == 0


def test_jaccard_rows_of_one_id_are_one_document(spark):
    """Id 5 copies id 3 and holds a text like that of id 9: all are one component, and so is its empty row."""
    words = lambda c, n: [f"{c}{i}" for i in range(n)]
    a, b = " ".join(words("a", 40)), " ".join(words("b", 40))
    near_a = " ".join([*words("a", 39), "z"])
    near_b = " ".join([*words("b", 39), "z"])
    rows = [(3, a), (5, a), (5, b), (5, ""), (9, near_b), (11, near_a), (12, " ".join(words("c", 40))), (13, ""), (14, "p q"), (14, "r s"), (15, "r s")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard.jaccard_components(df).collect()
    assert len(got) == len(rows)
    want = {3: 3, 5: 3, 9: 3, 11: 3, 12: 12, 13: 13, 14: 14, 15: 14}
    assert {(r.id, r.component_id) for r in got} == set(want.items())
    assert sorted({r.doc_id for r in jaccard.keep_one_of_each(df).collect()}) == [3, 12, 13, 14]
