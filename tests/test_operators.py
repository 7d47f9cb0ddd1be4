"""Micro fixtures with results worked out by hand."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from loomline.functions import chunks, fuzzy, html, metrics, reasoning, text
from loomline.hooks import extractive_generator
from loomline.operators import dedupe, ids, lookup, retrieval, windows
from loomline.plans import catalogue, flows
from loomline.sources import readers, sinks

WIKI = """<html><body><div class="mw-parser-output"><p>Intro<sup>[1]</sup> text.</p><h2>Life</h2><ul><li>a<ul><li>b</li></ul></li></ul>
<table class="infobox vcard"><tr><th>Born</th></tr><tr><th>Date</th><td>1 <b>May</b></td></tr><tr><th>Plain</th><td>x</td></tr></table>
<table class="wikitable sortable"><tr><th>H1</th><th>H2</th></tr><tr><th>r</th><td>1</td></tr></table>
<h2>References</h2><p>gone</p></div></body></html>"""


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_wiki_html():
    assert html.main_text(WIKI, heading_prefix="## ") == "Intro text.\n\n## Life\n\na b"
    assert html.main_text("<p>no body</p>") == "" and html.paragraphs("<p>a<p>b") == "a\n\nb"
    assert html.infobox(WIKI) == {"Born": {"Date": "1 | May", "Plain": "x"}}
    assert html.wikitables(WIKI) == [{"columns": ["H1", "H2", "r"], "rows": [["r", "1"]]}]
    page = html.generic_page("<nav>n</nav><article><p>a <b>b</p><script>'</p>'</script></article><div class=card>c</div>")
    assert page["text"] == "a b" and page["cards"] == ["c"]


def test_json_sources(spark, tmp_path):
    messy = '{"a": 1}\n\n{\n "a": "x}y\\"{",\n "b": [1]\n}\n{\'a\': 2}\nnot json\n{"a": 3'
    assert [ok for _, _, ok in readers.balanced_objects(messy)] == [True, True, True, False, False]
    (tmp_path / "m.jsonl").write_text(messy)
    got = readers.read_json_objects(spark, f"{tmp_path}/m.jsonl").where("ok").collect()
    assert [json.loads(r.raw)["a"] for r in got] == [1, 'x}y"{', 2]
    (tmp_path / "t.jsonl").write_text('{"a":1}\n\n{"a":\n{"a":2}\n')
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("a", LongType())])
    good, bad = readers.read_jsonl_tolerant(spark, f"{tmp_path}/t.jsonl", schema)
    assert sorted(r.a for r in good.collect()) == [1, 2] and bad.count() == 1
    with pytest.raises(Exception):
        readers.read_jsonl_strict(spark, f"{tmp_path}/t.jsonl", schema).collect()
    (tmp_path / "dev.json").write_text('[{"a":1},{"a":2}]')
    assert readers.probe_split(spark, str(tmp_path), "dev", schema).count() == 2
    with pytest.raises(FileNotFoundError):
        readers.probe_split(spark, str(tmp_path), "none")
    with pytest.raises(ValueError):
        readers.read_dataset(spark, "x.xml")
    assert json.loads(readers.repair_json('{"a": "\\d"}'))["a"] == "\\d" and readers.repair_json("{") is None


def test_folders_and_search_results(spark, tmp_path):
    (tmp_path / "h").mkdir()
    (tmp_path / "h" / "A_B.html").write_text("<p>x</p>")
    assert readers.read_html_folder(spark, f"{tmp_path}/h").first()[:2] == ("A B", "https://en.wikipedia.org/wiki/A_B")
    for d, body in (("t", {"url": "u", "title": "T", "header": [["h", "l"]], "data": [[["c", "l"]]]}), ("k", {"/p": "passage"})):
        (tmp_path / d).mkdir()
        (tmp_path / d / "s.json").write_text(json.dumps(body))
    (tmp_path / "t" / "alone.json").write_text("{}")
    r = readers.join_side_files(spark, f"{tmp_path}/t", f"{tmp_path}/k").collect()
    assert len(r) == 1 and r[0].header == ["h"] and r[0].data == [["c"]] and r[0].links == {"/p": "passage"}
    j = json.dumps({"organic_results": [{"title": "t", "link": "l", "snippet": "s", "date": "2024-01-01T00"}]})
    found = readers.search_results(spark.createDataFrame([(1, j)], "id int, j string"), "id", "j").first()
    assert (found["rank"], found.title, found.url, found.date) == (1, "t", "l", "2024-01-01")


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 0), (1, "b", 1), (2, "c", 0)], "id int, v string, pos int")
    assert {r.id: r.v for r in sinks.keyed_results(df, "id", "pos").collect()} == {1: "b", 2: "c"}
    sinks.write_json_array(df.orderBy("id", "pos"), f"{tmp_path}/a.json")
    assert [x["v"] for x in json.load(open(f"{tmp_path}/a.json"))] == ["a", "b", "c"]
    sinks.write_jsonl(df, f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 3
    assert sinks.write_questions(df, "v", f"{tmp_path}/q") == 3
    vectors = spark.createDataFrame([("s", [1.0, 2.0]), ("t", [1.0])], "source string, embedding array<float>")
    with pytest.raises(Exception):
        sinks.write_vectors(vectors, f"{tmp_path}/v", 2)
    good, bad = sinks.split_failures(df, F.col("v") == "c")
    assert (good.count(), bad.count()) == (2, 1)


def test_packing_of_sentences_against_a_scalar_model(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("w " * rng.randrange(1, 9) + "end." for _ in range(rng.randrange(0, 12)))) for i in range(60)] + [(99, "")]

    def model(t, most):
        done, cur, n = [], [], 0
        for s in [x.strip() for x in t.replace(". ", ".\x00").split("\x00") if x.strip()]:
            k = len(s.split())
            if cur and n + k > most:
                done.append(" ".join(cur))
                cur, n = [], 0
            cur.append(s)
            n += k
        return done + ([" ".join(cur)] if cur else [])

    df = spark.createDataFrame(docs, "i int, t string").select("i", chunks.pack_sentences(chunks.sentences(F.col("t")), 15).alias("c"))
    assert {r.i: r.c for r in df.collect()} == {i: model(t, 15) for i, t in docs}


def test_backing_chunks(spark):
    toks = F.split(F.lit("a . b c d e . f"), " ")
    assert one(spark, chunks.backing_chunks(toks, 4, F.array(F.lit("."))))[0] == [2, 4, 2]


def test_parsers(spark):
    c = F.lit("x <a>1</a> <a> 2 </a>")
    assert one(spark, text.between_last(c, "<a>", "</a>"), text.between_last(c, "<b>", "</b>"))[:] == ("2", None)
    assert one(spark, text.boxed(F.lit(r"\boxed{1} y}")), text.boxed(F.lit(r"a \boxed{\text{(b)}}")), text.boxed(F.lit("")))[:] == ("1} y", "b", "")
    assert one(spark, text.cut_at_stop(F.lit("ab STOP c"), ["STOP", "c"]), text.cut_at_stop(F.lit("ab STOP c"), ["STOP"], True))[:] == ("ab ", "ab STOP")
    assert one(spark, text.wiki_slug(F.lit("http://h/wiki/A%20b+c#d")), text.wiki_slug(F.lit("http://h/x")))[:] == ("A b+c", "")
    assert one(spark, text.normalize_answer(F.lit("The  a-b, an X!")))[0] == "ab x"
    assert one(spark, text.clean_wikitext(F.lit("[[a]] '''b''' <math>x\ny</math>{{cite q}}c &amp; style=\"x\" d")))[0].split() == ["a", "b", "c", "&", "d"]


def test_scores(spark):
    golds = F.array(F.lit("the cat"), F.lit("cat sat down"))
    r = one(spark, metrics.best_token_scores(F.lit("cat sat"), golds).alias("s")).s
    assert (round(r.f1, 4), r.precision, r.recall) == (0.8, 1.0, 1.0)
    assert one(spark, metrics.token_scores(F.lit("yes"), F.lit("no"))["f1"], metrics.token_scores(F.lit(""), F.lit("a b"))["f1"])[:] == (0.0, 0.0)
    n = lambda *v: [F.lit(x) for x in v]
    assert [round(one(spark, metrics.pass_at_k(*n(5, c), 2))[0], 4) for c in (0, 1, 4, 5)] == [0.0, 0.4, 1.0, 1.0]
    assert one(spark, metrics.lcs_length(F.split(F.lit("a b c d"), " "), F.split(F.lit("b x d"), " ")))[0] == 2
    pairs = spark.createDataFrame([("a b c d e".split(), "a b c d e".split())], "pred array<string>, gold array<string>")
    assert round(metrics.corpus_bleu(pairs).first().bleu, 6) == 1.0
    with pytest.raises(KeyError):
        metrics.evaluate(pairs, ["nope"])


def test_fuzzy_and_reasoning():
    assert fuzzy.lcs("abcde", "xbxdx") == 2 and fuzzy.indel_ratio("", "") == 100
    assert fuzzy.token_set_ratio("a b c", "c b a x") == 100 and fuzzy.partial_ratio("bcd", "abcde") == 100
    assert round(fuzzy.partial_ratio("bxd", "abcde"), 2) == 66.67 and fuzzy.token_set_ratio("", "a") == 0
    assert fuzzy.recover_wording("b d".split(), "a b c d b x x d".split()) == (1, 4)
    assert reasoning.merge_steps("Step 1: a\nmore\nStep 2: b", "Step 2: DELETE THIS STEP\nStep 3: c") == "a\nmore\n\nc"
    for raw, want in ((r"\dfrac12", r"\frac{1}{2}"), ("0.5", r"\frac{1}{2}"), ("3/4", r"\frac{3}{4}"), (r"\sqrt3", r"\sqrt{3}"), ("x=0.5", r"\frac{1}{2}"), (r"5\text{ cm}", "5"), ("", "")):
        assert reasoning.canonical_math(raw) == want
    assert reasoning.assert_value("assert f(1) == [1, 2]") == "[1, 2]" and reasoning.assert_value("assert f() == g()") is None
    assert reasoning.nested_tokens({"a": [1, {"b": None}], "c": "d"}) == ["a", "1", "b", "c", "d"]


def test_ids_and_conflicts(spark):
    df = spark.createDataFrame([("t_000001", "s", "x", 0), ("t_000001", "s", "x", 1), ("t_000001", "s", "y", 2), ("t_000001", "z", "x", 3), (None, "s", "q", 4), ("new_000009", "s", "w", 5)], "id string, src string, h string, pos long")
    got = {r.pos: r.new_id for r in dedupe.resolve_id_conflicts(df, "id", ["src", "h"], ["pos"]).collect()}
    assert got == {0: "t_000001", 1: "t_000001", 2: "new_000010", 3: "new_000011", 4: "new_000012", 5: "new_000009"}
    big = spark.range(5000).withColumn("k", F.hash("id"))
    pos = [r.pos for r in ids.with_position(big, ["k", "id"]).orderBy("k", "id").collect()]
    assert pos == list(range(5000))
    assert ids.sample_rows(big, ["id"], 7, 1).collect() == ids.sample_rows(big.repartition(5), ["id"], 7, 1).collect()


def test_rankings(spark):
    r = spark.createDataFrame([(1, "a", 9.0, "x"), (1, "b", 9.0, "x"), (1, "c", 1.0, "x"), (1, "a", 5.0, "y"), (1, "d", 4.0, "y")], "query_id int, doc_id string, score double, source string")
    assert [x.doc_id for x in retrieval.top_k(r.where("source = 'x'"), 2).orderBy("rank").collect()] == ["a", "b"]
    fused = retrieval.fuse_rrf(r, 2).orderBy("rank").collect()
    assert [x.doc_id for x in fused] == ["a", "b"] and fused[0].score == round(2 / 61, 6)
    assert retrieval.quota(r, {"x": 1, "y": 5}).count() == 3
    with pytest.raises(ValueError):
        retrieval.route({"x": r}, "nope", 1)


def test_budgets_and_trimming(spark):
    d = spark.createDataFrame([(1, i, c) for i, c in enumerate((5, 5, 5, 5))], "g int, t int, c int")
    assert [r.t for r in windows.within_budget(d, ["g"], ["t"], "c", 10).orderBy("t").collect()] == [0, 1, 2]
    assert [r.t for r in windows.within_budget(d, ["g"], ["t"], "c", 10, crossing=False).orderBy("t").collect()] == [0, 1]
    assert [r.t for r in windows.trim_turns(d, "g", "t", "c", 12).orderBy("t").collect()] == [0, 3]
    assert [r.t for r in windows.trim_turns(d, "g", "t", "c", 0).orderBy("t").collect()] == [0, 3]
    with pytest.raises(ValueError):
        windows.reorder(d, ["g"], "t", "nope")


def test_alignment_cascade(spark):
    corpus = spark.createDataFrame([(1, "T", "the quick brown fox jumps"), (2, "T", "alpha beta gamma delta"), (3, "U", "the quick brown fox jumps")], "doc_id long, title string, content string")
    ev = spark.createDataFrame([(1, "T", "quick brown"), (2, "T", "gamma beta alpha delta"), (3, "T", "nothing alike"), (4, "V", "quick brown"), (5, "V", "quick brown")], "ev_id long, title string, content string")
    got = {r.ev_id: (r.doc_id, r.how) for r in flows.align_evidence(ev, corpus, retrieval.hash_embedding).collect()}
    assert got[1] == ("1", "exact") and got[2] == ("2", "fuzzy") and got[3][1] == "new" and got[4] == got[5]


def test_loop_ends_by_turns_and_by_state(spark):
    s = spark.createDataFrame([(i, 0) for i in range(4)], "id int, n int")
    out = flows.loop(s, lambda d, t: d.withColumn("n", F.col("n") + 1), F.col("n") > F.col("id"), 3).collect()
    assert {r.id: (r.turns, r.finish_reason) for r in out} == {0: (1, "finished"), 1: (2, "finished"), 2: (3, "finished"), 3: (3, "turns")}


def test_knn_vote_and_lookups(spark):
    lab = spark.createDataFrame([(i, int(i < 3)) for i in range(10)], "id long, label int")
    near = spark.createDataFrame([(1, 0), (1, 1), (2, 8), (2, 9)], "query_id int, doc_id long")
    assert {r.query_id: r.retrieve for r in lookup.knn_vote(near, lab, 2).collect()} == {1: True, 2: False}
    q = spark.createDataFrame([(1,), (2,)], "k int")
    hits, misses = lookup.cached(q, spark.createDataFrame([(1, "v")], "k int, v string"), "k")
    assert (hits.count(), misses.first().k) == (1, 2)


def test_reading_flow(spark):
    q = spark.createDataFrame([(1, "What is blue? Sky."), (2, "zzz")], "query_id long, query string")
    docs = spark.createDataFrame([(1, "the blue sky"), (2, "red")], "doc_id long, text string")
    out = {r.query_id: r for r in flows.retrieve_and_read(q, docs, lambda x: retrieval.bm25(docs, x, 2), extractive_generator).collect()}
    assert "the blue sky" in out[1].prompt and out[1].answer == "What is blue?" and "No relevant documents" in out[2].prompt


def test_stream_equals_batch(spark, tmp_path):
    from loomline.streaming import events

    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    e.orderBy("ts").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.EVENTS).parquet(f"{tmp_path}/in")
    q = events.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("tumbling").start()
    try:
        q.processAllAvailable()
        assert {tuple(r) for r in spark.table("tumbling").collect()} == {tuple(r) for r in events.tumbling(e).collect()}
    finally:
        q.stop()


def test_compression_rank_meets_every_document(spark, tmp_path):
    """The nearest documents of an item, whatever their source; blocks and tasks make no difference."""
    rng = random.Random(4)
    texts = ["".join(rng.choices("abcdefgh ", k=80)) for _ in range(40)]
    items = [(i, texts[3 * i][:60]) for i in range(6)]
    docs = [(i, t, "elsewhere") for i, t in enumerate(texts)]
    spark.createDataFrame([*docs, (99, None, "src0")], "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.query_id, r.rank): (r.doc_id, r.score) for r in catalogue.queries()["compression_rank"](spark, str(tmp_path)).collect()}
    want = {}
    for q, t in items:
        best = sorted((round(fuzzy.compression_distance(t, x), 6), d) for d, x, _ in docs)[:3]
        want |= {(q, n + 1): (d, -s) for n, (s, d) in enumerate(best)}
    assert got == want and all(got[q, 1][0] == 3 * q for q, _ in items)
    queries = spark.createDataFrame(items, "query_id long, query string")
    small = retrieval.compression_top_k(spark.createDataFrame(docs, "doc_id long, text string, source string"), queries, 3, block=2)
    assert {(r.query_id, r.rank): (r.doc_id, r.score) for r in small.collect()} == want


def test_found_texts_reach_the_next_step_whole(spark, tmp_path):
    """What stands at the end of a long document counts in prompts, votes, the next search and the next turn."""
    long = " ".join(["filler"] * 500)
    docs = spark.createDataFrame([(1, f"start {long}\nlater clue"), (2, "clue found by the tail"), (3, "other")], "doc_id long, text string")
    q = spark.createDataFrame([(7, "start")], "query_id long, query string")
    search = lambda x: retrieval.bm25(docs, x, 3)
    ranked = search(q)
    assert "later clue" in flows.with_prompts(q, ranked, docs).first().prompt
    assert "later clue" not in flows.with_prompts(q, ranked, docs, max_chars=20).first().prompt
    told = lambda p: p.withColumn("answer", F.contains("prompt", F.lit("later clue")).cast("string"))
    assert flows.branch_and_vote(q, ranked, docs, told).first().answer == "true"
    last = lambda t: F.try_element_at(F.split(t, "\n"), F.lit(-1))
    asked = flows.search_agent(q, docs, search, last, limit=2, turns=3).first()
    assert asked.executed == ["start", "later clue"]

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "start")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in catalogue.queries()["iterative_retrieval"](spark, str(tmp_path)).collect()} == {1, 2}


def test_first_containing_anywhere_equals_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["a", "bb", "ab", "", "c\n", "é"])
    docs = [(i, None if i == 3 else " ".join(word() for _ in range(rnd.randrange(0, 12)))) for i in range(80)] + [(7, "ab bb a")]
    cut = lambda t: t[rnd.randrange(0, len(t) + 1) :][: rnd.randrange(0, 14)]
    needles = [(i, cut(rnd.choice([t for _, t in docs if t is not None]))) for i in range(150)] + [(150, None), (151, ""), (152, "no such words here"), (0, "a")]
    want = {}
    for n, x in needles:
        found = [i for i, t in docs if x is not None and t is not None and x in t]
        if found:
            want[n] = min(want.get(n, 99), *found)
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(needles, "item_id long, needle string")
    for small in (0, 1000):
        got = lookup.first_containing_anywhere(q, d, "item_id", "needle", "doc_id", "text", block=7, small=small)
        assert {r.item_id: r.doc_id for r in got.collect()} == want
    assert lookup.first_containing_anywhere(q.limit(0), d, "item_id", "needle", "doc_id", "text").count() == 0


def test_positions_within_groups_of_any_size(spark):
    rows = [(None if i % 7 == 0 else "hot" if i % 3 else f"g{i % 5}", i) for i in range(300)]
    got = ids.with_group_position(spark.createDataFrame(rows, "g string, i long"), "g", ["i"], start=1).collect()
    seen = {}
    want = {(g, i): seen.setdefault(g, []).append(i) or len(seen[g]) for g, i in rows}
    assert {(r.g, r.i): r.pos for r in got} == want and len(got) == 300


def test_rouge_l_of_long_texts_takes_the_best_gold(spark):
    rows = [("a cat sat", ["dog", "cat sat", None]), ("cat", []), ("cat", None), (None, ["cat"])]
    df = spark.createDataFrame(rows, "pred string, golds array<string>")
    assert [r[0] for r in df.select(metrics.METRICS["rouge-l-long"](F.col("pred"), F.col("golds"))).collect()] == [1.0, 0.0, 0.0, 0.0]


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
def test_dense_top_k_equals_brute_force(spark, metric, kind):
    import numpy as np

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=(130, 6)), 2).astype("float32" if kind == "float" else "float64")
    v[40:70] = v[7]  # equals: ties go to the smaller id
    ids, of = rng.permutation(1000)[:130], rng.choice([3, 5], 130)
    rows = [(int(i), [float(x) for x in r], int(o)) for i, r, o in zip(ids, v, of, strict=True)]
    df = spark.createDataFrame([*rows, (2000, None, 3), (2001, [0.5] * 6, None)], f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    asked = df.select(df.vec_id.alias("query_id"), "embedding", "label")
    w = v.astype("float64")
    score = {"ip": w @ w.T, "cosine": (w @ w.T) / np.sqrt(np.outer((w**2).sum(1), (w**2).sum(1))), "l2": -np.sqrt(((w[:, None] - w[None]) ** 2).sum(2))}[metric]
    for same in ("label", None):
        at_most = {"at_most": 1} if same else {"at_most": 4}
        out = retrieval.dense_top_k(df if same else df.where("label IS NOT NULL"), asked if same else asked.where("label IS NOT NULL"), 4, metric=metric, block=16, exclude_self=True, same=same, **at_most)
        got = {(r.query_id, r["rank"]): (r.doc_id, round(r.score, 4)) for r in out.collect()}
        for q in range(130):
            others = sorted((-round(score[q, x] + 0.0, 4), ids[x]) for x in range(130) if x != q and (same is None or of[x] == of[q]))[:4]
            assert [got[ids[q], n + 1][1] for n in range(4)] == pytest.approx([-s for s, _ in others], abs=1.1e-4)
            if 40 <= q < 70 and metric != "ip":
                assert [got[ids[q], n + 1][0] for n in range(4)] == [i for _, i in others]
        assert len(got) == 4 * 130


def test_containment_splits_a_long_text_once(spark):
    import time

    words = [f"w{i}" for i in range(40_000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (0, "short text"), (2, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(words[39_000:39_009])), (2, "w1 w3 w2 w4 w5"), (3, None)], "item_id long, needle string")
    began = time.monotonic()
    assert [tuple(r) for r in lookup.first_containing_anywhere(items, docs, "item_id", "needle", "doc_id", "text").collect()] == [(1, 1)]
    assert time.monotonic() - began < 60  # minutes where each run of words splits the text again


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_jaccard_pairs_equal_brute_force_whatever_the_chunks(spark, least):
    rng = random.Random(3)
    base = [[f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(rng.choice([1, 3, 12, 40]))] for _ in range(12)]
    texts = [" ".join(w if rng.random() < 0.8 else f"w{rng.randrange(60)}" for w in rng.choice(base)) for _ in range(150)] + ["", " ", "a\nb", "b  a"]
    rows = [(i, t, rng.choice(["s", "t"]), "en") for i, t in enumerate(texts)] + [(900, None, "s", "en"), (901, texts[0], None, "en")]
    sets = {i: (set(re.split(r"[ \t\n\x0b\f\r]+", t)), s) for i, t, s, _ in rows if t is not None and s}
    want = {(a, b): len(x & y) / len(x | y) for a, (x, s) in sets.items() for b, (y, r) in sets.items() if a < b and s == r and len(x & y) >= least * len(x | y)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    for size, often in ((1000, 1000), (20, 5), (7, 0)):
        got = retrieval.jaccard_pairs(docs, ["source", "lang"], least, chunk=size, often=often).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.j for r in got} == pytest.approx(want)


@pytest.mark.parametrize("name", ["metric_token_f1", "metric_qa_modes", "str_self_rag_clean"])
def test_queries_of_odd_turns_equal_sql(spark, tmp_path, name):
    import duckdb

    odd = ["", None, "The.", "...", "no", "No, thanks", "yes", "a.b.c d", "x!y?z", "a.[Relevant]b", "end</s>", "# x.y", "I.B.M. and U.S.A.F", "an the a", " : tail\nmore.dots"]
    rng = random.Random(1)
    rows = [(c, t, "user", rng.choice(odd)) for c in range(80) for t in range(4)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    df = catalogue.queries()[name](spark, str(tmp_path))
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duck.sql(f"SELECT {', '.join(df.columns)} FROM ({catalogue.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in df.collect())


@pytest.mark.parametrize("small", [20_000, 0])
def test_bm25_sums_scores_where_a_document_is_and_counts_all_documents(spark, small):
    import math

    texts = {1: "red fox red", 2: "the fox", 3: None, 4: "", 5: "blue whale, BLUE sea", 6: "a sea of red"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    q = spark.createDataFrame([(1, "red fox fox"), (2, "sea"), (3, None), (4, "nothing")], "query_id long, query string")
    out = retrieval.bm25(docs, q, 2, small=small)
    assert not small or not re.search(r"hashpartitioning\(query_id#\d+L?, doc_id", out._jdf.queryExecution().executedPlan().toString())
    words = {i: re.findall(r"\w+", t.lower()) for i, t in texts.items() if t is not None}
    mean = sum(map(len, words.values())) / len(words)

    def score(i, query):
        found = 0.0
        for w in query:
            df, tf = sum(w in x for x in words.values()), words[i].count(w)
            found += math.log(1 + (len(texts) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.1 + 0.9 * len(words[i]) / mean)) if tf else 0.0
        return round(found, 4)

    want = {}
    for n, query in ((1, {"red", "fox"}), (2, {"sea"})):
        best = sorted((-score(i, query), i) for i in words if score(i, query))[:2]
        want |= {(n, r + 1): (i, -s) for r, (s, i) in enumerate(best)}
    got = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in out.collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and all(abs(got[k][1] - want[k][1]) < 1.1e-4 for k in want)


@pytest.mark.parametrize("small", [100_000, 0])
def test_containment_within_the_same_title(spark, small):
    rng = random.Random(4)
    docs = [(i, rng.choice("st"), " ".join(rng.choice("ab cd e fg".split()) for _ in range(rng.randrange(12)))) for i in range(60)] + [(90, None, "ab cd"), (91, "s", None)]
    needles = [(i, rng.choice("stu"), " ".join(rng.choice("ab cd e fg".split()) for _ in range(rng.randrange(6)))) for i in range(40)] + [(90, None, "ab"), (91, "s", None)]
    want = {}
    for n, t, needle in needles:
        held = [d for d, u, text in docs if t and t == u and needle is not None and text is not None and needle in text]
        want |= {n: min(held)} if held else {}
    a = spark.createDataFrame(needles, "ev_id long, title string, content string")
    d = spark.createDataFrame(docs, "doc_id long, t string, text string")
    got = lookup.first_containing_anywhere(a, d, "ev_id", "content", "doc_id", "text", small=small, same=("title", "t")).collect()
    assert {r.ev_id: r.doc_id for r in got} == want and len(got) == len(want)


def test_pruning_groups_the_scores_once(spark):
    scored = spark.createDataFrame([(1, p, t, x) for p, t, x in ((2, "c", 3.0), (0, "a", 1.0), (1, "b", 2.0), (3, "a", 1.0))] + [(2, 0, "z", 0.0)], "id long, pos int, token string, score double")
    out = flows.prune_tokens(scored, 0.5)
    assert {r.id: r.text for r in out.collect()} == {1: "b c", 2: "z"}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
