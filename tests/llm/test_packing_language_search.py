import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from loomline.llm import language, neighbours, packing

ODD = ["", None, " ", "a", "don't I'll", "\x1c\x1d x\x85y", "é" * 3000, "word " * 5000, "<|endoftext|> x", "日本 ²½ ٣", "\n\n  \t a"]


def test_ids_equal_those_of_the_tokenizers_library():
    path = packing.byte_bpe_path()
    encode, tokenizer = packing.Encoder(path), Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    rng = random.Random(1)
    letters = list("abcdeAZ'stvelm 0129.,!?-_\n\t\r\x0b\x0c\x1c\x85\xa0 　éßİ中🙂²½٣्") + ["'s", "'re", "  ", "<|endoftext|>"]
    for text in [*(x or "" for x in ODD), *("".join(rng.choices(letters, k=rng.randrange(30))) for _ in range(1500))]:
        assert encode.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_added_tokens_equal_those_of_the_tokenizers_library():
    path = packing.byte_bpe_path()
    encode, tokenizer = packing.Encoder(path, added_tokens=True), Tokenizer.from_file(path)
    rng = random.Random(7)
    pieces = ["<|endoftext|>", "<|endoftext", "|>", " ", "a", "don't ", "\n", "é", "日本"]
    for text in [*(x or "" for x in ODD), *("".join(rng.choices(pieces, k=rng.randrange(12))) for _ in range(500))]:
        assert encode.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encode.ids("<|endoftext|> x").tolist() == [50256, 2124] and encode.size == 50257


def test_ids_of_many_texts_equal_those_of_the_tokenizers_library():
    path = packing.byte_bpe_path()
    encode, tokenizer = packing.Encoder(path, added_tokens=True), Tokenizer.from_file(path)
    rng = random.Random(3)
    words = ["a", "don't", "'s", "x.\ny", "z,", "é日", "12", "\u3000q", "r\n", "\x0b", "s\tt", "\x85", "\x1c", "²½", "🙂", "", "<|endoftext|>", "-'re", "\u2028", "n\x00"]
    safe = [w for w in words if w and w == w.strip() and not w.startswith("<")]
    texts = [*ODD, *(" ".join(rng.choices(safe if i % 2 else words, k=rng.randrange(12))) for i in range(1500))]
    for part in (pa.array(texts), pa.array(texts).slice(5, 900), pa.array(texts[:3]), pa.array(["one word", None, "each once"])):
        got = list(encode.all_ids(part))
        assert [g.tolist() for g in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in part.to_pylist()]


def test_a_word_that_recurs_is_encoded_once(monkeypatch):
    encode, encoded, plain = packing.Encoder(packing.byte_bpe_path()), [], tiktoken.Encoding.encode_ordinary
    monkeypatch.setattr(tiktoken.Encoding, "encode_ordinary", lambda self, text: encoded.append(len(text)) or plain(self, text))
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["alpha", "beta,", "gamma.\nDelta", "x"], k=200)) for _ in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(50), pa.int64()), pa.array(texts)], ["doc_id", "text"])
    out = pa.Table.from_batches(packing._tokenize(packing.byte_bpe_path(), 64, True)([batch])).to_pylist()
    assert sum(r["length"] for r in out if r["block"] is None) == sum(len(encode.ids(t)) + 1 for t in texts)
    assert sum(encoded) - sum(map(len, texts)) < sum(map(len, texts)) / 10  # the line above encodes them whole
    assert not [*packing._tokenize(packing.byte_bpe_path(), 64, True)([batch.slice(0, 0)])][0].num_rows


def test_op1_and_pipeline_read_added_tokens(spark, tmp_path):
    rows = [(1, "plain words"), (2, "<|endoftext|> x"), (3, "a<|endoftext|>b <|endoftext|>")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    for out in (packing.op1_packing(spark, str(tmp_path)), corpus_pipeline.packing(spark, docs, str(tmp_path))):
        got = {r.doc_id: r for r in out.collect()}
        for i, t in rows:
            ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
            assert (got[i].doc_tokens, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


@pytest.mark.parametrize("window", [16, 1024])
def test_each_id_lies_in_one_piece_and_windows_are_full(spark, window):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "x"], k=rng.randrange(60)))) for i in range(150)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(None, "no id"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, offset int").repartition(3)
    out = packing.pack(df, packing.byte_bpe_path(), window=window).collect()
    encode = packing.Encoder(packing.byte_bpe_path())
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append(r)
        pieces[r.doc_id].append(r)
    for i, text in rows:
        if i in (3, None):
            continue
        ids, at = np.append(encode.ids(text), np.uint32(0)), 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].astype("<u4").tobytes())
        assert at == len(ids)
    assert sum(r.length for r in pieces[3]) == 2 * pieces[3][0].doc_tokens and pieces[None]
    short = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        short += at < window
    assert short <= 1  # one task packs so little


def test_neighbours_share_windows():
    """Within a shard a seed takes the rests that share its terms before the others."""
    idf = np.ones(100, np.float32)
    p = packing._Packer(30, idf, 10.0, "<u2")
    topics = [np.array([t * 10 + j for j in range(10)], "<u2") for t in (0, 5, 3, 0, 5, 0)]
    p.shard([(i, 0, 10) for i in range(6)], topics)
    windows = defaultdict(list)
    for doc, *_, sequence, _ in p.out:
        windows[sequence].append(doc)
    assert windows[0] == [0, 3, 5] and windows[1][:2] == [1, 4]


def test_every_term_of_a_seed_counts():
    """The neighbour that shares many weak terms goes before those that share fewer strong ones."""
    idf = np.r_[np.full(10, 2.0), np.full(190, 1.0)].astype(np.float32)
    p = packing._Packer(80, idf, 40.0, "<u2")
    seed, strong, other = np.arange(40), np.r_[0:3, 100:137], np.arange(150, 190)
    weak = np.r_[10:40, 90:100]  # none of the seed's ten strongest terms
    p.shard([(i, 0, 40) for i in range(4)], [x.astype("<u2") for x in (seed, strong, other, weak)])
    assert [doc for doc, *_, sequence, _ in p.out if sequence == 0] == [0, 3]


def test_a_seed_meets_no_rests_used_long_ago(monkeypatch):
    met, plain = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda docs, *rest: met.append(len(docs)) or plain(docs, *rest))
    p = packing._Packer(30, np.ones(100, np.float32), 10.0, "<u2")
    p.shard([(i, 0, 7) for i in range(200)], [np.r_[0:6, 10 + i % 7].astype("<u2") for i in range(200)])
    assert met[0] > 1200 and met[-1] < 100 and sum(met) < 0.7 * len(met) * met[0]
    placed = defaultdict(int)
    for doc, _, length, *_ in p.out:
        placed[doc] += length
    assert placed == dict.fromkeys(range(200), 7)


def test_packing_of_an_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), packing.byte_bpe_path()).count() == 0


def corpus(seed, n):
    rng = random.Random(seed)
    syllables = {"aa": ["the", "ing", "er", "tion"], "bb": ["über", "keit", "sch", "ein"], "cc": ["eau", "ère", "que", "oi"]}
    common = {"aa": ["of", "and"], "bb": ["der", "und"], "cc": ["les", "des"]}
    out = []
    for i in range(n):
        lang = rng.choice(list(syllables))
        words = [rng.choice(common[lang]) if rng.random() < 0.2 else "".join(rng.choices(syllables[lang], k=rng.randrange(1, 5))) for _ in range(rng.randrange(5, 60))]
        out.append((i, " ".join(words).capitalize() + ".", lang))
    return out


def test_language_held_out_accuracy_and_odd_texts(spark):
    rows = corpus(1, 400)
    odd = [(1000, None), (1001, ""), (1002, "12 ... 34"), (1003, "日本語"), (1004, "eauquère " * 3000)]
    df = spark.createDataFrame([*((i, t, l if i % 9 else None, 0.5) for i, t, l in rows), *((i, t, "aa", 0.1) for i, t in odd)], "doc_id long, text string, lang string, score double").repartition(3)
    out = {r.doc_id: r for r in language.predict(df, language.fit_documents(df)).collect()}
    held = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(out[i].lang_pred == rows[i][2] for i in held) / len(held) > 0.97
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1002].lang_score == 0
    assert out[1003].lang_pred in ("aa", "bb", "cc") and out[1004].lang_pred == "cc"
    assert all(0 <= r.lang_score <= 1 for r in out.values())
    kept = {r.doc_id for r in language.keep_identified(df).collect()}
    assert kept == {*range(400), 1003, 1004}


def test_language_backs_off_word_first():
    """Scores by hand: a known word by its own share, an unseen one by its longest known character n-grams."""
    import pyarrow as pa

    known = language._distinct(pa.array(["zig"]))[1]
    grams, _ = language._grams(["zag"], 3)
    empty = np.zeros(0, np.uint64), np.zeros((0, 2))
    tables = {k: empty for k in (0, *language.ORDERS)} | {0: (known, np.array([[3, 0]])), 3: (grams[:1], np.array([[0, 4]]))}
    m = language.Model(["aa", "bb"], tables)
    assert m.predict(pa.array(["Zig!", "zagon", "zig zagon zagat", "qqq", "§"]))[0] == ["aa", "bb", "bb", "aa", "und"]


def test_language_without_labels(spark):
    df = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.predict(df, language.fit_documents(df)).collect()] == ["und"]
    assert language.predict(df.where("false"), language.fit_documents(df.where("false"))).count() == 0


def test_probing_retrieves_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (500, 4), np.uint8)
    codes[:50] = codes[0] ^ (1 << rng.integers(0, 8, (50, 4))).astype(np.uint8) * (rng.random((50, 4)) < 0.5)
    tables = neighbours.Tables(codes)
    for q in range(40):
        far = np.bitwise_count(codes ^ codes[q]).sum(axis=1)
        for radius in (0, 1, 3, 5, 9, 14, 32):
            assert tables.within(codes[q], radius).tolist() == np.flatnonzero(far <= radius).tolist()


def test_nearest_neighbours_recall_ties_and_unsound_vectors(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16)).astype(np.float32)
    v[300:320] = v[300]
    bad = [(9000, None), (9100, [0.0] * 16), (9200, [1.0] * 15 + [None]), (9300, [float("nan")] * 16), (9400, [float("inf")] * 16), (9500, [1.0, 2.0]), (None, [1.0] * 16)]
    rows = [(i, [float(x) for x in v[i]]) for i in range(600)] + bad
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, rank int").repartition(4)
    got = defaultdict(list)
    for r in neighbours.nearest(df, df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 100, 200, 300, 400, 500}
    hit = 0
    for q, found in got.items():
        d = np.sqrt(((v.astype(np.float64) - v[q].astype(np.float64)) ** 2).sum(axis=1))
        d[q] = np.inf
        hit += len({x for _, x, _ in found} & set(np.lexsort((np.arange(600), d))[:10].tolist()))
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(math.isclose(s, d[x], rel_tol=1e-12) for _, x, s in found)
    assert hit >= 54
    assert [x for _, x, _ in got[300]] == list(range(301, 311))
    few = neighbours.nearest(df.where("vec_id < 4"), df.where("vec_id = 0")).collect()
    assert len(few) == 3
    assert neighbours.nearest(df.where("false"), df.where("false")).count() == 0


def test_queries_are_not_copied_for_each_block(spark, monkeypatch):
    """A copy of the queries for each block of rows filled a task's memory at 6 GB."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(600, 16))
    v[300:320] = v[300]
    df = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(600)], "vec_id long, embedding array<double>").repartition(4)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    found = []
    for group in (16 << 20, 5000):  # all queries at once; four groups
        monkeypatch.setattr(neighbours, "GROUP", group, raising=False)
        out = neighbours.nearest(df, df.where("vec_id % 10 = 0"))
        plan = out._jdf.queryExecution().toString()
        assert "Generate" not in plan and "Join" not in plan
        found.append([tuple(r) for r in out.orderBy("query_id", "rank").collect()])
    assert found[0] == found[1] and len(found[0]) == 60 * 10
    hit = 0
    for at in range(0, 600, 10):
        q, d = found[0][at][0], np.sqrt(((v - v[found[0][at][0]]) ** 2).sum(axis=1))
        d[q] = np.inf
        got = found[0][at : at + 10]
        hit += len({x for _, _, x, _ in got} & set(np.lexsort((np.arange(600), d))[:10].tolist()))
        assert [r for _, r, _, _ in got] == list(range(1, 11)) and all(math.isclose(s, d[x], rel_tol=1e-12) for _, _, x, s in got)
    assert hit >= 540
    assert [x for q, _, x, _ in found[0] if q == 300] == list(range(301, 311))


def test_language_finds_the_text_wherever_it_stands(spark):
    rows = [(f"{w} one {w} two", i, "in", "aa" if w == "zig" else "bb") for i, w in enumerate(["zig", "zag"] * 20)]
    df = spark.createDataFrame(rows, "TEXT string, doc_id long, lang_pred string, lang string")
    out = language.predict(df, language.fit_documents(df))
    assert out.columns == ["TEXT", "doc_id", "lang", "lang_pred", "lang_score", "lang_known"]
    assert all(r.lang_pred == r.lang and r.TEXT == rows[r.doc_id][0] for r in out.collect())
    back = df.select("lang", "doc_id", "TEXT")
    assert {r.doc_id: r.lang_pred for r in language.predict(back, language.fit_documents(df)).collect()} == {r[1]: r[3] for r in rows}
