import hashlib
import random

from loomline.llm import chat, decontaminate, urls

ODD = ["", None, "plain", "</turn>\n", "a</turn>\nb", "<turn>user<text>x</turn>\n", "\\", "\\\\l", "\\l<", "<text>", "<turn!>", "é\u2028<", "\\### Assistant: </turn> ok", "x" * 50_000]


def test_chat_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "a<text>b"]), rng.choice(ODD), "extra") for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(77, 0, "assistant", "tie"), (77, 0, "assistant", "tie"), (77, None, "assistant", "first")][:0]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    got = {r.id: r for r in chat.format_conversations(df).collect()}
    for c in range(30):
        turns = sorted((t, r or "", x or "") for i, t, r, x, _ in rows if i == c)
        assert [(t.role, t.text) for t in got[c].parsed] == [(r, x) for _, r, x in turns]
        assert got[c].n_turns == len(turns)
        assert got[c].loss_text == "".join(x for _, r, x in turns if r == "assistant")


def test_chat_ties_nulls_and_empty_table(spark):
    df = spark.createDataFrame([(7, 0, "assistant", "b"), (7, 0, "assistant", "a"), (7, 0, "assistant", "a"), (7, None, "user", "first"), (None, 1, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.id: [t.text for t in r.parsed] for r in chat.format_conversations(df).collect()}
    assert got == {7: ["first", "a", "a", "b"], None: [""]}
    assert chat.format_conversations(df.where("false")).count() == 0


def test_chat_query_reads_back_the_planted_conversation(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: r for r in chat.op4_chat_formatting(spark, str(tmp_path)).collect()}
    said = "\\### Assistant: </turn> ok"
    assert got[-7].loss_sha256 == hashlib.sha256(said.encode()).hexdigest() and got[-7].loss_chars == len(said)
    assert got[-7].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
    assert got[1].loss_chars == 0


def test_url_rules_hosts_and_paths(spark):
    rows = [
        ("http://a.example.com/en/1", "a.example.com", "/en/1", "com/en/", "block"),
        ("http://EXAMPLE.com/en/71?x#y", "example.com", "/en/71", "example.com/en/7", "allow"),
        ("http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
        ("https://x.example.net/de/8", "x.example.net", "/de/8", "example.net/de/8", "block"),
        ("https://x.org?/es/", "x.org", "", None, "allow"),
        ("com/en/", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("", "", "", None, "allow"),
        ("a://b://c.com/en/", "b:", "//c.com/en/", None, "allow"),
    ]
    df = spark.createDataFrame([(r[0], "v") for r in rows], "url string, rule string")
    out = urls.judge(df, urls.RULES, spark.createDataFrame([], "src string, dst string")).collect()
    assert {(r.url, r.url_host, r.url_path, r.url_rule, r.url_verdict) for r in out} == set(rows)


def test_url_query_takes_each_verdict_from_the_contract(spark, tmp_path):
    contract = "block com/en/, allow example.com/en/7, allow net/de/, block example.net/de/8, block org/es/"
    want = dict(reversed(r.split()) for r in contract.split(", "))
    assert {h + p: v for v, h, p in urls.RULES} == want
    rows = [(1, "http://m.example.net/de/132#top", "<p>"), (2, "http://m.example.net/de/83", "<p>"), (3, "http://a.org/es/1", "<p>"), (4, "http://a.com/en/7", "<p>"), (5, "http://example.com/en/7", "<p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.op7_url_filter(spark, str(tmp_path)).collect()}
    rules = {1: "net/de/", 2: "example.net/de/8", 3: "org/es/", 4: "com/en/", 5: "example.com/en/7"}
    assert got == {i: (r, want[r]) for i, r in rules.items()}


def test_url_verdicts_spread_over_aliases_and_explicit_allow_wins(spark):
    e = [("http://m.xx/1", "http://m.xx/2"), ("http://m.xx/2", "http://a.com/en/1"), ("http://n.xx/1", "http://example.com/en/7"), ("http://n.xx/1", "http://b.com/en/2"), ("http://m.xx/1", "http://m.xx/1"), (None, "http://m.xx/1")]
    names = sorted({u for p in e for u in p if u} | {"http://free.xx/"})
    df = spark.createDataFrame([(u,) for u in [*names, names[0]]], "url string")
    got = {r.url: r.url_verdict for r in urls.judge(df, urls.RULES, spark.createDataFrame(e, "src string, dst string")).collect()}
    assert got == {"http://m.xx/1": "block", "http://m.xx/2": "block", "http://a.com/en/1": "block", "http://n.xx/1": "allow", "http://example.com/en/7": "allow", "http://b.com/en/2": "block", "http://free.xx/": "allow"}


def test_page_links(spark):
    html = "<link href='/c' rel='canonical'><meta http-equiv=\"refresh\" content=\"0; url=http://z.xx/r\"><link rel=stylesheet href=/no>"
    df = spark.createDataFrame([("http://h.xx/a/b", html), (None, html), ("http://h.xx/q", None)], "url string, html string")
    assert sorted(tuple(r) for r in urls.page_edges(df).collect()) == [("http://h.xx/a/b", "http://h.xx/c"), ("http://h.xx/a/b", "http://z.xx/r")]


def test_decontamination_equals_brute_force(spark):
    import regex

    rng = random.Random(2)
    items = [(i, " ".join(f"q{i}x{j}" for j in range(rng.choice([5, 8, 20, 60])))) for i in range(12)] + [(50, "two words"), (51, "One"), (52, None), (53, ""), (54, "..."), (1, "q1x0 other text entirely here now")][:-1]
    docs = []
    for d in range(60):
        w = [f"z{rng.randrange(500)}" for _ in range(rng.choice([0, 5, 300]))]
        if d % 3 == 0:
            q = items[rng.randrange(12)][1].split()
            q = [x if rng.random() > 0.03 else "swap" for x in q]
            at = rng.randrange(len(w) + 1)
            w[at:at] = [x.upper() if rng.random() < 0.2 else x + rng.choice(["", ",", "."]) for x in q]
        if d % 20 == 1:
            w += ["Two", "words!"]
        docs.append((d, " ".join(w)))
    docs += [(900, None), (901, ""), (None, items[0][1])]
    words = lambda t: [x for x in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if x]
    shingles = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, t in items:
        w = words(t)
        if not w:
            continue
        k = min(5, len(w))
        s = shingles(w, k)
        for d, x in docs:
            if d is not None and (c := len(s & shingles(words(x), k))) >= 0.75 * len(s):
                want.add((d, i, len(s), c))
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item int").repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in decontaminate.contaminated(df, it).collect()} == want and want
    kept = {r.doc_id for r in decontaminate.drop_contaminated(df, it).collect()}
    assert kept == {d for d, _ in docs} - {w[0] for w in want}
    assert decontaminate.contaminated(df, it.where("false")).count() == 0
    assert decontaminate.contaminated(df.where("false"), it).count() == 0


def test_page_edges_of_tags_that_quote_a_closing_sign(spark):
    rows = [
        ("http://a.xx/1", '<link title="a > b" rel="canonical" href="http://a.xx/2">'),
        ("http://b.xx/1", '<META content="0; url=http://b.xx/?q=>1" http-equiv="Refresh">'),
        ("http://c.xx/1", '<link rel="c&#97;nonical" href="/2">'),
        ("http://d.xx/1", '<link rel="icon" href="/2"><p>canonical refresh</p>'),
        ("http://e.xx/1", None),
    ]
    got = {(r.src, r.dst) for r in urls.page_edges(spark.createDataFrame(rows, "url string, html string")).collect()}
    assert got == {("http://a.xx/1", "http://a.xx/2"), ("http://b.xx/1", "http://b.xx/?q=>1"), ("http://c.xx/1", "http://c.xx/2")}
