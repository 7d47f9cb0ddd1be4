import hashlib
import io
import random

import pytest

import corpus_pipeline
from loomline.llm import archives, extract

ODD = ["", None, "WARC/1.1\r\n\r\n\r\nWARC-Type: response", "x\n" * 90, "é \r\n\r\n" * 40, "http://a 0.0.0.0 20240101000000 text/html 3\nabc", "\r\n\r\n" * 60]


@pytest.mark.parametrize("version", [1, 2])
def test_arc_round_trip(version):
    rows = [(i, u, (t or "").encode()) for i, (u, t) in enumerate(zip(["http://a/b c", None, "", "http://é/", "x", "y", "z"], ODD))]
    got = list(archives.read_arc(archives.arc_segment(rows, version)))
    assert [archives.http_parts(r["body"])[2] for r in got] == [p for _, _, p in rows]
    assert [int(archives.http_parts(r["body"])[0]["X-Page-Id"]) for r in got] == list(range(7))
    assert got[0]["URL"] == "http://a/b%20c" and got[1]["URL"] == "urn:x-page:1"
    warc = b"".join(archives.warc_record(r, archives.record_id(r, "", "a")) + b"\r\n\r\n" for r in got)
    back = list(archives.read_warc(io.BytesIO(warc)))
    assert [archives.http_parts(b)[2] for _, b in back] == [p for _, _, p in rows]
    assert back[0][0]["WARC-Date"] == "2024-01-01T00:00:00Z" and len({f["WARC-Record-ID"] for f, _ in back}) == 7


def test_broken_archives_are_refused():
    whole = archives.arc_segment([(1, "http://a/", b"body")], 1)
    with pytest.raises(ValueError):
        list(archives.read_arc(whole[:-3]))
    with pytest.raises(ValueError):
        list(archives.read_arc(b"http://a/ 0.0.0.0 20240101000000 text/html 2\nab\n"))
    record = archives.warc_record(next(archives.read_arc(whole)), "<urn:uuid:0>")
    with pytest.raises(ValueError):
        list(archives.read_warc(io.BytesIO(record.replace(b"body", b"bodx"))))


LEGACY = b"1 0 crawler\nURL IP-address Archive-date Content-type Archive-length\n"


def legacy(*records):
    """A version-1 file whose records have no page ids: (header line without its length, body)."""
    out = b"filedesc://x.arc 0.0.0.0 1999 text/plain %d\n" % len(LEGACY) + LEGACY + b"\n"
    return out + b"".join(head + b" %d\n" % len(body) + body + b"\n" for head, body in records)


def test_header_lines_of_real_archives():
    odd = legacy((b"http://a/x y 1.2.3.4 19990102030405 text/html; charset=utf-8", b"HTTP/1.0 200 OK\r\n\r\nhi"), (b"http://b/\xe9 - 19990102 ", b"plain \xff"), (b"dns:c 1.2.3.4 19990102030405 text/dns", b"c A 1"))
    got = list(archives.read_arc(odd))
    assert [(r["URL"], r["Content-type"], r["Archive-date"]) for r in got] == [("http://a/x y", "text/html; charset=utf-8", "19990102030405"), ("http://b/%E9", "", "19990102"), ("dns:c", "text/dns", "19990102030405")]
    back = list(archives.read_warc(io.BytesIO(b"".join(archives.warc_record(r, f"<urn:uuid:{i}>") + b"\r\n\r\n" for i, r in enumerate(got)))))
    assert [f["WARC-Type"] for f, _ in back] == ["response", "resource", "resource"]
    assert [b for _, b in back] == [b"HTTP/1.0 200 OK\r\n\r\nhi", b"plain \xff", b"c A 1"]
    assert [f["WARC-Date"] for f, _ in back] == ["1999-01-02T03:04:05Z", "1999-01-02T00:00:00Z", "1999-01-02T03:04:05Z"]
    two = archives.arc_segment([(1, "http://a/", b"x")], 2).replace(b"text/html 200", b"text/html; charset=latin1 200")
    assert next(archives.read_arc(two))["Content-type"] == "text/html; charset=latin1"
    bad: list = []
    assert len(list(archives.read_arc(odd + b"no header\nrest", bad))) == 3 and len(bad) == 1


def test_archives_without_page_ids_have_revisits_and_bad_rests_are_set_aside(spark, tmp_path):
    body = b"HTTP/1.0 200 OK\r\n\r\n" + b"same payload " * 20
    files = [legacy((b"http://a/1 - 19990102030405 text/html", body), (b"http://a/2 - 19990102030405 text/html", body)), legacy((b"http://a/1 - 19990102030405 text/html", body)) + b"broken\n", b""]
    arcs = spark.createDataFrame([(f,) for f in files], "content binary")
    archives.convert(arcs, f"{tmp_path}/warc")
    got = archives.read_archives(spark, f"{tmp_path}/warc").collect()
    first = [r for r in got if r.record_type == "response"]
    assert len(got) == 3 and len(first) == 1 and len({r.record_id for r in got}) == 3
    assert {r.refers_to_id for r in got} == {None, first[0].record_id}
    assert first[0].record_id == min(r.record_id for r in got)
    assert archives.set_aside(arcs).count() == 1


def test_equal_rows_are_records_of_their_own(spark, tmp_path):
    row = (1, "http://a/", "long enough to revisit " * 9)
    spark.createDataFrame([row, row, (None, None, "x" * 200)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = archives.op5_warc(spark, str(tmp_path)).collect()
    assert sorted((str(r.page_id), r.record_type) for r in got) == [("1", "response"), ("1", "revisit"), ("None", "response")]


def test_warc_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    payloads = [*ODD, "same " * 30, "other " * 40]
    rows = [(i * 3 % 101, f"http://h{i}/ x", rng.choice(payloads), "t") for i in range(101)]
    spark.createDataFrame(rows, "page_id long, url string, html string, record_type string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    first = {}
    for i, _, h, _ in rows:
        first[h or ""] = min(first.get(h or "", i), i)
    want = set()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        to = first[h or ""] if len(b) >= 100 and first[h or ""] != i else None
        want.add((i, len(b), hashlib.sha256(b).hexdigest(), "response" if to is None else "revisit", to))
    assert {tuple(r) for r in archives.op5_warc(spark, str(tmp_path)).collect()} == want


def test_warc_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert archives.op5_warc(spark, str(tmp_path)).count() == 0


def text(html, template=()):
    return extract.main_text(extract.parse(html), set(template))[0]


def test_main_text_of_messy_pages():
    assert text("<body><nav>n</nav><article><h1>T&amp;t</h1><p>a<b>b</b>\n c<br>d<p>e&nbsp;f</article><footer>x") == "T&t ab c d e f"
    assert text("<article><p>a<script>var t='</p>'</script>b<style>p{}</style><!-- <p>no</p> -->c</p></article>") == "abc"
    assert text("<article>x<div class='ad box'>no</div><aside>no</aside><form>no</form><section id=comments>no</section>y</article>") == "x y"
    assert text("<div class=menu>m</div><p>only body</p><div class='cookie-notice'>n</div>") == "only body"
    assert text("<article>a<div id=sidebar2>no</div><div class=siteFooter>no</div><ol class=commentlist><li>no</ol>b</article>") == "a b"
    assert text("<main><p>m</p></main><p>out</p>") == "m"
    assert text("<article><p>cut off <b>here") == "cut off here"
    assert text("<article>a < b and 1<2 &lt;p&gt; &#233; &bogus; <a title='x > y'>l</a></article>") == "a < b and 1<2 <p> é &bogus; l"
    assert text("<article><p>in</p></article><article class=comment>no</article>") == "in"
    assert text("<ARTICLE><UL><LI>one<LI>two</UL><TABLE><TR><TD>c1<TD>c2</TABLE></ARTICLE>") == "one two c1 c2"
    assert text("") == "" and text("<!-- open") == "" and text("<article></article>") == ""
    assert text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_templates_of_a_host_go_and_shared_paragraphs_stay(spark):
    box = "<div><p>Subscribe for more</p></div>"
    rows = [(i, f"http://h.xx/{i}", f"<article><p>shared line</p><p>own {i}</p>{box}</article>") for i in range(12)]
    rows += [(100, "http://other.xx/", f"<article><p>a</p>{box}</article>"), (101, None, None), (102, "http://h.xx/", "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, Main_Text string").repartition(3)
    got = {r.page_id: r.main_text for r in extract.extract_main_text(df).collect()}
    assert got == {i: f"shared line own {i}" for i in range(12)} | {100: "a Subscribe for more", 101: "", 102: ""}
    assert extract.extract_main_text(df.where("false")).count() == 0


@pytest.mark.parametrize("at_once", [extract.TEMPLATES_AT_ONCE, 0])
def test_template_counts_do_not_scale_with_the_host(spark, monkeypatch, at_once):
    """A block on a few pages of a large host goes, lists and tables too; copies of one page make no template."""
    monkeypatch.setattr(extract, "TEMPLATES_AT_ONCE", at_once)
    few = "<div><p>moved</p></div><ul><li>one<li>two</ul><table><tr><td>cell</table>"
    rows = [(i, f"http://big.xx/{i}", f"<article><p>own {i}</p>{few if i < 6 else ''}</article>") for i in range(200)]
    rows += [(1000 + i, f"http://big.xx/c{i}", "<article><p>copy</p><div>same</div></article>") for i in range(9)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.main_text for r in extract.extract_main_text(df).collect()}
    assert got == {i: f"own {i}" for i in range(200)} | {1000 + i: "copy same" for i in range(9)}


def test_names_of_what_holds_the_text_decide_nothing():
    assert text('<div class="wrap has-sidebar"><article><p>Main text</p></article></div>') == "Main text"
    assert text('<article>a <div class="content no-comments">b</div><div class="comments">no</div></article>') == "a b"


def test_templates_without_telling_names_go_by_their_counts(spark):
    """Menus, adverts and side boxes in plain divs, other words on each page; no article element."""
    word = lambda i, k: f"w{i}x{k}"

    def page(i):
        menu = "".join(f"<li><a href=/{word(i, k)}>{word(i, k)}</a>" for k in range(5))
        text = "".join(f"<p>{' '.join(word(i, 100 + k) for k in range(40))}</p>" for _ in range(1 + i % 3))
        return f"<body><div class=a><ul>{menu}</ul></div><div class=b{i}>{word(i, 7)}</div><h1>T{i}</h1><div class=c><div>{text}</div><div>box of all</div></div><div class=d>{word(i, 8)} {word(i, 9)}</div></body>"

    rows = [(i, f"http://h.xx/{i}", page(i)) for i in range(8)] + [(100, "http://lone.xx/", page(100))]
    out = {r.page_id: r for r in extract.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()}
    for i in range(8):
        p = " ".join(word(i, 100 + k) for k in range(40))
        assert out[i].main_text == " ".join([f"T{i}", *[p] * (1 + i % 3)]), i
        assert out[i].template_subtrees == 4
    assert out[100].template_subtrees == 0 and "w100x7" in out[100].main_text


def test_pipeline_stages_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices(["the", "ing", "er", "on", "le"], k=3))
    fresh = lambda n: [word() + str(rng.randrange(10**6)) for _ in range(n)]
    passage, leak, near = fresh(60), fresh(30), fresh(100)
    docs = {i: fresh(50) for i in range(20)}
    docs[30], docs[31] = near, near[:50] + ["changed"] + near[51:]
    docs[40], docs[41] = fresh(20) + passage, fresh(25) + passage + fresh(5)
    docs[50] = fresh(10) + leak + fresh(10)
    rows = [(i, " ".join(w), "en", "s", 0) for i, w in docs.items()] + [(60, "... 1 2", "en", "s", 7), (61, None, None, "s", 0), (62, "ภาษาไทย เป็นภาษา", None, "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(leak))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now, columns = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    seen = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if n < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and out.dtypes == now.dtypes
        out.write.parquet(f"{tmp_path}/out{n}")
        now = spark.read.parquet(f"{tmp_path}/out{n}")
        seen.append({r.doc_id for r in now.select("doc_id").collect()})
        if n == 2:
            kept = {r.doc_id: r for r in now.collect()}
            assert kept[40].text == " ".join(docs[40]) and kept[40].n_chars == 0
            assert kept[41].text == " ".join(docs[41][:25] + docs[41][-5:]) and kept[41].n_chars == len(kept[41].text)
    everything = set(docs)
    assert seen == [everything, everything - {31}, everything - {31}, everything - {31, 50}, everything - {31, 50}]
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen[-1]
