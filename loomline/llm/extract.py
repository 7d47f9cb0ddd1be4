"""Main text of HTML pages, with site template removal.

Pages are parsed into element trees (unclosed and stray tags follow the HTML rules for paragraphs and list
items). Two hashes are counted over the different pages of each host in Spark: of each container, list and
table the subtree itself (names, classes, links, texts and children), and its place (the names and classes
on the path to it, digits and ids apart), with the characters of text outside links that stand there over all
the host's pages. What stands on ``least_pages`` pages of a host or more recurs.

* The main text of a host's pages is found by descending from the top into the recurring place that holds
  more than half of the text. Neither it nor anything around it is ever dropped.
* A subtree that recurs goes, and so does any container, list or table in a recurring place aside from the
  main text, whatever it is called. These are the site's template.
* Names, classes and roles that say menu, header, footer, sidebar, notice, advert, form or reader comment only
  decide where counts do not: within the main text, and in places that do not recur. A class that begins with
  a word like ``no`` or ``has`` says nothing.

The text is what is left of the page's articles (of those around or within the main text, where that was
found by counts), else of its main element or its body: character references decoded, white space inside a block as
one space, blocks joined by one space. Paragraphs and headings are never judged by count, so text that
articles share stays.

Null and empty pages have an empty text; null URLs share the empty host. Exact copies of a page on its host
count once, so copying a page makes no template of its content; cut-off pages are read as far as they go.
Other columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Workspace, is_small, without
from .text import slices
from .urls import host_of

LEAST_PAGES = 5
TEMPLATES_AT_ONCE = 1 << 19  # 8 MB for each task; beyond it pages are joined to what recurs on them

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CONTAINERS = set("div section aside nav header footer form fieldset figure details dialog menu".split())
COUNTED = CONTAINERS | set("ul ol dl table".split())
DROPPED = set("script style noscript template nav header footer aside form fieldset button input select textarea iframe svg canvas object embed dialog menu head title xmp noembed noframes".split())
UNSEEN = set("script style noscript template".split())
SAYS_NO = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent notice notices gdpr alert"
    " sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer comment comments commentlist respond reply replies disqus share sharing social"
    " related recommended newsletter subscribe popup modal overlay toolbar pagination pager widget login search complementary contentinfo".split()
)
KEPT_ANYWAY = set("html body article main h1 h2 h3 h4 h5 h6".split())
SAYS_NOTHING = set("no not non without has have with is show hide hidden".split())  # before another word of a class
PLACES = COUNTED | {"article", "main", "body"}
ENDS_P = set("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ENDS_SAME = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}
SCOPE = set("article main section div td th table aside nav header footer body html form li blockquote".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*+)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_WORD = re.compile(r"[a-z]+")
_DIGITS = re.compile(r"\d+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Element:
    __slots__ = ("tag", "label", "children", "says_no", "comment", "key", "place", "chars", "around")

    def __init__(self, tag: str, rest: str):
        self.tag, self.children, self.key, self.place, self.chars, self.around = tag, [], None, 0, 0, False
        at = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(rest)} if rest.strip(" /") else {}
        self.label = _HUMP.sub("-", " ".join(at.get(k, "") for k in ("class", "id", "role"))).lower().strip()
        words = [w for token in self.label.split() if (found := _WORD.findall(token)) and (found[0] not in SAYS_NOTHING or len(found) == 1) for w in found]
        self.comment = not {"comment", "comments", "reply"}.isdisjoint(words)
        says = tag not in KEPT_ANYWAY and (not SAYS_NO.isdisjoint(words) or "hidden" in at)
        self.says_no = tag in DROPPED or says or tag == "article" and self.comment

    def elements(self) -> list[Element]:
        return [c for c in self.children if not isinstance(c, str)]


def parse(html: str) -> Element:
    """The tree under a root element; comments and declarations are left out."""
    root = Element("html", "")
    stack, at = [root], 0
    while True:
        m = _TOKEN.search(html, at)
        if (cut := html[at : m.start()] if m else html[at:]):
            stack[-1].children.append(cut)
        if not m:
            return root
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag = name.lower()
        if m[1] or m[4]:
            if tag == "p" and not any(e.tag == "p" for e in stack):
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag in INLINE and stack[i].tag in SCOPE:
                    break
            continue
        if tag in ("html", "body", "head") and len(stack) > 1 and tag != "body":
            continue
        if tag in ENDS_P:
            _end(stack, ("p",), SCOPE)
        if tag in ENDS_SAME:
            _end(stack, ("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,), ENDS_SAME[tag])
        element = Element(tag, m[3] or m[6] or "")
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(html, at)
            at = end.start() if end else len(html)
            if tag in ("textarea", "title"):
                element.children.append(html[m.end() : at])
            if end:
                close = html.find(">", at)
                at = close + 1 if close >= 0 else len(html)
        elif tag not in VOID and not (m[3] or m[6] or "").endswith("/"):
            stack.append(element)


def _end(stack: list[Element], tags: tuple[str, ...], scope: tuple[str, ...] | set[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in scope:
            return


def measure(root: Element) -> tuple[list[int], dict[int, int]]:
    """Hashes of the containers, lists and tables under root, and the characters of text in each place; both are noted on the elements."""
    subtrees: list[int] = []
    places: dict[int, int] = {}
    todo, order = [root], []
    root.place = xxhash.xxh3_64_intdigest("place")
    while todo:  # without recursion: pages may nest deeply
        x = todo.pop()
        order.append(x)
        for c in x.elements():
            c.place = xxhash.xxh3_64_intdigest(f"{x.place} {c.tag} {_DIGITS.sub('0', c.label)}") if c.tag in PLACES else x.place
            todo.append(c)
    for x in reversed(order):
        h, x.chars = xxhash.xxh3_64(f"{x.tag} {x.label}"), 0
        for c in x.children:
            if isinstance(c, str):
                words = " ".join(c.split())
                x.chars += len(words)
                h.update(words + "\x00")
            else:
                x.chars += c.chars
                h.update(f"\x01{c.key}")
        if x.tag == "a" or x.tag in UNSEEN or x.tag in ("head", "title"):
            x.chars = 0
        x.key = h.intdigest()
        if x.tag in COUNTED:
            subtrees.append(x.key)
        if x.tag in PLACES or x is root:
            places[x.place] = places.get(x.place, 0) + x.chars
    return subtrees, places


def _inner(x: Element) -> list[Element]:
    """The nearest elements under x that make a place of their own."""
    found, todo = [], x.elements()
    while todo:
        c = todo.pop()
        if c.tag in PLACES:
            found.append(c)
        else:
            todo += c.elements()
    return found


def main_place(root: Element, recurring: dict[int, int], template: set[int]) -> list[Element]:
    """Elements of the page where most of its host's text stands: down into what recurs and holds more than half. None if that is the page itself; never a subtree that recurs as it is."""
    here, total = [root], recurring.get(root.place, 0)
    while total:
        inner = [c for x in here for c in _inner(x) if c.key not in template]
        best = max((c.place for c in inner), key=lambda p: (recurring.get(p, 0), p), default=None)
        if best is None or 2 * recurring.get(best, 0) <= total:
            break
        here, total = [c for c in inner if c.place == best], recurring[best]
    return [] if here[0] is root else here


def _articles(root: Element) -> list[Element]:
    """The page's outermost articles that are no reader comments, else its main element, else its body."""
    found: dict[str, list[Element]] = {"article": [], "main": [], "body": []}
    todo = [root]
    while todo:
        x = todo.pop()
        if x.tag in DROPPED or x.tag == "article" and x.comment:
            continue
        role = "main" if x.tag == "main" or "main" in x.label.split() and x.tag not in ("article", "body") else x.tag
        if role in found:
            found[role].append(x)
        if role != "article":
            todo += reversed(x.elements())
    return found["article"] or found["main"][:1] or found["body"][:1] or [root]


def _under(tops: list[Element]) -> set[int]:
    seen, todo = set(), list(tops)
    while todo:
        x = todo.pop()
        if id(x) not in seen:
            seen.add(id(x))
            todo += x.elements()
    return seen


def _note_around(root: Element, kept: set[int]) -> None:
    """Note the elements that hold one of those kept."""
    todo, order = [root], []
    while todo:
        x = todo.pop()
        order.append(x)
        todo += x.elements()
    for x in reversed(order):
        x.around = id(x) in kept or any(c.around for c in x.elements())


def main_text(tree: Element, template: set[int] = frozenset(), recurring: dict[int, int] | None = None) -> tuple[str, int]:
    """The text of a page, and how many subtrees went by their counts.

    ``template`` has the hashes of the page's subtrees that recur on its host, ``recurring`` the host's
    characters in the page's places that recur.
    """
    recurring = recurring or {}
    main = main_place(tree, recurring, template)
    roots, within = _articles(tree), _under(main)
    if main:
        _note_around(tree, {id(x) for x in main})
        near = [x for x in roots if x.tag == "article" and (x.around or id(x) in within)]
        roots = near or [tree]
    _note_around(tree, {id(x) for x in (*main, *roots)})
    blocks: list[str] = []
    run: list[str] = []
    gone = 0

    def close() -> None:
        if words := unescape("".join(run)).split():
            blocks.append(" ".join(words))
        run.clear()

    def goes(x: Element) -> int:
        """2 by count, 1 by name, 0 not."""
        if x.tag in UNSEEN or x.tag in ("head", "title"):
            return 1
        if x.around:
            return 0
        if x.tag in COUNTED and (x.key in template or main and id(x) not in within and x.place in recurring):
            return 2
        return int(x.says_no)

    def aside(x: Element) -> None:
        """Count what goes by its count outside the articles."""
        nonlocal gone
        todo = [x]
        while todo:
            x = todo.pop()
            if (how := goes(x)) == 2:
                gone += 1
            elif not how and (x.around and x not in roots):
                todo += x.elements()

    if roots != [tree]:
        aside(tree)
    for root in roots:
        todo: list = [root]
        while todo:
            x = todo.pop()
            if x is None:
                close()
            elif isinstance(x, str):
                run.append(x)
            elif x.tag == "br":
                run.append("\n")
            elif x is not root and (how := goes(x)):
                gone += how == 2
                if x.tag not in INLINE and x.tag not in UNSEEN:  # what goes still parts the blocks around it
                    close()
            else:
                if x.tag not in INLINE:
                    close()
                    todo.append(None)
                todo += reversed(x.children)
        close()
    return " ".join(blocks), gone


def _of_host(host: str | None, keys: list[int]) -> np.ndarray:
    """Subtree hashes that hold for one host alone."""
    return (np.array(keys, np.uint64) ^ np.uint64(xxhash.xxh3_64_intdigest(host or ""))).view(np.int64)


def _seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each page the hashes of its subtrees and places, with the characters in a place (null for a subtree)."""
    for b in slices(batches, "html"):
        keys, chars = [], []
        for host, html in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
            subtrees, places = measure(parse(html or ""))
            subtrees = sorted(set(subtrees))
            keys.append(_of_host(host, [*subtrees, *places]))
            chars.append([None] * len(subtrees) + list(places.values()))
        yield pa.RecordBatch.from_arrays([b.column("page"), pa.array(keys, pa.list_(pa.int64())), pa.array(chars, pa.list_(pa.int64()))], ["page", "keys", "chars"])


def _extract(names: list[str], everywhere: tuple[np.ndarray, np.ndarray] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "__html"):
            out, gone = [], []
            for i, (host, html) in enumerate(zip(b.column("__host").to_pylist(), b.column("__html").to_pylist(), strict=True)):
                if everywhere is None:
                    of_page = b.column("__template")[i].as_py() or []
                    known, chars = np.array([t["key"] for t in of_page], np.int64), np.array([t["chars"] for t in of_page], np.int64)
                else:
                    known, chars = everywhere
                tree, template, recurring = parse(html or ""), set(), {}
                if len(known):
                    subtrees, places = measure(tree)
                    for keys, found in ((subtrees, lambda k, n: template.add(k)), (list(places), recurring.__setitem__)):
                        mine = _of_host(host, keys)
                        at = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                        for k, j, hit in zip(keys, at, known[at] == mine, strict=True):
                            if hit:
                                found(k, int(chars[j]))
                text, n = main_text(tree, template, recurring)
                out.append(text), gone.append(n)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(out, pa.string()), pa.array(gone, pa.int32())], [*names, "main_text", "template_subtrees"])

    return run


def extract_main_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", least_pages: int = LEAST_PAGES, ws: Workspace | None = None) -> DataFrame:
    """All rows of pages with main_text and template_subtrees (how many went by their counts), which replace columns of these names.

    Hashes hold for their host alone. Up to TEMPLATES_AT_ONCE of those that recur go to every task; of more, each
    page gets its own by a join, so what a row carries is bounded by its page and not by its host.
    """
    ws = ws or Workspace(pages.sparkSession)
    pages = without(pages, "main_text", "template_subtrees")
    names = pages.columns
    host, html = host_of(F.coalesce(F.col(f"`{url_col}`"), F.lit(""))), F.col(f"`{html_col}`")
    base = pages.select(*(F.col(f"`{c}`") for c in names), F.xxhash64(host, html).alias("__page"), host.alias("__host"), html.alias("__html"))
    seen = base.select(F.col("__page").alias("page"), F.col("__host").alias("host"), F.col("__html").alias("html")).mapInArrow(_seen, "page long, keys array<long>, chars array<long>")
    seen = ws.save(seen, "seen").dropDuplicates(["page"])
    each = ws.save(seen.select("page", F.explode(F.arrays_zip("keys", "chars")).alias("k")).select("page", F.col("k.keys").alias("key"), F.col("k.chars").alias("chars")), "pages")
    known = each.groupBy("key").agg(F.count("*").alias("n"), F.coalesce(F.sum("chars"), F.lit(0)).alias("chars")).where(F.col("n") >= least_pages)
    known = ws.save(known.select("key", "chars"), "recurring")
    everywhere = None
    if is_small(known, TEMPLATES_AT_ONCE):
        rows = sorted((r["key"], r["chars"]) for r in known.collect())
        everywhere = np.array([k for k, _ in rows], np.int64), np.array([c for _, c in rows], np.int64)
        base = base.withColumn("__template", F.lit(None).cast("array<struct<key:long,chars:long>>"))
    else:
        marked = each.select("page", "key").join(known, "key").groupBy(F.col("page").alias("__key")).agg(F.sort_array(F.collect_list(F.struct("key", "chars"))).alias("__template"))
        base = base.join(ws.save(marked, "marked"), F.col("__page") == F.col("__key"), "left")
    schema = T.StructType([*pages.schema.fields, T.StructField("main_text", T.StringType()), T.StructField("template_subtrees", T.IntegerType())])
    return base.select(*(F.col(f"`{c}`") for c in names), "__host", "__html", "__template").mapInArrow(_extract(names, everywhere), schema)


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


OP8_SQL = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1) AS x FROM pages
), t AS (
  SELECT page_id, url, regexp_replace(regexp_replace(x, '</?(?:b|a|i|em|strong|span)(?:\s[^>]*)?>', '', 'g'), '<[^>]*>', ' ', 'g') AS x FROM a
), d AS (
  SELECT page_id, url, trim(regexp_replace(html_unescaped, '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, url, replace(replace(replace(replace(replace(replace(x, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&') AS html_unescaped FROM t)
)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""
