"""HTML operators that need a tree: pandas UDFs over a small parser of our own."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
NOISE = frozenset(("sup", "style", "script"))
#: Headings at which the main text of a wiki page ends.
STOP_SECTIONS = frozenset(("references", "external links", "see also", "notes", "further reading"))


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """Elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def find_all(self, *tags: str) -> list[Node]:
        return [n for n in self.walk() if n.tag in tags]

    def strings(self) -> Iterator[str]:
        todo: list = list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                yield c
            else:
                todo += reversed(c.children)

    def text(self, joiner: str = " ") -> str:
        parts = (" ".join(s.split()) for s in self.strings())
        return joiner.join(p for p in parts if p)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS:
            self._close("p", BLOCKS - {"p"})
        elif tag in ("li", "tr"):
            self._close(tag, {"ul", "ol", "table"})
        elif tag in ("td", "th"):
            self._close("td", {"tr", "table"})
            self._close("th", {"tr", "table"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.at = self.at.parent

    def handle_endtag(self, tag):
        n = self.at
        while n.parent is not None and n.tag != tag:
            n = n.parent
        if n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)

    def _close(self, tag, scope):
        n = self.at
        while n.parent is not None and n.tag not in scope:
            if n.tag == tag:
                self.at = n.parent
                return
            n = n.parent


def parse(html: str | None) -> Node:
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def strip_noise(root: Node) -> Node:
    """Drops superscripts, styles, scripts and reference or sort-key spans (HTM-01)."""
    for n in [root, *root.walk()]:
        n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in NOISE or c.tag == "span" and (c.has_class("reference") or c.has_class("sortkey")))]
    return root


def main_text(html: str | None, container: str = "mw-parser-output", heading_prefix: str = "", lists: bool = True, twice: bool = False, stop: frozenset[str] = STOP_SECTIONS) -> str:
    """Headings, paragraphs and lists of the body in order, up to the first stop section (HTM-02).

    List text comes once; ``twice`` repeats the items after their list. Without the body the text is empty.
    """
    root = strip_noise(parse(html))
    body = next((n for n in root.walk() if n.tag == "div" and n.has_class(container)), None) or next((n for n in root.walk() if n.tag == container), None)
    if body is None:
        return ""
    tags = {"h2", "h3", "h4", "p"} | ({"ul", "ol"} | ({"li"} if twice else set()) if lists else set())
    out: list[str] = []
    inside: set[int] = set()
    for n in body.walk():
        if n.tag not in tags or (not twice and id(n.parent) in inside and n.tag in ("ul", "ol")):
            continue
        text = n.text()
        if n.tag in ("h2", "h3", "h4"):
            if text.lower().removesuffix(" edit").removesuffix("[ edit ]").strip() in stop:
                break
            text = heading_prefix + text
        if n.tag in ("ul", "ol"):
            inside |= {id(x) for x in n.walk()}
        if text:
            out.append(text)
    return "\n\n".join(out)


def paragraphs(html: str | None) -> str:
    """All paragraphs (HTM-03)."""
    return "\n\n".join(t for t in (p.text() for p in parse(html).find_all("p")) if t)


def infobox(html: str | None, exact_class: bool = False, sticky: bool = False) -> dict[str, dict[str, str]]:
    """Section -> key -> value of the first infobox table (HTM-04); ``sticky`` opens with the first header (HTM-05)."""
    root = strip_noise(parse(html))
    table = next((n for n in root.walk() if n.tag == "table" and ("infobox" in n.attrs.get("class", "").split() if exact_class else "infobox" in n.attrs.get("class", ""))), None)
    out: dict[str, dict[str, str]] = {}
    section = None
    for row in table.find_all("tr") if table else []:
        head, cell = next(iter(row.find_all("th")), None), next(iter(row.find_all("td")), None)
        if head is not None and cell is None:
            section = head.text()
        elif head is not None:
            key = head.text()
            if sticky and section is None:
                section = key
            out.setdefault(section or key, {})[key] = " | ".join(p for p in (" ".join(s.split()) for s in cell.strings()) if p)
    return out


def wikitables(html: str | None, within: str | None = None) -> list[dict]:
    """Columns (all header cells) and rows (all but the first row) of each wiki or sortable table (HTM-06)."""
    root = strip_noise(parse(html))
    if within is not None:
        root = next((n for n in root.walk() if n.tag == "div" and n.has_class(within)), Node("", {}, None))
    found = [n for n in root.walk() if n.tag == "table" and any(c in n.attrs.get("class", "") for c in ("wikitable", "sortable"))]
    return [{"columns": [h.text() for h in t.find_all("th")], "rows": [[c.text() for c in r.find_all("td", "th")] for r in t.find_all("tr")[1:]]} for t in found]


def generic_page(html: str | None) -> dict:
    """Readable text, information cards and header-row tables of any page (HTM-07, HTM-08)."""
    root = strip_noise(parse(html))
    for n in [root, *root.walk()]:
        n.children = [c for c in n.children if isinstance(c, str) or not (c.tag in ("nav", "footer", "header", "aside", "form", "noscript", "head") or c.has_class("ad"))]
    body = next((n for n in root.walk() if n.tag in ("article", "main")), None) or root
    blocks = [n.text() for n in body.walk() if n.tag in ("h1", "h2", "h3", "h4", "p", "li")]
    cards = [n.text() for n in root.walk() if any(n.has_class(c) for c in ("infobox", "sidebar", "summary", "card"))]
    tables = []
    for t in root.find_all("table"):
        rows = [[c.text() for c in r.find_all("td", "th")] for r in t.find_all("tr")]
        if rows:
            tables.append({"columns": rows[0], "rows": rows[1:]})
    return {"text": "\n".join(b for b in blocks if b) or body.text(), "cards": cards, "tables": tables}


TEXTS = T.ArrayType(T.StringType())
TABLES = T.ArrayType(T.StructType([T.StructField("columns", TEXTS), T.StructField("rows", T.ArrayType(TEXTS))]))
PAGE = T.StructType([T.StructField("text", T.StringType()), T.StructField("cards", TEXTS), T.StructField("tables", TABLES)])


def main_text_udf(**options):
    @F.pandas_udf(T.StringType())
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: main_text(h, **options))

    return run


def infobox_udf(**options):
    @F.pandas_udf(T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType())))
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: infobox(h, **options))

    return run


def tables_udf(within: str | None = None):
    @F.pandas_udf(TABLES)
    def run(html: pd.Series) -> pd.Series:
        return html.map(lambda h: wikitables(h, within))

    return run


@F.pandas_udf(PAGE)
def generic_page_udf(html: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([generic_page(h) for h in html], columns=["text", "cards", "tables"])
