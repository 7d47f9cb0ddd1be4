"""String operators as column expressions: everything here runs inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"(?U)\s+"
PUNCTUATION = r"[!-/:-@\[-`{-~]"
ARTICLES = r"(?U)\b(a|an|the)\b"

#: Words that mark a numeric question (matched as substrings).
NUMERIC_WORDS = (
    "how many", "how much", "amount", "total", "number", "count", "percentage", "ratio", "average", "maximum", "minimum", "sum",
    "difference", "increase", "decrease", "proportion", "median", "mean", "variance", "percent", "rate", "frequency", "size", "measure",
    "volume", "extent", "capacity", "weight", "depth", "height", "length", "width", "distance", "range", "spread", "estimate", "value",
    "cost", "price", "quantity", "degree", "intensity", "score", "level", "balance", "remaining", "left", "duration", "time", "interval",
    "multiplied by", "divided by", "half of", "twice", "thrice", "quarter of", "portion of",
)


def quote(literal: str) -> str:
    """A literal as a pattern."""
    return "".join("\\" + c if c in r"\.[]{}()*+-?^$|" else c for c in literal)


def let(f, *cols: Column) -> Column:
    """f of the columns' values, each computed once for a row; inside lambdas a column is otherwise computed
    anew for every element."""
    bound = F.array(F.struct(*(c.alias(f"v{i}") for i, c in enumerate(cols))))
    return F.get(F.transform(bound, lambda v: f(*(v[f"v{i}"] for i in range(len(cols))))), F.lit(0))


def chain(c: Column, steps: Sequence[tuple[str, str]]) -> Column:
    """Ordered (pattern, replacement) substitutions."""
    for pattern, replacement in steps:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def collapse(c: Column) -> Column:
    """White space runs (Unicode) to one space, trimmed (STR-01)."""
    return F.trim(F.regexp_replace(c, SPACES, " "))


def clean_content(c: Column) -> Column:
    """Drops all but letters, digits, underscores and spaces; lower case (STR-04)."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}_\s]", ""), SPACES, " ")))


def safe_file_name(c: Column) -> Column:
    return F.regexp_replace(c, r'[<>:"/\\|?*\n\t]', "_")


def wiki_slug(url: Column) -> Column:
    """Percent-decoded path after /wiki/, empty without one; plus signs stay (STR-06)."""
    path = F.regexp_extract(url, r"^[^?#]*/wiki/([^?#]*)", 1)
    return F.when(F.contains(url, F.lit("/wiki/")), F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)).otherwise("")


def canonical_page_key(title: Column, url: Column, host: str = "https://en.wikipedia.org") -> Column:
    """Slug of the URL moved to one host, without fragment, in lower case; else the sanitised title (STR-07)."""
    moved = F.lower(F.split_part(F.regexp_replace(url, r"^https?://[^/]+", host), F.lit("#"), F.lit(1)))
    slug = wiki_slug(moved)
    return F.when(slug != "", slug).otherwise(F.regexp_replace(F.lower(title), r"(?U)[^\p{L}\p{N}_-]", "_"))


def is_http_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://"), F.lit(False))


def title_from_url(url: Column) -> Column:
    return F.replace(wiki_slug(url), F.lit("_"), F.lit(" "))


def repair_punctuation(c: Column) -> Column:
    """No-break spaces, dashes, zero-width spaces and stray bars of infobox text (STR-09)."""
    c = F.translate(c, "\u00a0\u2013\u2014", " --")
    return chain(c, [("\u200b", ""), (r" \| ", " "), (r"\( \|", "(")])


#: Residues of wiki markup, in the order in which they are cleaned (pattern, replacement).
WIKITEXT_STEPS: list[tuple[str, str]] = [
    (r"(?s)\{\{cite .*?\}\}", " "), ("TABLETOREPLACE", " "), ("'''", " "), (r"\[\[", " "), (r"\]\]", " "), (r"\{\{", " "), (r"\}\}", " "),
    ("<br>", " "), ("&quot;", '"'), ("&amp;", "&"), ("& amp;", "&"), ("nbsp;", " "), ("formatnum:", ""),
    (r"(?s)<math.*?</math>", ""), (r"(?s)<chem.*?</chem>", ""), (r"(?s)<score.*?</score>", ""),
    *((rf"\| ?{name}= ?.*? ", " ") for name in (
        "item[0-9]?_?style", "col[0-9]?_?style", "row[0-9]?_?style", "style", "bodystyle", "frame_?style", "data_?style", "label_?style",
        "headerstyle", "list_?style", "title_?style", "ul_?style", "li_?style", "border-style")),
    *((rf'\|? ?{name}=".*?"', "") for name in ("style", "rowspan", "colspan", "scope", "align", "valign", "lang", "bgcolor")),
    (r"\|? ?bg=\#[a-z]+", ""), (r'\|? ?width=".*?"', ""), (r"\|? ?height=[0-9]+", ""), (r"\|? ?width=[0-9]+", ""), (r"\|? ?rowspan=[0-9]+", ""),
    (r"\|? ?colspan=[0-9]+", ""), (r"[\n\t]", " "), (r"<.*?/>", ""), (r"\|? ?align=[a-z]+", ""), (r"\|? ?valign=[a-z]+", ""), (r"\|? ?scope=[a-z]+", ""),
    ("&lt;ref&gt;.*?&lt;/ref&gt;", " "), ("&lt;.*?&gt;", " "), (r"File:[A-Za-z0-9 ]+\.[a-z]{3,4}(\|[0-9]+px)?", ""), (r"Source: \[.*?\]", ""),
    (r"Country flag\|", "country:"), (r"flag\|", "country:"), (r"flagicon\|", "country:"), (r"flagcountry\|", "country:"), (r"Flagu\|", "country:"),
    ("display=inline", ""), ("display=it", ""), ("abbr=on", ""), ("disp=table", ""),
]


def clean_wikitext(c: Column) -> Column:
    return chain(F.trim(c), WIKITEXT_STEPS)


def normalize_answer(c: Column) -> Column:
    """Lower case, without ASCII punctuation and articles, single spaces (STR-11)."""
    return collapse(F.regexp_replace(F.regexp_replace(F.lower(c), PUNCTUATION, ""), ARTICLES, " "))


def normalize_light(c: Column) -> Column:
    return collapse(F.lower(c))


def strip_fence(c: Column) -> Column:
    """Content of a Markdown code fence that wraps the whole text (STR-14)."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def between_last(c: Column, start: str, end: str) -> Column:
    """Last text between two marks, trimmed; null without one (STR-15)."""
    return F.trim(F.try_element_at(F.regexp_extract_all(c, F.lit(f"(?s){quote(start)}(.*?){quote(end)}"), F.lit(1)), F.lit(-1)))


def between_fuzzy(c: Column, start: str, end: str) -> Column:
    """Text after the last start mark up to the end mark, or else to the end of its line (STR-16)."""
    rest = F.substring_index(c, start, -1)
    told = F.when(F.contains(rest, F.lit(end)), F.split_part(rest, F.lit(end), F.lit(1))).otherwise(F.split_part(rest, F.lit("\n"), F.lit(1)))
    return F.when(F.contains(c, F.lit(start)), F.trim(told))


def boxed(c: Column) -> Column:
    r"""Last \boxed{..} (greedy within its line), inner \text{..}, without parentheses (STR-17)."""
    inner = F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit(r"\\boxed\{(.*)\}"), F.lit(1)), F.lit(-1)), F.lit(""))
    text = F.try_element_at(F.regexp_extract_all(inner, F.lit(r"\\text\{(.*)\}"), F.lit(1)), F.lit(-1))
    return F.trim(F.coalesce(text, inner), F.lit("()"))


def self_ask_answer(c: Column, mark: str = "So the final answer is: ") -> Column:
    """Rest of the first line that holds the mark, up to the mark's next use (STR-18)."""
    line = F.get(F.filter(F.split(c, "\n"), lambda x: F.contains(x, F.lit(mark))), F.lit(0))
    return F.coalesce(F.trim(F.split_part(line, F.lit(mark), F.lit(2))), F.lit(""))


def marked_answer(c: Column, mark: str = "So the answer is:") -> Column:
    return F.when(F.contains(c, F.lit(mark)), F.trim(F.split_part(c, F.lit(mark), F.lit(2)))).otherwise(c)


def first_line(c: Column) -> Column:
    return F.trim(F.split_part(c, F.lit("\n"), F.lit(1)))


def last_choice(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.regexp_extract_all(c, F.lit("[A-D]"), F.lit(0)), F.lit(-1)), F.lit(""))


def tail_choices(c: Column, mark: str = "【答案】") -> Column:
    """All letters A to D after the mark, else in the last ten characters."""
    c = F.regexp_replace(c, SPACES, "")
    told = F.when(F.instr(c, mark) > 1, F.substr(c, F.instr(c, mark))).otherwise(F.right(c, F.lit(10)))
    return F.array_join(F.regexp_extract_all(told, F.lit("[A-D]"), F.lit(0)), "")


def title_and_body(c: Column) -> tuple[Column, Column]:
    """First line, and what follows it (empty without a line break) (STR-20)."""
    body = F.when(F.instr(c, "\n") == 0, F.lit("")).otherwise(F.substr(c, F.instr(c, "\n") + 1))
    return F.split_part(c, F.lit("\n"), F.lit(1)), body


def cut_at_stop(c: Column, stops: Sequence[str], keep: bool = False) -> Column:
    """Text up to the earliest stop word, with it if kept (STR-31)."""
    at = [F.struct(F.instr(c, s).alias("at"), F.lit(len(s)).alias("n")) for s in stops]
    hit = F.array_sort(F.filter(F.array(*at), lambda x: x["at"] > 0))
    first = F.get(hit, F.lit(0))
    return F.when(F.size(hit) == 0, c).otherwise(F.substr(c, F.lit(1), first["at"] - 1 + (first["n"] if keep else 0)))


def is_chinese(c: Column) -> Column:
    return c.rlike("[\u4e00-\u9fff]")


def content_id(*cols: Column) -> Column:
    """Identity of a content: hash of its JSON form with fields in the order given (STR-26)."""
    return F.sha1(F.to_json(F.struct(*cols)))


def token_set(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.regexp_replace(F.lower(c), PUNCTUATION, ""), SPACES), lambda w: w != ""))


def mint_id(prefix: Column | str, n: Column, digits: int = 6) -> Column:
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return F.format_string(f"%s_%0{digits}d", p, n)


def words_and_symbols(c: Column) -> Column:
    """Words and listed punctuation marks (STR-33)."""
    return F.regexp_extract_all(c, F.lit(r"[\p{L}\p{N}_]+|[<>=/!@#$%^&*()?\":{}|\\`~;_+-]"), F.lit(0))


#: Fixed value: the name of the inline mark that carries a segment's rate and flag.
COMPRESSION_TAG = "llmlingua"


def compression_tags(c: Column, tag: str = COMPRESSION_TAG) -> Column:
    """(segment, rate, flag) of inline <tag, rate=x, compress=y>..</tag> marks; rate null and flag true by default (STR-34)."""
    each = F.regexp_extract_all(c, F.lit(rf"(?s)<{tag}[^>]*>.*?</{tag}>"), F.lit(0))
    return F.transform(
        each,
        lambda t: F.struct(
            F.regexp_extract(t, rf"(?s)^<{tag}[^>]*>(.*?)</{tag}>$", 1).alias("segment"),
            F.nullif(F.regexp_extract(t, rf"^<{tag}[^>]*rate\s*=\s*([0-9.]+)", 1), F.lit("")).cast("double").alias("rate"),
            (F.lower(F.regexp_extract(t, rf"^<{tag}[^>]*compress\s*=\s*([A-Za-z]+)", 1)) != "false").alias("flag"),
        ),
    )


def code_block(c: Column) -> Column:
    """Content of the first fenced block, empty without one (STR-22)."""
    return F.coalesce(F.get(F.regexp_extract_all(c, F.lit(r"(?s)```[a-z]*\n(.*?)```"), F.lit(1)), F.lit(0)), F.lit(""))


def last_assert(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.split(c, "\n"), lambda x: F.startswith(x, F.lit("assert"))), F.lit(-1)), F.lit(""))


def clean_generation(c: Column, control: Sequence[str], ends: Sequence[str] = ("</s>", "<|endoftext|>"), apart: bool = False) -> Column:
    """Without control tokens and line breaks, a leading # or :, and with a space after inner stops (STR-30).

    With ``apart`` stops are those of the text as it came, line breaks apart, and a character belongs to one of them
    only: of ``a.b.c`` the first alone gets a space.
    """
    c = F.replace(c, F.lit("\n"), F.lit(""))
    c = F.regexp_replace(c, r"([\p{L}\p{N}_][.!?])([\p{L}\p{N}_])", "$1 $2") if apart else c
    for token in (*control, *ends):
        c = F.replace(c, F.lit(token), F.lit(""))
    c = F.regexp_replace(F.regexp_replace(c, r"^\p{Zs}+|\p{Zs}+$", ""), r"^[#:]", "")
    return c if apart else F.regexp_replace(c, r"(?U)(?<=\w)([.!?])(?=\w)", "$1 ")


def is_numeric_question(question: Column, answer: Column) -> Column:
    pattern = "|".join(quote(w) for w in NUMERIC_WORDS)
    return F.coalesce(F.lower(question).rlike(pattern), F.lit(False)) | F.coalesce(answer.rlike("[0-9]"), F.lit(False))


def is_content_page(title: Column, text: Column) -> Column:
    """Not a disambiguation, list, index, outline or redirect page (FLT-10)."""
    return ~F.contains(F.lower(title), F.lit("(disambiguation)")) & ~title.rlike("^(List of .+|Index of .+|Outline of .+)") & ~text.rlike("^(REDIRECT|redirect)")


def first_truthy(*cols: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in cols))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), "")


def query_prefix(family: str) -> tuple[str, str]:
    """Prefixes (query, passage) that an encoder family expects (STR-29)."""
    known = {"e5": ("query: ", "passage: "), "bge": ("Represent this sentence for searching relevant passages: ", "")}
    return known.get(family, ("", ""))
