"""URL filters by redirect equivalence.

Block and allow rules (host, path) judge the URLs they fit: a rule fits its host and all subdomains if the
path starts with the rule's; the longest rule (host and path together) wins, allow before block on a tie.
Redirects and canonical links are edges between URLs; all URLs of a connected component are aliases. An
alias that no rule fits takes the verdict of its component: allow if any alias is explicitly allowed, else
block if any is blocked, else allow.

Null URLs and URLs without ``://`` have an empty host and path, fit no rule and are allowed unless an edge
joins them to a judged URL (null never has edges). Repeated rows are judged alike. Other columns stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Workspace, broadcast_if_small, components

RULES = [  # fixed values of the query: verdict, host, path
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TAG = re.compile(r"<(link|meta)\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.I)
_ATTR = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))")
_REFRESH = re.compile(r"^\s*[\d.]+\s*[;,]\s*(?:url\s*=\s*)?['\"]?(.*?)['\"]?\s*$", re.I | re.S)


def host_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.substr(url, F.instr(url, "://") + 3)
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1], r[2]))
    fits = [((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)) for _, h, p in ordered]
    found = [F.when(fit, F.struct(F.lit(v).alias("verdict"), F.lit(h + p).alias("rule"))) for fit, (v, h, p) in zip(fits, ordered, strict=True)]
    return F.coalesce(*found, F.lit(None).cast("struct<verdict:string,rule:string>"))


def links_of(url: str, html: str) -> list[str]:
    """Absolute targets of a page's canonical links and refresh redirects."""
    out = []
    for tag, rest in _TAG.findall(html):
        at = {k.lower(): unescape(a or b or c) for k, a, b, c in _ATTR.findall(rest)}
        target = None
        if tag.lower() == "link" and "canonical" in at.get("rel", "").lower().split():
            target = at.get("href")
        elif tag.lower() == "meta" and at.get("http-equiv", "").lower() == "refresh":
            m = _REFRESH.match(at.get("content", ""))
            target = m and m[1]
        if target:
            try:
                out.append(urljoin(url, target.strip()))
            except ValueError:  # not a URL at all
                continue
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        pairs = [(u, t) for u, h in zip(b.column("url").to_pylist(), b.column("html").to_pylist(), strict=True) for t in links_of(u, h)]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.string()), pa.array([p[1] for p in pairs], pa.string())], ["src", "dst"])


def page_edges(pages: DataFrame) -> DataFrame:
    """(src, dst) of canonical links and refresh redirects; only pages that may hold such a tag leave the JVM.

    The word may stand anywhere, as attributes may hold a ``>``, and be written in character references.
    """
    low = F.lower("html")
    may = lambda tag, word: F.contains(low, F.lit(tag)) & (F.contains(low, F.lit(word)) | F.contains(low, F.lit("&#")))
    has = pages.where("url IS NOT NULL").where(may("<link", "canonical") | may("<meta", "refresh"))
    return has.select("url", "html").mapInArrow(_edges, "src string, dst string")


def judge(urls: DataFrame, rules: list[tuple[str, str, str]], edges: DataFrame, url_col: str = "url", ws: Workspace | None = None) -> DataFrame:
    """All rows of urls with host, path, rule and verdict as ``url_host``, ``url_path``, ``url_rule``, ``url_verdict``."""
    ws = ws or Workspace(urls.sparkSession)
    url = F.col(f"`{url_col}`")
    judged = urls.withColumn("url_host", host_of(F.coalesce(url, F.lit("")))).withColumn("url_path", path_of(F.coalesce(url, F.lit(""))))
    judged = judged.withColumn("__best", best_rule(F.col("url_host"), F.col("url_path"), rules))
    own = F.col("__best.verdict")
    edges = ws.save(edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct(), "redirects")
    if edges.limit(1).count() == 0:
        verdict = F.coalesce(own, F.lit("allow"))
        return judged.withColumn("url_rule", F.col("__best.rule")).withColumn("url_verdict", verdict).drop("__best")
    comp = components(ws, edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    known = comp.withColumn("v", best_rule(host_of(F.col("node")), path_of(F.col("node")), rules)["verdict"])
    known = known.groupBy("component").agg(F.max(F.expr("v = 'allow'")).alias("allowed"), F.max(F.expr("v = 'block'")).alias("blocked"))
    spread = known.withColumn("__spread", F.expr("CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' END")).where("__spread IS NOT NULL")
    of_url = comp.join(spread, "component").select(F.col("node").alias("__node"), "__spread")
    out = judged.join(broadcast_if_small(ws.save(of_url, "spread"), 50_000), url == F.col("__node"), "left")
    out = out.withColumn("url_rule", F.col("__best.rule")).withColumn("url_verdict", F.coalesce(own, "__spread", F.lit("allow")))
    return out.drop("__best", "__node", "__spread")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    out = judge(pages.select("page_id", "url"), RULES, page_edges(pages))
    return out.select("page_id", F.col("url_host").alias("host"), F.col("url_path").alias("path"), F.col("url_rule").alias("rule"), F.col("url_verdict").alias("verdict"))


OP7_SQL = r"""
WITH RECURSIVE rules(v, h, p) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), tags AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<link[^>]+canonical[^>]*>')) AS tag FROM pages
), direct AS (
  SELECT url AS src, regexp_extract(tag, '(?i)href="([^"]*)"', 1) AS dst FROM tags
  UNION SELECT url, regexp_extract(html, '(?i)<meta[^>]+refresh[^>]*url=([^">]*)', 1) FROM pages WHERE regexp_matches(html, '(?i)<meta[^>]+refresh')
), both_ways AS (
  SELECT src AS a, dst AS b FROM direct WHERE src <> dst AND dst <> '' UNION SELECT dst, src FROM direct WHERE src <> dst AND dst <> ''
), reach AS (
  SELECT a, a AS b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b
), urls AS (
  SELECT url AS u FROM pages UNION SELECT b FROM reach
), split AS (
  SELECT u, CASE WHEN contains(coalesce(u, ''), '://') THEN translate(regexp_extract(u[instr(u, '://') + 3:], '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(coalesce(u, ''), '://') THEN regexp_extract(u[instr(u, '://') + 3:], '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM urls
), best AS (
  SELECT u, host, path, arg_max(v, length(h || p)) AS v, arg_max(h || p, length(h || p)) AS rule
  FROM split LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY u, host, path
), spread AS (
  SELECT r.a AS u, bool_or(b.v = 'allow') AS allowed, bool_or(b.v = 'block') AS blocked FROM reach r JOIN best b ON b.u = r.b GROUP BY r.a
)
SELECT p.page_id, b.host, b.path, b.rule, coalesce(b.v, CASE WHEN s.allowed THEN 'allow' WHEN s.blocked THEN 'block' END, 'allow') AS verdict
FROM pages p JOIN best b ON b.u IS NOT DISTINCT FROM p.url LEFT JOIN spread s ON s.u = p.url
"""
