"""Readers of samples, corpora and side files. Schemas are declared, never inferred, where one is given."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt"


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, malformed lines); blank lines count as neither (SRC-01)."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")  # a read of the corrupt column alone is refused
    parsed = lines.select("value", F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}).alias("j"))
    bad = parsed.where(F.col(f"j.{CORRUPT}").isNotNull()).select(F.col("value").alias(CORRUPT))
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT), bad


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A malformed line raises when it is read (SRC-02)."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def balanced_objects(text: str) -> Iterator[tuple[int, str, bool]]:
    """(line of the start, text, is JSON) of each brace-balanced object in a text of concatenated objects.

    Braces inside strings do not count; what is not JSON is tried as a Python literal; a rest without its
    closing brace and what stands between objects is not JSON.
    """
    start, depth, inside, escaped, line, first = None, 0, False, False, 1, 1
    for i, c in enumerate(text):
        if start is None and not c.isspace():
            start, first = i, line
        if inside:
            inside, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"':
            inside = True
        elif c == "{":
            depth += 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield first, *_as_json(text[start : i + 1])
                start = None
        if c == "\n":
            line += 1
            if start is not None and depth == 0 and not inside:
                yield first, text[start:i].strip(), False
                start = None
    if start is not None and text[start:].strip():
        yield first, text[start:].strip(), False


def _as_json(raw: str) -> tuple[str, bool]:
    try:
        json.loads(raw)
        return raw, True
    except ValueError:
        pass
    try:
        return json.dumps(ast.literal_eval(raw), ensure_ascii=False), True
    except (ValueError, SyntaxError):
        return raw, False


def read_json_objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, raw, ok) of the objects of multi-line JSONL files, in parallel over files (SRC-03)."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, *o) for f, v in zip(b["file"], b["value"], strict=True) for o in balanced_objects(v or "")]
            yield pd.DataFrame(rows, columns=["file", "line", "raw", "ok"])

    return files.mapInPandas(run, "file string, line int, raw string, ok boolean")


def read_dataset(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Reader by the suffix of the path: jsonl, json, parquet, csv (SRC-05, SRC-15)."""
    suffix = PurePosixPath(path.rstrip("/")).suffix
    if suffix == ".jsonl":
        return spark.read.json(path, schema=schema)
    if suffix == ".json":
        return spark.read.json(path, schema=schema, multiLine=True)
    if suffix == ".parquet":
        return spark.read.parquet(path) if schema is None else spark.read.schema(schema).parquet(path)
    if suffix == ".csv":
        return spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"')
    raise ValueError(f"unsupported suffix {suffix!r} of {path}")


def probe_split(spark: SparkSession, folder: str, split: str, schema: T.StructType | None = None) -> DataFrame:
    """The first of split.jsonl, .json, .parquet that exists in a folder of any file system (SRC-05)."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for suffix in (".jsonl", ".json", ".parquet"):
        p = jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}{suffix}")
        if p.getFileSystem(conf).exists(p):
            return read_dataset(spark, f"{folder}/{split}{suffix}", schema)
    raise FileNotFoundError(f"{folder} has no {split}")


def with_contents(df: DataFrame) -> DataFrame:
    """A contents column from contents, content or text, the first there is (SRC-06)."""
    have = [c for c in ("contents", "content", "text") if c in df.columns]
    if not have:
        raise ValueError("no column to take contents from")
    return df.withColumn("contents", F.coalesce(*have))


def read_html_folder(spark: SparkSession, path: str, prefix: str = "https://en.wikipedia.org/wiki/") -> DataFrame:
    """(title, url, html) of the .html files of a folder (SRC-07)."""
    files = spark.read.option("pathGlobFilter", "*.html").text(path, wholetext=True).select(F.col("value").alias("html"), F.input_file_name().alias("f"))
    stem = F.regexp_extract(F.try_url_decode(F.replace("f", F.lit("+"), F.lit("%2B"))), r"([^/]+)\.html$", 1)
    return files.select(F.replace(stem, F.lit("_"), F.lit(" ")).alias("title"), F.concat(F.lit(prefix), stem).alias("url"), "html")


def join_side_files(spark: SparkSession, tables: str, links: str) -> DataFrame:
    """Tables with the link map of the file of the same name; tables without one go (SRC-08)."""
    stem = lambda: F.regexp_extract(F.input_file_name(), r"([^/]+)\.json$", 1)
    t = spark.read.option("pathGlobFilter", "*.json").text(tables, wholetext=True).select(stem().alias("stem"), F.from_json("value", "url string, title string, header array<array<string>>, data array<array<array<string>>>").alias("t"))
    k = spark.read.option("pathGlobFilter", "*.json").text(links, wholetext=True).select(stem().alias("stem"), F.from_json("value", "map<string,string>").alias("links"))
    first = lambda cells: F.transform(cells, lambda c: F.get(c, F.lit(0)))
    return t.join(k, "stem").select("stem", "t.url", "t.title", first(F.col("t.header")).alias("header"), F.transform("t.data", first).alias("data"), "links")


def search_results(df: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """(id, rank from 1, title, url, date, snippet) of cached search responses of either shape (SRC-12)."""
    item = "array<struct<name:string,title:string,link:string,url:string,snippet:string,date:string,datePublished:string>>"
    parsed = df.select(id_col, F.from_json(json_col, f"organic_results {item}, webPages struct<value:{item}>").alias("j"))
    each = parsed.select(id_col, F.posexplode(F.coalesce("j.organic_results", "j.webPages.value")).alias("i", "r"))
    return each.select(id_col, (F.col("i") + 1).alias("rank"), F.coalesce("r.title", "r.name").alias("title"), F.coalesce("r.link", "r.url").alias("url"), F.split_part(F.coalesce("r.date", "r.datePublished"), F.lit("T"), F.lit(1)).alias("date"), "r.snippet")


def merge_duplicate_titles(df: DataFrame, title: str, text: str, order: str) -> DataFrame:
    """Texts of each title joined in arrival order (SRC-14)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return df.groupBy(title).agg(F.array_join(parts, " ").alias(text))


def import_outputs(outputs: DataFrame, benchmark: DataFrame, key: str) -> DataFrame:
    """Benchmark rows with their outputs; raises when their numbers differ (SRC-21)."""
    if outputs.count() != benchmark.count():
        raise ValueError("outputs and benchmark differ in length")
    return benchmark.join(outputs, key)


def repair_json(raw: str | None) -> str | None:
    """JSON with stray backslashes doubled, else all doubled; null if it still does not parse (STR-13)."""
    import re

    if raw is None:
        return None
    for text in (raw, re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", raw), raw.replace("\\", "\\\\")):
        try:
            json.loads(text)
            return text
        except ValueError:
            continue
    return None


@F.pandas_udf(T.StringType())
def repaired_json(c: pd.Series) -> pd.Series:
    return c.map(repair_json)
