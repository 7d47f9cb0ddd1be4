"""Extension points: protocols for what the engine does not do itself, with deterministic offline stand-ins.

Model inference, network access and execution of untrusted code stay behind these; credentials come from the
caller.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Generator(Protocol):
    """Adds an ``answer`` column to rows with a ``prompt`` column."""

    def __call__(self, prompts: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    def __call__(self, text: Column) -> Column: ...


class PairScorer(Protocol):
    def __call__(self, query: Column, doc: Column) -> Column: ...


class Retriever(Protocol):
    """(query_id, query) rows to (query_id, doc_id, score, rank) rows."""

    def __call__(self, queries: DataFrame) -> DataFrame: ...


class Fetcher(Protocol):
    """(url) rows to (url, html) rows."""

    def __call__(self, urls: DataFrame) -> DataFrame: ...


def extractive_generator(prompts: DataFrame) -> DataFrame:
    """Answers with the first sentence of the last line of the prompt: a stand-in with a fixed result."""
    last = F.try_element_at(F.filter(F.split("prompt", "\n"), lambda x: F.trim(x) != ""), F.lit(-1))
    return prompts.withColumn("answer", F.regexp_extract(F.coalesce(last, F.lit("")), r"^([^.!?]*[.!?]?)", 1))
