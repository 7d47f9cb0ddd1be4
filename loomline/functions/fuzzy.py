"""Alignment scores that need dynamic programming: pandas UDFs."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: Sequence, b: Sequence) -> int:
    """Length of the longest common subsequence of texts or token lists, bit-parallel."""
    at: dict = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & at.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def indel_ratio(a: str, b: str) -> float:
    """100 times the share of characters that insertions and deletions leave alone."""
    return 100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b))


def token_set_ratio(a: str, b: str) -> float:
    """Best of the ratios between common words and common plus own words (RET-12)."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, only_x, only_y = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not only_x or not only_y):
        return 100.0
    left, right = f"{common} {only_x}".strip(), f"{common} {only_y}".strip()
    return max(indel_ratio(left, right), *((indel_ratio(common, left), indel_ratio(common, right)) if common else (0.0,)))


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of its length in the longer one (RET-13)."""
    short, long_ = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long_ else 0.0
    if short in long_:
        return 100.0
    n = len(short)
    return max(indel_ratio(short, long_[max(0, i) : i + n]) for i in range(1 - n, len(long_)))


def compression_distance(a: str, b: str) -> float:
    """Normalised compression distance (RET-16)."""
    x, y, xy = (len(zlib.compress(t.encode())) for t in (a, b, f"{a} {b}"))
    return (xy - min(x, y)) / max(x, y)


def recover_wording(response: list[str], original: list[str], gap: int = 10) -> tuple[int, int]:
    """Span of the original that holds the longest in-order match of the response's words, neighbours at most
    ``gap`` words apart; the shortest span on ties (JON-20)."""
    best: dict[int, tuple[int, int]] = {}  # end in original -> (words matched, start)
    for w in response:
        grown = {}
        for j in np.flatnonzero(np.array([o == w for o in original])) if original else ():
            prev = max(((n, s) for e, (n, s) in best.items() if 0 < j - e <= gap), default=(0, int(j)), key=lambda t: (t[0], t[1]))
            grown[int(j)] = (prev[0] + 1, prev[1] if prev[0] else int(j))
        for j, v in grown.items():
            best[j] = max(best.get(j, (0, j)), v, key=lambda t: (t[0], t[1]))
    if not best:
        return (0, 0)
    end, (_, start) = max(best.items(), key=lambda kv: (kv[1][0], kv[1][1] - kv[0], -kv[0]))
    return (start, end + 1)


def pair_udf(score):
    """A (text, text) -> double function as a pandas UDF; null where either text is."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else float(score(x, y)) for x, y in zip(a, b, strict=True)], dtype="float64")

    return run
