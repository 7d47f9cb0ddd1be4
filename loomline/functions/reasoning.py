"""Model-output operators with rules too irregular for column expressions."""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DELETE = "DELETE THIS STEP"  # fixed value: the mark by which a replacement deletes a step
_STEP = re.compile(r"^Step\s+(\d+):\s*(.*)$")


def parse_steps(text: str | None) -> dict[int, str]:
    """Step number -> content; lines before the first step are left out."""
    steps: dict[int, list[str]] = {}
    current = None
    for line in (text or "").splitlines():
        if m := _STEP.match(line):
            current = int(m[1])
            steps[current] = [m[2].strip()] if m[2].strip() else []
        elif current is not None:
            steps[current].append(line)
    return {n: "\n".join(lines).strip() for n, lines in steps.items()}


def merge_steps(origin: str | None, update: str | None) -> str:
    """Steps of origin overlaid by those of update, deleted ones left out, by number (STR-23)."""
    steps = parse_steps(origin)
    for n, content in parse_steps(update).items():
        if DELETE in content:
            steps.pop(n, None)
        else:
            steps[n] = content
    return "\n\n".join(steps[n] for n in sorted(steps))


def canonical_math(s: str | None) -> str | None:
    r"""Canonical form of a short math answer (STR-21): layout marks and right-hand units dropped, \frac and
    \sqrt arguments braced, a leading 0 before a point, ``k =`` dropped, a/b and 0.5 as fractions."""
    if s is None:
        return None
    for old, new in (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", "")):
        s = s.replace(old, new)
    s = s.split("\\text{ ")[0].replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if not s:
        return s
    if s[0] == ".":
        s = "0" + s
    name, eq, value = s.partition("=")
    if eq and "=" not in value and len(name) <= 2:
        s = value
    s = re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", s).replace(" ", "")
    s = re.sub(r"\\frac([^{])([^{])", r"\\frac{\1}{\2}", s)
    s = re.sub(r"\\frac([^{])\{", r"\\frac{\1}{", s)
    if s == "0.5":
        return "\\frac{1}{2}"
    if m := re.fullmatch(r"(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))", s):
        return f"\\frac{{{m[1]}}}{{{m[2]}}}"
    return s


def assert_value(line: str | None) -> str | None:
    """Right-hand side of ``assert x == literal`` in canonical form, null if it is no literal (MET-11)."""
    if line is None:
        return None
    try:
        test = ast.parse(line.strip()).body[0].test
        return repr(ast.literal_eval(test.comparators[-1]))
    except (SyntaxError, ValueError, AttributeError, IndexError):
        return None


def nested_tokens(value: object) -> list[str]:
    """Keys and scalar values of a nested value, in order (STR-03)."""
    out: list[str] = []
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo += [x for k, w in reversed(list(v.items())) for x in (w, k)]
        elif isinstance(v, (list, tuple)):
            todo += reversed(v)
        elif v is not None:
            out.append(str(v))
    return out


@F.pandas_udf(T.StringType())
def merge_steps_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([merge_steps(x, y) for x, y in zip(a, b, strict=True)])


@F.pandas_udf(T.StringType())
def canonical_math_udf(c: pd.Series) -> pd.Series:
    return c.map(canonical_math)


@F.pandas_udf(T.StringType())
def assert_value_udf(c: pd.Series) -> pd.Series:
    return c.map(assert_value)


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_tokens_udf(c: pd.Series) -> pd.Series:
    import json

    def read(x):
        try:
            return nested_tokens(json.loads(x))
        except (TypeError, ValueError):
            return [] if x is None else [x]

    return c.map(read)
