"""Operators on nested shapes: dotted paths, residual fields, entity-attribute-value pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dotted(df: DataFrame) -> DataFrame:
    """Nested structs as flat columns named by their path (STR-32)."""

    def walk(kind: T.DataType, path: list[str]) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [c for f in kind.fields for c in walk(f.dataType, [*path, f.name])]
        return [F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path))]

    return df.select(*walk(df.schema, []))


def residual(raw_json: Column, drop: list[str]) -> Column:
    """All fields of a JSON object but the named ones, as a map of strings (FLT-15)."""
    return F.map_filter(F.from_json(raw_json, "map<string,string>"), lambda k, v: ~k.isin(drop))


def pivot_attributes(df: DataFrame, id_col: str, key_col: str, value_cols: list[str]) -> DataFrame:
    """Map of key to the first value that is set, for each id (SRC-18)."""
    value = F.coalesce(*(F.col(c).cast("string") for c in value_cols))
    entries = F.array_sort(F.collect_list(F.struct(F.col(key_col).alias("key"), value.alias("value"))))
    return df.groupBy(id_col).agg(F.map_from_entries(entries).alias("attributes"))
