"""Writers of results and reports. All go through Spark's commit protocol, so a failed job leaves no half-written output."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines (SNK-01, SNK-02); one file only for results known to be small."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, indent: int = 4) -> None:
    """An indented JSON array on the driver's disk, row by row, for small results (SNK-03)."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, row in enumerate(df.toJSON().toLocalIterator()):
            f.write(("," if i else "") + "\n" + json.dumps(json.loads(row), ensure_ascii=False, indent=indent))
        f.write("\n]\n")


def keyed_results(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key (SNK-04)."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def write_metrics(report: DataFrame, path: str) -> None:
    """``metric: value`` lines (SNK-05)."""
    report.select(F.concat_ws(": ", F.col("metric"), F.col("value").cast("string"))).coalesce(1).write.mode("overwrite").text(path)


def write_questions(df: DataFrame, column: str, path: str) -> int:
    """One question a line, and their number (SNK-06)."""
    df.select(F.regexp_replace(column, r"\s*\n\s*", " ")).write.mode("overwrite").text(path)
    return df.count()


def split_failures(df: DataFrame, failed: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, failed rows) (SNK-07)."""
    bad = F.coalesce(failed, F.lit(False))
    return df.where(~bad), df.where(bad)


def write_vectors(df: DataFrame, path: str, dim: int, source: str = "source", vector: str = "embedding") -> None:
    """Vector table partitioned by source; a vector of another dimension raises (SNK-08, SNK-09)."""
    v = F.when(F.size(vector) == dim, F.col(vector)).otherwise(F.raise_error(F.lit(f"a vector is not of dimension {dim}")))
    df.withColumn(vector, v).write.mode("overwrite").partitionBy(source).parquet(path)


def plain_values(df: DataFrame) -> DataFrame:
    """Without binary columns, vectors as doubles (SNK-10)."""
    keep = [f for f in df.schema.fields if not isinstance(f.dataType, T.BinaryType)]
    return df.select(*(F.col(f.name).cast("array<double>") if f.dataType == T.ArrayType(T.FloatType()) else F.col(f.name) for f in keep))
