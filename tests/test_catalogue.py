"""Every query with SQL against DuckDB at the smallest scale; the others must run and return a stable schema."""

import os
import re

import duckdb
import pytest

import __spark_entry__
from loomline.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def rows(found):
    value = lambda x: repr(round(x, 9) + 0.0) if isinstance(x, float) else str(x)
    return sorted(tuple(value(x) for x in r) for r in found)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df, sql = catalogue.queries()[name](spark, SF), catalogue.oracle_sql()[name]
    columns = sorted(df.columns)
    assert columns == sorted(duck.sql(sql).columns)
    want = duck.sql(f"SELECT {', '.join(f'\"{c}\"' for c in columns)} FROM ({sql})").fetchall()
    assert rows(df.select(*columns).collect()) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = catalogue.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry_and_names(spark):
    assert len(__spark_entry__.entry(spark).take(1)) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert all(re.fullmatch(r"[a-z0-9_]+", n) for n in __spark_entry__.queries())


def test_flagship_plan_prunes_columns_and_needs_no_python(spark):
    plan = catalogue.queries()["bm25_top5"](spark, SF)._jdf.queryExecution().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan and "Python" not in plan and "Cartesian" not in plan
