"""The registered queries against their SQL at the smallest scale, and the pipeline on odd tables."""

import os

import duckdb
import pytest

import corpus_pipeline
from loomline.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        p = f"{SF}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    columns = sorted(df.columns)
    found = duck.sql(queries.oracle_sql()[name])
    assert columns == sorted(found.columns)
    want = found.select(*(f'"{c}"' for c in columns)).fetchall()
    as_text = lambda rows: sorted(tuple(map(str, r)) for r in rows)
    assert as_text(df.select(*columns).collect()) == as_text(want)


def test_queries_without_sql_take_whole_tables(spark, duck):
    made = queries.queries()
    packed = made["op1_packing"](spark, SF).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).collect()
    assert {r.doc_id for r in packed} == {i for (i,) in duck.sql("SELECT doc_id FROM documents").fetchall()}
    assert all(r["sum(length)"] == r["max(doc_tokens)"] for r in packed)
    asked = {i for (i,) in duck.sql("SELECT vec_id FROM embeddings WHERE vec_id % 100 = 0").fetchall()}
    assert {r.query_id for r in made["op2_nearest_neighbours"](spark, SF).collect()} == asked
    told = made["op3_language_id"](spark, SF).collect()
    assert len(told) == duck.sql("SELECT count(*) FROM documents").fetchall()[0][0] and all(0 <= r.score <= 1 for r in told)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id string, __text long"
PLAIN = "the river runs past the old mill and the children play on its banks until the evening comes"
ODD = [
    (1, PLAIN, "en", "s", 91, "x", 1),
    (1, PLAIN, "en", "s", 91, "y", None),
    (2, PLAIN, None, None, None, None, None),
    (3, None, "en", "s", 0, "x", 1),
    (4, "", "en", "s", 0, "x", 1),
    (None, "another text of the same language that nothing else repeats at all here", "en", "s", 0, "x", 1),
    (5, "a long text " + " ".join(f"the{i} river{i}" for i in range(30_000)) + " the and of", "en", "s", 0, "x", 1),
]


@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_pipeline_of_odd_tables(spark, tmp_path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, str(tmp_path))
        if n < 4:
            assert out.dtypes == now.dtypes
        out.write.parquet(f"{tmp_path}/out{n}")
        now = spark.read.parquet(f"{tmp_path}/out{n}")
        if n == 1 and rows:
            assert 2 not in {r.doc_id for r in now.collect()} and 1 in {r.doc_id for r in now.collect()}
    assert rows or now.count() == 0
