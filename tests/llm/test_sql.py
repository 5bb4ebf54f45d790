"""Queries with SQL against DuckDB on the smallest tables, and on odd rows."""

import duckdb
import pytest

from llm import queries

FOLDER = "/root/testdata/sf0.001"


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in found)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{FOLDER}/documents.parquet'")
    df = queries.queries()[name](spark, FOLDER)
    cursor = duck.execute(queries.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_odd_rows(spark, name, tmp_path):
    """Passages at beginnings and ends, next to each other, at the very length that counts; nulls, empties, other white space and signs of several bytes."""
    a, b = " ".join(f"a{k}" for k in range(20)), " ".join(f"b{k}" for k in range(25))
    texts = [a, f"{a} {b}", f"{b} {a}", f"x {a}\t\n{b} y", f"{a} {a}", None, "", " \x0b\x0c ", "é" * 60, "é" * 59 + "x", "Z" * 49, "Z" * 50, "Z" * 51, a.upper(), b[:-1], "漢" * 40 + b]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df = queries.queries()[name](spark, str(tmp_path))
    cursor = duck.execute(queries.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())
