"""Queries of the engine against DuckDB on the smallest tables."""

import decimal

import duckdb
import numpy as np
import pytest

from tessera import plans
from tessera.functions import text as fn
from tessera.plans import scalars
from tessera.session import TABLES, sql

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(plain(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return None if v != v else v + 0.0
    return v


def rows(names, found):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in found)


CHEAP = [n for n in plans.oracle_sql() if n not in scalars.SPECS]


@pytest.mark.parametrize("name", CHEAP)
def test_query(spark, duck, name):
    df = plans.queries()[name](spark, FOLDER)
    cursor = duck.execute(plans.oracle_sql()[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("frm", sorted({s[0] for s in scalars.SPECS.values()}))
def test_scalars(spark, duck, frm):
    """All functions over one table in one statement."""
    found = [(n, s) for n, s in scalars.SPECS.items() if s[0] == frm and s[3]]
    keys = found[0][1][1]
    df = sql(spark, FOLDER, f"SELECT {keys}, " + ", ".join(f"{s[2].replace('{', '{{').replace('}', '}}')} AS {n}" for n, s in found) + f" FROM {{{frm}}}")
    cursor = duck.execute(f"SELECT {keys}, " + ", ".join(f"{s[3]} AS {n}" for n, s in found) + f" FROM {frm}")
    assert rows(df.columns, df.collect()) == rows([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("expression, value", [
    (fn("substr", "'abc'", "-5", "2"), "ab"), (fn("split_part", "'a,b'", "','", "0"), ""), (fn("split_part", "'a,b'", "','", "9"), ""), (fn("concat", "NULL", "'x'"), "x"), (fn("initcap", "'foo-bar é'"), "Foo-Bar É"), (fn("chr", "128512"), "😀"),
    (fn("trim", r"'\t a \n'"), "a"), (fn("substr_count", "'aaa'", "''"), 0), (fn("factorial", "25"), 9223372036854775807), (fn("gcd", "0", "0"), 0), (fn("lcm", "0", "5"), 0), (fn("width_bucket", "5", "10", "20", "2"), 0), (fn("isnan", "CAST(NULL AS DOUBLE)"), None),
    (fn("array_position", "array(1, 2)", "3"), None), (fn("array_dims", "slice(array(1), 1, 0)"), "[]"), (fn("array_lower", "slice(array(1), 1, 0)", "1"), None), (fn("array_generate", "5", "1", "1"), []), (fn("array_rotate", "array(1, 2, 3)", "-1"), [3, 1, 2]),
    (fn("regexp_replace", "'aXbX'", "'X'", "'-'"), "a-bX"), (fn("regexp_match", "'zzz'", "'(a)'"), None), (fn("hamming_distance", "'abc'", "'abcd'"), 1), (fn("soundex", "'Robert'"), "R163"), (fn("difference", "'Robert'", "'Rupert'"), 4), (fn("similarity", "'word'", "'word'"), 1.0),
    (fn("date_diff", "TIMESTAMP_NTZ '1969-12-31 23:59:59'", "TIMESTAMP_NTZ '1970-01-01 12:00:00'"), 0), (fn("extract", "dow", "TIMESTAMP_NTZ '2024-03-03 00:00:00'"), 0), (fn("to_char", "TIMESTAMP_NTZ '2024-02-29 13:05:09'", "'DD Mon YYYY HH12:MI AM'"), "29 Feb 2024 01:05 PM"),
    (fn("string_decode", "'|'", fn("string_encode", "'|'", r"'a|b\\c'", "'d'"), "0"), "a|b\\c"), (fn("string_decode", "'|'", "'a'", "3"), None), (fn("numnode", "'a & !b'"), 4), (fn("jsonb_typeof", "'[1]'"), "array"), (fn("matrix", "ROW", "RANGE", "1", "array(1, 5, 2, 9)", "2", "2", "1"), 7.0),
])
def test_edges(spark, expression, value):
    assert spark.sql(f"SELECT {expression} AS r").first().r == value


@pytest.mark.parametrize("expression", [fn("sqrt", "-1"), fn("ln", "0"), fn("acos", "2"), "1 div 0", fn("make_date", "2024", "2", "30")])
def test_raises(spark, expression):
    with pytest.raises(Exception):
        spark.sql(f"SELECT {expression}").collect()


def test_unknown_function():
    with pytest.raises(ValueError):
        fn("no_such_function")


def test_plans(spark):
    explain = lambda n: plans.queries()[n](spark, FOLDER)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in explain("j_3_merge") and "ShuffledHashJoin" in explain("j_2_hash") and "BroadcastHashJoin" in explain("j_7_broadcast")
    assert "PushedFilters: [IsNotNull(o_custkey), EqualTo(o_custkey,77)]" in explain("s_3_index_equality")
    assert "TakeOrderedAndProject" in explain("o_4_top_k") and "CartesianProduct" not in explain("j_range")


def test_constraints(spark):
    from pyspark.sql import functions as F

    from tessera.operators import changes as ch

    df = spark.createDataFrame([(1, None), (2, 5), (3, -1)], "k int, v int")
    with pytest.raises(Exception, match="positive"):
        ch.checked(df, positive=F.col("v") > 0).collect()
    assert ch.checked(df.where("k < 3"), positive=F.col("v") > 0).count() == 2
    parents = spark.createDataFrame([(5,)], "id int")
    with pytest.raises(Exception, match="restrict"):
        ch.delete_parent(df, parents, "v", "id", "restrict").collect()
    assert {r.v for r in ch.delete_parent(df, parents, "v", "id", "set default", F.lit(0)).collect()} == {None, 0, -1}
