"""Expressions work an argument out once, not for each element or word, and crowded buckets are spread; results stay."""

import random

from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import relational

DIGITS = dict(zip("BFPVCGJKQSXZDTLMNR", "111122222222334556"))


def _sounds(s):
    letters = [c for c in s.upper() if "A" <= c <= "Z"]
    codes = [DIGITS.get(c, "0") for c in letters]
    return (letters[0] + "".join(c for b, c in zip(codes, codes[1:]) if c not in ("0", b))[:3]).ljust(4, "0") if letters else ""


def test_difference(spark):
    rng = random.Random(5)
    rows = [tuple("".join(rng.choices("abcdfhklmrswyßé -7BFP", k=rng.randrange(14))) for _ in "ab") for _ in range(300)] + [("", ""), (None, "a"), ("a", None)]
    found = spark.createDataFrame(rows, "a string, b string").selectExpr("a", "b", f"{fn('soundex', 'a')} AS s", f"{fn('difference', 'a', 'b')} AS d").collect()
    for r in found:
        assert r.s == (None if r.a is None else _sounds(r.a))
        assert r.d == (None if r.a is None or r.b is None else sum(_sounds(r.a)[i : i + 1] == _sounds(r.b)[i : i + 1] for i in range(4)))
    assert "sequence" not in fn("difference", "a", "b") and fn("difference", "a", "first_").count("first_") == fn("soundex", "first_").count("first_") <= 3


def test_crowded_bucket_is_spread(spark, monkeypatch):
    monkeypatch.setattr(relational, "TILE", 50)
    rng = random.Random(6)
    points = [(k, rng.choice([None, 7.0, 7.5, 8.0, rng.uniform(-30, 60)])) for k in range(400)]
    lows = [(k, rng.choice([None, 1.0, 7.5, rng.uniform(-30, 60)])) for k in range(300)]
    p, i = spark.createDataFrame(points, "k int, x double"), spark.createDataFrame(lows, "j int, lo double").withColumn("hi", F.col("lo") + 5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = relational.range_join(p, i, "x", "lo", "hi", 20.0, 5.0).select("k", "j", "x", F.spark_partition_id().alias("part")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.k, r.j) for r in found) == sorted((k, j) for k, x in points for j, lo in lows if x is not None and lo is not None and lo <= x < lo + 5)
    assert len({r.part for r in found if r.x == 7.5}) > 1


def test_vectors_are_made_once(spark):
    for name in ("ts_match", "ts_rank", "ts_rank_cd"):
        assert fn(name, "the_vector", "'red & (ring | !blue)'").count("the_vector") == 1
    rows = [("Ring the RED ring, was blue_1 ring",), ("the was no",), ("",), (None,), ("9 red Red é É é",)]
    v = fn("to_tsvector", "t")
    found = spark.createDataFrame(rows, "t string").selectExpr("t", f"transform({v}, e -> concat(e.lexeme, ':', array_join(e.positions, '/'))) AS v", f"{fn('ts_match', v, chr(39) + 'ring & !blue_1 | 9' + chr(39))} AS m", f"{fn('ts_rank', v, chr(39) + 'red | é' + chr(39))} AS r", f"{fn('ts_rank_cd', v, chr(39) + 'red | é' + chr(39))} AS c").collect()
    got = {r.t: (r.v, r.m, r.r, r.c) for r in found}
    assert got["Ring the RED ring, was blue_1 ring"] == (["blue_1:6", "red:3", "ring:1/4/7"], False, 1 / 3, 1 / 5)
    assert got["the was no"] == got[""] == ([], False, 0.0, 0.0)
    assert got[None] == (None, None, 0.0, 0.0)
    assert got["9 red Red é É é"] == (["9:1", "red:2/3", "é:4/5/6"], True, 2 / 3, 5 / 6)
