from pyspark.sql import functions as F

from tessera.sources.cursors import Cursor, Prepared, Sequence


def test_cursor(spark):
    c = Cursor(spark.range(10).orderBy("id"))
    assert [r.id for r in c.fetch(3)] == [0, 1, 2] and c.move(4) == 4 and [r.id for r in c.fetch(9)] == [7, 8, 9]


def test_prepared(spark):
    q = Prepared(spark, "SELECT id FROM range(10) WHERE id > :least AND id < :most")
    assert q.execute(least=3, most=6).count() == 2 and q.execute(least=8, most=9).count() == 0


def test_sequence(spark):
    s = Sequence(5)
    assert s.next() == 5
    rows = sorted(s.number(spark.range(100).withColumnRenamed("id", "k").repartition(7), [F.col("k").desc()]).collect(), key=lambda r: -r.k)
    assert [r.id for r in rows] == list(range(6, 106)) and s.value == 105
