"""Relational operators that Spark SQL has no single word for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tessera.operators.changes import fresh


def distinct_on(df: DataFrame, keys: list[str], order: list[Column | str | tuple[str, str]]) -> DataFrame:
    """The first row of each key in the given order (SELECT DISTINCT ON).

    order: columns ascending, NULL last, or pairs of a column and "desc", NULL first: then an aggregate over the order's
    struct finds it, which combines map-side. Any other Columns with an order of their own take a window.
    """
    if all(isinstance(x, (str, tuple)) for x in order):
        (row,) = fresh(df.columns, "row")
        column = {c: F.col(c) for c in df.columns}
        parts = []
        for x in order:
            name, down = (x, False) if isinstance(x, str) else (x[0], x[1] == "desc")
            kind = df.schema[name].dataType
            if down and not isinstance(kind, NumericType):
                break
            parts += [column[name].isNotNull() if down else column[name].isNull(), -column[name] if down else column[name]]
        else:
            return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*parts)).alias(row)).select(f"{row}.*")
        order = [(F.col(x).asc_nulls_last() if isinstance(x, str) else F.col(x[0]).desc_nulls_first()) for x in order]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def groups_frame(df: DataFrame, partition: list[str], order: Column, start: int, end: int, value: Column, name: str) -> DataFrame:
    """value (an aggregate) over a frame counted in groups of peers: a rank of the groups turns it into a range frame."""
    ranked = df.withColumn("_g", F.dense_rank().over(Window.partitionBy(*partition).orderBy(order)))
    return ranked.withColumn(name, value.over(Window.partitionBy(*partition).orderBy("_g").rangeBetween(start, end))).drop("_g")


def asof(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, columns: list[str], slice_seconds: int = 0) -> DataFrame:
    """Each left row with the given columns of the last right row of its key at or before its time (of several at one time, the greatest by these columns).

    Both sides are laid on one time line and the last right row is carried forward, so a key is sorted, not joined.
    slice_seconds: times are cut into slices of so many seconds; a task then sorts one key's slice, and what a slice
    begins with comes from an aggregate of one row a key and slice. So a key that a third of all rows have is spread.
    """
    t, side, row, last, part, start, before = fresh([*left.columns, *right.columns], "time", "side", "row", "last", "slice", "start", "before")
    payload = F.struct(*[F.col(c) for c in columns])
    a = left.select(*by, F.col(left_time).alias(t), F.lit(1).alias(side), F.struct(*left.columns).alias(row), F.lit(None).cast(right.select(payload.alias("p")).schema[0].dataType).alias(last))
    b = right.select(*by, F.col(right_time).alias(t), F.lit(0).alias(side), F.lit(None).cast(a.schema[row].dataType).alias(row), payload.alias(last))
    both = a.unionByName(b)
    number = F.floor(F.unix_micros(F.col(t).cast("timestamp")) / (slice_seconds * 1_000_000)) if slice_seconds else F.lit(0)
    both = both.withColumn(part, number.cast("long"))
    w = Window.partitionBy(*by, part).orderBy(t, side, last).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn(last, F.last(last, ignorenulls=True).over(w)).where(F.col(side) == 1)
    if slice_seconds:
        ends = both.groupBy(*by, part).agg(F.max_by(last, F.when(F.col(side) == 0, F.struct(t, last))).alias(start))
        ends = ends.select(*by, part, F.last(start, ignorenulls=True).over(Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
        other = ends.select(*[F.col(k).alias(f"{k}_of_slice") for k in by], F.col(part).alias(f"{part}_of_slice"), before)
        same = F.col(part) == F.col(f"{part}_of_slice")
        for k in by:
            same &= F.col(k).eqNullSafe(F.col(f"{k}_of_slice"))
        found = found.join(other, same, "left").withColumn(last, F.coalesce(last, before))
    return found.select(f"{row}.*", *[F.col(f"{last}.{c}").alias(c) for c in columns])


#: Points and intervals of one bucket that a tile of a range join holds, about.
TILE = 4096


def range_join(points: DataFrame, intervals: DataFrame, point: str, low: str, high: str, width: float, longest: float) -> DataFrame:
    """Points with the intervals that hold them (low <= point < high), through buckets of the given width instead of a cross join.

    longest: no interval is longer; an interval goes to each bucket it touches. A bucket with more than TILE points or
    intervals is cut into tiles of about TILE of each, so that no task has more of a crowded bucket than some tiles: a
    point goes to one row of tiles, an interval to one column. Buckets are counted first, so both inputs are read twice.
    """
    if longest / width > 1000:
        raise ValueError("width is too small for intervals this long")
    b, rows, columns, r, c = fresh([*points.columns, *intervals.columns], "bucket", "rows", "columns", "row", "column")
    p = points.withColumn(b, F.floor(F.col(point) / width))
    i = intervals.withColumn(b, F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    count = lambda df, n: df.where(F.col(b).isNotNull()).groupBy(b).agg(F.ceil(F.count("*") / TILE).alias(n))
    crowded = F.broadcast(count(p, rows).join(count(i, columns), b).where((F.col(rows) > 1) | (F.col(columns) > 1)))
    number = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.coalesce(F.col(n), F.lit(1)))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(n), F.lit(1)) - 1))
    p = p.join(crowded, b, "left").withColumn(r, number(rows)).withColumn(c, every(columns)).drop(rows, columns)
    i = i.join(crowded, b, "left").withColumn(c, number(columns)).withColumn(r, every(rows)).drop(rows, columns)
    # merged by shuffle: a broadcast of the intervals would leave the points in the few tasks that read them
    return p.join(i.hint("merge"), [b, r, c]).where((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop(b, r, c)
