"""Changes of tables as DataFrame transformations: each returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def update(df: DataFrame, where: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()})


def delete(df: DataFrame, where: Column) -> DataFrame:
    """Rows for which the condition isn't true."""
    return df.where(~F.coalesce(where, F.lit(False)))


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names like the given ones that aren't taken."""
    used, out = {c.lower() for c in taken}, []
    for name in names:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        out.append(name)
    return out


def one_a_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Of rows with one key the first by all columns (NULL last): an aggregate, so that rows of a hot key meet map-side."""
    (row,) = fresh(df.columns, "row")
    first = F.struct(*[x for c in df.columns for x in (F.col(c).isNull(), F.col(c))])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), first).alias(row)).select(f"{row}.*")


def update_from(df: DataFrame, source: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """UPDATE ... FROM: columns set to columns of the source row of equal key; of several such rows the first by its values counts, and a row of the table stays one row. NULL keys match nothing."""
    names = dict(zip(values, fresh(df.columns, *[f"new_{c}" for c in values])))
    (hit,) = fresh([*df.columns, *names.values()], "hit")
    wanted = list(dict.fromkeys([*keys, *values.values()]))
    chosen = one_a_key(source.select(*wanted), keys).select(*keys, *[F.col(v).alias(names[c]) for c, v in values.items()], F.lit(True).alias(hit))
    joined = df.join(chosen, keys, "left")
    return joined.select(*[F.when(F.col(hit), F.col(names[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def delete_using(df: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(source.select(*keys).distinct(), keys, "left_anti")


def insert_or_ignore(df: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING; of new rows with one key the first by all columns is taken."""
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    new = one_a_key(rows.where(whole), keys).unionByName(rows.where(~whole))  # rows with a NULL key conflict with nothing
    return df.unionByName(new.join(df.select(*keys), keys, "left_anti").select(*df.columns))


def _marked(df: DataFrame, rows: DataFrame, left: str, right: str, keys: list[str]) -> tuple[DataFrame, Column, Column]:
    """Both sides by equal keys, and whether each is there: told by markers, so that rows with NULL keys are there too."""
    mark, other = fresh([*df.columns, *rows.columns], "is_there", "is_given")
    a, b = df.withColumn(mark, F.lit(True)).alias(left), rows.withColumn(other, F.lit(True)).alias(right)
    joined = a.join(b, [F.col(f"{left}.{k}") == F.col(f"{right}.{k}") for k in keys], "full_outer")
    return joined, F.coalesce(F.col(mark), F.lit(False)), F.coalesce(F.col(other), F.lit(False))


def upsert(df: DataFrame, rows: DataFrame, keys: list[str], values: dict[str, str]) -> DataFrame:
    """ON CONFLICT DO UPDATE: values maps columns to SQL over old (the table's row) and excluded (the new row). Two new rows of one key raise; rows with a NULL key conflict with nothing."""
    joined, there, given = _marked(df, _sole(rows, keys, "ON CONFLICT DO UPDATE"), "old", "excluded", keys)
    return joined.select(*[F.when(there & given, F.expr(values[c]) if c in values else F.col(f"old.{c}")).when(there, F.col(f"old.{c}")).otherwise(F.col(f"excluded.{c}")).alias(c) for c in df.columns])


def _sole(rows: DataFrame, keys: list[str], statement: str) -> DataFrame:
    """rows, which raise where a key without NULL comes twice."""
    row, n = fresh(rows.columns, "row", "n")
    whole = F.lit(True)
    for k in keys:
        whole &= F.col(k).isNotNull()
    found = rows.where(whole).groupBy(*keys).agg(F.first(F.struct(*rows.columns)).alias(row), F.count("*").alias(n))
    bad = F.raise_error(F.lit(f"{statement} would touch a row twice: its source has several rows of one key")).cast("boolean")
    return found.where(F.when(F.col(n) == 1, F.lit(True)).otherwise(bad)).select(f"{row}.*").unionByName(rows.where(~whole))


def merge(df: DataFrame, source: DataFrame, keys: list[str], matched_update: dict[str, str] | None = None, matched_delete: str | None = None, insert: bool = True, update_when: str = "true", insert_when: str = "true") -> DataFrame:
    """MERGE INTO with target t and source s: delete where matched and matched_delete, else update where update_when, insert the unmatched where insert_when. One full outer join.

    Rows with a NULL key match nothing: the target's stay, the source's are inserted. A row of the target that several
    rows of the source match raises, as the standard has it; several unmatched ones of one key are all inserted.
    """
    (n,) = fresh([*df.columns, *source.columns], "n")
    several = source.groupBy(*keys).agg(F.count("*").alias(n)).where(F.col(n) > 1)
    joined, there, given = _marked(df, source.join(several, keys, "left"), "t", "s", keys)
    both = there & given
    ok = F.when(~both | F.col(n).isNull(), F.lit(True)).otherwise(F.raise_error(F.lit("MERGE would touch a row twice: its source has several rows of one key")).cast("boolean"))
    keep = there & ~(both & F.coalesce(F.expr(matched_delete or "false"), F.lit(False)))
    add = ~there & F.lit(insert) & F.coalesce(F.expr(insert_when), F.lit(False))
    columns = [F.when(both & F.coalesce(F.expr(update_when), F.lit(False)), F.expr((matched_update or {}).get(c, f"t.{c}"))).when(there, F.col(f"t.{c}")).otherwise(F.col(f"s.{c}") if c in source.columns else F.lit(None)).alias(c) for c in df.columns]
    return joined.where(ok & (keep | add)).select(*columns)


def latest(log: DataFrame, keys: list[str]) -> DataFrame:
    """The change of each key with the greatest seq: an aggregate, so that changes of a hot key meet map-side."""
    (row,) = fresh(log.columns, "row")
    return log.groupBy(*keys).agg(F.max_by(F.struct(*log.columns), "seq").alias(row)).select(f"{row}.*")


def apply_changes(df: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The table after a change log (op I, U or D, and seq): of each key the last change counts, found by an aggregate that combines map-side. NULL is a key like any other."""
    last = latest(log, keys)
    names = fresh([*df.columns, *log.columns], *[f"key_{k}" for k in keys])
    touched = last.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    kept = df.join(touched, [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names)], "left_anti")
    return kept.select(*df.columns).unionByName(last.where("op <> 'D'").select(*df.columns))


def checked(df: DataFrame, **conditions: Column) -> DataFrame:
    """Rows as they are; a row that breaks a condition (that is false, not NULL) raises with its name."""
    for name, condition in conditions.items():
        bad = F.raise_error(F.lit(f"check constraint {name} is violated")).cast("boolean")
        df = df.where(F.when(F.coalesce(condition, F.lit(True)), F.lit(True)).otherwise(bad))
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys without NULL that break uniqueness, and how often they come."""
    return df.dropna(subset=keys).groupBy(*keys).count().where("count > 1")


def orphans(df: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """Rows whose foreign key isn't NULL and names no parent."""
    return df.where(F.col(foreign).isNotNull()).join(parent.select(F.col(key).alias("_k")).distinct(), F.col(foreign) == F.col("_k"), "left_anti")


def delete_parent(child: DataFrame, gone: DataFrame, foreign: str, key: str, action: str, default: Column | None = None) -> DataFrame:
    """The child table after parents are deleted: action cascade, set null, set default or restrict (raises if there are children)."""
    keys = gone.select(F.col(key).alias("_k")).distinct()
    if action == "cascade":
        return child.join(keys, F.col(foreign) == F.col("_k"), "left_anti")
    joined = child.join(keys, F.col(foreign) == F.col("_k"), "left")
    hit = F.col("_k").isNotNull()
    if action == "restrict":
        return checked(joined, restrict=~hit).drop("_k")
    value = F.lit(None) if action == "set null" else default
    return joined.withColumn(foreign, F.when(hit, value).otherwise(F.col(foreign))).drop("_k")
