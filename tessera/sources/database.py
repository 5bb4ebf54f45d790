"""Tables with names: statements that change them, transactions, policies, triggers, change slots, indexes, routines.

A table is a list of Parquet folders that are never changed: a statement that changes a table writes a new one (an INSERT
adds a folder to the list) and then switches the name. So a transaction or savepoint is a copy of the names' lists, a
backup is the same copied to another place, and readers see one version throughout. Everything runs in a Spark session of
its own, in which each table is a view of its name.
"""

from __future__ import annotations

import copy
import re
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.functions import plpgsql
from tessera.functions.plpgsql import Compiled, Interpreter, PlError, parse, sql_type

PRIVILEGES = ("SELECT", "INSERT", "UPDATE", "DELETE", "TRUNCATE", "ALL")


@dataclass
class Policy:
    name: str
    command: str  # ALL, SELECT, INSERT, UPDATE or DELETE
    using: str | None = None
    check: str | None = None


@dataclass
class Trigger:
    name: str
    timing: str  # BEFORE or AFTER
    events: tuple[str, ...]
    each_row: bool
    function: str


@dataclass
class Index:
    name: str
    columns: list[str]
    unique: bool
    folders: list[str] = field(default_factory=list)


@dataclass
class Table:
    schema: StructType
    folders: list[str] = field(default_factory=list)
    serial: dict[str, int] = field(default_factory=dict)
    policies: dict[str, Policy] = field(default_factory=dict)
    secured: bool = False
    triggers: dict[str, Trigger] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)


@dataclass
class Routine:
    name: str
    arguments: list[tuple[str, str]]
    returns: str
    language: str
    body: str


@dataclass
class Slot:
    """Where a reader of the change log is."""

    name: str
    confirmed: int
    active: bool = False
    tables: list[str] | None = None
    markers: bool = True


@dataclass
class Role:
    name: str
    superuser: bool = False
    member_of: set[str] = field(default_factory=set)


class Database:
    """folder: shared by all executors. role: whose privileges count; None: the owner's, who may do everything."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark.newSession(), folder.rstrip("/")
        for key in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled", "spark.sql.shuffle.partitions"):
            if (value := spark.conf.get(key, None)) is not None:
                self.spark.conf.set(key, value)
        self.tables: dict[str, Table] = {}
        self.routines: dict[str, Routine] = {}
        self.slots: dict[str, Slot] = {}
        self.log: list[tuple[int, str, str, str | None]] = []  # lsn, operation, table, folder of its rows
        self.notices: list[tuple[str, str]] = []
        self.roles: dict[str, Role] = {"public": Role("public")}
        self.grants: set[tuple[str, str, str]] = set()  # role, privilege, table
        self.role: str | None = None
        self.channels: set[str] = set()
        self.heard: list[tuple[str, str]] = []
        self._unsaid: list[tuple[str, str]] = []
        self._saved: list[tuple[str, tuple]] = []
        self._lsn = 0

    # --- tables

    def _written(self, df: DataFrame, table: str) -> str:
        path = f"{self.folder}/{table}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def raw(self, name: str) -> DataFrame:
        """All rows of a table, whatever its policies."""
        t = self._table(name)
        if not t.folders:
            return self.spark.createDataFrame([], t.schema)
        return self.spark.read.schema(t.schema).parquet(*t.folders)

    def _table(self, name: str) -> Table:
        if name.lower() not in self.tables:
            raise PlError(f'table "{name}" does not exist', "undefined_table")
        return self.tables[name.lower()]

    def table(self, name: str, command: str = "SELECT") -> DataFrame:
        """The rows that the policies let a command see: those of any policy for it; without policies, all."""
        self._may(command, name)
        df, t = self.raw(name), self._table(name)
        using = [p.using for p in t.policies.values() if p.using and p.command in ("ALL", command)]
        return df.where(" OR ".join(f"({u})" for u in using)) if t.secured and using else df

    def _shown(self, name: str) -> None:
        try:
            df = self.table(name)
        except PlError as e:  # of a privilege: a query that reads the view says so
            df = self.raw(name).where(F.raise_error(F.lit(str(e))).cast("boolean"))
        df.createOrReplaceTempView(name.lower())

    def create(self, name: str, rows: DataFrame | None = None, schema: StructType | str | None = None, serial: tuple[str, ...] = (), if_missing: bool = False) -> None:
        if name.lower() in self.tables:
            if if_missing:
                return
            raise PlError(f'table "{name}" already exists', "duplicate_table")
        if schema is None:
            schema = rows.schema
        elif isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        t = self.tables[name.lower()] = Table(StructType([copy.copy(f) for f in schema]), serial={c: 0 for c in serial})
        for f in t.schema:
            f.nullable = True
        if rows is not None:
            t.folders.append(self._written(rows, name))
        self._shown(name)

    def drop(self, name: str, if_exists: bool = False) -> None:
        if name.lower() not in self.tables:
            if if_exists:
                return
            self._table(name)
        self._may("ALL", name)
        del self.tables[name.lower()]
        self.grants = {g for g in self.grants if g[2] != name.lower()}
        self.spark.catalog.dropTempView(name.lower())

    def truncate(self, name: str) -> None:
        self._may("TRUNCATE", name)
        t = self._table(name)
        t.folders, t.serial = [], dict.fromkeys(t.serial, 0)
        for index in t.indexes.values():
            index.folders = []
        self._shown(name)

    def _switched(self, name: str, folders: list[str], operation: str, changed: str | None) -> None:
        t = self._table(name)
        t.folders = folders
        for index in t.indexes.values():
            self._indexed(name, index)
        if self.slots or operation == "DDL":
            self._emit(operation, name, changed)
        self._shown(name)

    # --- statements that change rows

    def insert(self, name: str, rows: DataFrame) -> None:
        """rows by the names of their columns; missing ones are NULL, or the next numbers of a serial."""
        self._may("INSERT", name)
        t = self._table(name)
        self._fire(name, "BEFORE", "INSERT", False, None)
        rows = self._numbered(t, rows).select(*[(F.col(f.name) if f.name.lower() in map(str.lower, rows.columns) or f.name in t.serial else F.lit(None)).cast(f.dataType).alias(f.name) for f in t.schema])
        rows = self._fire(name, "BEFORE", "INSERT", True, rows.select(F.struct("*").alias("new"))).select("new.*")
        checks = [p.check or p.using for p in t.policies.values() if t.secured and p.command in ("ALL", "INSERT") and (p.check or p.using)]
        if checks:
            bad = F.raise_error(F.lit(f'new row violates row-level security policy for table "{name}"')).cast("boolean")
            rows = rows.where(F.when(F.coalesce(F.expr(" OR ".join(f"({c})" for c in checks)), F.lit(False)), F.lit(True)).otherwise(bad))
        path = self._written(rows, name)
        self._unique(name, path)
        self._switched(name, [*t.folders, path], "INSERT", path)
        self._fire(name, "AFTER", "INSERT", True, self.spark.read.schema(t.schema).parquet(path).select(F.struct("*").alias("new")))
        self._fire(name, "AFTER", "INSERT", False, None)

    def _numbered(self, t: Table, rows: DataFrame) -> DataFrame:
        from tessera.sources.cursors import Sequence

        for column in t.serial:
            if column.lower() not in map(str.lower, rows.columns):
                sequence = Sequence(t.serial[column] + 1)
                rows = sequence.number(rows, [F.col(c) for c in rows.columns], column)
                t.serial[column] = sequence.value
        return rows

    def update(self, name: str, values: dict[str, str], where: str = "TRUE") -> None:
        """values: columns to SQL over the row."""
        self._may("UPDATE", name)
        t = self._table(name)
        self._fire(name, "BEFORE", "UPDATE", False, None)
        hit = F.coalesce(F.expr(where) & self._reached(t, "UPDATE"), F.lit(False))
        rows, given = self.raw(name), {c.lower(): v for c, v in values.items()}
        new = F.struct(*[(F.expr(f"({given[f.name.lower()]})").cast(f.dataType) if f.name.lower() in given else F.col(f.name)).alias(f.name) for f in t.schema])
        changed = self._fire(name, "BEFORE", "UPDATE", True, rows.where(hit).select(F.struct(*rows.columns).alias("old"), new.alias("new")))
        path = self._written(changed.select("old", "new"), name)
        changed = self.spark.read.parquet(path)
        kept = self._written(rows.where(~hit).unionByName(changed.select("new.*")).unionByName(self._skipped(rows.where(hit), changed)), name)
        self._unique(name, kept, alone=True)
        self._switched(name, [kept], "UPDATE", path)
        self._fire(name, "AFTER", "UPDATE", True, changed)
        self._fire(name, "AFTER", "UPDATE", False, None)

    def delete(self, name: str, where: str = "TRUE") -> None:
        self._may("DELETE", name)
        t = self._table(name)
        self._fire(name, "BEFORE", "DELETE", False, None)
        hit = F.coalesce(F.expr(where) & self._reached(t, "DELETE"), F.lit(False))
        rows = self.raw(name)
        gone = self._fire(name, "BEFORE", "DELETE", True, rows.where(hit).select(F.struct("*").alias("old")))
        path = self._written(gone.select("old"), name)
        gone = self.spark.read.parquet(path)
        kept = self._written(rows.where(~hit).unionByName(self._skipped(rows.where(hit), gone)), name)
        self._switched(name, [kept], "DELETE", path)
        self._fire(name, "AFTER", "DELETE", True, gone)
        self._fire(name, "AFTER", "DELETE", False, None)

    @staticmethod
    def _skipped(rows: DataFrame, done: DataFrame) -> DataFrame:
        """Rows that a trigger took out of a statement: they stay as they are."""
        return rows.exceptAll(done.select("old.*"))

    def _reached(self, t: Table, command: str) -> Column:
        using = [p.using for p in t.policies.values() if t.secured and p.using and p.command in ("ALL", command)]
        return F.expr(" OR ".join(f"({u})" for u in using)) if using else F.lit(True)

    def _unique(self, name: str, path: str, alone: bool = False) -> None:
        t = self._table(name)
        for index in (x for x in t.indexes.values() if x.unique):
            new = self.spark.read.schema(t.schema).parquet(path)
            every = new if alone or not t.folders else new.unionByName(self.raw(name))
            if not every.dropna(subset=index.columns).groupBy(*index.columns).count().where("count > 1").isEmpty():
                raise PlError(f'duplicate key violates unique constraint "{index.name}"', "unique_violation")

    # --- indexes: the table sorted by the columns, in files with statistics and Bloom filters for them

    def create_index(self, name: str, table: str, columns: list[str], unique: bool = False, if_missing: bool = False) -> None:
        t = self._table(table)
        if any(name in x.indexes for x in self.tables.values()):
            if if_missing:
                return
            raise PlError(f'index "{name}" already exists', "duplicate_object")
        index = Index(name, columns, unique)
        if unique and not self.raw(table).dropna(subset=columns).groupBy(*columns).count().where("count > 1").isEmpty():
            raise PlError(f'duplicate key violates unique constraint "{name}"', "unique_violation")
        self._indexed(table, index)
        t.indexes[name] = index

    def drop_index(self, name: str, if_exists: bool = False) -> None:
        for t in self.tables.values():
            if t.indexes.pop(name, None):
                return
        if not if_exists:
            raise PlError(f'index "{name}" does not exist', "undefined_object")

    def _indexed(self, table: str, index: Index) -> None:
        path = f"{self.folder}/{table}-{index.name}-{uuid.uuid4().hex}"
        writer = self.raw(table).repartitionByRange(*index.columns).sortWithinPartitions(*index.columns).write
        for c in index.columns:
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(path)
        index.folders = [path]

    def lookup(self, name: str, **values) -> DataFrame:
        """Rows with these values, read through an index on the columns where there is one: all but the files and pages that can hold them are skipped."""
        self._may("SELECT", name)
        t = self._table(name)
        folders = next((x.folders for x in t.indexes.values() if x.folders and {c.lower() for c in x.columns} >= {c.lower() for c in values}), t.folders)
        df = self.spark.read.schema(t.schema).parquet(*folders) if folders else self.raw(name)
        using = [p.using for p in t.policies.values() if t.secured and p.using and p.command in ("ALL", "SELECT")]
        if using:
            df = df.where(" OR ".join(f"({u})" for u in using))
        for c, v in values.items():
            df = df.where(F.col(c) == F.lit(v))
        return df

    # --- policies

    def create_policy(self, name: str, table: str, command: str = "ALL", using: str | None = None, check: str | None = None) -> None:
        t = self._table(table)
        if name in t.policies:
            raise PlError(f'policy "{name}" already exists', "duplicate_object")
        t.policies[name] = Policy(name, command, using, check)
        self._shown(table)

    def drop_policy(self, name: str, table: str, if_exists: bool = False) -> None:
        if self._table(table).policies.pop(name, None) is None and not if_exists:
            raise PlError(f'policy "{name}" does not exist', "undefined_object")
        self._shown(table)

    def secure(self, table: str, on: bool = True) -> None:
        self._table(table).secured = on
        self._shown(table)

    # --- roles and privileges

    def create_role(self, name: str, superuser: bool = False) -> None:
        if name.lower() in self.roles:
            raise PlError(f'role "{name}" already exists', "duplicate_object")
        self.roles[name.lower()] = Role(name.lower(), superuser)

    def drop_role(self, name: str, if_exists: bool = False) -> None:
        if name.lower() not in self.roles:
            if if_exists:
                return
            self._role(name)
        if any(g[0] == name.lower() for g in self.grants):
            raise PlError(f'role "{name}" can\'t be dropped: it has privileges', "dependent_objects_still_exist")
        del self.roles[name.lower()]
        for other in self.roles.values():
            other.member_of.discard(name.lower())

    def _role(self, name: str) -> Role:
        if name.lower() not in self.roles:
            raise PlError(f'role "{name}" does not exist', "undefined_object")
        return self.roles[name.lower()]

    def grant(self, privileges: list[str], table: str, role: str) -> None:
        self._may("ALL", table)
        self._table(table), self._role(role)
        self.grants |= {(role.lower(), p, table.lower()) for p in privileges}
        self._shown(table)

    def revoke(self, privileges: list[str], table: str, role: str) -> None:
        self._may("ALL", table)
        self.grants -= {(role.lower(), p, table.lower()) for p in (PRIVILEGES if "ALL" in privileges else privileges)}
        self._shown(table)

    def grant_role(self, role: str, to: str, on: bool = True) -> None:
        """Membership: what role may, to may too. A role is no member of itself, however long the way round."""
        self._role(role), self._role(to)
        if on and to.lower() in self._all_of(role.lower()):
            raise PlError(f'role "{role}" is a member of role "{to}"', "invalid_grant_operation")
        (self.roles[to.lower()].member_of.add if on else self.roles[to.lower()].member_of.discard)(role.lower())

    def _all_of(self, role: str) -> set[str]:
        found, todo = set(), [role]
        while todo:
            if (name := todo.pop()) not in found:
                found.add(name)
                todo += self.roles[name].member_of
        return found

    def set_role(self, name: str | None) -> None:
        self.role = self._role(name).name if name else None
        for table in self.tables:
            self._shown(table)

    def _may(self, privilege: str, table: str) -> None:
        """Raises unless the role, one it is a member of, or everyone has the privilege; ALL is the owner's alone."""
        if self.role is None:
            return
        mine = self._all_of(self.role) | {"public"}
        if any(self.roles[r].superuser for r in mine) or any((r, p, table.lower()) in self.grants for r in mine for p in {privilege, "ALL"}):
            return
        raise PlError(f"permission denied for table {table}", "insufficient_privilege")

    # --- channels

    def notify(self, channel: str, payload: str = "") -> None:
        """To all that listen; in a transaction with its end, and the same message once."""
        if self._saved:
            if (channel, payload) not in self._unsaid:
                self._unsaid.append((channel, payload))
        elif channel in self.channels:
            self.heard.append((channel, payload))

    def heard_since(self) -> list[tuple[str, str]]:
        """Messages since the last call."""
        found, self.heard = self.heard, []
        return found

    # --- triggers

    def create_trigger(self, trigger: Trigger, table: str) -> None:
        t = self._table(table)
        if trigger.name in t.triggers:
            raise PlError(f'trigger "{trigger.name}" already exists', "duplicate_object")
        if trigger.function.lower() not in self.routines:
            raise PlError(f"function {trigger.function}() does not exist", "undefined_function")
        t.triggers[trigger.name] = trigger

    def drop_trigger(self, name: str, table: str, if_exists: bool = False) -> None:
        if self._table(table).triggers.pop(name, None) is None and not if_exists:
            raise PlError(f'trigger "{name}" does not exist', "undefined_object")

    def _fire(self, table: str, timing: str, event: str, each_row: bool, rows: DataFrame | None) -> DataFrame | None:
        """Runs the triggers, by name. Those for each row are compiled: rows (columns old and new, as structs) come back as they leave them."""
        t = self._table(table)
        for trigger in sorted((x for x in t.triggers.values() if x.timing == timing and event in x.events and x.each_row == each_row), key=lambda x: x.name):
            block = parse(self.routines[trigger.function.lower()].body)
            if not each_row:
                self._interpreter({"tg_op": event, "tg_table_name": table, "tg_when": timing, "tg_level": "STATEMENT"}).run(block)
                continue
            sides = [side for side in ("old", "new") if side in rows.columns]
            known = {"tg_op": plpgsql.literal(event), "tg_table_name": plpgsql.literal(table), "tg_when": plpgsql.literal(timing), "tg_level": "'ROW'"}
            for side in sides:
                for f in t.schema:
                    known |= {f"{side}.{f.name.lower()}": f"{side}.{f.name}", f"{side}_{f.name.lower()}": f"{side}.{f.name}"}
            done = Compiled(block, known)
            for target, columns, values, condition in done.effects:
                names = columns or [f.name for f in self._table(target).schema]
                self.insert(target, rows.where(condition).select(*[F.expr(v).alias(c) for c, v in zip(names, values)]))
            if timing == "BEFORE":
                if "new" in sides:
                    new = F.struct(*[F.expr(done.known[f"new.{f.name.lower()}"]).cast(f.dataType).alias(f.name) for f in t.schema])
                    rows = rows.where(done.checked(f"NOT ({done.dropped})")).select(*[c for c in rows.columns if c != "new"], new.alias("new"))
                else:
                    rows = rows.where(done.checked(f"NOT ({done.dropped})"))
            elif done.errors:
                rows.where(done.checked("TRUE")).write.format("noop").mode("overwrite").save()
        return rows

    # --- routines

    def _interpreter(self, variables: dict[str, object]) -> Interpreter:
        return Interpreter(lambda sql: [r.asDict(recursive=True) for r in found.collect()] if (found := self.sql(sql)) is not None else [], variables, lambda level, text: self.notices.append((level, text)))

    def create_routine(self, routine: Routine, replace: bool = False) -> None:
        if routine.name.lower() in self.routines and not replace:
            raise PlError(f"function {routine.name} already exists", "duplicate_function")
        if routine.language == "plpgsql":
            block = parse(routine.body)  # errors of syntax come now
            if routine.returns.lower() not in ("trigger", "void", "") and not routine.returns.lower().startswith(("table", "setof")):
                self._inlined(routine, lambda known: (lambda c: c.checked(c.value))(Compiled(block, known)))
        elif routine.language == "sql":
            text = re.sub(r"(?is)^\s*SELECT\s+(.*?);?\s*$", r"\1", routine.body)
            if " from " not in text.lower():
                for k, (name, _) in enumerate(routine.arguments, 1):
                    text = re.sub(rf"\${k}\b", name, text)
                self._inlined(routine, lambda known: text)
        self.routines[routine.name.lower()] = routine

    def _inlined(self, routine: Routine, body: Callable[[dict[str, str]], str]) -> None:
        """A function that SQL can call: its body is an expression. One that isn't (loops, statements) can be called by call() alone."""
        try:
            text = body({n: n for n, _ in routine.arguments})
        except ValueError:
            return
        arguments = ", ".join(f"{n} {sql_type(k)}" for n, k in routine.arguments)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {routine.name}({arguments}) RETURNS {sql_type(routine.returns)} RETURN CAST({text} AS {sql_type(routine.returns)})")

    def drop_routine(self, name: str, if_exists: bool = False) -> None:
        if self.routines.pop(name.lower(), None) is None and not if_exists:
            raise PlError(f"function {name} does not exist", "undefined_function")
        self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")

    def call(self, name: str, *values: object) -> object:
        """A function or procedure with these arguments: its value, or a DataFrame of the rows of RETURN QUERY."""
        if name.lower() not in self.routines:
            raise PlError(f"procedure {name} does not exist", "undefined_function")
        routine = self.routines[name.lower()]
        if routine.language == "sql":
            text = routine.body
            for k, (argument, v) in enumerate(zip((n for n, _ in routine.arguments), values), 1):
                text = re.sub(rf"\${k}\b", plpgsql.literal(v).replace("\\", "\\\\"), text)
                text = plpgsql.replaced(text, lambda n, a=argument, x=v: plpgsql.literal(x) if n == a.lower() else None)
            found = [self.sql(part) for part in statements(text)][-1]
            row = found.first() if found is not None else None
            return row[0] if row else None
        run = self._interpreter({n.lower(): v for (n, _), v in zip(routine.arguments, values)})
        value = run.run(parse(routine.body))
        return self.spark.createDataFrame(run.rows) if run.rows else value

    # --- change slots

    def _emit(self, operation: str, table: str, path: str | None) -> None:
        self._lsn += 1
        self.log.append((self._lsn, operation, table, path))

    def create_slot(self, name: str) -> Slot:
        """A reader of all changes from now on."""
        if name.lower() in self.slots:
            raise PlError(f"replication slot '{name}' already exists", "duplicate_object")
        self.slots[name.lower()] = slot = Slot(name, self._lsn)
        return slot

    def drop_slot(self, name: str) -> None:
        if self._slot(name).active:
            raise PlError(f"cannot drop active replication slot '{name}'", "object_in_use")
        del self.slots[name.lower()]

    def _slot(self, name: str) -> Slot:
        if name.lower() not in self.slots:
            raise PlError(f"replication slot '{name}' not found", "undefined_object")
        return self.slots[name.lower()]

    def activate(self, name: str, on: bool = True) -> None:
        slot = self._slot(name)
        if on and slot.active:
            raise PlError("slot already active", "object_in_use")
        slot.active = on

    def advance(self, name: str, lsn: int) -> None:
        """The reader has done with everything up to lsn; it never goes back."""
        slot = self._slot(name)
        slot.confirmed = max(slot.confirmed, lsn)

    def poll(self, name: str, most: int) -> list[tuple[int, str, str, DataFrame | None]]:
        """Up to most changes (statements and transaction marks) behind what the slot has confirmed: lsn, operation, table, and the rows it touched (old, new). Polling again gives the same until advance()."""
        slot = self._slot(name)
        wanted = [x for x in self.log if x[0] > slot.confirmed and (slot.markers if x[1] in ("BEGIN", "COMMIT", "ROLLBACK") else slot.tables is None or x[2] in slot.tables)]
        return [(lsn, operation, table, self.spark.read.parquet(path) if path else None) for lsn, operation, table, path in wanted[:most]]

    def collect_garbage(self) -> int:
        """Forgets what every slot has confirmed."""
        least = min((s.confirmed for s in self.slots.values()), default=self._lsn)
        before = len(self.log)
        self.log = [x for x in self.log if x[0] > least]
        return before - len(self.log)

    # --- transactions, backups

    def _state(self) -> tuple:
        return copy.deepcopy((self.tables, self.routines)), len(self.log)

    def _back_to(self, state: tuple) -> None:
        (tables, routines), entries = state
        for name in self.tables.keys() - tables.keys():
            self.spark.catalog.dropTempView(name)
        self.tables, self.routines = copy.deepcopy((tables, routines))
        del self.log[entries:]
        for name in self.tables:
            self._shown(name)

    def begin(self) -> None:
        if self._saved:
            raise PlError("there is already a transaction in progress", "active_sql_transaction")
        self._saved.append(("", self._state()))
        self._emit("BEGIN", "", None)

    def savepoint(self, name: str) -> None:
        self._in_transaction()
        self._saved.append((name.lower(), self._state()))

    def commit(self) -> None:
        self._in_transaction()
        self._saved.clear()
        self._emit("COMMIT", "", None)
        unsaid, self._unsaid = self._unsaid, []
        for message in unsaid:
            self.notify(*message)

    def rollback(self, to: str | None = None) -> None:
        self._in_transaction()
        k = max((k for k, (n, _) in enumerate(self._saved) if n == (to or "").lower()), default=None)
        if k is None:
            raise PlError(f'savepoint "{to}" does not exist', "invalid_savepoint_specification")
        self._back_to(self._saved[k][1])
        if not to:
            self._unsaid = []
        del self._saved[k + 1 if to else 0 :]

    def release(self, name: str) -> None:
        k = max((k for k, (n, _) in enumerate(self._saved) if n == name.lower()), default=None)
        if k is None:
            raise PlError(f'savepoint "{name}" does not exist', "invalid_savepoint_specification")
        del self._saved[k:]

    def _in_transaction(self) -> None:
        if not self._saved:
            raise PlError("there is no transaction in progress", "no_active_sql_transaction")

    def backup(self, folder: str) -> None:
        """All tables as they are now, as Parquet under folder."""
        for name in self.tables:
            self.raw(name).write.mode("overwrite").parquet(f"{folder.rstrip('/')}/{name}")

    def restore(self, folder: str, names: list[str] | None = None) -> None:
        """Tables as backup() left them, instead of those of their names."""
        for name in names or list(self.tables):
            rows = self.spark.read.parquet(f"{folder.rstrip('/')}/{name}")
            if name in self.tables:
                self._switched(name, [self._written(rows, name)], "DDL", None)
            else:
                self.create(name, rows)

    # --- the catalog

    def catalog(self) -> DataFrame:
        """information_schema.columns of all tables."""
        kinds = {"string": "text", "int": "integer", "double": "double precision", "float": "real", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp with time zone"}
        rows = [(n, f.name, k, kinds.get(f.dataType.simpleString(), f.dataType.simpleString())) for n, t in sorted(self.tables.items()) for k, f in enumerate(t.schema, 1)]
        return self.spark.createDataFrame(rows, "table_name string, column_name string, ordinal_position long, data_type string")

    def show(self, what: str) -> DataFrame:
        """What the database holds: tables, table_stats, indexes, triggers, policies, functions, roles, grants or replication_slots."""
        tables = sorted(self.tables.items())
        made: dict[str, tuple[str, Callable[[], list[tuple]]]] = {
            "tables": ("table_name string", lambda: [(n,) for n, _ in tables]),
            "table_stats": ("table_name string, row_count long, column_count long, folders long", lambda: [(n, self.raw(n).count(), len(t.schema), len(t.folders)) for n, t in tables]),
            "indexes": ("table_name string, index_name string, columns string, is_unique boolean", lambda: [(n, x.name, ", ".join(x.columns), x.unique) for n, t in tables for x in t.indexes.values()]),
            "triggers": ("table_name string, trigger_name string, timing string, events string, level string, function string", lambda: [(n, x.name, x.timing, ", ".join(x.events), "ROW" if x.each_row else "STATEMENT", x.function) for n, t in tables for x in t.triggers.values()]),
            "policies": ("table_name string, policy_name string, command string, using_expr string, check_expr string", lambda: [(n, x.name, x.command, x.using, x.check) for n, t in tables for x in t.policies.values()]),
            "functions": ("function_name string, language string, returns string", lambda: [(x.name, x.language, x.returns) for _, x in sorted(self.routines.items())]),
            "roles": ("role_name string, superuser boolean, member_of string", lambda: [(x.name, x.superuser, ", ".join(sorted(x.member_of))) for _, x in sorted(self.roles.items())]),
            "grants": ("role_name string, privilege string, table_name string", lambda: sorted(self.grants)),
            "replication_slots": ("slot_name string, active boolean, confirmed_lsn long", lambda: [(x.name, x.active, x.confirmed) for _, x in sorted(self.slots.items())]),
        }
        if what.lower() not in made:
            raise PlError(f'there is nothing to show as "{what}"', "undefined_object")
        schema, rows = made[what.lower()]
        return self.spark.createDataFrame(rows(), schema)

    # --- statements as text

    def sql(self, text: str) -> DataFrame | None:
        """One statement: a query's rows, or None. What is no statement of this database goes to Spark."""
        text = text.strip().rstrip(";").strip()
        for pattern, act in _STATEMENTS:
            if m := re.match(pattern, text, re.I | re.S):
                return act(self, m)
        return self.spark.sql(text)

    def script(self, text: str) -> DataFrame | None:
        """Statements in turn; the last one's rows."""
        found = None
        for one in statements(text):
            found = self.sql(one)
        return found


def statements(text: str) -> list[str]:
    """Statements between semicolons outside quotes and dollar quotes."""
    out, begin = [], 0
    for m in re.finditer(r"'(?:[^']|'')*'|\"[^\"]*\"|(\$\w*\$).*?\1|--[^\n]*|;", text, re.S):
        if m.group() == ";":
            out.append(text[begin : m.start()])
            begin = m.end()
    return [x.strip() for x in [*out, text[begin:]] if x.strip()]


def _names(text: str | None) -> list[str]:
    return [x.strip().strip('"').lower() for x in text.split(",")] if text else []


def _create_table(db: Database, m: re.Match) -> None:
    columns, serial = [], []
    for part in plpgsql._split(m["columns"]):
        if re.match(r"(?i)(PRIMARY\s+KEY|UNIQUE|CHECK|FOREIGN|CONSTRAINT)\b", part):
            continue
        name, kind = re.match(r"(\S+)\s+(.*)", part, re.S).groups()
        kind = re.split(r"(?i)\s+(?:PRIMARY|NOT|NULL|UNIQUE|DEFAULT|CHECK|REFERENCES)\b", kind)[0]
        if kind.lower() in ("serial", "bigserial"):
            serial.append(name.lower())
        columns.append(f"{name.lower()} {'BIGINT' if kind.lower() == 'bigserial' else sql_type(kind)}")
    db.create(m["name"], schema=", ".join(columns), serial=tuple(serial), if_missing=bool(m["missing"]))
    keys = [p for p in plpgsql._split(m["columns"]) if re.search(r"(?i)\bPRIMARY\s+KEY\b", p)]
    if keys:
        found = re.match(r"(?i)\s*PRIMARY\s+KEY\s*\(([^)]*)\)", keys[0])
        db.create_index(f"{m['name'].lower()}_pkey", m["name"], _names(found[1]) if found else [keys[0].split()[0].lower()], unique=True)


def _insert(db: Database, m: re.Match) -> DataFrame | None:
    fields = [f.name for f in db._table(m["name"]).schema]
    rows = db.spark.sql(m["rows"])
    names = _names(m["columns"]) or fields
    if len(names) != len(rows.columns):
        if m["columns"] or len(rows.columns) > len(names):
            raise PlError("INSERT has other columns than expressions", "syntax_error")
        names = names[: len(rows.columns)]
    db.insert(m["name"], rows.toDF(*names))
    return None


def _update(db: Database, m: re.Match) -> None:
    db.update(m["name"], dict(re.match(r"(?s)\s*(\w+)\s*=\s*(.*)", x).groups() for x in plpgsql._split(m["values"])), m["where"] or "TRUE")


def _routine(db: Database, m: re.Match) -> None:
    arguments = []
    for k, part in enumerate(plpgsql._split(m["arguments"]), 1):
        words = re.sub(r"(?i)^(IN|OUT|INOUT)\s+", "", part).split(None, 1)
        arguments.append((words[0].lower(), words[1]) if len(words) > 1 else (f"arg{k}", words[0]))
    text = m.group(0)
    body = re.search(r"(?is)\bAS\s+(?:(\$\w*\$)(.*?)\1|'((?:[^']|'')*)')", text)
    language = re.search(r"(?i)\bLANGUAGE\s+(\w+)", text)
    returns = re.search(r"(?is)\bRETURNS\s+(TABLE\s*\([^)]*\)|SETOF\s+\w+|(?!NULL\s+ON)[\w ]+?(?:\s*\([^)]*\))?)\s+(?:AS|LANGUAGE|IMMUTABLE|STABLE|VOLATILE|STRICT|RETURNS|CALLED)\b", text)
    source = body[2] if body[1] else body[3].replace("''", "'")
    db.create_routine(Routine(m["name"], arguments, returns[1].strip() if returns else "", (language[1] if language else "sql").lower(), source), bool(m["replace"]))


def _trigger(db: Database, m: re.Match) -> None:
    events = tuple(re.findall("INSERT|UPDATE|DELETE", m["events"].upper()))
    db.create_trigger(Trigger(m["name"].lower(), m["timing"].upper(), events, (m["level"] or "STATEMENT").upper() == "ROW", m["function"]), m["table"])


def _policy(db: Database, m: re.Match) -> None:
    tail, found = m["tail"], {}
    for word, key in (("USING", "using"), (r"WITH\s+CHECK", "check")):
        if at := re.search(rf"(?i)\b{word}\s*\(", tail):
            depth, k = 1, at.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(tail[k], 0)
                k += 1
            found[key] = tail[at.end() : k - 1]
    db.create_policy(m["name"].lower(), m["table"], (m["command"] or "ALL").upper(), **found)


def _do(db: Database, m: re.Match) -> None:
    body = re.match(r"(?is)(?:LANGUAGE\s+\w+\s+)?(?:(\$\w*\$)(.*?)\1|'((?:[^']|'')*)')", m["rest"])
    db._interpreter({}).run(parse(body[2] if body[1] else body[3].replace("''", "'")))


def _call(db: Database, m: re.Match) -> DataFrame | None:
    values = [db.spark.sql(f"SELECT {x} AS v").first().v for x in plpgsql._split(m["values"])]
    found = db.call(m["name"], *values)
    return found if isinstance(found, DataFrame) else None


def _privileges(db: Database, m: re.Match) -> None:
    act = db.grant if m["verb"].upper() == "GRANT" else db.revoke
    wanted = [p.strip().upper() for p in m["privileges"].split(",")]
    for table in _names(m["tables"]):
        for role in _names(m["roles"]):
            act(["ALL" if p.startswith("ALL") else p for p in wanted], table, role)


def _notify(db: Database, m: re.Match) -> None:
    db.notify(m["name"].lower(), (m["payload"] or "").replace("''", "'"))


def _unlisten(db: Database, m: re.Match) -> None:
    db.channels = set() if m["name"] == "*" else db.channels - {m["name"].lower()}


_NAME = r"\"?(?P<name>\w+)\"?"
_STATEMENTS: list[tuple[str, Callable[[Database, re.Match], DataFrame | None]]] = [
    (rf"CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?P<missing>IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+AS\s+(?P<rows>.*)$", lambda db, m: db.create(m["name"], db.spark.sql(m["rows"]), if_missing=bool(m["missing"]))),
    (rf"CREATE\s+(?:TEMP(?:ORARY)?\s+)?TABLE\s+(?P<missing>IF\s+NOT\s+EXISTS\s+)?{_NAME}\s*\((?P<columns>.*)\)\s*$", _create_table),
    (rf"DROP\s+TABLE\s+(?P<exists>IF\s+EXISTS\s+)?{_NAME}(?:\s+(?:CASCADE|RESTRICT))?$", lambda db, m: db.drop(m["name"], bool(m["exists"]))),
    (rf"TRUNCATE\s+(?:TABLE\s+)?{_NAME}$", lambda db, m: db.truncate(m["name"])),
    (rf"INSERT\s+INTO\s+{_NAME}\s*(?:\((?P<columns>[\w\s,\"]*)\)\s*)?(?P<rows>(?:SELECT|VALUES|WITH|TABLE)\b.*)$", _insert),
    (rf"UPDATE\s+{_NAME}\s+SET\s+(?P<values>.*?)(?:\s+WHERE\s+(?P<where>.*))?$", _update),
    (rf"DELETE\s+FROM\s+{_NAME}(?:\s+WHERE\s+(?P<where>.*))?$", lambda db, m: db.delete(m["name"], m["where"] or "TRUE")),
    (rf"CREATE\s+(?P<unique>UNIQUE\s+)?INDEX\s+(?:CONCURRENTLY\s+)?(?P<missing>IF\s+NOT\s+EXISTS\s+)?{_NAME}\s+ON\s+(?P<table>\w+)\s*\((?P<columns>[^)]*)\)", lambda db, m: db.create_index(m["name"].lower(), m["table"], _names(m["columns"]), bool(m["unique"]), bool(m["missing"]))),
    (rf"DROP\s+INDEX\s+(?P<exists>IF\s+EXISTS\s+)?{_NAME}$", lambda db, m: db.drop_index(m["name"].lower(), bool(m["exists"]))),
    (rf"CREATE\s+POLICY\s+{_NAME}\s+ON\s+(?P<table>\w+)(?:\s+FOR\s+(?P<command>ALL|SELECT|INSERT|UPDATE|DELETE))?(?P<tail>.*)$", _policy),
    (rf"DROP\s+POLICY\s+(?P<exists>IF\s+EXISTS\s+)?{_NAME}\s+ON\s+(?P<table>\w+)$", lambda db, m: db.drop_policy(m["name"].lower(), m["table"], bool(m["exists"]))),
    (rf"ALTER\s+TABLE\s+{_NAME}\s+(?P<on>ENABLE|DISABLE)\s+ROW\s+LEVEL\s+SECURITY$", lambda db, m: db.secure(m["name"], m["on"].upper() == "ENABLE")),
    (rf"CREATE\s+(?P<replace>OR\s+REPLACE\s+)?(?:FUNCTION|PROCEDURE)\s+{_NAME}\s*\((?P<arguments>[^)]*)\).*$", _routine),
    (rf"DROP\s+(?:FUNCTION|PROCEDURE)\s+(?P<exists>IF\s+EXISTS\s+)?{_NAME}(?:\s*\([^)]*\))?$", lambda db, m: db.drop_routine(m["name"], bool(m["exists"]))),
    (rf"CREATE\s+TRIGGER\s+{_NAME}\s+(?P<timing>BEFORE|AFTER)\s+(?P<events>[\w\s]+?)\s+ON\s+(?P<table>\w+)(?:\s+FOR\s+EACH\s+(?P<level>ROW|STATEMENT))?\s+EXECUTE\s+(?:FUNCTION|PROCEDURE)\s+(?P<function>\w+)\s*\(\s*\)$", _trigger),
    (rf"DROP\s+TRIGGER\s+(?P<exists>IF\s+EXISTS\s+)?{_NAME}\s+ON\s+(?P<table>\w+)$", lambda db, m: db.drop_trigger(m["name"].lower(), m["table"], bool(m["exists"]))),
    (r"DO\s+(?P<rest>.*)$", _do),
    (rf"CREATE\s+(?:ROLE|USER)\s+{_NAME}(?P<super>.*\bSUPERUSER\b)?.*$", lambda db, m: db.create_role(m["name"], bool(m["super"]) and "NOSUPERUSER" not in m["super"].upper())),
    (rf"DROP\s+(?:ROLE|USER)\s+(?P<exists>IF\s+EXISTS\s+)?{_NAME}$", lambda db, m: db.drop_role(m["name"], bool(m["exists"]))),
    (r"(?P<verb>GRANT|REVOKE)\s+(?P<privileges>(?:(?:SELECT|INSERT|UPDATE|DELETE|TRUNCATE|ALL(?:\s+PRIVILEGES)?)\s*,?\s*)+)\s+ON\s+(?:TABLE\s+)?(?P<tables>[\w,\s]+?)\s+(?:TO|FROM)\s+(?P<roles>[\w,\s]+)$", _privileges),
    (rf"GRANT\s+{_NAME}\s+TO\s+(?P<to>\w+)$", lambda db, m: db.grant_role(m["name"], m["to"])),
    (rf"REVOKE\s+{_NAME}\s+FROM\s+(?P<to>\w+)$", lambda db, m: db.grant_role(m["name"], m["to"], False)),
    (r"(?:RESET\s+ROLE|SET\s+ROLE\s+NONE)$", lambda db, m: db.set_role(None)),
    (rf"SET\s+ROLE\s+{_NAME}$", lambda db, m: db.set_role(m["name"])),
    (rf"LISTEN\s+{_NAME}$", lambda db, m: db.channels.add(m["name"].lower())),
    (r"UNLISTEN\s+(?P<name>\w+|\*)$", _unlisten),
    (rf"NOTIFY\s+{_NAME}(?:\s*,\s*'(?P<payload>(?:[^']|'')*)')?$", _notify),
    (r"SHOW\s+(?P<name>tables|table_stats|indexes|triggers|policies|functions|roles|grants|replication_slots)$", lambda db, m: db.show(m["name"])),
    (rf"CALL\s+{_NAME}\s*\((?P<values>.*)\)$", _call),
    (r"(?:BEGIN|START)(?:\s+(?:TRANSACTION|WORK))?$", lambda db, m: db.begin()),
    (r"(?:COMMIT|END)(?:\s+(?:TRANSACTION|WORK))?$", lambda db, m: db.commit()),
    (r"(?:ROLLBACK|ABORT)(?:\s+(?:TRANSACTION|WORK))?$", lambda db, m: db.rollback()),
    (r"ROLLBACK\s+TO\s+(?:SAVEPOINT\s+)?(?P<name>\w+)$", lambda db, m: db.rollback(m["name"])),
    (r"SAVEPOINT\s+(?P<name>\w+)$", lambda db, m: db.savepoint(m["name"])),
    (r"RELEASE\s+(?:SAVEPOINT\s+)?(?P<name>\w+)$", lambda db, m: db.release(m["name"])),
]
