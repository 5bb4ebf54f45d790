"""Named tables: statements, triggers, policies, routines, slots, transactions, indexes."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import plpgsql
from tessera.operators import changes as ch
from tessera.operators.relational import distinct_on
from tessera.plans.storage import folder
from tessera.sources.database import Database, PlError, statements


@pytest.fixture()
def db(spark):
    return Database(spark, folder(spark))


def values(df):
    return sorted(tuple(r) for r in df.collect())


def test_statement_trigger(db):
    db.script("""
        CREATE TABLE audit (id SERIAL PRIMARY KEY, msg TEXT);
        CREATE TABLE target (id INTEGER PRIMARY KEY, val TEXT);
        CREATE FUNCTION audit_fn() RETURNS TRIGGER LANGUAGE plpgsql AS $$ BEGIN INSERT INTO audit(msg) VALUES('inserted'); RETURN NEW; END $$;
        CREATE TRIGGER audit_trg AFTER INSERT ON target FOR EACH STATEMENT EXECUTE FUNCTION audit_fn();
        INSERT INTO target VALUES (1, 'hello'), (2, 'there')
    """)
    assert values(db.sql("SELECT * FROM audit")) == [(1, "inserted")]
    with pytest.raises(PlError, match="already exists"):
        db.sql("CREATE TRIGGER audit_trg AFTER INSERT ON target EXECUTE FUNCTION audit_fn()")
    db.sql("DROP TRIGGER IF EXISTS nonexistent ON target")
    with pytest.raises(PlError, match="does not exist"):
        db.sql("DROP TRIGGER nonexistent ON target")
    db.sql("DROP TRIGGER audit_trg ON target")
    db.sql("INSERT INTO target VALUES (3, 'x')")
    assert db.sql("SELECT * FROM audit").count() == 1
    with pytest.raises(PlError, match="duplicate key"):
        db.sql("INSERT INTO target VALUES (3, 'again')")
    assert db.sql("SELECT * FROM target").count() == 3


def test_row_triggers(db):
    db.script("""
        CREATE TABLE data (id INTEGER PRIMARY KEY, name TEXT, score INTEGER);
        CREATE TABLE log (n SERIAL PRIMARY KEY, what TEXT, id INTEGER);
        CREATE FUNCTION keep() RETURNS TRIGGER LANGUAGE plpgsql AS $$
        DECLARE most INTEGER := 100;
        BEGIN
            IF NEW.score IS NULL THEN RETURN NULL; ELSIF NEW.score > most THEN NEW.score := most; NEW.name := NEW.name || '!'; ELSE NEW.score := NEW.score + 1; END IF;
            IF NEW.name = 'bad' THEN RAISE EXCEPTION 'no % here', NEW.name; END IF;
            RETURN NEW;
        END $$;
        CREATE TRIGGER a BEFORE INSERT OR UPDATE ON data FOR EACH ROW EXECUTE FUNCTION keep();
        CREATE FUNCTION note() RETURNS TRIGGER LANGUAGE plpgsql AS $$ BEGIN INSERT INTO log(what, id) VALUES(lower(TG_OP), old_id); RETURN OLD; END $$;
        CREATE TRIGGER b BEFORE DELETE ON data FOR EACH ROW EXECUTE FUNCTION note();
        INSERT INTO data VALUES (1, 'a', 5), (2, 'b', 500), (3, 'c', NULL)
    """)
    assert values(db.table("data")) == [(1, "a", 6), (2, "b!", 100)]
    db.sql("UPDATE data SET score = CASE id WHEN 1 THEN NULL ELSE 7 END")
    assert values(db.table("data")) == [(1, "a", 6), (2, "b!", 8)]  # the row that the trigger skips stays
    with pytest.raises(Exception, match="no bad here"):
        db.sql("INSERT INTO data VALUES (9, 'bad', 1)")
    db.sql("DELETE FROM data WHERE id = 1")
    assert values(db.table("data")) == [(2, "b!", 8)] and values(db.table("log")) == [(1, "delete", 1)]


def test_policies(db):
    db.script("""
        CREATE TABLE accounts (id INT PRIMARY KEY, owner TEXT, balance INT);
        INSERT INTO accounts VALUES (1, 'alice', 100), (2, 'bob', 200), (3, NULL, 5);
        CREATE POLICY alice_only ON accounts FOR ALL USING (owner = 'alice')
    """)
    assert db.sql("SELECT * FROM accounts").count() == 3
    db.script("ALTER TABLE accounts ENABLE ROW LEVEL SECURITY; UPDATE accounts SET balance = 999; DELETE FROM accounts WHERE id > 1")
    assert values(db.sql("SELECT id, balance FROM accounts")) == [(1, 999)]
    with pytest.raises(Exception, match="row-level security"):
        db.sql("INSERT INTO accounts VALUES (7, 'bob', 1)")
    db.sql("ALTER TABLE accounts DISABLE ROW LEVEL SECURITY")
    assert values(db.sql("SELECT id, balance FROM accounts")) == [(1, 999), (2, 200), (3, 5)]
    db.script("ALTER TABLE accounts ENABLE ROW LEVEL SECURITY; DROP POLICY alice_only ON accounts")
    assert db.sql("SELECT * FROM accounts").count() == 3


def test_routines(db):
    db.script("""
        CREATE FUNCTION add_two(a INTEGER, b INTEGER) RETURNS INTEGER LANGUAGE SQL AS 'SELECT $1 + $2';
        CREATE FUNCTION grade(n INTEGER) RETURNS TEXT LANGUAGE plpgsql IMMUTABLE AS $$
        DECLARE r TEXT; BEGIN IF n >= 90 THEN RETURN 'A'; ELSIF n >= 50 THEN r := 'B'; ELSE r := 'C'; END IF; r := r || CASE WHEN n % 2 = 0 THEN '+' ELSE '' END; RETURN r; END $$;
        CREATE FUNCTION fib(n INTEGER) RETURNS BIGINT LANGUAGE plpgsql AS $$
        DECLARE a BIGINT := 0; b BIGINT := 1; c BIGINT; BEGIN FOR k IN 1..n LOOP c := a + b; a := b; b := c; EXIT WHEN k >= 1000; END LOOP; RETURN a; END $$
    """)
    assert values(db.sql("SELECT id, grade(CAST(id AS INT)), add_two(CAST(id AS INT), 1) FROM range(40, 100, 25)")) == [(40, "C+", 41), (65, "B", 66), (90, "A", 91)]
    assert db.call("fib", 10) == 55 and db.call("add_two", 2, 3) == 5 and db.call("grade", 40) == "C+"
    db.script("CREATE OR REPLACE FUNCTION add_two(a INTEGER, b INTEGER) RETURNS INTEGER LANGUAGE SQL AS 'SELECT $1 - $2'; DROP FUNCTION IF EXISTS nothing; DROP FUNCTION fib")
    assert db.call("add_two", 2, 3) == -1
    with pytest.raises(PlError, match="does not exist"):
        db.call("fib", 1)
    with pytest.raises(PlError, match="already exists"):
        db.sql("CREATE FUNCTION add_two(a INTEGER) RETURNS INTEGER LANGUAGE SQL AS 'SELECT 1'")
    with pytest.raises(SyntaxError):
        db.sql("CREATE FUNCTION broken() RETURNS INT LANGUAGE plpgsql AS $$ BEGIN IF 1 THEN RETURN 1; END $$")


def test_do_and_call(db):
    db.script("""
        CREATE TABLE out (key INT, label TEXT);
        CREATE PROCEDURE fill(n INTEGER) LANGUAGE plpgsql AS $$
        DECLARE total BIGINT := 0; r RECORD; k INT := 0;
        BEGIN
            WHILE k < n LOOP k := k + 1; CONTINUE WHEN k = 2; INSERT INTO out VALUES (k, 'it''s ' || k); END LOOP;
            FOR r IN SELECT key, label FROM out ORDER BY key LOOP total := total + r.key; END LOOP;
            SELECT count(*) INTO k FROM out;
            RAISE NOTICE 'rows % total %', k, total;
            FOR j IN REVERSE 3..1 LOOP EXIT WHEN j = 1; PERFORM j; END LOOP;
            BEGIN total := 1 / 0; EXCEPTION WHEN division_by_zero THEN RAISE NOTICE 'caught'; END;
            BEGIN RAISE EXCEPTION 'mine'; EXCEPTION WHEN no_data_found THEN k := 0; WHEN OTHERS THEN RAISE NOTICE '%', SQLERRM; END;
        END $$;
        CALL fill(4)
    """)
    assert values(db.table("out")) == [(1, "it's 1"), (3, "it's 3"), (4, "it's 4")]
    assert db.notices == [("NOTICE", "rows 3 total 8"), ("NOTICE", "caught"), ("NOTICE", "mine")]
    db.sql("DO $$ DECLARE n INT; BEGIN SELECT max(key) INTO n FROM out; DELETE FROM out WHERE key = n; END $$")
    assert db.table("out").count() == 2
    db.sql("CREATE FUNCTION listed() RETURNS SETOF INT LANGUAGE plpgsql AS $$ BEGIN RETURN QUERY SELECT key FROM out; RETURN; END $$")
    assert values(db.call("listed")) == [(1,), (3,)]
    with pytest.raises(PlError, match="nothing caught"):
        db.sql("DO $$ BEGIN RAISE EXCEPTION 'nothing caught'; END $$")


def test_slots(db):
    db.sql("CREATE TABLE users (id INT, name TEXT)")
    db.sql("CREATE TABLE orders (id INT)")
    db.create_slot("one")
    with pytest.raises(PlError, match="already exists"):
        db.create_slot("ONE")
    db.script("BEGIN; INSERT INTO users VALUES (1, 'a'); UPDATE users SET name = 'b'; COMMIT; INSERT INTO orders VALUES (5); DELETE FROM users")
    seen = db.poll("one", 100)
    assert [x[1] for x in seen] == ["BEGIN", "INSERT", "UPDATE", "COMMIT", "INSERT", "DELETE"]
    assert values(seen[2][3].select("old.name", "new.name")) == [("a", "b")]
    assert [x[0] for x in db.poll("one", 2)] == [x[0] for x in db.poll("one", 2)] == [seen[0][0], seen[1][0]]
    db.advance("one", seen[1][0])
    db.advance("one", seen[0][0])
    assert len(db.poll("one", 100)) == 4
    db.slots["one"].tables, db.slots["one"].markers = ["users"], False
    assert [x[1] for x in db.poll("one", 100)] == ["UPDATE", "DELETE"]
    db.activate("one")
    for act in (lambda: db.activate("one"), lambda: db.drop_slot("one")):
        with pytest.raises(PlError, match="active"):
            act()
    db.activate("one", False)
    assert db.collect_garbage() == 2
    db.drop_slot("one")
    with pytest.raises(PlError, match="not found"):
        db.poll("one", 1)


def test_transactions_backup_truncate(db, spark):
    db.script("CREATE TABLE t AS SELECT id FROM range(10); BEGIN; DELETE FROM t WHERE id < 5; SAVEPOINT a; DELETE FROM t; CREATE TABLE u AS SELECT 1 AS x; ROLLBACK TO a")
    assert db.sql("SELECT * FROM t").count() == 5 and "u" not in db.tables
    db.sql("ROLLBACK")
    assert db.sql("SELECT * FROM t").count() == 10
    with pytest.raises(PlError, match="no transaction"):
        db.sql("COMMIT")
    where = folder(spark)
    db.backup(where)
    db.sql("TRUNCATE TABLE t")
    assert db.sql("SELECT * FROM t").count() == 0
    db.restore(where)
    assert db.sql("SELECT * FROM t").count() == 10
    db.sql("DROP TABLE t")
    with pytest.raises(Exception, match="t"):
        db.sql("SELECT * FROM t").collect()
    db.sql("DROP TABLE IF EXISTS t")


def test_indexes(db):
    db.script("CREATE TABLE t AS SELECT id AS k, id % 7 AS m FROM range(1000); CREATE UNIQUE INDEX ik ON t (k); CREATE INDEX CONCURRENTLY im ON t (m)")
    assert values(db.lookup("t", k=77)) == [(77, 0)] and db.lookup("t", m=3).count() == 143
    plan = db.lookup("t", k=77)._jdf.queryExecution().toString()
    assert "t-ik-" in plan and "EqualTo(k,77)" in plan
    with pytest.raises(PlError, match="duplicate key"):
        db.sql("INSERT INTO t VALUES (5, 5)")
    db.sql("INSERT INTO t VALUES (5000, 3)")
    assert db.lookup("t", m=3).count() == 144
    with pytest.raises(PlError, match="duplicate key"):
        db.sql("CREATE UNIQUE INDEX bad ON t (m)")
    db.script("DROP INDEX im; DROP INDEX IF EXISTS im")
    with pytest.raises(PlError):
        db.sql("DROP INDEX im")


def test_statements():
    assert statements("SELECT ';'; DO $x$ a; b $x$; -- no; end\nSELECT 2") == ["SELECT ';'", "DO $x$ a; b $x$", "-- no; end\nSELECT 2"]
    assert plpgsql.replaced("x + t.x + 'x' + r.a", lambda n: {"x": "1", "r.a": "2"}.get(n)) == "1 + t.x + 'x' + 2"


def test_null_keys_stay(spark):
    df = spark.createDataFrame([(None, 1), (1, 10), (2, 20)], "k int, v int")
    new = spark.createDataFrame([(None, 5), (2, 7), (3, 8)], "k int, v int")
    assert sorted(map(repr, values_of(ch.upsert(df, new, ["k"], {"v": "excluded.v"})))) == sorted(map(repr, [(None, 1), (1, 10), (2, 7), (None, 5), (3, 8)]))
    assert sorted(map(repr, values_of(ch.merge(df, new, ["k"], {"v": "t.v + s.v"})))) == sorted(map(repr, [(None, 1), (1, 10), (2, 27), (None, 5), (3, 8)]))
    assert sorted(map(repr, values_of(ch.insert_or_ignore(df, new, ["k"])))) == sorted(map(repr, [(None, 1), (1, 10), (2, 20), (None, 5), (3, 8)]))
    log = spark.createDataFrame([("U", 1, None, 3), ("U", 2, None, 4), ("D", 3, 1, 0)], "op string, seq int, k int, v int")
    assert sorted(map(repr, values_of(ch.apply_changes(df, log, ["k"])))) == sorted(map(repr, [(None, 4), (2, 20)]))


def values_of(df):
    return [tuple(r) for r in df.collect()]


def test_several_source_rows(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "k int, v int")
    twice = spark.createDataFrame([(1, 5), (1, 3), (9, 1), (9, 2)], "k int, v int")
    assert values(ch.update_from(df, twice, ["k"], {"v": "v"})) == [(1, 3), (2, 20)]
    with pytest.raises(Exception, match="twice"):
        ch.merge(df, twice, ["k"], {"v": "s.v"}).collect()
    assert values(ch.merge(df, twice.where("k = 9"), ["k"], {"v": "s.v"})) == [(1, 10), (2, 20), (9, 1), (9, 2)]
    with pytest.raises(Exception, match="twice"):
        ch.upsert(df, twice, ["k"], {"v": "excluded.v"}).collect()


def test_distinct_on_orders(spark):
    df = spark.createDataFrame([(1, 5, "b"), (1, None, "a"), (1, 7, "c"), (2, 1, "z"), (2, 1, "y")], "k int, n int, s string")
    assert values(distinct_on(df, ["k"], ["n", "s"])) == [(1, 5, "b"), (2, 1, "y")]
    assert {tuple(r) for r in distinct_on(df, ["k"], [("n", "desc"), "s"]).collect()} == {(1, None, "a"), (2, 1, "y")}
    assert values(distinct_on(df, ["k"], [("s", "desc")])) == [(1, 7, "c"), (2, 1, "z")] == values(distinct_on(df, ["k"], [F.col("s").desc()]))


@pytest.mark.parametrize("expression, value", [
    ("set('{\"a\":1}', array('x', 'y'), '2')", '{"a":1}'), ("set('{\"a\":1}', array('x'), '2')", '{"a":1,"x":2}'), ("set('[1,2]', array('5'), '3')", "[1,2,3]"), ("set('[1,2]', array('-1'), '3')", "[1,3]"), ("set('[1]', array('z'), '3')", "[1]"),
    ("delete('{\"a\":1}', array('x', 'y'))", '{"a":1}'), ("delete('[1,2]', array('7'))", "[1,2]"), ("delete('[1,2]', array('0'))", "[2]"), ("delete('3', array('0'))", "3"), ("set('{}', CAST(NULL AS ARRAY<STRING>), '1')", None),
])
def test_paths_that_lead_nowhere(spark, expression, value):
    from tessera.functions import json_udf

    spark.udf.register("set", json_udf.jsonb_set)
    spark.udf.register("delete", json_udf.jsonb_delete_path)
    assert spark.sql(f"SELECT {expression} AS r").first().r == value


def test_asof_in_slices(spark):
    import random

    from tessera.operators.relational import asof

    rng = random.Random(2)
    at = lambda n: f"2024-01-{1 + n // 1440:02d} {n // 60 % 24:02d}:{n % 60:02d}:00"
    a = [(rng.choice([1, 1, 1, 2, None]), rng.randrange(20000), k) for k in range(300)]
    b = [(rng.choice([1, 1, 3, None]), rng.randrange(20000), k) for k in range(60)]
    left = spark.createDataFrame([(k, at(t), i) for k, t, i in a], "k int, t string, i int").selectExpr("k", "CAST(t AS TIMESTAMP_NTZ) AS t", "i")
    right = spark.createDataFrame([(k, at(t), i) for k, t, i in b], "k int, u string, v int").selectExpr("k", "CAST(u AS TIMESTAMP_NTZ) AS u", "v")
    want = {i: max(((t2, v) for k2, t2, v in b if k2 == k and t2 <= t), default=(0, None))[1] for k, t, i in a}
    for slices in (0, 3600, 86400):
        found = asof(left, right, ["k"], "t", "u", ["u", "v"], slices).collect()
        assert {r.i: r.v for r in found} == want and len(found) == 300


def test_roles(db):
    db.script("""
        CREATE TABLE a (id INT); CREATE TABLE b (id INT); INSERT INTO a VALUES (1), (2); INSERT INTO b VALUES (3);
        CREATE ROLE reader; CREATE ROLE boss SUPERUSER; CREATE ROLE clerk NOSUPERUSER; GRANT SELECT, INSERT ON TABLE a TO reader; GRANT reader TO clerk; GRANT SELECT ON b TO public;
        SET ROLE clerk; INSERT INTO a VALUES (9)
    """)
    assert db.sql("SELECT * FROM a").count() == 3 and db.sql("SELECT * FROM b").count() == 1
    for text in ("DELETE FROM a", "UPDATE a SET id = 1", "TRUNCATE a", "DROP TABLE a", "INSERT INTO b VALUES (1)", "GRANT ALL ON a TO clerk"):
        with pytest.raises(PlError, match="permission denied"):
            db.sql(text)
    db.script("RESET ROLE; REVOKE SELECT ON b FROM public; SET ROLE clerk")
    with pytest.raises(Exception, match="permission denied"):
        db.sql("SELECT * FROM b").collect()
    with pytest.raises(PlError, match="permission denied"):
        db.table("b")
    db.script("SET ROLE boss; DELETE FROM a WHERE id = 9; RESET ROLE")
    assert values(db.show("grants")) == [("reader", "INSERT", "a"), ("reader", "SELECT", "a")]
    for text in ("GRANT clerk TO reader", "CREATE ROLE boss", "SET ROLE nobody", "DROP ROLE reader"):
        with pytest.raises(PlError):
            db.sql(text)
    db.script("REVOKE ALL ON a FROM reader; REVOKE reader FROM clerk; DROP ROLE reader; DROP ROLE IF EXISTS reader")
    assert "reader" not in db.roles


def test_channels(db):
    db.script("LISTEN news; NOTIFY news, 'it''s here'; NOTIFY other; BEGIN; NOTIFY news, 'x'; NOTIFY news, 'x'")
    assert db.heard_since() == [("news", "it's here")]
    db.script("COMMIT; BEGIN; NOTIFY news, 'never'; ROLLBACK; UNLISTEN *; NOTIFY news, 'late'")
    assert db.heard_since() == [("news", "x")]


def test_show(db):
    db.script("CREATE TABLE a (id INT PRIMARY KEY, v TEXT); INSERT INTO a VALUES (1, 'x'), (2, 'y')")
    assert values(db.sql("SHOW table_stats")) == [("a", 2, 2, 1)] and values(db.sql("SHOW indexes")) == [("a", "a_pkey", "id", True)]
    assert db.sql("SHOW triggers").count() == db.sql("SHOW policies").count() == db.sql("SHOW functions").count() == db.sql("SHOW replication_slots").count() == 0
    with pytest.raises(PlError):
        db.show("weather")


def test_objects(spark):
    from tessera.sources.objects import ObjectStore

    store = ObjectStore(spark, folder(spark))
    assert store.list() == []
    store.put("seg/1", bytes(range(256)))
    store.put("seg/2", b"")
    store.put("seg/1", b"again" * 1000)
    store.put("other", b"x")
    assert store.get("seg/1") == b"again" * 1000 and store.size("seg/1") == 5000 and store.get("seg/2") == b""
    assert store.list("seg/") == ["seg/1", "seg/2"] and store.list() == ["other", "seg/1", "seg/2"]
    assert store.delete("seg/1") and not store.delete("seg/1") and not store.exists("seg/1") and not store.exists("seg")
    with pytest.raises(FileNotFoundError):
        store.get("seg/1")
    with pytest.raises(ValueError):
        store.put("../out", b"")
