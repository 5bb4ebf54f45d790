"""Queries that go through files, streams, views and user-defined functions: each writes to a folder all executors share and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import functions
from tessera.session import TABLES, shared_folder, sql, table
from tessera.sources.cursors import Cursor, Prepared, Sequence
from tessera.sources.database import Database
from tessera.sources.files import MaterializedView, copy_from, copy_to, dump, restore
from tessera.sources.objects import ObjectStore
from tessera.streaming import changelog


def folder(spark: SparkSession) -> str:
    """A new folder that all executors share."""
    return f"{shared_folder(spark)}/tessera-{uuid.uuid4().hex}"


def partition_pruned(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    dump(table(s, d, "orders").withColumn("year", F.year("o_orderdate").cast("long")), path, partition_by=["year"])
    return restore(s, path).where("year = 1997").select("o_orderkey", "o_totalprice")


def copy_round_trip(s: SparkSession, d: str) -> DataFrame:
    path, rows = folder(s), table(s, d, "customer").withColumn("c_mktsegment", F.expr("nullif(c_mktsegment, 'BUILDING')"))
    copy_to(rows, path)
    return copy_from(s, path, rows.schema)


def copy_query(s: SparkSession, d: str) -> DataFrame:
    path, rows = folder(s), sql(s, d, "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey")
    copy_to(rows, path, delimiter="|", header=False)
    return copy_from(s, path, rows.schema, delimiter="|", header=False)


def lenient_import(s: SparkSession, d: str) -> DataFrame:
    """Half of the lines don't parse as numbers; they are left out."""
    path = folder(s)
    copy_to(table(s, d, "customer").selectExpr("CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey AS STRING) ELSE 'bad' END AS k", "c_name"), path)
    return copy_from(s, path, "k BIGINT, c_name STRING", on_error="continue")


def dump_restore(codec: str):
    def run(s: SparkSession, d: str) -> DataFrame:
        path, rows = folder(s), table(s, d, "part")
        dump(rows, path, codec)
        return restore(s, path, rows.schema)

    return run


def appended(s: SparkSession, d: str) -> DataFrame:
    path = folder(s)
    table(s, d, "nation").write.parquet(path)
    table(s, d, "nation").selectExpr("n_nationkey + 100 AS n_nationkey", "n_name", "n_regionkey").write.mode("append").parquet(path)
    return s.read.parquet(path)


def view(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "orders").where("o_orderstatus = 'P'").createOrReplaceTempView("tessera_pending")
    return s.sql("SELECT o_custkey, count(*) AS n FROM tessera_pending GROUP BY o_custkey")


def materialized(s: SparkSession, d: str) -> DataFrame:
    kept = MaterializedView(s, folder(s), lambda: sql(s, d, "SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY o_orderpriority"))
    kept.refresh()
    return kept.read()


def catalog_tables(s: SparkSession, d: str) -> DataFrame:
    """information_schema.columns of all tables of the folder."""
    kinds = {"bigint": "bigint", "int": "integer", "string": "text", "double": "double precision", "float": "real", "timestamp_ntz": "timestamp without time zone", "timestamp": "timestamp without time zone", "date": "date", "boolean": "boolean"}
    rows = [(t, f.name, k, kinds.get(f.dataType.simpleString(), "ARRAY" if f.dataType.typeName() == "array" else "USER-DEFINED")) for t in TABLES for k, f in enumerate(table(s, d, t).schema, 1)]
    return s.createDataFrame(rows, "table_name string, column_name string, ordinal_position long, data_type string")


def copied_lines(s: SparkSession, d: str) -> DataFrame:
    """COPY TO, as lines of text."""
    path = folder(s)
    copy_to(table(s, d, "nation").selectExpr("n_nationkey", "nullif(n_name, 'CHINA') AS n_name", "n_regionkey"), path, delimiter="|", header=False)
    return s.read.text(path).withColumnRenamed("value", "line")


def streamed_changes(s: SparkSession, d: str) -> DataFrame:
    """Orders as a change log in four files, polled one a micro-batch in any order: the table's state is what each key's latest change says."""
    path = folder(s)
    log = table(s, d, "orders").selectExpr("CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'U' ELSE 'I' END AS op", "o_orderkey AS seq", "o_custkey AS c_custkey", "o_totalprice AS c_acctbal")
    log.repartition(4).write.parquet(f"{path}/log")
    at = {"now": f"{path}/v-start"}
    table(s, d, "customer").selectExpr("'I' AS op", "-1L AS seq", "c_custkey", "c_acctbal").write.parquet(at["now"])

    def save(df: DataFrame, number: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/v{number}")
        at["now"] = f"{path}/v{number}"

    stream = changelog.changes(s, f"{path}/log", log.schema, per_poll=1)
    changelog.follow(stream, lambda: s.read.parquet(at["now"]), save, ["c_custkey"], f"{path}/slot").awaitTermination()
    return s.read.parquet(at["now"]).where("op <> 'D'").select("c_custkey", "c_acctbal")


def windowed_counts(s: SparkSession, d: str) -> DataFrame:
    """Events as a stream, counted by hour and type; windows are final once the watermark has passed them."""
    path = folder(s)
    table(s, d, "events").repartition(3).write.parquet(f"{path}/in")
    stream = s.readStream.schema(table(s, d, "events").schema).parquet(f"{path}/in")
    name = f"tessera_counts_{uuid.uuid4().hex}"
    changelog.windowed(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return s.table(name).selectExpr("CAST(window.start AS TIMESTAMP_NTZ) AS start", "event_type", "n", "round(total, 4) AS total")


def decoded_changes(s: SparkSession, d: str) -> DataFrame:
    log = table(s, d, "nation").selectExpr("'I' AS op", "CAST(n_nationkey AS BIGINT) AS seq", "n_name")
    return changelog.decoded(log, "nation")


def sql_function(s: SparkSession, d: str) -> DataFrame:
    s.sql("CREATE OR REPLACE TEMPORARY FUNCTION tessera_net(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return sql(s, d, "SELECT l_orderkey, l_partkey, l_linenumber, tessera_net(l_extendedprice, l_discount) AS net FROM {lineitem}")


def registered(s: SparkSession, d: str) -> DataFrame:
    functions.register(s)
    return sql(s, d, "SELECT p_partkey, pg_gcd(p_size, p_partkey) AS g, pg_substr_count(p_name, 'r') AS n, pg_quote_literal(p_name) AS q FROM {part}")


def located(s: SparkSession, d: str, name: str, text: str) -> str:
    """A table made of a query (CREATE TABLE AS), in a schema of its own; its files lie in the shared folder."""
    path = folder(s)
    s.sql(f"CREATE DATABASE IF NOT EXISTS tessera_work LOCATION '{path}/db'")
    s.sql(f"DROP TABLE IF EXISTS tessera_work.{name}")
    sql(s, d, text).write.option("path", f"{path}/{name}").saveAsTable(f"tessera_work.{name}")
    return f"tessera_work.{name}"


def created(s: SparkSession, d: str) -> DataFrame:
    return s.table(located(s, d, "big_orders", "SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000"))


def base(s: SparkSession, d: str, *names: str) -> Database:
    """A database with some of the folder's tables."""
    db = Database(s, folder(s))
    for name in names:
        db.create(name, table(s, d, name))
    return db


def truncated(s: SparkSession, d: str) -> DataFrame:
    """A table emptied, then filled again from another; one dropped and made anew."""
    db = base(s, d, "nation", "supplier", "region")
    db.script("TRUNCATE TABLE nation; INSERT INTO nation (n_nationkey, n_name) SELECT s_suppkey, s_name FROM supplier")
    db.script("DROP TABLE region; DROP TABLE IF EXISTS region; CREATE TABLE region AS SELECT count(*) AS n FROM nation")
    return db.sql("SELECT n_nationkey, n_name, n_regionkey, n FROM nation, region")


def secured(s: SparkSession, d: str) -> DataFrame:
    """Policies decide which rows SELECT, UPDATE and DELETE reach."""
    db = base(s, d, "customer")
    db.script("""
        CREATE POLICY builders ON customer FOR SELECT USING (c_mktsegment = 'BUILDING');
        CREATE POLICY owners ON customer FOR ALL USING (c_acctbal > 9000);
        CREATE POLICY poor ON customer FOR UPDATE USING (c_acctbal < 0);
        ALTER TABLE customer ENABLE ROW LEVEL SECURITY;
        UPDATE customer SET c_name = 'seen';
        DROP POLICY poor ON customer
    """)
    return db.sql("SELECT c_custkey, c_name, c_mktsegment FROM customer")


def triggered(s: SparkSession, d: str) -> DataFrame:
    """Row triggers over a whole table: one changes and rejects rows before they are inserted, one logs them after."""
    db = base(s, d)
    db.script("""
        CREATE TABLE parts (p_partkey BIGINT PRIMARY KEY, p_name TEXT, p_size INT);
        CREATE TABLE audit (n SERIAL, what TEXT, k BIGINT);
        CREATE FUNCTION tidy() RETURNS TRIGGER LANGUAGE plpgsql AS $$
        BEGIN
            IF NEW.p_size > 40 THEN RETURN NULL; END IF;
            IF NEW.p_size % 2 = 0 THEN NEW.p_name := upper(NEW.p_name); ELSE NEW.p_size := NEW.p_size * 10; END IF;
            RETURN NEW;
        END $$;
        CREATE TRIGGER tidy BEFORE INSERT ON parts FOR EACH ROW EXECUTE FUNCTION tidy();
        CREATE FUNCTION note() RETURNS TRIGGER LANGUAGE plpgsql AS $$ BEGIN INSERT INTO audit(what, k) VALUES (lower(TG_OP), NEW.p_partkey); RETURN NEW; END $$;
        CREATE TRIGGER note AFTER INSERT ON parts FOR EACH ROW EXECUTE FUNCTION note()
    """)
    db.insert("parts", table(s, d, "part").select("p_partkey", "p_name", "p_size"))
    return db.sql("SELECT p_partkey, p_name, p_size, what FROM parts JOIN audit ON p_partkey = k")


def row_function(s: SparkSession, d: str) -> DataFrame:
    """A procedural function over a whole table: its branches become one expression."""
    db = base(s, d, "part")
    db.sql("""CREATE FUNCTION grade(n INTEGER, name TEXT) RETURNS TEXT LANGUAGE plpgsql IMMUTABLE AS $$
        DECLARE r TEXT := 'small';
        BEGIN
            IF n > 30 THEN r := 'large'; ELSIF n > 10 THEN r := 'medium'; END IF;
            IF name LIKE '%ring%' THEN RETURN r || ' ring'; END IF;
            RETURN r;
        END $$""")
    return db.sql("SELECT p_partkey, grade(p_size, p_name) AS grade FROM part")


def procedures(s: SparkSession, d: str) -> DataFrame:
    """A block and a procedure: loops over a range and over rows, an exception caught, statements with variables."""
    db = base(s, d, "region", "nation")
    db.sql("CREATE TABLE found (r_name TEXT, n BIGINT, note TEXT)")
    db.sql("""CREATE PROCEDURE count_nations(least INTEGER) LANGUAGE plpgsql AS $$
        DECLARE r RECORD; many BIGINT;
        BEGIN
            FOR r IN SELECT r_regionkey, r_name FROM region WHERE r_regionkey >= least ORDER BY r_regionkey LOOP
                SELECT count(*) INTO many FROM nation WHERE n_regionkey = r.r_regionkey;
                INSERT INTO found VALUES (r.r_name, many, 'called');
            END LOOP;
        END $$""")
    db.sql("CALL count_nations(2)")
    db.sql("""DO $$
        DECLARE total BIGINT := 0;
        BEGIN
            FOR k IN 1..10 LOOP CONTINUE WHEN k % 2 = 1; total := total + k; EXIT WHEN k >= 8; END LOOP;
            BEGIN total := total / 0; EXCEPTION WHEN division_by_zero THEN INSERT INTO found VALUES ('caught', total, SQLSTATE); END;
        END $$""")
    return db.table("found")


def slots(s: SparkSession, d: str) -> DataFrame:
    """Changes polled through a slot three at a time, until there are none."""
    db = base(s, d, "nation", "region", "supplier")
    db.create_slot("reader")
    db.slots["reader"].tables = ["nation"]
    db.script("BEGIN; INSERT INTO nation SELECT s_suppkey + 1000, s_name, 0 FROM supplier; UPDATE region SET r_name = lower(r_name); UPDATE nation SET n_name = lower(n_name) WHERE n_regionkey = 1; COMMIT; DELETE FROM nation WHERE n_nationkey >= 1000")
    rows, poll = [], 0
    while changes := db.poll("reader", 3):
        poll += 1
        rows += [(poll, operation, name, df.count() if df is not None else 0) for _, operation, name, df in changes]
        db.advance("reader", changes[-1][0])
    return s.createDataFrame(rows, "poll long, op string, table_name string, n long")


def transactions(s: SparkSession, d: str) -> DataFrame:
    """Rolled-back changes leave nothing, those before a savepoint stay."""
    db = base(s, d, "supplier")
    db.script("BEGIN; DELETE FROM supplier WHERE s_nationkey < 5; SAVEPOINT a; DELETE FROM supplier; ROLLBACK TO a; COMMIT; BEGIN; UPDATE supplier SET s_name = 'x'; ROLLBACK")
    return db.sql("SELECT s_suppkey, s_name FROM supplier")


def backed_up(s: SparkSession, d: str) -> DataFrame:
    db, path = base(s, d, "customer"), folder(s)
    db.backup(path)
    db.script("DELETE FROM customer WHERE c_acctbal > 0; UPDATE customer SET c_name = 'x'")
    db.restore(path)
    return db.sql("SELECT c_custkey, c_name, c_acctbal FROM customer")


def indexed(s: SparkSession, d: str) -> DataFrame:
    """A lookup through an index: a sorted copy whose files and pages without the value are skipped."""
    db = base(s, d, "orders")
    db.script("CREATE INDEX CONCURRENTLY by_customer ON orders (o_custkey); CREATE UNIQUE INDEX by_key ON orders (o_orderkey); DROP INDEX by_key")
    return db.lookup("orders", o_custkey=77).select("o_orderkey", "o_totalprice")


def databases(s: SparkSession, d: str) -> DataFrame:
    """A schema made, used and dropped with its table."""
    name = f"tessera_{uuid.uuid4().hex[:8]}"
    s.sql(f"CREATE DATABASE {name} LOCATION '{folder(s)}/db'")
    sql(s, d, "SELECT * FROM {region}").write.saveAsTable(f"{name}.r")
    n = s.table(f"{name}.r").count()
    s.sql(f"DROP DATABASE {name} CASCADE")
    return s.createDataFrame([(n, s.catalog.databaseExists(name))], "n long, still_there boolean")


def views_dropped(s: SparkSession, d: str) -> DataFrame:
    """A view replaced and dropped, a materialized view that keeps its rows until it is refreshed."""
    db = base(s, d, "nation")
    db.spark.sql("CREATE OR REPLACE TEMPORARY VIEW few AS SELECT * FROM nation WHERE n_regionkey = 1")
    kept = MaterializedView(db.spark, folder(s), lambda: db.sql("SELECT count(*) AS n FROM few"))
    before = kept.read().first().n
    db.sql("DELETE FROM nation WHERE n_nationkey = 1")
    db.spark.sql("CREATE OR REPLACE TEMPORARY VIEW few AS SELECT * FROM nation WHERE n_regionkey = 1")
    stale = kept.read().first().n
    kept.refresh()
    after = kept.read().first().n
    db.spark.catalog.dropTempView("few")
    kept.drop()
    return s.createDataFrame([(before, stale, after, db.spark.catalog.tableExists("few"))], "n_before long, n_stale long, n_after long, still_there boolean")


def fetched(s: SparkSession, d: str) -> DataFrame:
    """DECLARE, FETCH 100, MOVE 50, FETCH 25."""
    cursor = Cursor(sql(s, d, "SELECT o_orderkey FROM {orders} ORDER BY o_orderkey"))
    rows = [(1, r.o_orderkey) for r in cursor.fetch(100)]
    cursor.move(50)
    return s.createDataFrame(rows + [(2, r.o_orderkey) for r in cursor.fetch(25)], "fetch long, o_orderkey long")


def prepared(s: SparkSession, d: str) -> DataFrame:
    """One statement, run with several values."""
    table(s, d, "orders").createOrReplaceTempView("tessera_orders")
    q = Prepared(s, "SELECT o_orderkey, o_custkey FROM tessera_orders WHERE o_custkey = :who AND o_totalprice > :least")
    return q.execute(who=77, least=1000).unionByName(q.execute(who=10, least=0)).unionByName(q.execute(who=5, least=1e12))


def numbered(s: SparkSession, d: str) -> DataFrame:
    """nextval for each row in an order, counted by ranges; then once more from where that ended."""
    sequence = Sequence(100)
    first = sequence.number(table(s, d, "orders").select("o_orderkey"), [F.col("o_orderkey")])
    second = sequence.number(table(s, d, "nation").selectExpr("-n_nationkey AS o_orderkey"), [F.col("o_orderkey").desc()])
    return first.unionByName(second)


def privileged(s: SparkSession, d: str) -> DataFrame:
    """What a role may do, by grants to it, to a role it is a member of, and to everyone; what is refused raises."""
    db, rows = base(s, d, "nation", "region"), []
    db.script("CREATE ROLE reader; CREATE ROLE clerk; GRANT SELECT, DELETE ON nation TO reader; GRANT reader TO clerk; GRANT SELECT ON region TO public; SET ROLE clerk")
    for text in ("SELECT * FROM nation", "SELECT * FROM region", "DELETE FROM nation WHERE n_regionkey = 1", "UPDATE nation SET n_regionkey = 0", "DELETE FROM region", "DROP TABLE nation"):
        try:
            found = db.sql(text)
            rows.append((text, True, found.count() if found is not None else None))
        except Exception:
            rows.append((text, False, None))
    db.sql("RESET ROLE")
    return s.createDataFrame([*rows, ("left", True, db.table("nation").count())], "statement string, allowed boolean, n long")


def notified(s: SparkSession, d: str) -> DataFrame:
    """Messages to those that listen; of a transaction those that it committed, each once."""
    db = base(s, d, "region")
    db.script("LISTEN changes; NOTIFY changes, 'first'; NOTIFY other, 'unheard'; BEGIN; NOTIFY changes, 'second'; NOTIFY changes, 'second'; ROLLBACK; BEGIN; NOTIFY changes, 'third'; NOTIFY changes, 'third'; COMMIT")
    for r in db.sql("SELECT r_name FROM region ORDER BY r_regionkey").collect():
        db.notify("changes", r.r_name)
    return s.createDataFrame([(k, *x) for k, x in enumerate(db.heard_since(), 1)], "place long, channel string, payload string")


def shown(s: SparkSession, d: str) -> DataFrame:
    """SHOW table_stats after an insert."""
    db = base(s, d, "nation", "region", "supplier")
    db.sql("INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation")
    return db.sql("SHOW table_stats")


def stored_objects(s: SparkSession, d: str) -> DataFrame:
    """Rows as objects of a store, listed by a prefix and read back."""
    store = ObjectStore(s, folder(s))
    for r in table(s, d, "nation").select("n_nationkey", "n_name", "n_regionkey").collect():
        store.put(f"region-{r.n_regionkey}/{r.n_nationkey}", r.n_name.encode())
    store.delete("region-1/1")
    return s.createDataFrame([(name, store.get(name).decode(), store.size(name)) for name in store.list("region-1/")], "name string, content string, size long")


def unknown_statement(s: SparkSession, d: str) -> DataFrame:
    """What no part of the engine knows raises instead of passing silently."""
    db, rows = base(s, d), []
    for text in ("CREATE EXTENSION x", "FROBNICATE the table", "ALTER SYSTEM SET x = 1"):
        try:
            db.sql(text)
            rows.append((text, False))
        except Exception:
            rows.append((text, True))
    return s.createDataFrame(rows, "statement string, raised boolean")


def explained(s: SparkSession, d: str) -> DataFrame:
    table(s, d, "lineitem").createOrReplaceTempView("tessera_lines")
    plan = s.sql("EXPLAIN FORMATTED SELECT l_partkey, sum(l_quantity) FROM tessera_lines GROUP BY l_partkey").first().plan
    tree = plan.split("\n\n")[0]
    return s.createDataFrame([("ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan, tree.count("HashAggregate (") == 2, tree.count("Exchange (") == 1)], "scans_two_columns boolean, aggregates_twice boolean, shuffles_once boolean")


def analyzed(s: SparkSession, d: str) -> DataFrame:
    name = located(s, d, "measured", "SELECT p_partkey, p_brand, p_size FROM {part}")
    s.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    return s.sql(f"DESCRIBE EXTENDED {name} p_size").where("info_name IN ('min', 'max', 'num_nulls')").select("info_name", "info_value")


def scripted(s: SparkSession, d: str) -> DataFrame:
    """A procedure with a loop and a branch, as an SQL script."""
    return s.sql("BEGIN DECLARE n INT = 0; DECLARE total BIGINT = 0; WHILE n < 10 DO SET n = n + 1; IF n % 2 = 0 THEN SET total = total + n; END IF; END WHILE; SELECT n, total; END")


def grouped_function(s: SparkSession, d: str) -> DataFrame:
    """An aggregate of one's own: groups come as Arrow batches."""
    spread = F.pandas_udf(lambda v: float(v.max() - v.min()), "double", F.PandasUDFType.GROUPED_AGG)
    return table(s, d, "part").groupBy("p_type").agg(F.round(spread("p_retailprice"), 4).alias("spread"))


def table_function(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.functions import udtf

    @udtf(returnType="word string, place int")
    class Words:
        def eval(self, text: str):
            yield from ((w, k) for k, w in enumerate(text.split(" "), 1))

    s.udtf.register("tessera_words", Words)
    return sql(s, d, "SELECT p_partkey, w.word, w.place FROM {part}, LATERAL tessera_words(p_name) w")


def enumerated(s: SparkSession, d: str) -> DataFrame:
    """Values outside the type raise; with one of them allowed no more, those rows are told apart first."""
    from tessera.operators.changes import checked

    rows = table(s, d, "orders").select("o_orderkey", "o_orderstatus")
    try:
        checked(rows, status=F.col("o_orderstatus").isin("F", "O")).write.format("noop").mode("overwrite").save()
        raised = False
    except Exception:
        raised = True
    return checked(rows.where("o_orderstatus <> 'P'"), status=F.col("o_orderstatus").isin("F", "O")).withColumn("raised", F.lit(raised))


_LOG = "WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders) WHERE k = 1)"
FRAMES = {
    "s_8_partition_pruned": (partition_pruned, "SELECT o_orderkey, o_totalprice FROM orders WHERE year(o_orderdate) = 1997"),
    "s_15_copy_from": (copy_round_trip, "SELECT * REPLACE (nullif(c_mktsegment, 'BUILDING') AS c_mktsegment) FROM customer"),
    "s_17_copy_query": (copy_query, "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey"),
    "s_18_lenient_import": (lenient_import, "SELECT c_custkey AS k, c_name FROM customer WHERE c_custkey % 2 = 0"),
    "s_19_dump_restore": (dump_restore("zstd"), "SELECT * FROM part"),
    "s_24_codec_lz4": (dump_restore("lz4"), "SELECT * FROM part"),
    "s_24_codec_none": (dump_restore("none"), "SELECT * FROM part"),
    "s_22_insert_select": (appended, "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation"),
    "s_23_catalog": (catalog_tables, f"SELECT table_name, column_name, CAST(ordinal_position AS BIGINT) AS ordinal_position, CASE WHEN data_type LIKE '%[]' THEN 'ARRAY' WHEN data_type LIKE 'TIMESTAMP%' THEN 'timestamp without time zone' WHEN data_type = 'VARCHAR' THEN 'text' WHEN data_type = 'DOUBLE' THEN 'double precision' WHEN data_type = 'FLOAT' THEN 'real' ELSE lower(data_type) END AS data_type FROM information_schema.columns WHERE table_name IN ({', '.join(repr(t) for t in TABLES)})"),
    "s_16_copy_to": (copied_lines, "SELECT n_nationkey || '|' || CASE n_name WHEN 'CHINA' THEN '\\N' ELSE n_name END || '|' || n_regionkey AS line FROM nation"),
    "q_7_view": (view, "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey"),
    "q_8_materialized_view": (materialized, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority"),
    "t_3_streamed_changes": (streamed_changes, f"{_LOG} SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM l) UNION ALL SELECT o_custkey, o_totalprice FROM l WHERE o_orderstatus <> 'F'"),
    "t_4_decoded_changes": (decoded_changes, "SELECT n_nationkey::BIGINT AS seq, 'table nation: INSERT: n_name:' || n_name AS line FROM nation"),
    "f_1_sql_function": (sql_function, "SELECT l_orderkey, l_partkey, l_linenumber, l_extendedprice * (1 - l_discount) AS net FROM lineitem"),
    "s_21_create_as": (created, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 200000"),
    "d_3_truncate": (truncated, "SELECT s_suppkey AS n_nationkey, s_name AS n_name, CAST(NULL AS BIGINT) AS n_regionkey, (SELECT count(*) FROM supplier) AS n FROM supplier"),
    "d_8_enum": (enumerated, "SELECT o_orderkey, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') > 0 AS raised FROM orders WHERE o_orderstatus <> 'P'"),
    "d_14_explain": (explained, "SELECT true AS scans_two_columns, true AS aggregates_twice, true AS shuffles_once"),
    "d_1_database": (databases, "SELECT count(*) AS n, false AS still_there FROM region"),
    "d_5_index": (indexed, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 77"),
    "d_6_views": (views_dropped, "SELECT count(*) AS n_before, count(*) AS n_stale, count(*) FILTER (WHERE n_nationkey <> 1) AS n_after, false AS still_there FROM nation WHERE n_regionkey = 1"),
    "d_7_sequence": (numbered, "SELECT o_orderkey, 99 + row_number() OVER (ORDER BY o_orderkey) AS id FROM orders UNION ALL SELECT -n_nationkey, 99 + (SELECT count(*) FROM orders) + row_number() OVER (ORDER BY n_nationkey) FROM nation"),
    "d_16_row_policy": (secured, "SELECT c_custkey, CASE WHEN c_acctbal > 9000 OR c_acctbal < 0 THEN 'seen' ELSE c_name END AS c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal > 9000"),
    "d_17_roles": (privileged, "SELECT * FROM (VALUES ('SELECT * FROM nation', true, (SELECT count(*) FROM nation)), ('SELECT * FROM region', true, (SELECT count(*) FROM region)), ('DELETE FROM nation WHERE n_regionkey = 1', true, NULL), ('UPDATE nation SET n_regionkey = 0', false, NULL), ('DELETE FROM region', false, NULL), ('DROP TABLE nation', false, NULL), ('left', true, (SELECT count(*) FROM nation WHERE n_regionkey <> 1))) AS x(statement, allowed, n)"),
    "d_20_show": (shown, "SELECT 'nation' AS table_name, count(*) AS row_count, CAST(3 AS BIGINT) AS column_count, CAST(1 AS BIGINT) AS folders FROM nation UNION ALL SELECT 'region', (SELECT count(*) FROM region) + (SELECT count(*) FROM nation), 2, 2 UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), (SELECT count(*) FROM information_schema.columns WHERE table_name = 'supplier'), 1"),
    "t_7_notify": (notified, "SELECT * FROM (VALUES (1, 'changes', 'first'), (2, 'changes', 'third')) AS x(place, channel, payload) UNION ALL SELECT 2 + row_number() OVER (ORDER BY r_regionkey), 'changes', r_name FROM region"),
    "s_20_objects": (stored_objects, "SELECT 'region-1/' || n_nationkey AS name, n_name AS content, length(n_name) AS size FROM nation WHERE n_regionkey = 1 AND n_nationkey <> 1"),
    "d_18_transactions": (transactions, "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey >= 5"),
    "d_19_backup": (backed_up, "SELECT c_custkey, c_name, c_acctbal FROM customer"),
    "d_22_unknown": (unknown_statement, "SELECT unnest(['CREATE EXTENSION x', 'FROBNICATE the table', 'ALTER SYSTEM SET x = 1']) AS statement, true AS raised"),
    "f_2_row_function": (row_function, "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 THEN 'medium' ELSE 'small' END || CASE WHEN p_name LIKE '%ring%' THEN ' ring' ELSE '' END AS grade FROM part"),
    "f_3_block": (procedures, "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n, 'called' AS note FROM region WHERE r_regionkey >= 2 UNION ALL SELECT 'caught', 20, 'division_by_zero'"),
    "f_4_call": (procedures, "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n, 'called' AS note FROM region WHERE r_regionkey >= 2 UNION ALL SELECT 'caught', 20, 'division_by_zero'"),
    "f_5_triggers": (triggered, "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS p_name, CAST(CASE WHEN p_size % 2 = 0 THEN p_size ELSE p_size * 10 END AS INT) AS p_size, 'insert' AS what FROM part WHERE p_size <= 40"),
    "f_8_prepared": (prepared, "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 77 AND o_totalprice > 1000 OR o_custkey = 10 AND o_totalprice > 0"),
    "t_2_slots": (slots, "SELECT * FROM (VALUES (1, 'BEGIN', '', 0), (1, 'INSERT', 'nation', (SELECT count(*) FROM supplier)), (1, 'UPDATE', 'nation', (SELECT count(*) FROM nation WHERE n_regionkey = 1)), (2, 'COMMIT', '', 0), (2, 'DELETE', 'nation', (SELECT count(*) FROM supplier))) AS x(poll, op, table_name, n)"),
    "t_6_cursor": (fetched, "SELECT CASE WHEN k <= 100 THEN 1 ELSE 2 END AS fetch, o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 100 OR k BETWEEN 151 AND 175"),
    "x_window_stream": (windowed_counts, "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"),
    "d_15_analyze": (analyzed, "SELECT 'num_nulls' AS info_name, '0' AS info_value UNION ALL SELECT 'min', CAST(min(p_size) AS VARCHAR) FROM part UNION ALL SELECT 'max', CAST(max(p_size) AS VARCHAR) FROM part"),
    "f_2_script": (scripted, "SELECT 10 AS n, 30 AS total"),
    "f_6_aggregate_function": (grouped_function, "SELECT p_type, round(max(p_retailprice) - min(p_retailprice), 4) AS spread FROM part GROUP BY p_type"),
    "f_7_table_function": (table_function, "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS place FROM part"),
    "f_1_registered": (registered, "SELECT p_partkey, CAST(gcd(p_size, p_partkey) AS BIGINT) AS g, length(p_name) - length(replace(p_name, 'r', '')) AS n, '''' || p_name || '''' AS q FROM part"),
}


def queries():
    return {name: f for name, (f, _) in FRAMES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q for name, (_, q) in FRAMES.items() if q}
