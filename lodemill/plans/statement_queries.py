"""Queries that define, change and read tables of a database of their own: schema, constraints, foreign keys, views,
transactions, documents, files. What a statement refuses is a row that names the kind of error."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemill import errors
from lodemill.database import Database, open_database
from lodemill.functions import values as v
from lodemill.operators.filters import filters_to_column
from lodemill.sources import textio
from lodemill.sources.scratch import shared_root

Query = tuple[Callable[[SparkSession, str], DataFrame], str]


def own_root(spark: SparkSession) -> str:
    return f"{shared_root(spark).removeprefix('file://').removeprefix('file:')}/db-{uuid.uuid4().hex}"


def with_tables(spark: SparkSession, sf_dir: str, *tables: str) -> Database:
    """A database that holds the tables named, filled in the order of their first column."""
    db = open_database(spark, own_root(spark))
    for name in tables:
        rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        with db.change() as state:
            db.insert_frame(state, name, rows.coalesce(1).sortWithinPartitions(rows.columns[0]), rows.columns)
    return db


def outcome(run: Callable[[], object]) -> str:
    try:
        run()
    except errors.LodemillError as e:
        return type(e).__name__
    return "ok"


def told(spark: SparkSession, rows: Iterable[tuple[str, object]]) -> DataFrame:
    return spark.createDataFrame([(a, str(b)) for a, b in rows], "what string, result string")


def told_sql(*rows: tuple[str, object]) -> str:
    return f"SELECT * FROM (VALUES {', '.join(f"('{a}', '{b}')" for a, b in rows)}) AS t(what, result)"


def statements(tables: tuple[str, ...], *sql: str) -> Callable[[SparkSession, str], DataFrame]:
    """Run all statements; the last is the result."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = with_tables(spark, sf_dir, *tables)
        for s in sql[:-1]:
            db.exec_sql(s)
        return db.exec_sql(sql[-1]).rows

    return run


def attempts(tables: tuple[str, ...], setup: tuple[str, ...], tried: dict[str, str]) -> Callable[[SparkSession, str], DataFrame]:
    """The outcome of each statement tried, after the setup."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = with_tables(spark, sf_dir, *tables)
        for s in setup:
            db.exec_sql(s)
        return told(spark, [(what, outcome(lambda s=s: db.exec_sql(s))) for what, s in tried.items()])

    return run


NATION, REGION, SUPPLIER = ("nation",), ("region",), ("supplier",)
_TYPED = "CREATE TABLE t (k INT UNIQUE, name TEXT NOT NULL, kind TEXT DEFAULT 'plain', w FLOAT DEFAULT 1.5)"
_FILL = "INSERT INTO t (k, name) SELECT n_nationkey, n_name FROM nation"


def failed_alter(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "nation")
    db.exec_sql("INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (900, '12', 0)")
    said = outcome(lambda: db.exec_sql("ALTER TABLE nation ALTER COLUMN n_name TYPE INT"))
    return db.exec_sql("SELECT n_nationkey, n_name FROM nation").rows.withColumn("said", F.lit(said))


def schema_of_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "nation")
    db.exec_sql("CREATE TABLE t (k INT PRIMARY KEY, name TEXT NOT NULL, w FLOAT DEFAULT 2.5, ok BOOL INDEX, data BLOB)")
    return told(spark, [(line.split(" ")[0], line) for line in v.schema_lines(db.get_schema("t"))])


def tables_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "region", "nation")
    db.exec_sql("CREATE TABLE more (x INT)")
    db.exec_sql("DROP TABLE nation")
    db.exec_sql("DROP TABLE nation")
    return told(spark, [("tables", ",".join(db.list_tables())), ("more", db.table_exists("more")), ("nation", db.table_exists("nation"))])


def find_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "supplier")
    return db.find("supplier", ["s_acctbal__gt=0"], order_by="s_acctbal", ascending=False, limit=7, offset=3).select("s_suppkey", "s_acctbal")


def documents_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adds, a batch, point reads, first matches and counts."""
    db = with_tables(spark, sf_dir, "region")
    first = db.add("region", {"r_regionkey": 50, "r_name": "fifty"})
    n = db.batch_import("region", [{"r_regionkey": 51, "r_name": "x"}, {"r_regionkey": 52, "r_name": "y", "note": "new column"}])
    refused = outcome(lambda: db.add("region", {"r_regionkey": -1}, validator=lambda row: row["r_regionkey"] >= 0))
    taken = outcome(lambda: db.add("region", {"r_regionkey": 53}, validator=lambda row: row["r_regionkey"] >= 0))
    by_id, one = db.find_by_id("region", 2), db.find_one("region", ["note__isnotnull"])
    return told(
        spark,
        [
            ("id", first), ("batch", n), ("refused", refused), ("taken", taken), ("by id", by_id["r_name"]), ("no id", db.find_by_id("region", 999)), ("one", one["r_regionkey"]),
            ("none", db.find_one("region", ["r_regionkey=77"])), ("count", db.count("region")), ("counted", db.count("region", ["r_regionkey__gte=50"])),
            ("updated", db.update("region", ["r_regionkey__gt=50"], {"r_name": "z"})), ("deleted", db.delete("region", ["r_name=z"])), ("left", db.count("region")),
        ],
    )


def nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey", F.struct(F.col("n_name").alias("name"), F.struct(F.col("n_regionkey").alias("key")).alias("region")).alias("who"), F.col("n_name").alias("who.name")
    )


def dot_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column of the exact name comes before a path."""
    df = nested(spark, sf_dir).withColumn("who.name", F.upper("`who.name`"))
    return df.filter(filters_to_column(df.schema, ["who.region.key__gte=2", "who.name__contains=_1", "OR:who.region.key=0"])).select("n_nationkey", F.col("who.region.key").alias("region"))


def nested_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays and objects built from rows, stored, read back and grouped by equality and order."""
    df = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.array((F.col("s_suppkey") % 3).alias("a"), (F.col("s_suppkey") % 2).alias("b")).alias("list"), F.struct((F.col("s_suppkey") % 2).alias("odd")).alias("object")
    )
    db = open_database(spark, own_root(spark))
    with db.change() as state:
        db.insert_frame(state, "t", df, df.columns)
    found = db.table("t").groupBy("list", "object").count()
    return found.filter(F.col("list") > F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).select(F.array_join("list", "-").alias("list"), F.col("object.odd").alias("odd"), F.col("count").alias("n"))


def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = open_database(spark, own_root(spark))
    db.add("t", {"n": 3, "x": 0.5, "ok": True, "s": "text", "data": b"\x01\x02", "tags": ["p", "q"], "place": {"city": "Ulm", "zip": {"code": 89}}})
    row = db.find_one("t")
    widened = v.get_float(row, "n")
    return told(
        spark,
        [
            ("int", v.get_int(row, "n")), ("widened", widened), ("float", v.get_float(row, "x")), ("bool", v.get_bool(row, "ok")), ("text", v.get_text(row, "s")), ("blob", v.get_blob(row, "data").hex()),
            ("array", len(v.get_array(row, "tags"))), ("path", v.get_int(row, "place.zip.code")), ("object", v.as_text(v.get_object(row, "place"))), ("wrong", outcome(lambda: v.get_int(row, "x"))),
            ("missing", outcome(lambda: v.get(row, "place.street"))), ("line", v.as_text({k: row[k] for k in ("n", "ok", "tags", "data")})),
            ("order", [v.compare(None, False), v.compare(2, 2.0), v.compare("a", "b"), v.compare([1, [2]], [1, [1, 5]]), v.compare({"a": 1, "b": 2}, {"b": 2, "a": 1})]),
        ],
    )


def read_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "region")
    seen = open_database(spark, db.catalog.root, read_only=True)
    return told(
        spark,
        [
            ("read", seen.count("region")), ("add", outcome(lambda: seen.add("region", {"r_regionkey": 9}))), ("sql", outcome(lambda: seen.exec_sql("DELETE FROM region"))),
            ("missing", outcome(lambda: open_database(spark, own_root(spark), read_only=True))), ("still", seen.count("region")),
        ],
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poisoned, nested and misplaced transaction statements, close, and what a crash leaves."""
    db = with_tables(spark, sf_dir, "region")
    run, said = db.exec_sql, []
    tell = lambda what, sql: said.append((what, outcome(lambda: run(sql))))
    tell("commit without", "COMMIT")
    run("CREATE TABLE u (k INT UNIQUE)")
    run("BEGIN")
    tell("nested", "BEGIN TRANSACTION")
    tell("ddl", "CREATE TABLE x (k INT)")
    run("INSERT INTO u (k) VALUES (1)")
    run("SAVEPOINT a")
    run("INSERT INTO u (k) VALUES (2)")
    run("SAVEPOINT b")
    tell("twice", "INSERT INTO u (k) VALUES (2)")
    tell("poisoned", "INSERT INTO u (k) VALUES (3)")
    tell("commit poisoned", "COMMIT")
    tell("back", "ROLLBACK TO SAVEPOINT b")
    run("INSERT INTO u (k) VALUES (4)")
    tell("release", "RELEASE SAVEPOINT a")
    tell("released", "ROLLBACK TO b")
    run("COMMIT")
    said.append(("committed", db.count("u")))
    run("BEGIN")
    run("DELETE FROM region")
    db.close()
    said.append(("closed", db.count("region")))
    db.begin()
    run("DELETE FROM region")
    again = open_database(spark, db.catalog.root)  # the first one is gone, with its transaction open
    said.append(("recovered", again.count("region")))
    again.add("region", {"r_regionkey": 8})
    tell("lost race", "COMMIT")
    run("ROLLBACK")
    said.append(("kept", db.count("region")))
    return told(spark, said)


def locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second writer is refused while one writes, and what one writes no other sees before the manifest names it."""
    db = with_tables(spark, sf_dir, "region")
    other = open_database(spark, db.catalog.root)
    with db.change() as state:
        db.insert_rows(state, "region", [{"r_regionkey": 77}])
        said = [("writer", outcome(lambda: other.add("region", {"r_regionkey": 78}))), ("reader", other.count("region"))]
    return told(spark, [*said, ("after", other.count("region"))])


def statement_is_atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "nation")
    db.exec_sql("ALTER TABLE nation ALTER COLUMN n_nationkey SET UNIQUE")
    said = outcome(lambda: db.exec_sql("INSERT INTO nation (n_nationkey, n_name) VALUES (100, 'a'), (101, 'b'), (3, 'twice')"))
    return db.exec_sql("SELECT n_nationkey FROM nation").rows.withColumn("said", F.lit(said))


def storage(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "nation")
    db.exec_sql("UPDATE nation SET n_regionkey = 7 WHERE n_nationkey < 5")
    db.exec_sql("INSERT INTO nation (n_nationkey) VALUES (100)")
    before = db.stats("nation")
    db.compact("nation", keep_seconds=0)
    after = db.stats("nation")
    rows = [("files", before["files"]), ("garbage", before["garbage_bytes"] > 0 and 0 < before["fragmentation"] < 1), ("compacted", after["files"]), ("left", after["garbage_bytes"]), ("next", after["next_id"])]
    return told(spark, rows).unionByName(told(spark, [("rows", after["rows"])]))


def import_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file of key=value lines written from nation, with a comment, an empty line and bad lines."""
    folder = f"{own_root(spark)}-pairs"
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    lines = n.select(F.format_string("key=%d name=%s share=%s.5 even=%s", "n_nationkey", "n_name", F.col("n_regionkey").cast("string"), F.when(F.col("n_nationkey") % 2 == 0, "yes").otherwise("no")))
    lines.toDF("value").unionAll(spark.createDataFrame([("# a comment",), ("",), ("key=1 nothing",)], "value string")).write.text(folder)
    db = open_database(spark, own_root(spark))
    imported, bad = db.import_pairs("t", folder)
    return db.exec_sql("SELECT key, name, share, even FROM t").rows.withColumns({"imported": F.lit(imported).cast("long"), "bad": F.lit(bad).cast("long")})


def export_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{own_root(spark)}-csv"
    df = spark.read.parquet(f"{sf_dir}/nation.parquet").select(
        "n_nationkey", F.concat(F.col("n_name"), F.when(F.col("n_regionkey") == 1, ', "so"').otherwise("")).alias("name"), F.array("n_nationkey", "n_regionkey").alias("both"), F.struct("n_name").alias("o")
    )
    textio.write_csv(df.coalesce(1), folder)
    return spark.read.text(folder).select(F.col("value").alias("line"))


def export_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{own_root(spark)}-json"
    textio.write_json(nested(spark, sf_dir).drop("who.name").orderBy("n_nationkey"), folder, limit=10)
    return spark.read.text(folder).select(F.col("value").alias("line"))


def blob_from_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, data = f"{own_root(spark)}.bin", bytes(range(256)) * 4
    with open(path, "wb") as f:
        f.write(data)
    db = open_database(spark, own_root(spark))
    db.add("t", {"name": "all bytes", "data": textio.read_blob(path)})
    same = hashlib.sha256(data).hexdigest()
    return db.table("t").select("name", F.octet_length("data").cast("long").alias("n"), (F.sha2("data", 256) == same).alias("same"))


def printed(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "region")
    lines = v.row_lines(db.find("region", order_by="r_regionkey").select("r_regionkey", "r_name", F.lit(None).cast("string").alias("none")))
    return spark.createDataFrame([(x,) for x in lines], "line string")


def now(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "region")
    found = db.exec_sql("SELECT r_name, NOW() AS t FROM region").rows
    return found.select("r_name", (F.abs(F.col("t") - F.unix_timestamp()) < 120).alias("near"))


def indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index statements, and equality reads on the columns that they name."""
    db = with_tables(spark, sf_dir, "nation")
    said = [outcome(lambda s=s: db.exec_sql(s)) for s in ("CREATE INDEX ON nation (n_regionkey)", "CREATE INDEX both ON nation (n_regionkey, n_name)", "CREATE INDEX ON nation (n_name, n_regionkey)", "DROP INDEX ON nation (n_nationkey)")]
    one = db.exec_sql("SELECT n_nationkey FROM nation WHERE n_regionkey = 2").rows
    db.exec_sql("INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (70, 'NATION_X', 3)")
    two = db.find("nation", ["n_regionkey=3", "n_name=NATION_X"]).select("n_nationkey")
    db.exec_sql("DROP INDEX ON nation (n_name, n_regionkey)")
    return one.unionByName(two).withColumn("said", F.lit(",".join(said)))


def index_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "nation")
    db.exec_sql("CREATE INDEX ON nation (n_regionkey)")
    db.exec_sql("CREATE INDEX ON nation (n_regionkey, n_name)")
    db.exec_sql("INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (70, 'NATION_X', 3), (71, 'NATION_X', 3)")
    return told(spark, [("+".join(i["columns"]), [i["keys"], i["most"], i["rows"]]) for i in db.index_stats("nation")])


def shell_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands of the shell, and what it prints."""
    import contextlib
    import io

    from lodemill.__main__ import shell

    db, said = with_tables(spark, sf_dir, "region"), io.StringIO()
    with contextlib.redirect_stdout(said):
        shell(db, ["tables", "count region", "add region r_regionkey=9 r_name=more", "count region r_regionkey__gte=3", "update region r_regionkey=9 set r_name=less", "get region 99", "find nowhere", "delete region r_name=less", "drop region", "tables", "quit", "count region"])
    return told(spark, [(f"{i:02}", line) for i, line in enumerate(said.getvalue().splitlines())])


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = with_tables(spark, sf_dir, "region")
    said = []
    for sql in ("SELECT r_name FROM region", "SELECT nothing FROM region", "SELEC", "SELECT x FROM nowhere", "SELECT r_name FROM region"):
        outcome(lambda sql=sql: db.exec_sql(sql))
        said.append((f"{len(said)}", errors.last_status()))
    return told(spark, said)


_PARENTS = ("CREATE TABLE p (k INT UNIQUE, a INT, b INT)", "INSERT INTO p (k, a, b) SELECT n_nationkey, n_nationkey AS a, n_regionkey FROM nation WHERE n_nationkey < 10")
_CHILDREN = "INSERT INTO c (k, name) SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10"
_N10 = "FROM nation WHERE n_nationkey < 10"


def _fk(on: str, *after: str) -> Callable[[SparkSession, str], DataFrame]:
    return statements(NATION, *_PARENTS, f"CREATE TABLE c (k INT REFERENCES p(k) {on}, name TEXT)", _CHILDREN, *after, "SELECT k, name FROM c")


QUERIES: dict[str, Query] = {
    # schema
    "schema_create": (statements(NATION, _TYPED, _FILL, "SELECT k, name, kind, w FROM t"), "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name, 'plain' AS kind, CAST(1.5 AS DOUBLE) AS w FROM nation"),
    "schema_default_when_left_out": (
        statements(NATION, _TYPED, "INSERT INTO t (k, name, kind) VALUES (1, 'a', NULL), (2, 'b', 'own')", "INSERT INTO t (k, name) VALUES (3, 'c')", "SELECT k, kind, w FROM t"),
        "SELECT CAST(k AS BIGINT) AS k, kind, CAST(1.5 AS DOUBLE) AS w FROM (VALUES (1, NULL), (2, 'own'), (3, 'plain')) AS t(k, kind)",
    ),
    "schema_add_column": (
        statements(NATION, "ALTER TABLE nation ADD COLUMN tag TEXT DEFAULT 'new'", "INSERT INTO nation (n_nationkey) VALUES (99)", "SELECT n_nationkey, tag FROM nation"),
        "SELECT n_nationkey, CAST(NULL AS VARCHAR) AS tag FROM nation UNION ALL SELECT 99, 'new'",
    ),
    "schema_drop_column": (statements(NATION, "ALTER TABLE nation DROP COLUMN n_name", "SELECT * FROM nation"), "SELECT n_nationkey, n_regionkey FROM nation"),
    "schema_rename_column": (statements(NATION, "ALTER TABLE nation RENAME COLUMN n_name TO label", "SELECT n_nationkey, label FROM nation"), "SELECT n_nationkey, n_name AS label FROM nation"),
    "schema_rename_table": (statements(NATION, "ALTER TABLE nation RENAME TO lands", "SELECT n_nationkey FROM lands"), "SELECT n_nationkey FROM nation"),
    "schema_alter_type": (
        statements(NATION, "ALTER TABLE nation ALTER COLUMN n_nationkey TYPE TEXT", "ALTER TABLE nation ALTER COLUMN n_regionkey TYPE FLOAT", "SELECT n_nationkey, n_regionkey FROM nation"),
        "SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation",
    ),
    "schema_alter_type_all_or_nothing": (failed_alter, "SELECT n_nationkey, n_name, 'TypeMismatch' AS said FROM nation UNION ALL SELECT 900, '12', 'TypeMismatch'"),
    "schema_alter_flags": (
        attempts(
            NATION, ("ALTER TABLE nation ALTER COLUMN n_name SET NOT NULL", "ALTER TABLE nation ALTER COLUMN n_nationkey SET UNIQUE"),
            {
                "null": "INSERT INTO nation (n_nationkey) VALUES (91)", "twice": "INSERT INTO nation (n_nationkey, n_name) VALUES (3, 'x')", "not unique": "ALTER TABLE nation ALTER COLUMN n_regionkey SET UNIQUE",
                "drop": "ALTER TABLE nation ALTER COLUMN n_name DROP NOT NULL", "null now": "INSERT INTO nation (n_nationkey) VALUES (91)", "drop unique": "ALTER TABLE nation ALTER COLUMN n_nationkey DROP UNIQUE",
                "twice now": "INSERT INTO nation (n_nationkey) VALUES (91)", "has nulls": "ALTER TABLE nation ALTER COLUMN n_name SET NOT NULL",
            },
        ),
        told_sql(("null", "ConstraintViolation"), ("twice", "ConstraintViolation"), ("not unique", "ConstraintViolation"), ("drop", "ok"), ("null now", "ok"), ("drop unique", "ok"), ("twice now", "ok"), ("has nulls", "ConstraintViolation")),
    ),
    "schema_get": (schema_of_table, told_sql(("k", "k INT NOT NULL UNIQUE"), ("name", "name TEXT NOT NULL"), ("w", "w FLOAT DEFAULT 2.5"), ("ok", "ok BOOL INDEX"), ("data", "data BLOB"))),
    "schema_list_and_drop": (tables_listed, told_sql(("tables", "more,region"), ("more", True), ("nation", False))),
    "schema_managed_columns": (
        attempts(
            NATION, ("CREATE TABLE t (id INT, x INT, created_at INT)", "INSERT INTO t (id, x) VALUES (77, 1)"),
            {"skipped": "SELECT x FROM t WHERE id = 1", "add": "ALTER TABLE t ADD COLUMN updated_at INT", "rename": "ALTER TABLE t RENAME COLUMN x TO id", "set": "UPDATE t SET id = 5", "drop": "ALTER TABLE t DROP COLUMN id"},
        ),
        told_sql(("skipped", "ok"), ("add", "InvalidArgument"), ("rename", "AlreadyExists"), ("set", "InvalidArgument"), ("drop", "NotFound")),
    ),
    "schema_refusals": (
        attempts(
            NATION, ("CREATE TABLE t (x INT UNIQUE, y TEXT)", "CREATE TABLE u (x INT REFERENCES t(x))", "CREATE VIEW w AS SELECT x FROM t"),
            {
                "table": "CREATE TABLE t (x INT)", "column": "ALTER TABLE t ADD COLUMN y INT", "no table": "ALTER TABLE nope DROP COLUMN x", "no column": "ALTER TABLE t RENAME COLUMN q TO z", "referred": "ALTER TABLE t DROP COLUMN x",
                "view": "CREATE TABLE w (x INT)", "no view": "DROP VIEW nope", "bad view": "CREATE VIEW v AS SELECT nothing FROM nowhere", "default": "CREATE TABLE d (n INT DEFAULT 'oops')",
            },
        ),
        told_sql(("table", "AlreadyExists"), ("column", "AlreadyExists"), ("no table", "NotFound"), ("no column", "NotFound"), ("referred", "ConstraintViolation"), ("view", "AlreadyExists"), ("no view", "NotFound"), ("bad view", "NotFound"), ("default", "TypeMismatch")),
    ),
    "schema_indexes": (indexed, "SELECT n_nationkey, 'ok,ok,AlreadyExists,NotFound' AS said FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 70, 'ok,ok,AlreadyExists,NotFound'"),
    # constraints
    "constraint_insert": (
        attempts(
            NATION, ("CREATE TABLE t (k INT UNIQUE, name TEXT NOT NULL, n INT, CHECK (n >= 0))", "INSERT INTO t (k, name, n) VALUES (1, 'a', 0)"),
            {
                "null": "INSERT INTO t (k, n) VALUES (2, 1)", "twice": "INSERT INTO t (k, name) VALUES (1, 'b')", "both new": "INSERT INTO t (k, name) VALUES (5, 'b'), (5, 'c')", "check": "INSERT INTO t (k, name, n) VALUES (3, 'c', -1)",
                "null passes": "INSERT INTO t (k, name, n) VALUES (NULL, 'd', NULL), (NULL, 'e', 4)", "type": "INSERT INTO t (k, name) VALUES ('x', 'y')",
            },
        ),
        told_sql(("null", "ConstraintViolation"), ("twice", "ConstraintViolation"), ("both new", "ConstraintViolation"), ("check", "ConstraintViolation"), ("null passes", "ok"), ("type", "TypeMismatch")),
    ),
    "constraint_update": (
        attempts(
            NATION, ("CREATE TABLE t (k INT UNIQUE, name TEXT NOT NULL, n INT CHECK (n < 10))", "INSERT INTO t (k, name, n) VALUES (1, 'a', 0), (2, 'b', 5), (3, 'c', 9)"),
            {
                "null": "UPDATE t SET name = NULL WHERE k = 1", "collides": "UPDATE t SET k = 2 WHERE k = 1", "pairs": "UPDATE t SET k = 8 WHERE n > 1", "check": "UPDATE t SET n = 10 WHERE k = 3",
                "itself": "UPDATE t SET k = 2 WHERE k = 2", "fine": "UPDATE t SET k = 7, n = 1 WHERE k = 3",
            },
        ),
        told_sql(("null", "ConstraintViolation"), ("collides", "ConstraintViolation"), ("pairs", "ConstraintViolation"), ("check", "ConstraintViolation"), ("itself", "ok"), ("fine", "ok")),
    ),
    "constraint_added_later": (
        attempts(NATION, (), {"holds": "ALTER TABLE nation ADD CHECK (n_regionkey < 100)", "fails": "ALTER TABLE nation ADD CHECK (n_regionkey > 2)", "row": "INSERT INTO nation (n_nationkey, n_regionkey) VALUES (90, 100)"}),
        told_sql(("holds", "ok"), ("fails", "ConstraintViolation"), ("row", "ConstraintViolation")),
    ),
    "constraint_statement_is_atomic": (statement_is_atomic, "SELECT n_nationkey, 'ConstraintViolation' AS said FROM nation"),
    # foreign keys
    "fk_cascade_delete": (_fk("ON DELETE CASCADE", "DELETE FROM p WHERE b = 1"), f"SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name {_N10} AND n_regionkey <> 1"),
    "fk_set_null_delete": (_fk("ON DELETE SET NULL", "DELETE FROM p WHERE b = 1"), f"SELECT CASE WHEN n_regionkey <> 1 THEN CAST(n_nationkey AS BIGINT) END AS k, n_name AS name {_N10}"),
    "fk_cascade_update": (_fk("ON UPDATE CASCADE", "UPDATE p SET k = 400 WHERE k = 4"), f"SELECT CAST(CASE WHEN n_nationkey = 4 THEN 400 ELSE n_nationkey END AS BIGINT) AS k, n_name AS name {_N10}"),
    "fk_set_null_update": (_fk("ON UPDATE SET NULL", "UPDATE p SET k = 400 WHERE k = 4"), f"SELECT CASE WHEN n_nationkey <> 4 THEN CAST(n_nationkey AS BIGINT) END AS k, n_name AS name {_N10}"),
    "fk_restrict": (
        attempts(
            NATION, (*_PARENTS, "CREATE TABLE c (k INT REFERENCES p(k), name TEXT)", "INSERT INTO c (k, name) VALUES (3, 'x'), (NULL, 'none')"),
            {
                "no parent": "INSERT INTO c (k) VALUES (77)", "to no parent": "UPDATE c SET k = 78 WHERE k = 3", "delete": "DELETE FROM p WHERE k = 3", "update": "UPDATE p SET k = 30 WHERE k = 3", "other column": "UPDATE p SET a = 30 WHERE k = 3",
                "unreferred": "DELETE FROM p WHERE k = 4", "drop key": "ALTER TABLE c DROP FOREIGN KEY (k)", "delete now": "DELETE FROM p WHERE k = 3", "add key": "ALTER TABLE c ADD FOREIGN KEY (k) REFERENCES p(k)",
            },
        ),
        told_sql(("no parent", "ConstraintViolation"), ("to no parent", "ConstraintViolation"), ("delete", "ConstraintViolation"), ("update", "ConstraintViolation"), ("other column", "ok"), ("unreferred", "ok"), ("drop key", "ok"), ("delete now", "ok"), ("add key", "ConstraintViolation")),
    ),
    "fk_composite_match_simple": (
        attempts(
            NATION, (*_PARENTS, "CREATE TABLE c (x INT, y INT, FOREIGN KEY (x, y) REFERENCES p(a, b) ON DELETE CASCADE)", "INSERT INTO c (x, y) SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 5"),
            {"part null": "INSERT INTO c (x, y) VALUES (700, NULL), (NULL, NULL)", "no pair": "INSERT INTO c (x, y) VALUES (1, 700)", "cascade": "DELETE FROM p WHERE a = 2"},
        ),
        told_sql(("part null", "ok"), ("no pair", "ConstraintViolation"), ("cascade", "ok")),
    ),
    "fk_composite_cascade": (
        statements(
            NATION, *_PARENTS, "CREATE TABLE c (x INT, y INT, FOREIGN KEY (x, y) REFERENCES p(a, b) ON DELETE CASCADE)", "INSERT INTO c (x, y) SELECT n_nationkey, n_regionkey FROM nation WHERE n_nationkey < 5",
            "INSERT INTO c (x, y) VALUES (2, NULL)", "DELETE FROM p WHERE a = 2", "SELECT x, y FROM c",
        ),
        "SELECT CAST(n_nationkey AS BIGINT) AS x, CAST(n_regionkey AS BIGINT) AS y FROM nation WHERE n_nationkey < 5 AND n_nationkey <> 2 UNION ALL SELECT 2, NULL",
    ),
    # views and reads
    "view_read": (
        statements(
            ("nation", "region"), "CREATE VIEW low AS SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_nationkey < 12", "CREATE VIEW names AS SELECT l.n_name AS n, r.r_name AS r FROM low l JOIN region r ON l.n_regionkey = r.r_regionkey",
            "INSERT INTO nation (n_nationkey, n_name, n_regionkey) VALUES (11, 'LATE', 0)", "SELECT n, r FROM names",
        ),
        "SELECT n_name AS n, r_name AS r FROM (SELECT * FROM nation UNION ALL SELECT 11, 'LATE', 0) JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 12",
    ),
    "view_dropped": (attempts(NATION, ("CREATE VIEW w AS SELECT n_name FROM nation",), {"read": "SELECT n_name FROM w", "again": "CREATE VIEW w AS SELECT n_name FROM nation", "drop": "DROP VIEW w", "gone": "SELECT n_name FROM w"}), told_sql(("read", "ok"), ("again", "AlreadyExists"), ("drop", "ok"), ("gone", "NotFound"))),
    "managed_columns_read": (statements(NATION, "SELECT id, n_name FROM nation WHERE id BETWEEN 3 AND 9 AND created_at > 0 AND updated_at >= created_at"), "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name FROM nation WHERE n_nationkey + 1 BETWEEN 3 AND 9"),
    "managed_columns_after_update": (statements(NATION, "UPDATE nation SET n_name = 'x' WHERE id = 4", "SELECT id, n_name FROM nation WHERE id IN (4, 5)"), "SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, CASE WHEN n_nationkey = 3 THEN 'x' ELSE n_name END AS n_name FROM nation WHERE n_nationkey IN (3, 4)"),
    "default_names": (
        statements(SUPPLIER, "SELECT COUNT(*), SUM(s_suppkey), MIN(s_name), COUNT(DISTINCT s_nationkey) FROM supplier"),
        'SELECT COUNT(*) AS "COUNT(*)", CAST(SUM(s_suppkey) AS DOUBLE) AS "SUM(s_suppkey)", MIN(s_name) AS "MIN(s_name)", COUNT(DISTINCT s_nationkey) AS "COUNT(DISTINCT s_nationkey)" FROM supplier',
    ),
    "fn_now": (now, "SELECT r_name, TRUE AS near FROM region"),
    "find_ordered": (find_ordered, "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0 ORDER BY s_acctbal DESC, s_suppkey LIMIT 7 OFFSET 3"),
    "find_dot_paths": (dot_paths, "SELECT n_nationkey, n_regionkey AS region FROM nation WHERE (n_regionkey >= 2 AND contains(upper(n_name), '_1')) OR n_regionkey = 0"),
    "find_documents": (
        documents_api,
        told_sql(("id", 6), ("batch", 2), ("refused", "InvalidArgument"), ("taken", "ok"), ("by id", "AMERICA"), ("no id", None), ("one", 52), ("none", None), ("count", 9), ("counted", 4), ("updated", 3), ("deleted", 3), ("left", 6)),
    ),
    "refused_reads": (
        attempts(
            ("nation", "region"), (),
            {
                "null": "SELECT n_name FROM nation WHERE n_name = NULL", "alias": "SELECT a.n_name FROM nation a JOIN region a ON a.n_regionkey = a.r_regionkey", "mixed": "SELECT n_name FROM nation UNION SELECT r_name FROM region INTERSECT SELECT r_name FROM region",
                "mixed all": "SELECT n_name FROM nation UNION ALL SELECT r_name FROM region UNION SELECT r_name FROM region", "columns": "SELECT n_name, n_nationkey FROM nation UNION SELECT r_name FROM region",
                "recursive": "WITH RECURSIVE t (x) AS (SELECT r_regionkey AS x FROM region UNION ALL SELECT x, x FROM t) SELECT x FROM t", "cross": "SELECT n_name FROM nation CROSS JOIN region ON n_regionkey = r_regionkey",
                "garbage": "SELECT n_name FROM nation; DROP TABLE nation", "column": "SELECT nothing FROM nation", "table": "SELECT x FROM nowhere", "good": "SELECT n_name FROM nation WHERE n_name IS NULL",
            },
        ),
        told_sql(
            ("null", "SyntaxProblem"), ("alias", "SyntaxProblem"), ("mixed", "SyntaxProblem"), ("mixed all", "SyntaxProblem"), ("columns", "SyntaxProblem"), ("recursive", "SyntaxProblem"), ("cross", "SyntaxProblem"),
            ("garbage", "SyntaxProblem"), ("column", "NotFound"), ("table", "NotFound"), ("good", "ok"),
        ),
    ),
    "schema_index_stats": (
        index_figures,
        """SELECT 'n_regionkey' AS what, '[' || count(DISTINCT n_regionkey) || ', ' || (SELECT max(n) FROM (SELECT count(*) + CASE n_regionkey WHEN 3 THEN 2 ELSE 0 END AS n FROM nation GROUP BY n_regionkey)) || ', ' || (count(*) + 2) || ']' AS result FROM nation
            UNION ALL SELECT 'n_regionkey+n_name', '[' || (count(DISTINCT n_name) + 1) || ', 2, ' || (count(*) + 2) || ']' FROM nation""",
    ),
    "shell_session": (
        shell_session, told_sql(("00", "region"), ("01", 5), ("02", "id 6"), ("03", 3), ("04", "1 updated"), ("05", None), ("06", "error: no table nowhere"), ("07", "1 deleted"), ("08", "")),
    ),
    "last_status": (status, told_sql(("0", "OK"), ("1", "NotFound"), ("2", "SyntaxProblem"), ("3", "NotFound"), ("4", "OK"))),
    # values
    "value_nested_equality": (
        nested_equality,
        """SELECT CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) AS list, b AS odd, count(*) AS n FROM (SELECT s_suppkey % 3 AS a, s_suppkey % 2 AS b FROM supplier)
            WHERE a > 0 GROUP BY a, b""",
    ),
    "value_getters": (
        typed_values,
        told_sql(
            ("int", 3), ("widened", 3.0), ("float", 0.5), ("bool", True), ("text", "text"), ("blob", "0102"), ("array", 2), ("path", 89), ("object", "{city: Ulm, zip: {code: 89}}"), ("wrong", "TypeMismatch"), ("missing", "NotFound"),
            ("line", "{n: 3, ok: true, tags: [p, q], data: <blob:2 bytes>}"), ("order", "[-1, 0, -1, 1, 0]"),
        ),
    ),
    # files
    "file_import_pairs": (import_pairs, "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name, n_regionkey + CAST(0.5 AS DOUBLE) AS share, n_nationkey % 2 = 0 AS even, CAST(25 AS BIGINT) AS imported, CAST(1 AS BIGINT) AS bad FROM nation"),
    "file_csv": (
        export_csv,
        """SELECT CAST(n_nationkey AS VARCHAR) || ',' || CASE WHEN n_regionkey = 1 THEN '"' || n_name || ', ""so""' || '"' ELSE n_name END || ',<array:2 items>,<object:1 fields>' AS line FROM nation
            UNION ALL SELECT 'n_nationkey,name,both,o'""",
    ),
    "file_json": (export_json, """SELECT '{"n_nationkey":' || n_nationkey || ',"who":{"name":"' || n_name || '","region":{"key":' || n_regionkey || '}}}' AS line FROM nation WHERE n_nationkey < 10"""),
    "file_blob": (blob_from_file, "SELECT 'all bytes' AS name, CAST(1024 AS BIGINT) AS n, TRUE AS same"),
    "file_printed_rows": (printed, "SELECT '{r_regionkey: ' || r_regionkey || ', r_name: ' || r_name || ', none: NULL}' AS line FROM region"),
    # storage and transactions
    "storage_read_only": (read_only, told_sql(("read", 5), ("add", "ReadOnly"), ("sql", "ReadOnly"), ("missing", "NotFound"), ("still", 5))),
    "storage_stats_and_compact": (storage, told_sql(("files", 2), ("garbage", True), ("compacted", 1), ("left", 0), ("next", 27), ("rows", 26))),
    "storage_lock": (locked, told_sql(("writer", "Locked"), ("reader", 5), ("after", 6))),
    "tx_misplaced_and_poisoned": (
        transactions,
        told_sql(
            ("commit without", "TransactionError"), ("nested", "TransactionError"), ("ddl", "TransactionError"), ("twice", "ConstraintViolation"), ("poisoned", "TransactionError"), ("commit poisoned", "TransactionError"), ("back", "ok"),
            ("release", "ok"), ("released", "NotFound"), ("committed", 3), ("closed", 5), ("recovered", 5), ("lost race", "TransactionError"), ("kept", 6),
        ),
    ),
}
