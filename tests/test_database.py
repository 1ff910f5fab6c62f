"""Statements, constraints and transactions over a database in a temporary folder."""

import pytest

from lodemill import errors
from lodemill.database import open_database


@pytest.fixture
def db(spark, tmp_path):
    with open_database(spark, str(tmp_path / "db")) as d:
        yield d


def rows(db, sql, params=()):
    return [tuple(r) for r in db.exec_sql(sql, params).rows.collect()]


def test_insert_select_update_delete_returning(db):
    db.exec_sql("CREATE TABLE t (name TEXT, status TEXT DEFAULT 'pending', n INT)")
    assert rows(db, "INSERT INTO t (name, n) VALUES ('a', 1), ('b', 2) RETURNING id, name, status") == [(1, "a", "pending"), (2, "b", "pending")]
    assert db.exec_sql("INSERT INTO t (name, n) SELECT name, n FROM t WHERE n > 1").affected == 1
    assert rows(db, "UPDATE t SET status = 'done' WHERE name = 'b' RETURNING id, status") in ([(2, "done"), (3, "done")], [(3, "done"), (2, "done")])
    assert rows(db, "DELETE FROM t WHERE (n = 1 OR n > 5) AND name LIKE 'a%' RETURNING *") == [("a", "pending", 1)]
    assert rows(db, "SELECT COUNT(*) AS n, MAX(id) AS m FROM t") == [(2, 3)]
    with pytest.raises(errors.SyntaxProblem):
        db.exec_sql("INSERT INTO t (name) VALUES ('x'); garbage")
    assert rows(db, "SELECT name FROM t WHERE n = $1 AND status = ? ORDER BY id LIMIT 1", [2, "done"]) == []


def test_upsert(db):
    db.exec_sql("CREATE TABLE gauge (river TEXT, day INT, level FLOAT)")
    put = "INSERT INTO gauge (river, day, level) VALUES ('ems', 3, 1.25) ON CONFLICT (day, river) DO "
    assert db.exec_sql(put + "NOTHING").affected == 1
    assert db.exec_sql(put + "NOTHING").affected == 0
    assert rows(db, put + "UPDATE SET level = 2.5 RETURNING river, level") == [("ems", 2.5)]
    assert rows(db, "SELECT day, level FROM gauge") == [(3, 2.5)]


def test_constraints(db):
    db.exec_sql("CREATE TABLE users (email TEXT UNIQUE, name TEXT NOT NULL, age INT, CHECK (age >= 0))")
    db.exec_sql("INSERT INTO users (email, name, age) VALUES ('a@x', 'a', 3)")
    for bad in ("('a@x', 'b', 1)", "('b@x', NULL, 1)", "('b@x', 'b', -1)"):
        with pytest.raises(errors.ConstraintViolation):
            db.exec_sql(f"INSERT INTO users (email, name, age) VALUES {bad}")
    db.exec_sql("INSERT INTO users (email, name, age) VALUES ('b@x', 'b', 1)")
    with pytest.raises(errors.ConstraintViolation):
        db.exec_sql("UPDATE users SET email = 'z'")
    assert db.count("users") == 2


def test_foreign_keys(db):
    db.exec_sql("CREATE TABLE ta (k INT UNIQUE)")
    db.exec_sql("CREATE TABLE tb (k INT UNIQUE REFERENCES ta(k) ON DELETE CASCADE ON UPDATE CASCADE)")
    db.exec_sql("CREATE TABLE tc (k INT, v TEXT, FOREIGN KEY (k) REFERENCES tb(k) ON DELETE SET NULL)")
    db.exec_sql("CREATE TABLE td (a INT REFERENCES ta(id))")
    db.exec_sql("INSERT INTO ta (k) VALUES (1), (2)")
    db.exec_sql("INSERT INTO tb (k) VALUES (1), (2)")
    db.exec_sql("INSERT INTO tc (k, v) VALUES (1, 'x'), (NULL, 'y')")
    with pytest.raises(errors.ConstraintViolation):
        db.exec_sql("INSERT INTO tb (k) VALUES (7)")
    db.exec_sql("INSERT INTO td (a) VALUES (2)")
    with pytest.raises(errors.ConstraintViolation):
        db.exec_sql("DELETE FROM ta WHERE k = 2")
    db.exec_sql("DELETE FROM ta WHERE k = 1")
    assert rows(db, "SELECT k FROM tb") == [(2,)]
    assert sorted(rows(db, "SELECT k, v FROM tc"), key=str) == [(None, "x"), (None, "y")]
    db.exec_sql("UPDATE ta SET k = 5 WHERE k = 2")
    assert rows(db, "SELECT k FROM tb") == [(5,)]


def test_transactions(db):
    db.exec_sql("CREATE TABLE t (name TEXT)")
    db.exec_sql("BEGIN")
    db.exec_sql("INSERT INTO t (name) VALUES ('a')")
    db.exec_sql("SAVEPOINT s")
    db.exec_sql("INSERT INTO t (name) VALUES ('b')")
    db.exec_sql("INSERT INTO fresh (x) VALUES (1)")
    assert rows(db, "SELECT COUNT(*) AS n FROM t") == [(2,)]
    with pytest.raises(errors.AlreadyExists):
        db.exec_sql("SAVEPOINT s")
    db.exec_sql("ROLLBACK TO SAVEPOINT s")
    assert rows(db, "SELECT name FROM t") == [("a",)] and not db.table_exists("fresh")
    with pytest.raises(errors.TransactionError):
        db.exec_sql("CREATE TABLE u (x INT)")
    with pytest.raises(errors.TransactionError):
        db.exec_sql("BEGIN")
    db.exec_sql("COMMIT")
    db.exec_sql("BEGIN")
    db.exec_sql("DELETE FROM t")
    db.exec_sql("ROLLBACK")
    assert rows(db, "SELECT name FROM t") == [("a",)]
    with pytest.raises(errors.TransactionError):
        db.exec_sql("COMMIT")


def test_a_crash_leaves_the_last_manifest(spark, tmp_path):
    root = str(tmp_path / "db")
    db = open_database(spark, root)
    db.add("t", {"x": 1})
    db.begin()
    db.add("t", {"x": 2})
    again = open_database(spark, root)  # the first is abandoned
    assert again.count("t") == 1
    assert again.catalog.collect(keep_seconds=3600) == 0 and again.catalog.collect() == 1
    again.compact("t")
    assert again.find("t").select("x").collect()[0].x == 1
    with pytest.raises(errors.ReadOnly):
        open_database(spark, root, read_only=True).add("t", {"x": 3})
    with pytest.raises(errors.NotFound):
        open_database(spark, root + "-none", read_only=True)


def test_alter(db):
    db.exec_sql("CREATE TABLE t (name TEXT, age TEXT)")
    db.exec_sql("INSERT INTO t (name, age) VALUES ('a', '30'), ('b', '25')")
    with pytest.raises(errors.TypeMismatch):
        db.exec_sql("ALTER TABLE t ALTER COLUMN name TYPE INT")
    db.exec_sql("ALTER TABLE t ALTER COLUMN age TYPE INT")
    db.exec_sql("ALTER TABLE t RENAME COLUMN age TO years")
    db.exec_sql("ALTER TABLE t ADD COLUMN kind TEXT DEFAULT 'basic'")
    db.exec_sql("INSERT INTO t (name) VALUES ('c')")
    assert rows(db, "SELECT years, kind FROM t ORDER BY id") == [(30, None), (25, None), (None, "basic")]
    db.exec_sql("CREATE INDEX ON t (name, years)")
    with pytest.raises(errors.AlreadyExists):
        db.exec_sql("CREATE INDEX i ON t (years, name)")
    db.exec_sql("DROP INDEX ON t (years, name)")
    db.exec_sql("ALTER TABLE t DROP COLUMN kind")
    db.exec_sql("ALTER TABLE t RENAME TO people")
    db.exec_sql("CREATE VIEW adults AS SELECT name FROM people WHERE years > 26")
    assert rows(db, "SELECT a.name FROM adults a JOIN people p ON a.name = p.name") == [("a",)]
    db.exec_sql("DROP VIEW adults")
    db.exec_sql("DROP TABLE people")
    db.exec_sql("DROP TABLE people")
    assert db.list_tables() == []


def test_recursive_union_ends_on_a_cycle(db):
    db.exec_sql("INSERT INTO roads (here, there) VALUES (10, 20), (20, 30), (30, 40), (40, 20), (70, 80)")
    db.spark.sql("SELECT 1 AS mine").createOrReplaceTempView("reach")
    sql = "WITH RECURSIVE reach (p) AS (SELECT here FROM roads WHERE here = 10 UNION SELECT o.there AS p FROM roads o JOIN reach ON o.here = reach.p) SELECT p FROM reach ORDER BY p"
    assert rows(db, sql) == [(10,), (20,), (30,), (40,)]
    assert db.spark.table("reach").columns == ["mine"]  # the user's view of that name is untouched
    db.spark.catalog.dropTempView("reach")


def test_two_writers(spark, tmp_path):
    a, b = (open_database(spark, str(tmp_path / "db")) for _ in range(2))
    a.add("t", {"x": 0})
    a.add("u", {"x": 0})
    a.begin()
    a.add("t", {"x": 1})
    b.add("u", {"x": 5})
    assert a.count("u") == 1 and b.count("t") == 1  # each sees its own
    a.commit()
    assert (b.count("t"), b.count("u"), a.count("u")) == (2, 2, 2)  # nothing is lost
    a.begin()
    a.add("t", {"x": 2})
    b.add("t", {"x": 3})
    with pytest.raises(errors.TransactionError):
        a.commit()
    a.rollback()
    assert sorted(r.x for r in a.find("t").collect()) == [0, 1, 3]


def test_compact_leaves_an_open_transaction_alone(spark, tmp_path):
    a, b = (open_database(spark, str(tmp_path / "db")) for _ in range(2))
    for x in range(3):
        a.add("t", {"x": x})
    a.begin()
    a.add("u", {"x": 9})
    seen = b.find("t")
    b.compact("t")
    a.commit()
    assert a.count("t") == 3 and a.count("u") == 1 and seen.count() == 3
    assert b.stats("t")["files"] == 1 and 0 < b.stats("t")["fragmentation"] < 1
    a.begin()
    a.add("u", {"x": 10})
    b.compact("u", keep_seconds=0)  # asked to keep nothing, it takes what the transaction wrote
    with pytest.raises(errors.TransactionError):
        a.commit()
    a.rollback()
    assert a.count("u") == 1


def test_a_write_leaves_folders_without_a_hit(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "db"))
    for x in range(4):
        db.add("t", {"x": x})
    before = db.meta("t")["files"]
    assert db.exec_sql("UPDATE t SET x = 10 WHERE x = 2").affected == 1
    assert db.exec_sql("UPDATE t SET x = 10 WHERE x = 77").affected == 0
    assert db.exec_sql("DELETE FROM t WHERE x = 0").affected == 1
    after = db.meta("t")["files"]
    assert set(before[1:2] + before[3:]) < set(after) and not {before[0], before[2]} & set(after)
    assert sorted(r.x for r in db.find("t").collect()) == [1, 3, 10]
    plan = db._marked(db.table("t"), ["x=1"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_a_database_on_a_store_that_only_hadoop_reads(spark, tmp_path):
    """viewfs has no local path, so every file goes through Hadoop."""
    conf = spark._jsc.hadoopConfiguration()
    conf.set("fs.viewfs.mounttable.box.link./in", f"file://{tmp_path}")
    root = "viewfs://box/in/db"
    with pytest.raises(errors.NotFound):
        open_database(spark, root, read_only=True)
    a, b = (open_database(spark, root) for _ in range(2))
    a.exec_sql("CREATE TABLE t (k INT UNIQUE, s TEXT)")
    a.exec_sql("INSERT INTO t (k, s) VALUES (1, 'x'), (2, 'y')")
    b.exec_sql("UPDATE t SET s = 'z' WHERE k = 2")
    with a.change(), pytest.raises(errors.Locked):
        b.add("t", {"k": 9})
    a.begin()
    a.add("t", {"k": 3})
    b.add("t", {"k": 4})
    with pytest.raises(errors.TransactionError):
        a.commit()
    a.rollback()
    assert a.stats("t")["garbage_bytes"] > 0
    a.compact("t", keep_seconds=0)
    assert a.stats("t")["garbage_bytes"] == 0 and b.stats("t")["files"] == 1
    assert sorted((r.k, r.s) for r in b.find("t").collect()) == [(1, "x"), (2, "z"), (4, None)]


def test_an_index_puts_bloom_filters_into_all_files(spark, tmp_path):
    db = open_database(spark, str(tmp_path / "db"))
    db.exec_sql("CREATE TABLE t (k INT, s TEXT)")
    with db.change() as state:
        db.insert_frame(state, "t", spark.range(5000).selectExpr("id * 7 % 5000 AS k", "concat('s', id) AS s"), ["k", "s"])
    plain = db.stats("t")["bytes"]
    db.exec_sql("CREATE INDEX ON t (k)")
    assert db.stats("t")["bytes"] > plain + 1000
    db.exec_sql("INSERT INTO t (k, s) VALUES (14, 'x')")
    assert db.exec_sql("UPDATE t SET s = 'y' WHERE k = 14").affected == 2
    assert db.exec_sql("SELECT s FROM t WHERE k = 14").rows.count() == 2 and db.count("t") == 5001
    assert db.index_stats("t") == [{"columns": ["k"], "keys": 5000, "most": 2, "rows": 5001}]


def test_set_default_takes_values_of_the_column(db):
    db.exec_sql("CREATE TABLE t (n INT, s TEXT)")
    with pytest.raises(errors.TypeMismatch):
        db.set_default("t", "n", "oops")
    db.set_default("t", "n", 4)
    db.exec_sql("INSERT INTO t (s) VALUES ('x')")
    assert rows(db, "SELECT n, s FROM t") == [(4, "x")]
