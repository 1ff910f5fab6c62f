"""Import, export, nested values and the shell."""

import json
from pathlib import Path

from lodemill.__main__ import shell
from lodemill.database import open_database
from lodemill.operators.filters import filters_to_column
from lodemill.sources.textio import write_csv, write_json


def _lines(folder, pattern):
    return [x for f in sorted(Path(folder).glob(pattern)) for x in f.read_text().splitlines()]


def test_import_and_export(spark, tmp_path):
    (tmp_path / "in.txt").write_text("# people\nname=ann age=3\n\nname=bob age=4 age=5\nbad line\nname=c,\"d\n")
    with open_database(spark, str(tmp_path / "db")) as db:
        assert db.import_pairs("t", str(tmp_path / "in.txt")) == (3, 1)
        assert [(r.name, r.age) for r in db.find("t", order_by="id").collect()] == [("ann", 3), ("bob", 5), ('c,"d', None)]
        write_csv(db.find("t", order_by="id").select("name", "age").coalesce(1), str(tmp_path / "csv"))
        assert _lines(tmp_path / "csv", "*.csv") == ["name,age", "ann,3", "bob,5", '"c,""d",']


def test_nested_values(spark, tmp_path):
    rows = [("alice", ["a", "b"], ("NYC", 10001), bytearray(b"\x00\x01")), ("carol", None, None, None)]
    df = spark.createDataFrame(rows, "name string, tags array<string>, address struct<city:string,zip:long>, data binary").coalesce(1)
    hits = lambda *f: df.filter(filters_to_column(df.schema, list(f))).count()
    assert (hits("address.city=NYC"), hits("address.zip__gt=50000"), hits("address.city__isnull"), hits("address.none=1")) == (1, 0, 1, 0)
    write_json(df, str(tmp_path / "json"), limit=1)
    assert json.loads(_lines(tmp_path / "json", "*.json")[0])["address"] == {"city": "NYC", "zip": 10001}
    write_csv(df, str(tmp_path / "csv"))
    assert _lines(tmp_path / "csv", "*.csv")[1] == "alice,<array:2 items>,<object:2 fields>,<blob:2 bytes>"
    with open_database(spark, str(tmp_path / "db")) as db:
        db.add("t", {"name": "x", "tags": ["p", "q"], "address": {"city": "LA"}})
        assert db.find_one("t")["tags"] == ["p", "q"] and db.find_one("t", ["tags__isnull"]) is None


def test_shell(spark, tmp_path, capsys):
    with open_database(spark, str(tmp_path / "db")) as db:
        shell(db, ["add t name=ann age=3", "update t name=ann set age=4", "count t age=4", "find nope", "what", "sql SELECT name FROM t", "delete t age=4", "quit", "drop t"])
        assert db.list_tables() == ["t"]
    said = capsys.readouterr().out
    assert "id 1" in said and "1 updated" in said and "error: no table nope" in said and "|ann |" in said and "1 deleted" in said
