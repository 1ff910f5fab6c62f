"""python -m lodemill FOLDER: a small shell over a database; ``help`` lists the commands."""

from __future__ import annotations

import shlex
import sys
from collections.abc import Callable

from lodemill import __version__
from lodemill.database import Database, open_database
from lodemill.errors import LodemillError
from lodemill.functions.literals import infer_literal
from lodemill.sources.textio import read_blob, write_csv, write_json


def _values(parts: list[str]) -> dict:
    """key=value parts; ``key=@path`` takes the bytes of a file."""
    out = {}
    for p in parts:
        key, _, value = p.partition("=")
        out[key] = read_blob(value[1:]) if value.startswith("@") else infer_literal(value)
    return out


def _split(parts: list[str]) -> tuple[list[str], list[str]]:
    """Filters and values on the two sides of ``set``."""
    at = parts.index("set") if "set" in parts else len(parts)
    return parts[:at], parts[at + 1 :]


def commands(db: Database) -> dict[str, Callable[[list[str]], None]]:
    def update(a: list[str]) -> None:
        filters, values = _split(a[1:])
        print(db.update(a[0], filters, _values(values)), "updated")

    def sql(a: list[str]) -> None:
        rows, affected = db.exec_sql(" ".join(a))
        rows.show(1000, False) if rows is not None else print(affected, "affected")

    return {
        "tables": lambda a: print("\n".join(db.list_tables())),
        "schema": lambda a: print("\n".join(map(str, db.get_schema(a[0])))),
        "add": lambda a: print("id", db.add(a[0], _values(a[1:]))),
        "find": lambda a: db.find(a[0], a[1:]).show(1000, False),
        "get": lambda a: print(db.find_by_id(a[0], int(a[1]))),
        "count": lambda a: print(db.count(a[0], a[1:])),
        "update": update,
        "delete": lambda a: print(db.delete(a[0], a[1:]), "deleted"),
        "search": lambda a: db.text_search(a[0], " ".join(a[1:])).show(100, False),
        "import": lambda a: print("%d imported, %d bad lines" % db.import_pairs(a[0], a[1])),
        "csv": lambda a: write_csv(db.table(a[0]), a[1]),
        "json": lambda a: write_json(db.table(a[0]), a[1]),
        "stats": lambda a: print(db.stats(a[0])),
        "compact": lambda a: db.compact(a[0]),
        "drop": lambda a: db.drop_table(a[0]),
        "version": lambda a: print(__version__),
        "sql": sql,
    }


def shell(db: Database, lines) -> None:
    known = commands(db)
    for line in lines:
        word, _, rest = line.strip().partition(" ")
        if word in ("quit", "exit"):
            break
        if not word:
            continue
        try:
            if word == "help" or word not in known:
                print(*sorted([*known, "quit"]))
            else:
                known[word]([rest] if word == "sql" else shlex.split(rest))
        except (LodemillError, IndexError, ValueError, OSError) as e:
            print("error:", e or type(e).__name__)


if __name__ == "__main__":
    from lodemill.session import session

    with open_database(session(master="local[*]"), sys.argv[1] if len(sys.argv) > 1 else "data") as opened:
        shell(opened, sys.stdin)
