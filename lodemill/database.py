"""The database: document API, tables with constraints, transactions."""

from __future__ import annotations

import copy
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodemill.errors import AlreadyExists, ConstraintViolation, InvalidArgument, NotFound, TransactionError, TypeMismatch, reset_status
from lodemill.functions.literals import BOOL, FLOAT, INT, NUMERIC, SPARK_TYPES, TEXT, type_of, type_of_value
from lodemill.operators import constraints as rules
from lodemill.operators import pipeline, search
from lodemill.operators.filters import filters_to_column
from lodemill.sources.catalog import MANAGED, Catalog, new_table

RESERVED = tuple(f.name for f in MANAGED)
#: Folders of a table beyond which a commit merges the small ones, and bytes below which one is small.
MANY_FILES, SMALL_BYTES = 64, 32 << 20
#: Bytes of a file that compacting and merging aim at.
FILE_BYTES = 128 << 20
#: Seconds that a folder which no manifest names is left for open readers and transactions.
KEEP_SECONDS = 3600
#: Marks the rows that a write changes.
HIT = "__hit"


class Database:
    """One folder. Every statement is atomic; ``begin`` groups statements."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.catalog = spark, Catalog(spark, root, read_only)
        self.tx: dict | None = None
        #: The state that the open transaction began with.
        self.base: dict = {}
        self.spoilt = False
        self.savepoints: list[tuple[str, dict]] = []

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """An open transaction is rolled back."""
        self.tx, self.savepoints = None, []

    # --- state
    @property
    def state(self) -> dict:
        """The open transaction's, else the last one that any writer published."""
        return self.tx if self.tx is not None else self.catalog.load()

    def meta(self, table: str, state: dict | None = None) -> dict:
        found = (state or self.state)["tables"].get(table)
        if found is None:
            raise NotFound(f"no table {table}")
        return found

    def table(self, table: str, state: dict | None = None) -> DataFrame:
        return self.catalog.read(self.meta(table, state))

    @contextmanager
    def change(self, schema: bool = False) -> Iterator[dict]:
        """A copy of the state, which counts if the block ends well: at once, or with the open transaction."""
        if self.tx is not None:
            if schema:
                raise TransactionError("schema changes can't be part of a transaction")
            if self.spoilt:
                raise TransactionError("an earlier statement failed; roll back")
            staged = copy.deepcopy(self.tx)
            try:
                yield staged
            except Exception:
                self.spoilt = True
                raise
            self.tx = staged
            return
        with self.catalog.lock():
            staged = self.catalog.load()
            yield staged
            self._publish(staged)

    def _publish(self, staged: dict) -> None:
        for name, meta in staged["tables"].items():
            if len(meta["files"]) > MANY_FILES:
                sizes = {p: self.catalog.folder_bytes(p) for p in meta["files"]}
                small = [p for p in meta["files"] if sizes[p] < SMALL_BYTES]
                if len(small) > 1:
                    rows = self.catalog.read(meta | {"files": small}).coalesce(_files(sum(sizes[p] for p in small)))
                    meta["files"] = [p for p in meta["files"] if p not in small] + [self.catalog.write(rows, name, meta)]
        self.catalog.publish(staged)

    # --- transactions
    def begin(self) -> None:
        if self.tx is not None:
            raise TransactionError("a transaction is open")
        self.base = self.catalog.load()
        self.tx, self.spoilt, self.savepoints = copy.deepcopy(self.base), False, []

    def _open(self) -> dict:
        if self.tx is None:
            raise TransactionError("no transaction is open")
        return self.tx

    def commit(self) -> None:
        """What other writers published meanwhile stays. It is refused if they changed a table that the transaction
        wrote, or one that is tied to such a table by a foreign key; the transaction is still open then."""
        staged, base = self._open(), self.base
        if self.spoilt:
            raise TransactionError("a statement failed; roll back")
        with self.catalog.lock():
            now = self.catalog.load()
            if now["version"] != base["version"]:
                own = {t for t in staged["tables"] if staged["tables"][t] != base["tables"].get(t)}
                tied = own | {fk["table"] for t in own for fk in staged["tables"][t]["fks"]} | {t for t, m in now["tables"].items() for fk in m["fks"] if fk["table"] in own}
                moved = sorted(t for t in tied if now["tables"].get(t) != base["tables"].get(t))
                if moved:
                    raise TransactionError(f"another writer changed {', '.join(moved)}; roll back")
                staged = now | {"tables": now["tables"] | {t: staged["tables"][t] for t in own}}
            lost = [p for m in staged["tables"].values() for p in m["files"] if not self.catalog.has(p)]
            if lost:
                raise TransactionError(f"{lost[0]} is gone; roll back")
            self._publish(staged)
        self.tx, self.savepoints = None, []

    def rollback(self) -> None:
        self._open()
        self.tx, self.spoilt, self.savepoints = None, False, []

    def savepoint(self, name: str) -> None:
        if any(n == name for n, _ in self.savepoints):
            raise AlreadyExists(f"savepoint {name}")
        self.savepoints.append((name, copy.deepcopy(self._open())))

    def _savepoint(self, name: str) -> int:
        self._open()
        for k, (n, _) in enumerate(self.savepoints):
            if n == name:
                return k
        raise NotFound(f"no savepoint {name}")

    def rollback_to(self, name: str) -> None:
        k = self._savepoint(name)
        self.tx, self.spoilt = copy.deepcopy(self.savepoints[k][1]), False
        del self.savepoints[k + 1 :]

    def release(self, name: str) -> None:
        del self.savepoints[self._savepoint(name) :]

    # --- schema
    def list_tables(self) -> list[str]:
        return sorted(self.state["tables"])

    def table_exists(self, table: str) -> bool:
        return table in self.state["tables"]

    def get_schema(self, table: str) -> list[dict]:
        meta = self.meta(table)
        return [{"name": f.name, "type": type_of(f.dataType) or f.dataType.simpleString(), **meta["columns"].get(f.name, {})} for f in T.StructType.fromJson(meta["schema"])]

    def create_table(self, table: str, columns: list[dict], checks: list[dict] = (), fks: list[dict] = ()) -> None:
        """columns: name, type, and any of not_null, unique, indexed, default, references (see ``add_foreign_key``)."""
        with self.change(schema=True) as state:
            if table in state["tables"]:
                raise AlreadyExists(f"table {table}")
            state["tables"][table] = new_table()
            for c in columns:
                self._add_column(state, table, c)
            for check in checks:
                self._add_check(state, table, check)
            for fk in fks:
                self._add_fk(state, table, fk)

    def _add_column(self, state: dict, table: str, column: dict) -> None:
        meta, name = self.meta(table, state), column["name"]
        if name.lower() in RESERVED:
            return
        schema = T.StructType.fromJson(meta["schema"])
        if name in schema.names:
            raise AlreadyExists(f"column {name}")
        kind = column["type"]
        meta["schema"] = schema.add(name, SPARK_TYPES[kind] if kind in SPARK_TYPES else kind).jsonValue()
        about = {k: column[k] for k in ("not_null", "unique", "indexed") if column.get(k)}
        if "default" in column:
            about["default"] = self._fit(column["default"], SPARK_TYPES[kind], name)
        meta["columns"][name] = about
        if column.get("indexed") or column.get("unique"):
            meta["indexes"].append([name])
        if column.get("references"):
            self._add_fk(state, table, {"columns": [name], **column["references"]})

    def add_column(self, table: str, column: dict) -> None:
        """Existing rows are null there; a default holds for later rows. NOT NULL needs an empty table."""
        with self.change(schema=True) as state:
            if column["name"].lower() in RESERVED:
                raise InvalidArgument(f"{column['name']} is managed")
            self._add_column(state, table, column)
            if column.get("not_null") and not self.table(table, state).isEmpty():
                raise ConstraintViolation("rows would be null in a NOT NULL column")

    def _need(self, meta: dict, column: str, managed: bool = False) -> None:
        if column not in T.StructType.fromJson(meta["schema"]).names and not (managed and column in RESERVED):
            raise NotFound(f"no column {column}")

    def drop_column(self, table: str, column: str) -> None:
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            self._need(meta, column)
            if any(column in fk["refs"] and fk["table"] == table for m in state["tables"].values() for fk in m["fks"]) or any(column in fk["columns"] for fk in meta["fks"]):
                raise ConstraintViolation(f"a foreign key uses {column}")
            rows = self.catalog.read(meta).drop(column)
            meta["schema"] = T.StructType([f for f in T.StructType.fromJson(meta["schema"]) if f.name != column]).jsonValue()
            meta["columns"].pop(column, None)
            meta["checks"] = [c for c in meta["checks"] if c["column"] != column]
            meta["indexes"] = [i for i in meta["indexes"] if column not in i]
            meta["files"] = [self.catalog.write(rows, table, meta)] if meta["files"] else []

    def rename_column(self, table: str, old: str, new: str) -> None:
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            self._need(meta, old)
            schema = T.StructType.fromJson(meta["schema"])
            if new in schema.names or new.lower() in RESERVED:
                raise AlreadyExists(f"column {new}")
            rows = self.catalog.read(meta).withColumnRenamed(old, new)
            swap = lambda names: [new if n == old else n for n in names]
            meta["schema"] = T.StructType([T.StructField(new if f.name == old else f.name, f.dataType) for f in schema]).jsonValue()
            meta["columns"] = {new if k == old else k: v for k, v in meta["columns"].items()}
            meta["checks"] = [c | {"column": new if c["column"] == old else c["column"]} for c in meta["checks"]]
            meta["indexes"] = [swap(i) for i in meta["indexes"]]
            for fk in meta["fks"]:
                fk["columns"] = swap(fk["columns"])
            for m in state["tables"].values():
                for fk in m["fks"]:
                    if fk["table"] == table:
                        fk["refs"] = swap(fk["refs"])
            meta["files"] = [self.catalog.write(rows, table, meta)] if meta["files"] else []

    def rename_table(self, old: str, new: str) -> None:
        with self.change(schema=True) as state:
            self.meta(old, state)
            if new in state["tables"] or new in state["views"]:
                raise AlreadyExists(f"table {new}")
            state["tables"][new] = state["tables"].pop(old)
            for m in state["tables"].values():
                for fk in m["fks"]:
                    if fk["table"] == old:
                        fk["table"] = new

    def alter_type(self, table: str, column: str, kind: str) -> None:
        """All rows convert, or nothing changes."""
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            self._need(meta, column)
            rows, c = self.catalog.read(meta), F.col(f"`{column}`")
            own = type_of(rows.schema[column].dataType)
            cast = c.try_cast(SPARK_TYPES[kind]) if own in (TEXT, *NUMERIC) else F.lit(None).cast(SPARK_TYPES[kind])
            if own == TEXT and kind == INT:
                cast = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), cast)
            if rules.any_row(rows.filter(c.isNotNull() & cast.isNull())):
                raise TypeMismatch(f"not all of {table}.{column} are {kind}")
            schema = T.StructType.fromJson(meta["schema"])
            meta["schema"] = T.StructType([T.StructField(f.name, SPARK_TYPES[kind] if f.name == column else f.dataType) for f in schema]).jsonValue()
            meta["files"] = [self.catalog.write(rows.withColumn(column, cast), table, meta)] if meta["files"] else []

    def alter_column(self, table: str, column: str, **flags: bool) -> None:
        """not_null or unique, set or dropped; what is set must hold already."""
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            self._need(meta, column)
            meta["columns"].setdefault(column, {}).update(flags)
            rules.check_rows(table, meta, self.catalog.read(meta))

    def set_default(self, table: str, column: str, value: Any) -> None:
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            self._need(meta, column)
            kind = T.StructType.fromJson(meta["schema"])[column].dataType
            meta["columns"].setdefault(column, {})["default"] = self._fit(value, kind, column)

    def drop_default(self, table: str, column: str) -> None:
        with self.change(schema=True) as state:
            self.meta(table, state)["columns"].get(column, {}).pop("default", None)

    def create_index(self, table: str, columns: list[str]) -> None:
        """Bloom filters on the columns, in the rows that are there, which are sorted by them file by file, and in all that
        come. Equality filters on the columns then skip most of the table; results don't depend on it."""
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            for c in columns:
                self._need(meta, c)
            if any(sorted(i) == sorted(columns) for i in meta["indexes"]):
                raise AlreadyExists(f"an index on {', '.join(columns)}")
            meta["indexes"].append(list(columns))
            if meta["files"]:
                rows = self.catalog.read(meta).sortWithinPartitions(*[f"`{c}`" for c in columns])
                meta["files"] = [self.catalog.write(rows, table, meta)]

    def index_stats(self, table: str) -> list[dict]:
        """Each index with its number of distinct keys and the most rows that one has."""
        rows, out = self.table(table), []
        for columns in self.meta(table)["indexes"]:
            keys = rows.groupBy(*[f"`{c}`" for c in columns]).count()
            found = keys.agg(F.count("*").alias("keys"), F.max("count").alias("most"), F.coalesce(F.sum("count"), F.lit(0)).alias("rows")).first()
            out.append({"columns": columns, **found.asDict()})
        return out

    def drop_index(self, table: str, columns: list[str]) -> None:
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            left = [i for i in meta["indexes"] if sorted(i) != sorted(columns)]
            if len(left) == len(meta["indexes"]):
                raise NotFound(f"no index on {', '.join(columns)}")
            meta["indexes"] = left

    def drop_table(self, table: str) -> None:
        """Dropping a table that isn't there is no error."""
        with self.change(schema=True) as state:
            state["tables"].pop(table, None)

    def _add_check(self, state: dict, table: str, check: dict) -> None:
        meta = self.meta(table, state)
        self._need(meta, check["column"])
        meta["checks"].append(check)

    def add_check(self, table: str, column: str, op: str, value: Any) -> None:
        with self.change(schema=True) as state:
            self._add_check(state, table, {"column": column, "op": op, "value": value})
            rules.check_rows(table, self.meta(table, state), self.table(table, state))

    def _add_fk(self, state: dict, table: str, fk: dict) -> None:
        meta = self.meta(table, state)
        fk = {"on_delete": "RESTRICT", "on_update": "RESTRICT"} | fk
        for c in fk["columns"]:
            self._need(meta, c)
        parent = self.meta(fk["table"], state)
        for c in fk["refs"]:
            self._need(parent, c, managed=True)
        rules.check_fk(fk["columns"], fk["refs"], fk["on_delete"], fk["on_update"], meta)
        if any(sorted(x["columns"]) == sorted(fk["columns"]) for x in meta["fks"]):
            raise AlreadyExists(f"a foreign key on {', '.join(fk['columns'])}")
        meta["fks"].append(fk)

    def add_foreign_key(self, table: str, columns: list[str], parent: str, refs: list[str], on_delete: str = "RESTRICT", on_update: str = "RESTRICT") -> None:
        with self.change(schema=True) as state:
            self._add_fk(state, table, {"columns": columns, "table": parent, "refs": refs, "on_delete": on_delete, "on_update": on_update})
            rules.check_parents(table, self.meta(table, state), self.table(table, state), lambda t: self.table(t, state))

    def drop_foreign_key(self, table: str, columns: list[str]) -> None:
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            left = [fk for fk in meta["fks"] if sorted(fk["columns"]) != sorted(columns)]
            if len(left) == len(meta["fks"]):
                raise NotFound(f"no foreign key on {', '.join(columns)}")
            meta["fks"] = left

    # --- writing
    @staticmethod
    def _fit(value: Any, kind: T.DataType, column: str) -> Any:
        own = type_of(kind)
        if value is None or own is None:
            return value
        if own == FLOAT and isinstance(value, (int, float)):
            return float(value)
        if own == INT and isinstance(value, (bool, int)):
            return int(value)
        if own == INT and isinstance(value, float) and value.is_integer():
            return int(value)
        if own == BOOL and isinstance(value, (bool, int)) and value in (0, 1):
            return bool(value)
        if (own == TEXT and isinstance(value, str)) or isinstance(value, (bytes, bytearray)):
            return value
        raise TypeMismatch(f"{column} takes {own}, not {value!r}")

    def _infer(self, rows: list[dict], schema: T.StructType) -> T.StructType:
        """schema with the fields that the rows have beyond it, typed by their values."""
        for row in rows:
            for name, value in row.items():
                if name not in schema.names and value is not None:
                    schema = schema.add(name, _kind_of(value))
        return schema

    def insert_rows(self, state: dict, table: str, rows: list[dict], check_fk: bool = True) -> list[int]:
        """Rows as dicts. A missing table is made. Defaults fill what a row leaves out."""
        meta = state["tables"].setdefault(table, new_table())
        rows = [{k: v for k, v in r.items() if k not in RESERVED} for r in rows]
        schema = self._infer(rows, T.StructType.fromJson(meta["schema"]))
        meta["schema"] = schema.jsonValue()
        now, first = int(time.time()), meta["next_id"]
        defaults = {c: a["default"] for c, a in meta["columns"].items() if "default" in a}
        data = []
        for i, r in enumerate(rows):
            r = defaults | r
            data.append((first + i, now, now, *[self._fit(r.get(f.name), f.dataType, f.name) for f in schema]))
        new = self.spark.createDataFrame(data, self.catalog.schema(meta))
        self._append(state, table, new, len(rows), check_fk)
        return list(range(first, first + len(rows)))

    def _append(self, state: dict, table: str, new: DataFrame, n: int, check_fk: bool = True) -> None:
        meta = self.meta(table, state)
        rules.check_rows(table, meta, new, self.catalog.read(meta))
        if check_fk:
            rules.check_parents(table, meta, new, lambda t: self.table(t, state))
        if n:
            meta["files"] = [*meta["files"], self.catalog.write(new.coalesce(1) if n < 100_000 else new, table, meta)]
            meta["next_id"] += n

    def insert_frame(self, state: dict, table: str, rows: DataFrame, columns: list[str], check_fk: bool = True) -> tuple[int, int]:
        """Rows of a DataFrame, matched to columns by position; (first id, number of rows).

        Ids follow the order of the rows: each task numbers its own, and the sizes of the tasks before are added.
        """
        if len(rows.columns) != len(columns):
            raise InvalidArgument(f"{len(rows.columns)} values for {len(columns)} columns")
        meta = state["tables"].setdefault(table, new_table())
        schema = T.StructType.fromJson(meta["schema"])
        named = rows.toDF(*columns)
        for f in named.schema:
            if f.name not in schema.names and f.name not in RESERVED:
                schema = schema.add(f.name, f.dataType)
        meta["schema"] = schema.jsonValue()
        staged = self.catalog.write(named.withColumn("__n", F.monotonically_increasing_id()), table)
        named = self.spark.read.parquet(self.catalog.path(staged)).withColumn("__p", F.shiftright("__n", 33))
        sizes = sorted((r["__p"], r["count"]) for r in named.groupBy("__p").count().collect())  # a row for each task
        first = at = meta["next_id"]
        offsets = []
        for p, n in sizes:
            offsets.append((p, at))
            at += n
        now = F.lit(int(time.time())).cast("long")
        defaults = {c: a["default"] for c, a in meta["columns"].items() if "default" in a}
        fields = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) if f.name in columns else F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in schema]
        if len(offsets) == 1:
            placed = named.withColumn("__at", F.lit(first))
        else:
            placed = named.join(F.broadcast(self.spark.createDataFrame(offsets, "__p long, __at long")), "__p")
        new = placed.select((F.col("__at") + F.col("__n").bitwiseAND(F.lit((1 << 33) - 1))).alias("id"), now.alias("created_at"), now.alias("updated_at"), *fields)
        self._append(state, table, new, at - first, check_fk)
        self.catalog.remove(staged)  # nothing reads it any more
        return first, at - first

    def _marked(self, rows: DataFrame, filters: list[str] | Column | DataFrame | None) -> DataFrame:
        """rows with HIT. filters: filter strings, a condition, a DataFrame of ids, or None for all rows."""
        if isinstance(filters, DataFrame):
            ids = filters.select("id").distinct().withColumn(HIT, F.lit(True))
            return rows.join(ids, "id", "left").withColumn(HIT, F.coalesce(HIT, F.lit(False)))
        hit = F.lit(True) if filters is None else filters if isinstance(filters, Column) else filters_to_column(rows.schema, list(filters))
        return rows.withColumn(HIT, F.coalesce(hit, F.lit(False)))

    def _touched(self, state: dict, table: str, filters: list[str] | Column | DataFrame | None) -> tuple[list[str], DataFrame]:
        """(folders without a hit, marked rows of the others). A write leaves the former as they are."""
        meta = self.meta(table, state)
        if len(meta["files"]) < 2 or isinstance(filters, DataFrame) or filters is None:
            return [], self._marked(self.catalog.read(meta).alias(table), filters)
        hits = self._marked(self.catalog.read(meta).alias(table), filters).filter(HIT)
        folder = F.element_at(F.split(F.input_file_name(), "/"), -2)
        held = {r[0] for r in hits.select(folder).distinct().collect()}  # as many as the table has folders
        idle = [p for p in meta["files"] if p.rsplit("/", 1)[-1] not in held]
        busy = meta | {"files": [p for p in meta["files"] if p not in idle]}
        return idle, self._marked(self.catalog.read(busy).alias(table), filters)

    def _count_into(self, rows: DataFrame, table: str, meta: dict) -> tuple[str, int]:
        """Write rows without HIT; (folder, number of hits)."""
        seen = Observation()
        path = self.catalog.write(rows.observe(seen, F.coalesce(F.sum(F.col(HIT).cast("long")), F.lit(0)).alias("n")).drop(HIT), table, meta)
        return path, seen.get["n"]

    def update_rows(self, state: dict, table: str, filters: list[str] | Column | DataFrame | None, values: dict) -> tuple[DataFrame, int]:
        """The changed rows as they are after the update, and their number. One pass over the folders that hold them."""
        meta = self.meta(table, state)
        for c in values:
            if c in RESERVED:
                raise InvalidArgument(f"{c} is managed")
            self._need(meta, c)
        idle, marked = self._touched(state, table, filters)
        kinds = {f.name: f.dataType for f in self.catalog.schema(meta)}
        fitted = {c: self._fit(v, kinds[c], c) for c, v in values.items()}
        fitted["updated_at"] = int(time.time())

        def image(name: str) -> Column:
            c = F.col(f"`{name}`")
            return (F.when(F.col(HIT), F.lit(fitted[name]).cast(kinds[name])).otherwise(c) if name in fitted else c).alias(name)

        after = marked.select(*map(image, kinds), HIT)
        new = after.filter(HIT).drop(HIT)
        if rules.constrained(meta):
            rest = after.filter(~F.col(HIT)).drop(HIT)
            others = self.catalog.read(meta | {"files": idle}).unionByName(rest) if idle else rest
            rules.check_rows(table, meta, new, others)
        if not meta["files"] or (len(idle) == len(meta["files"])):
            return new, 0
        path, n = self._count_into(after, table, meta)
        if n:
            meta["files"] = [*idle, path]
            self._after_change(state, table, marked.filter(HIT).drop(HIT), new, set(values))
        return new, n

    def _after_change(self, state: dict, table: str, old: DataFrame, new: DataFrame, changed: set[str]) -> None:
        """Check the parents of changed rows, and follow foreign keys that refer to them."""
        rules.check_parents(table, self.meta(table, state), new, lambda t: self.table(t, state), changed)
        for child, m in list(state["tables"].items()):
            for fk in m["fks"]:
                if fk["table"] == table and changed & set(fk["refs"]):
                    self._follow(state, child, fk, old, new)

    def _replace(self, state: dict, table: str, rows: DataFrame, old: DataFrame, new: DataFrame, changed: set[str]) -> None:
        """Put new in the place of old, row by row, check it, and follow foreign keys that refer to it."""
        meta = self.meta(table, state)
        others = rows.join(old.select("id"), "id", "left_anti")
        rules.check_rows(table, meta, new, others)
        meta["files"] = [self.catalog.write(others.select(*rows.columns).unionByName(new.select(*rows.columns)), table, meta)]
        self._after_change(state, table, old, new, changed)

    @staticmethod
    def _match(child: list[str], parent: list[str]) -> Column:
        return reduce(lambda a, b: a & b, [F.col(f"c.`{x}`") == F.col(f"p.`{y}`") for x, y in zip(child, parent, strict=True)])

    def _follow(self, state: dict, child: str, fk: dict, old: DataFrame, new: DataFrame) -> None:
        """Children of rows whose referred columns changed."""
        both = old.select("id", *[F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(fk["refs"])]).join(
            new.select("id", *[F.col(f"`{c}`").alias(f"_n{i}") for i, c in enumerate(fk["refs"])]), "id"
        )
        moved = both.filter(reduce(lambda a, b: a | b, [~F.col(f"_o{i}").eqNullSafe(F.col(f"_n{i}")) for i in range(len(fk["refs"]))])).drop("id")
        rows = self.table(child, state)
        met = rows.alias("c").join(moved.alias("p"), self._match(fk["columns"], [f"_o{i}" for i in range(len(fk["refs"]))]))
        if fk["on_update"] == "RESTRICT":
            if rules.any_row(met):
                raise ConstraintViolation(f"{child} refers to a changed row")
            return
        if not rules.any_row(met):
            return
        at = {c: i for i, c in enumerate(fk["columns"])}
        value = (lambda c: F.col(f"p._n{at[c]}")) if fk["on_update"] == "CASCADE" else lambda c: F.lit(None)
        image = met.select(*[value(f.name).cast(f.dataType).alias(f.name) if f.name in at else F.col(f"c.`{f.name}`") for f in rows.schema])
        self._replace(state, child, rows, met.select("c.*"), image, set(at))

    def delete_rows(self, state: dict, table: str, filters: list[str] | Column | DataFrame | None) -> tuple[DataFrame, int]:
        """The rows as they were before they went, and their number. One pass over the folders that hold them."""
        meta = self.meta(table, state)
        idle, marked = self._touched(state, table, filters)
        doomed = marked.filter(HIT).drop(HIT)
        if len(idle) == len(meta["files"]):
            return doomed, 0
        # Hits are counted where they are dropped.
        seen = Observation()
        left = marked.observe(seen, F.coalesce(F.sum(F.col(HIT).cast("long")), F.lit(0)).alias("n")).filter(~F.col(HIT)).drop(HIT)
        path = self.catalog.write(left, table, meta)
        n = seen.get["n"]
        if not n:
            return doomed, 0
        meta["files"] = [*idle, path]
        for child, m in list(state["tables"].items()):
            for fk in m["fks"]:
                if fk["table"] != table:
                    continue
                now = self.table(child, state)
                met = now.alias("c").join(doomed.alias("p"), self._match(fk["columns"], fk["refs"]), "left_semi")
                if not rules.any_row(met):
                    continue
                if fk["on_delete"] == "RESTRICT":
                    raise ConstraintViolation(f"{child} refers to a row of {table}")
                if fk["on_delete"] == "CASCADE":
                    self.delete_rows(state, child, met)
                else:
                    image = met.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name in fk["columns"] else F.col(f"`{f.name}`") for f in now.schema])
                    self._replace(state, child, now, met, image, set(fk["columns"]))
        return doomed, n

    # --- document API
    def add(self, table: str, row: dict, validator: Callable[[dict], bool] | None = None) -> int:
        if validator is not None and not validator(row):
            raise InvalidArgument("the validator rejects the row")
        with self.change() as state:
            return self.insert_rows(state, table, [row])[0]

    def batch_import(self, table: str, rows: list[dict]) -> int:
        """Without foreign-key checks."""
        with self.change() as state:
            return len(self.insert_rows(state, table, rows, check_fk=False))

    def import_pairs(self, table: str, path: str) -> tuple[int, int]:
        """Lines of key=value text; (imported, bad lines). A column takes the type that its values look like, text if
        they look like several; the rows stay a DataFrame."""
        from lodemill.sources.textio import read_pairs, typed_pairs

        pairs, bad = read_pairs(self.spark, path)
        rows = typed_pairs(pairs)
        if not rows.columns:
            return 0, bad
        with self.change() as state:
            columns = [c for c in rows.columns if c not in RESERVED]
            schema = T.StructType.fromJson(self.meta(table, state)["schema"]) if table in state["tables"] else T.StructType()
            for f in schema:
                own = type_of(f.dataType)
                if f.name in columns and own not in (type_of(rows.schema[f.name].dataType), TEXT, FLOAT):
                    raise TypeMismatch(f"{f.name} takes {own}")
            return self.insert_frame(state, table, rows.select(*columns), columns, check_fk=False)[1], bad

    def find(self, table: str, filters: list[str] = (), order_by: str | None = None, ascending: bool = True, limit: int = 0, offset: int = 0) -> DataFrame:
        """A limit of 0 is none."""
        df = self.table(table)
        df = df.filter(filters_to_column(df.schema, list(filters))) if filters else df
        if order_by is not None:
            c = F.col(f"`{order_by}`")
            df = df.orderBy(c.asc_nulls_first() if ascending else c.desc_nulls_last(), "id")
        df = df.offset(offset) if offset else df
        return df.limit(limit) if limit else df

    def find_one(self, table: str, filters: list[str] = ()) -> dict | None:
        found = self.find(table, filters).limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def find_by_id(self, table: str, id: int) -> dict | None:
        found = self.table(table).filter(F.col("id") == id).limit(1).collect()
        return found[0].asDict(recursive=True) if found else None

    def count(self, table: str, filters: list[str] = ()) -> int:
        return self.find(table, filters).count()

    def update(self, table: str, filters: list[str], values: dict) -> int:
        with self.change() as state:
            return self.update_rows(state, table, list(filters), values)[1]

    def delete(self, table: str, filters: list[str]) -> int:
        with self.change() as state:
            return self.delete_rows(state, table, list(filters))[1]

    def aggregate(self, table: str, stages: list[pipeline.Stage]) -> DataFrame:
        return pipeline.aggregate(self.table(table), stages)

    def lookup(self, from_table: str, local_field: str, foreign_field: str, as_field: str) -> pipeline.Stage:
        return pipeline.lookup(self.table(from_table), local_field, foreign_field, as_field)

    def text_search(self, table: str, query: str, **options: Any) -> DataFrame:
        return search.text_search(self.table(table), query, **options)

    def geo_near(self, table: str, lat: str, lon: str, at: tuple[float, float], max_km: float = 0, limit: int = 0) -> DataFrame:
        return search.geo_near(self.table(table), lat, lon, at, max_km, limit)

    def geo_within_box(self, table: str, lat: str, lon: str, low: tuple[float, float], high: tuple[float, float]) -> DataFrame:
        return search.geo_within_box(self.table(table), lat, lon, low, high)

    def stats(self, table: str) -> dict:
        """``garbage_bytes`` are those of older versions of the table, ``fragmentation`` their share of all its bytes."""
        meta = self.meta(table)
        live, garbage = sum(map(self.catalog.folder_bytes, meta["files"])), self.catalog.garbage_bytes(table, meta)
        return {
            "bytes": live, "rows": self.table(table).count(), "files": len(meta["files"]), "next_id": meta["next_id"],
            "garbage_bytes": garbage, "fragmentation": garbage / (live + garbage) if live + garbage else 0.0,
        }

    def compact(self, table: str, keep_seconds: float = KEEP_SECONDS) -> None:
        """Rewrite a table into files of about FILE_BYTES, and remove what no manifest has named for ``keep_seconds``:
        open readers and transactions go on with the folders that they know."""
        with self.change(schema=True) as state:
            meta = self.meta(table, state)
            size = sum(map(self.catalog.folder_bytes, meta["files"]))
            meta["files"] = [self.catalog.write(self.catalog.read(meta).coalesce(_files(size)), table, meta)] if meta["files"] else []
        self.catalog.collect(keep_seconds)

    # --- SQL
    def exec_sql(self, text: str, params: list | tuple = ()) -> Any:
        from lodemill.plans.statements import execute

        reset_status()
        return execute(self, text, params)


def _kind_of(value: Any) -> T.DataType:
    """Type of a Python value; dicts are objects with a field for each key, what is unknown is text."""
    if isinstance(value, dict):
        return T.StructType([T.StructField(k, _kind_of(v)) for k, v in value.items()])
    if isinstance(value, (list, tuple)):
        return T.ArrayType(_kind_of(next((v for v in value if v is not None), None)))
    return SPARK_TYPES.get(type_of_value(value), T.StringType())


def _files(n_bytes: int) -> int:
    return max(1, -(-n_bytes // FILE_BYTES))


def open_database(spark: SparkSession, root: str, read_only: bool = False) -> Database:
    return Database(spark, root, read_only)


