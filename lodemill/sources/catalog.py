"""Versioned Parquet tables behind one manifest.

A table is a list of immutable Parquet folders and its metadata. Nothing is changed in place: a write adds folders,
and one atomic replacement of the manifest makes it visible. A reader, a rollback or a crash only ever sees a whole
manifest; folders that no manifest names are garbage, which ``collect`` removes.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from lodemill.errors import NotFound, ReadOnly, VersionMismatch
from lodemill.sources.files import files_of

FORMAT = [1, 0]
MANAGED = [T.StructField("id", T.LongType()), T.StructField("created_at", T.LongType()), T.StructField("updated_at", T.LongType())]


def new_table() -> dict:
    return {"schema": T.StructType([]).jsonValue(), "columns": {}, "checks": [], "fks": [], "indexes": [], "files": [], "next_id": 1}


class Catalog:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.files, self.read_only = spark, files_of(spark, root), read_only
        if not self.files.has():
            if read_only:
                raise NotFound(f"no database in {root}")
            self.files.make()
        self.load()  # it must be readable

    @property
    def root(self) -> str:
        return self.files.root

    def load(self) -> dict:
        text = self.files.read("manifest.json")
        if text is None:
            return {"format": FORMAT, "version": 0, "tables": {}, "views": {}}
        state = json.loads(text)
        if state["format"][0] != FORMAT[0]:
            raise VersionMismatch(f"format {state['format'][0]}; this reads {FORMAT[0]}")
        return {"version": 0} | state

    def path(self, folder: str) -> str:
        return self.files.path(folder)

    def has(self, folder: str) -> bool:
        return self.files.has(folder)

    def remove(self, folder: str) -> None:
        self.files.remove(folder)

    @contextmanager
    def lock(self) -> Iterator[None]:
        if self.read_only:
            raise ReadOnly("the database was opened for reading")
        with self.files.lock():
            yield

    def publish(self, state: dict) -> None:
        self.files.replace("manifest.json", json.dumps(state | {"version": state["version"] + 1}))

    @staticmethod
    def schema(meta: dict) -> T.StructType:
        return T.StructType(MANAGED + T.StructType.fromJson(meta["schema"]).fields)

    def read(self, meta: dict) -> DataFrame:
        """Columns that a folder lacks are null."""
        schema = self.schema(meta)
        if not meta["files"]:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[self.path(p) for p in meta["files"]])

    def write(self, df: DataFrame, table: str, meta: dict | None = None) -> str:
        """A new folder of rows. Columns with an index of the table get a Bloom filter in every row group, which an
        equality filter looks at before it reads one."""
        folder = f"data/{table}/{uuid.uuid4().hex}"
        writer = df.write
        for c in sorted({c for i in (meta or {}).get("indexes", []) for c in i}):
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
        writer.parquet(self.path(folder))
        return folder

    def collect(self, keep_seconds: float = 0) -> int:
        """Remove folders that the manifest doesn't name and nothing was written to for a time; how many there were."""
        with self.lock():
            named = {p for m in self.load()["tables"].values() for p in m["files"]}
            every = [p for t in self.files.folders("data") for p in self.files.folders(t)]
            old = [p for p in every if p not in named and self.files.age(p) >= keep_seconds]
            for p in old:
                self.remove(p)
        return len(old)

    def folder_bytes(self, folder: str) -> int:
        return self.files.size(folder)

    def garbage_bytes(self, table: str, meta: dict) -> int:
        """Bytes of the folders written for a table that it doesn't name any more."""
        return sum(self.folder_bytes(p) for p in self.files.folders(f"data/{table}") if p not in meta["files"])
