"""The files of a database: on the driver's own file system, or on any that Hadoop knows.

A manifest is replaced by one rename. On stores whose rename does not replace, the old manifest moves aside first, and a
reader takes the newest of both; a lock file that one writer at a time can create keeps writers apart.
"""

from __future__ import annotations

import fcntl
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from lodemill.errors import Locked

#: Seconds after which a lock file that its writer left behind counts no more.
STALE_LOCK = 6 * 3600


class LocalFiles:
    def __init__(self, root: str):
        self.root = root.removeprefix("file://").removeprefix("file:") if root.startswith("file:") else root

    def path(self, name: str) -> str:
        return os.path.join(self.root, name)

    def has(self, name: str = "") -> bool:
        return os.path.exists(self.path(name))

    def make(self) -> None:
        os.makedirs(self.root)

    def remove(self, name: str) -> None:
        shutil.rmtree(self.path(name))

    def read(self, name: str) -> str | None:
        try:
            with open(self.path(name)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def replace(self, name: str, text: str) -> None:
        """Write beside the file, flush to disk, replace it, and flush the folder."""
        beside = f"{self.path(name)}.{uuid.uuid4().hex}"
        with open(beside, "w") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(beside, self.path(name))
        folder = os.open(self.root, os.O_RDONLY)
        try:
            os.fsync(folder)
        finally:
            os.close(folder)

    @contextmanager
    def lock(self) -> Iterator[None]:
        with open(self.path(".lock"), "w") as f:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
            except OSError:
                raise Locked("another process is writing") from None
            yield

    def folders(self, name: str) -> list[str]:
        top = self.path(name)
        return sorted(f"{name}/{d}" for d in os.listdir(top) if os.path.isdir(os.path.join(top, d))) if os.path.isdir(top) else []

    def size(self, name: str) -> int:
        return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(self.path(name)) for f in names)

    def age(self, name: str) -> float:
        """Seconds since something was written to a folder."""
        return time.time() - os.path.getmtime(self.path(name))


class HadoopFiles:
    def __init__(self, spark: SparkSession, root: str):
        self.root, self.jvm = root.rstrip("/"), spark._jvm
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.path(name))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def has(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def make(self) -> None:
        self.fs.mkdirs(self._at(""))

    def remove(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def read(self, name: str) -> str | None:
        for found in (name, f"{name}.old"):
            if self.has(found):
                stream = self.fs.open(self._at(found))
                try:
                    return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
                finally:
                    stream.close()
        return None

    def replace(self, name: str, text: str) -> None:
        beside = f"{name}.{uuid.uuid4().hex}"
        out = self.fs.create(self._at(beside), False)
        try:
            out.write(bytearray(text.encode()))
            out.hsync()
        finally:
            out.close()
        if self.has(name):
            self.remove(f"{name}.old")
            self.fs.rename(self._at(name), self._at(f"{name}.old"))
        if not self.fs.rename(self._at(beside), self._at(name)):
            raise OSError(f"{self.path(name)} can't be replaced")

    @contextmanager
    def lock(self) -> Iterator[None]:
        if self.has(".lock") and time.time() - self.fs.getFileStatus(self._at(".lock")).getModificationTime() / 1000 > STALE_LOCK:
            self.remove(".lock")
        if not self.fs.createNewFile(self._at(".lock")):
            raise Locked("another process is writing")
        try:
            yield
        finally:
            self.remove(".lock")

    def folders(self, name: str) -> list[str]:
        if not self.has(name):
            return []
        return sorted(f"{name}/{x.getPath().getName()}" for x in self.fs.listStatus(self._at(name)) if x.isDirectory())

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self._at(name)).getLength() if self.has(name) else 0

    def age(self, name: str) -> float:
        return time.time() - self.fs.getFileStatus(self._at(name)).getModificationTime() / 1000


def files_of(spark: SparkSession, root: str) -> LocalFiles | HadoopFiles:
    """By the scheme of the folder's name; without one it is local."""
    scheme = root.partition("://")[0] if "://" in root else ""
    return HadoopFiles(spark, root) if scheme not in ("", "file") else LocalFiles(root)
