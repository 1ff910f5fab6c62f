"""One exception class for each kind of failure."""

from __future__ import annotations

import threading


#: The class of the last error of this thread since its last statement began.
_last = threading.local()


def last_status() -> str:
    """Name of the error class of this thread's last statement, or OK."""
    return getattr(_last, "status", "OK")


def reset_status() -> None:
    _last.status = "OK"


class LodemillError(Exception):
    """Base of all errors that this package raises by itself."""

    def __init__(self, *args: object):
        super().__init__(*args)
        _last.status = type(self).__name__


class SyntaxProblem(LodemillError):
    """A statement or filter that can't be read."""


class InvalidArgument(LodemillError):
    """A value out of its range, or a combination that has no meaning."""


class NotFound(LodemillError):
    """A table, column, view, index or savepoint that isn't there."""


class AlreadyExists(LodemillError):
    """A table, column, view, index or savepoint that is there already."""


class ConstraintViolation(LodemillError):
    """NOT NULL, UNIQUE, CHECK or a foreign key."""


class TypeMismatch(LodemillError):
    """A value that doesn't convert to the wanted type."""


class ReadOnly(LodemillError):
    """A write to a database that was opened for reading."""


class Locked(LodemillError):
    """Another process is writing."""


class VersionMismatch(LodemillError):
    """Data of another major format version."""


class TransactionError(LodemillError):
    """A transaction statement out of place, or a transaction that an earlier failure has spoilt."""
