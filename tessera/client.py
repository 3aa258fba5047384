"""A client in the form of Python's database interface: connections, cursors, rows one after another."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import suppress

from pyspark.sql import functions as F

from tessera import types
from tessera.errors import BadSemantics, DialectError
from tessera.plans import parser
from tessera.plans.engine import Engine

apilevel, threadsafety, paramstyle = "2.0", 1, "qmark"
Error = DialectError


class Connection:
    """A session on an engine; without ``autocommit`` statements are part of one transaction until commit or rollback."""

    def __init__(self, engine: Engine, autocommit: bool = True, isolation: str = "serializable") -> None:
        self.engine, self.autocommit, self.isolation, self.closed = engine, autocommit, isolation, False

    @property
    def read_only(self) -> bool:
        return self.engine.read_only

    @read_only.setter
    def read_only(self, value: bool) -> None:
        self.engine.read_only = value

    def cursor(self) -> Cursor:
        if self.closed:
            raise BadSemantics("the connection is closed")
        return Cursor(self)

    def _open(self) -> None:
        if not self.autocommit and not self.engine.catalog.txn:
            self.engine.catalog.begin(self.isolation)

    def commit(self) -> None:
        if self.engine.catalog.txn:
            changed = self.engine.catalog.txn.pending
            self.engine.catalog.end()
            for table in changed:
                self.engine.follow(table)

    def rollback(self) -> None:
        if self.engine.catalog.txn:
            self.engine.catalog.rollback()

    def close(self) -> None:
        """Changes that were not committed are lost."""
        self.rollback()
        self.closed = True

    def __enter__(self) -> Connection:
        return self

    def __exit__(self, kind: type | None, *_: object) -> None:
        (self.rollback if kind else self.commit)()
        self.close()


class Cursor:
    """Runs statements; ``description`` has (name, type, size) of each column, ``rowcount`` the rows changed."""

    def __init__(self, connection: Connection) -> None:
        self.connection, self.rowcount, self.description = connection, -1, None
        self._df, self._rows, self._held = None, iter(()), None

    def execute(self, text: str, parameters: tuple = ()) -> Cursor:
        from tessera.plans.procedures import quoted

        pieces = _split(text)
        if len(pieces) != len(parameters) + 1:
            raise BadSemantics(f"{len(pieces) - 1} parameters wanted")
        text = pieces[0] + "".join(quoted(v) + rest for v, rest in zip(parameters, pieces[1:]))
        self.connection._open()
        engine = self.connection.engine
        if isinstance(parser.parse(text), parser.Select):
            self._df = engine.sql(text)
            self.description = [(f.name, types.kind_of(f), f.metadata.get("length") or f.metadata.get("dimension"), None, None, None, True) for f in self._df.schema]
            self.rowcount = -1
            self.before_first()
        else:
            self.rowcount, self.description, self._df = engine.execute(text), None, None
        return self

    def callproc(self, name: str, **parameters: object) -> Cursor:
        from tessera.plans.procedures import call

        self.connection._open()
        self._df = call(self.connection.engine, name, **parameters)
        self.description = [(f.name, types.kind_of(f), None, None, None, None, True) for f in self._df.schema]
        self.before_first()
        return self

    def before_first(self) -> None:
        """Reads the result from its beginning again."""
        if self._df is None:
            raise BadSemantics("no result")
        self._rows = (tuple(r) for r in self._df.toLocalIterator())

    def fetchone(self) -> tuple | None:
        return next(self._rows, None)

    def fetchmany(self, size: int = 100) -> list[tuple]:
        return [r for _, r in zip(range(size), self._rows)]

    def fetchall(self) -> list[tuple]:
        return list(self._rows)

    def __iter__(self) -> Iterator[tuple]:
        return self._rows

    def close(self) -> None:
        self._df, self._rows = None, iter(())


def _split(text: str) -> list[str]:
    """The text around question marks that stand outside quotes."""
    out, quotes = [""], False
    for c in text:
        quotes ^= c == "'"
        if c == "?" and not quotes:
            out.append("")
        else:
            out[-1] += c
    return out


def connect(engine: Engine, autocommit: bool = True, isolation: str = "serializable") -> Connection:
    return Connection(engine, autocommit, isolation)


def register_function(engine: Engine, name: str, function: object, prefix: str | None = None, combine: Callable[[object, object], object] | None = None) -> None:
    """A function of the user's: an aggregate of statements if it has a prefix, and a function of Spark's SQL.

    ``function`` is a pandas UDF, so rows go to Python in Arrow batches; with a
    prefix it aggregates a column to one value a group: then Spark brings a whole group
    to one task, unless ``combine`` makes one of two results, with which the function is
    asked of parts of a group where they are.
    """
    from tessera.operators.aggregates import Partial
    from tessera.operators.relational import register_aggregate, register_mergeable

    engine.spark.udf.register(name, function)
    if prefix is not None and combine is not None:
        with suppress(BadSemantics):
            register_mergeable(name, prefix, Partial(function.func, combine, function.returnType))
    elif prefix is not None:
        with suppress(BadSemantics):
            register_aggregate(name, prefix, lambda c: F.call_function(name, c))
