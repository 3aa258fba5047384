"""Tables, views and indexes by name.

A stored table is a list of Parquet files named by a manifest; each change
writes new files and then a new manifest, so readers see whole versions and a
lost writer leaves nothing behind that is read.  Updates and deletes rewrite
only the files that hold rows they touch.  External tables are DataFrames put
in by the caller and can't be changed.

A transaction reads the versions it first saw and keeps its changes to itself.  At
its end it writes the manifests of all tables it changed, which count only once
one file that ends the transaction is there: all or nothing, also after a crash.
The second of two writers of a table gets a conflict; ``serializable`` ones also
get it where a table they only read has changed.

Views are kept as their texts, indexes of stored tables as numbered states, beside the
manifests: every session of the same root has them.  A view over an external table
can be read where that table is registered; indexes of external tables are the session's own.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types
from tessera.errors import BadSemantics, Conflict
from tessera.plans import parser
from tessera.plans.parser import Select
from tessera.sources.files import scratch

LONGEST_NAME = 30


class Folder:
    """A folder on any file system Spark reads."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs
        self.at = self.fs.Path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def _path(self, name: str):
        return self.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, sub: str = "") -> list[str]:
        p = self._path(sub)
        return sorted(s.getPath().getName() for s in self.at.listStatus(p)) if self.at.exists(p) else []

    def read(self, name: str) -> str:
        stream = self.at.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def commit(self, name: str, text: str) -> None:
        """Creates a file whole, or raises if there is one."""
        draft = f"_{uuid.uuid4().hex}"
        stream = self.at.create(self._path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        if self.at.exists(self._path(name)) or not self.at.rename(self._path(draft), self._path(name)):
            self.at.delete(self._path(draft), False)
            raise Conflict(f"{name} is there already")

    def remove(self, name: str = "") -> None:
        self.at.delete(self._path(name), True)


ISOLATION = ("serializable", "repeatable read", "read committed")


@dataclass
class Transaction:
    isolation: str
    pending: dict[str, dict] = field(default_factory=dict)  # manifests to be, by table
    seen: dict[str, int] = field(default_factory=dict)  # versions read first
    written: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Index:
    table: str
    columns: tuple[str, ...]
    kind: str
    number: int = 0  # of its newest state; 0: only this session has it


@dataclass
class Catalog:
    spark: SparkSession
    root: str = ""
    external: dict[str, DataFrame] = field(default_factory=dict)
    own_indexes: dict[str, Index] = field(default_factory=dict)  # of external tables
    txn: Transaction | None = None
    _known: set[tuple[str, int]] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.root = self.root or f"{scratch(self.spark)}/tables-{uuid.uuid4().hex}"

    # ---- names

    def folder(self, table: str) -> Folder:
        return Folder(self.spark, f"{self.root}/{table}")

    def stored(self) -> list[str]:
        there = Folder(self.spark, self.root).names()
        return [t for t in sorted({*there, *(self.txn.pending if self.txn else ())}) if self.versions(t)]

    def is_stored(self, table: str) -> bool:
        return table not in self.external and bool(self.versions(table))

    def has(self, name: str) -> bool:
        return name in self.external or self.view(name) is not None or bool(self.versions(name))

    def fresh(self, name: str) -> str:
        if len(name) > LONGEST_NAME:
            raise BadSemantics(f"a name of over {LONGEST_NAME} characters: {name}")
        if self.has(name):
            raise BadSemantics(f"{name} is there already")
        return name

    # ---- snapshots

    def versions(self, table: str) -> list[int]:
        found = sorted(int(m[1]) for n in self.folder(table).names() if (m := re.fullmatch(r"v(\d+)\.json", n)))
        # only the newest can belong to a transaction that has not ended
        while found and not self._counts(table, found[-1]):
            found.pop()
        if self.txn and table in self.txn.pending:
            found.append(self.txn.pending[table]["base"] + 1)
        return found

    def _counts(self, table: str, version: int) -> bool:
        if (table, version) not in self._known:
            owner = json.loads(self.folder(table).read(f"v{version:09d}.json")).get("transaction")
            if owner and owner not in self._ended().names():
                return False
            self._known.add((table, version))
        return True

    def _ended(self) -> Folder:
        return Folder(self.spark, f"{self.root}/_transactions")

    def manifest(self, table: str, version: int | None = None) -> dict:
        if version is None:
            if self.txn and table in self.txn.pending:
                return self.txn.pending[table] | {"version": self.txn.pending[table]["base"]}
            version = max(self.versions(table))
            if self.txn:
                first = self.txn.seen.setdefault(table, version)
                version = version if self.txn.isolation == "read committed" else first
        return json.loads(self.folder(table).read(f"v{version:09d}.json")) | {"version": version}

    def commit(self, table: str, schema: T.StructType, files: list[str], after: int) -> None:
        """The next version, unless another writer was first; within a transaction, when that ends."""
        made = {"schema": schema.jsonValue(), "files": files}
        if self.txn:
            self.txn.pending[table] = made | {"base": after}
        else:
            self.folder(table).commit(f"v{after + 1:09d}.json", json.dumps(made))

    def begin(self, isolation: str = "serializable") -> None:
        if self.txn:
            raise BadSemantics("a transaction is open")
        if isolation not in ISOLATION:
            raise BadSemantics(f"no isolation {isolation}")
        self.txn = Transaction(isolation)

    def end(self) -> None:
        """Commits all changes of the open transaction, or raises a conflict and leaves none."""
        txn, self.txn = self.txn, None
        done: list[tuple[str, str]] = []
        try:
            if txn.isolation == "serializable" and txn.pending:
                for table, version in txn.seen.items():
                    if max(self.versions(table), default=-1) != version:
                        raise Conflict(f"{table} has changed")
            ident = uuid.uuid4().hex
            for table, m in txn.pending.items():
                name = f"v{m['base'] + 1:09d}.json"
                self.folder(table).commit(name, json.dumps({k: m[k] for k in ("schema", "files")} | {"transaction": ident}))
                done.append((table, name))
            if txn.pending:
                self._ended().commit(ident, "")
        except BaseException:
            for table, name in done:
                self.folder(table).remove(name)
            self._forget(txn)
            raise

    def rollback(self) -> None:
        txn, self.txn = self.txn, None
        self._forget(txn)

    def _forget(self, txn: Transaction) -> None:
        for path in txn.written:
            Folder(self.spark, path).remove()

    @contextmanager
    def transaction(self, isolation: str = "serializable") -> Iterator[Catalog]:
        self.begin(isolation)
        try:
            yield self
        except BaseException:
            self.rollback()
            raise
        self.end()

    def recover(self) -> list[str]:
        """Removes what lost writers left, manifests and data that no version names; to be called while nobody writes."""
        gone = []
        for table in Folder(self.spark, self.root).names():
            if table.startswith("_"):
                continue
            folder, kept = self.folder(table), self.versions(table)
            names = folder.names()
            used = {f.split(f"/{table}/", 1)[1].split("/")[0] for v in kept for f in json.loads(folder.read(f"v{v:09d}.json"))["files"]}
            for n in names:
                m = re.fullmatch(r"v(\d+)\.json", n)
                if m and int(m[1]) not in kept or n.startswith("data-") and n not in used or re.fullmatch("_[0-9a-f]{32}", n):
                    folder.remove(n)
                    gone.append(f"{table}/{n}")
        named = {self.index_state(n, i.number)["layout"]["path"].rsplit("/", 1)[1] for n, i in self.indexes.items() if i.number}
        folder = self._definitions("indexes")
        for n in folder.names():
            if n not in named and n.rsplit("-", 1)[0] not in self.own_indexes:
                folder.remove(n)
                gone.append(f"_indexes/{n}")
        return gone

    def write(self, table: str, df: DataFrame) -> list[str]:
        """New files of a table, not yet part of any version."""
        path = f"{self.root}/{table}/data-{uuid.uuid4().hex}"
        if self.txn:
            self.txn.written.append(path)
        df.write.parquet(path)
        return [f"{path}/{n}" for n in Folder(self.spark, path).names() if n.startswith("part-")]

    def schema(self, table: str) -> T.StructType:
        if table in self.external:
            return self.external[table].schema
        return T.StructType.fromJson(self.manifest(table)["schema"])

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A stored table as of a version, or an external one."""
        if table in self.external:
            return self.external[table]
        m = self.manifest(table, version)
        schema = T.StructType.fromJson(m["schema"])
        # names of fields decide, as files of different versions may be ordered differently
        return self.spark.read.schema(schema).parquet(*m["files"]) if m["files"] else self.spark.createDataFrame([], schema)

    # ---- definitions

    def register(self, name: str, df: DataFrame) -> None:
        self.external[name.lower()] = df.toDF(*(c.lower() for c in df.columns))

    def create(self, table: str, schema: T.StructType) -> None:
        self.commit(self.fresh(table), schema, [], -1)

    def _definitions(self, kind: str) -> Folder:
        return Folder(self.spark, f"{self.root}/_{kind}")

    @property
    def views(self) -> dict[str, tuple[Select, str]]:
        folder = self._definitions("views")
        texts = {n.removesuffix(".sql"): folder.read(n) for n in folder.names() if n.endswith(".sql")}
        return {n: (parser.parse(t), t) for n, t in texts.items()}

    def view(self, name: str) -> Select | None:
        folder = self._definitions("views")
        return parser.parse(folder.read(f"{name}.sql")) if f"{name}.sql" in folder.names() else None

    def create_view(self, name: str, text: str) -> None:
        """Keeps the text of its query, unless another session was first."""
        self._definitions("views").commit(f"{self.fresh(name)}.sql", text)

    @property
    def indexes(self) -> dict[str, Index]:
        out = dict(self.own_indexes)
        for name in self._definitions("states").names():
            if number := self._newest(name):
                state = self.index_state(name, number)
                out[name] = Index(state["table"], tuple(state["columns"]), state["kind"], number)
        return out

    def _newest(self, index: str) -> int:
        return max((int(m[1]) for n in self._definitions(f"states/{index}").names() if (m := re.fullmatch(r"s(\d+)\.json", n))), default=0)

    def index_state(self, name: str, number: int) -> dict:
        return json.loads(self._definitions(f"states/{name}").read(f"s{number:09d}.json"))

    def publish(self, name: str, index: Index, state: dict) -> Index:
        """The next state of an index, or a conflict if another session has published one since."""
        folder, made = self._definitions(f"states/{name}"), Index(index.table, index.columns, index.kind, index.number + 1)
        folder.commit(f"s{made.number:09d}.json", json.dumps({"table": made.table, "columns": made.columns, "kind": made.kind, "layout": state}))
        for n in folder.names():
            if (m := re.fullmatch(r"s(\d+)\.json", n)) and int(m[1]) < index.number:  # the one before may be being read
                folder.remove(n)
        return made

    def _forget_index(self, name: str) -> None:
        """The index and its files."""
        if self.own_indexes.pop(name, None) is None:
            self._definitions(f"states/{name}").remove()
        folder = self._definitions("indexes")
        for n in folder.names():
            if n.rsplit("-", 1)[0] == name:
                folder.remove(n)

    def drop_table(self, table: str) -> None:
        """The table, its indexes and the views over it, and views over those."""
        if table not in self.external and not self.versions(table):
            raise BadSemantics(f"no table {table}")
        if self.txn:
            raise BadSemantics("tables are dropped outside transactions")
        for n, i in self.indexes.items():
            if i.table == table:
                self._forget_index(n)
        gone, views = {table}, self.views
        while more := {v for v, (q, _) in views.items() if set(q.tables) & gone}:
            for v in more:
                self._definitions("views").remove(f"{v}.sql")
                del views[v]
            gone |= more
        if self.external.pop(table, None) is None:
            self.folder(table).remove()

    def drop(self, what: str, name: str) -> None:
        if what == "table":
            return self.drop_table(name)
        if name not in (self.views if what == "view" else self.indexes):
            raise BadSemantics(f"no {what} {name}")
        if what == "view":
            self._definitions("views").remove(f"{name}.sql")
        else:
            self._forget_index(name)

    # ---- the catalog as tables

    def tables(self) -> dict[str, DataFrame]:
        """tblcat, fldcat, viewcat, idxcat and idxkeycat."""
        known = sorted({*self.external, *self.stored()})
        make = self.spark.createDataFrame
        return {
            "tblcat": make([(t,) for t in known], "tblname string"),
            "fldcat": make([(t, f.name, *types.declaration(f)) for t in known for f in self.schema(t)], "tblname string, fldname string, type string, typearg int"),
            "viewcat": make([(v, text) for v, (_, text) in sorted(self.views.items())], "viewname string, viewdef string"),
            "idxcat": make([(n, i.table, i.kind) for n, i in sorted(self.indexes.items())], "idxname string, tblname string, idxtype string"),
            "idxkeycat": make([(n, c) for n, i in sorted(self.indexes.items()) for c in i.columns], "idxname string, keyname string"),
        }


def touched_files(df: DataFrame, condition) -> dict[str, int]:
    """Files with rows that meet a condition, and how many: a row a file reaches the driver."""
    rows = df.where(F.coalesce(condition, F.lit(False))).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return {r.f: r.n for r in rows.collect()}
