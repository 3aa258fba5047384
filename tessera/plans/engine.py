"""Statements to DataFrames and snapshots.

A query is put together in one order: tables, joins, WHERE, GROUP BY, ORDER BY,
columns, LIMIT.  Everything is declared lazily, so Catalyst pushes filters and
columns into scans, orders joins and fuses orders with limits.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import types
from tessera.errors import BadSemantics, Conflict
from tessera.functions import arithmetic, vectors
from tessera.operators import knn, layouts, relational, statistics
from tessera.operators.predicates import Constant, Name, Operand, Predicate, Term, column
from tessera.plans import parser
from tessera.plans.catalog import LONGEST_NAME, Catalog, Index, touched_files


#: Files whose rows an index leaves out when it is read; with more it is built anew.
MOST_DEAD = 1000


class Engine:
    """A session of the dialect.

    ``reference_order`` gives columns alphabetically, ``strict_empty`` no row
    for a global aggregate of nothing, ``similarity`` orders <COS> by cosine
    similarity, least similar first, instead of by cosine distance.  With
    ``exact`` an ordering by distance gives the true nearest rows even where an
    ivf index could give near ones.
    """

    def __init__(self, spark: SparkSession, root: str = "", *, reference_order: bool = False, strict_empty: bool = False, similarity: bool = False, read_only: bool = False, tie: str | None = None, exact: bool = False) -> None:
        self.spark = spark
        self.catalog = Catalog(spark, root)
        self.reference_order, self.strict_empty, self.similarity, self.read_only = reference_order, strict_empty, similarity, read_only
        self.tie = tie  # a column that breaks ties of every distance ordering
        self.built: dict[str, layouts.Layout] = {}
        self.exact = exact
        self.used: list[str] = []  # indexes the last query read
        self.cells_read: tuple[int, int] | None = None  # cells that the last query read, and those there are
        self.buckets_read: dict[str, tuple[int, int]] = {}  # the same of buckets that its joins read, by index
        self.published: dict[str, int] = {}  # numbers of the states in ``built``
        self.statistics = statistics.Manager(self.table)

    # ---- use

    def register(self, name: str, df: DataFrame) -> None:
        self.catalog.register(name, df)

    def sql(self, text: str) -> DataFrame:
        """A query's rows; EXPLAIN gives one row with the plan."""
        statement = parser.parse(text)
        if not isinstance(statement, parser.Select):
            raise BadSemantics("not a query; use execute()")
        return self.query(statement)

    def sql_each(self, text: str, asked: DataFrame, vector: str) -> DataFrame:
        """A prepared statement for every row of ``asked``, whose first column names the row: query_id, id and rank.

        The statement is ``select id from table order by column <EUC> ? limit k``, and the question mark stands for the row's
        ``vector``.  All are one plan, whatever their number, that reads what each would alone; ties go by id.
        """
        if text.count("?") != 1:
            raise BadSemantics("a prepared statement has one question mark")
        first = asked.select(vector).first()
        q = parser.parse(text.replace("?", "[" + ", ".join(map(repr, map(float, first[0] if first else [0.0]))) + "]"))
        near = q.order[0].by if isinstance(q, parser.Select) and len(q.order) == 1 else None
        if not isinstance(near, parser.Near) or near.distance != "euclidean" or not q.limit or len(q.tables) != 1 or len(q.columns) != 1 or q.where.terms or q.group is not None or q.explain:
            raise BadSemantics("an id of the nearest rows of one table, by Euclidean distance and with a limit, can be prepared")
        df = self.table(q.tables[0])
        self._verify(q, {f.name: f for f in df.schema})
        self.used, self.cells_read, self.buckets_read = [], None, {}
        queries = asked.select(F.col(f"`{asked.columns[0]}`").alias("query_id"), F.col(f"`{vector}`").alias(near.column))
        for name, x in sorted(self._fresh(q.tables[0]).items()):
            if not self.exact and isinstance(x, layouts.Cells) and x.columns == (near.column,) and x.index is not None and x.index.id_column == q.columns[0]:
                self.used.append(name)
                return x.near_each(queries, q.limit, "query_id").select("query_id", "id", "rank")
        return knn.knn_batch(df, queries, q.limit, near.distance, q.columns[0], near.column, "query_id").select("query_id", "id", "rank")

    def execute(self, text: str) -> int:
        """Runs a statement that changes something; the number of rows it changed."""
        statement = parser.parse(text)
        if isinstance(statement, parser.Select):
            raise BadSemantics("a query; use sql()")
        if self.read_only:
            raise BadSemantics("this session only reads")
        return {
            parser.Insert: self._insert, parser.Delete: self._delete, parser.Update: self._update, parser.CreateTable: self._create_table,
            parser.CreateView: self._create_view, parser.CreateIndex: self._create_index, parser.Drop: lambda s: self.catalog.drop(s.what, s.name) or 0,
        }[type(statement)](statement)

    def rows(self, text: str) -> Iterator[T.Row]:
        return self.sql(text).toLocalIterator()

    def explain(self, text: str) -> str:
        return relational.explain(self.query(parser.parse(text)), count=False).first()[0]

    # ---- queries

    def table(self, name: str) -> DataFrame:
        if view := self.catalog.view(name):
            return self.query(view)
        if name in self.catalog.external or self.catalog.versions(name):
            return self.catalog.read(name)
        catalog = self.catalog.tables() if name in ("tblcat", "fldcat", "viewcat", "idxcat", "idxkeycat") else {}
        if name in catalog:
            return catalog[name]
        raise BadSemantics(f"no table or view {name}")

    def query(self, q: parser.Select) -> DataFrame:
        inputs = [self.table(t) for t in q.tables]
        fields: dict[str, T.StructField] = {}
        for df in inputs:
            for f in df.schema:
                if f.name in fields:
                    raise BadSemantics(f"column {f.name} is in more than one table")
                fields[f.name] = f
        self._verify(q, fields)
        self.used, self.cells_read, self.buckets_read = [], None, {}
        where = q.where.closed()
        paths = [self._path(i, inputs, where, q) for i in range(len(inputs))]
        df = self._join(self._meeting(q, inputs, paths, where), where)
        if q.group is not None or q.aggregates:
            df = relational.group_by(df, q.group or (), [(a.fn, a.column) for a in q.aggregates], self.strict_empty)
        keys = [k for s in q.order for k in self._sort_keys(s)]
        if self.tie and any(isinstance(s.by, parser.Near) for s in q.order) and self.tie in df.columns:
            keys.append((F.col(self.tie), True))
        if keys:
            df = relational.order(df, keys)
        names = [relational.aggregate_name(c.fn, c.column) if isinstance(c, parser.Aggregate) else c for c in q.columns]
        df = relational.project(df, names, self.reference_order)
        if q.limit is not None:
            df = df.limit(q.limit)
        return relational.explain(df) if q.explain else df

    def _fresh(self, table: str) -> dict[str, layouts.Layout]:
        """The indexes of a table that show all of its rows as they are."""
        own = {n: x for n, i in self.catalog.indexes.items() if i.table == table and (x := self._opened(n, i))}
        if not own or table in self.catalog.external:
            return own
        if self.catalog.txn and table in self.catalog.txn.pending:
            return {}
        version = self.catalog.manifest(table)["version"]
        return {n: x for n, x in own.items() if x.version == version}

    def _opened(self, name: str, index: Index) -> layouts.Layout | None:
        """An index as its newest state says, whichever session published that; None while one is being built."""
        if index.number and self.published.get(name) != index.number:
            made = layouts.KINDS[index.kind](self.spark, index.columns, "", self.catalog.schema(index.table))
            made.reopen(self.catalog.index_state(name, index.number)["layout"])
            self.built[name], self.published[name] = made, index.number
        return self.built.get(name)

    def _publish(self, name: str, index: Index, made: layouts.Layout) -> None:
        """Makes a state of an index the one that sessions read; that of an external table stays with this one."""
        if index.table in self.catalog.external:
            self.catalog.own_indexes[name] = index
        else:
            self.published[name] = self.catalog.publish(name, index, made.state()).number
        self.built[name] = made

    def _meeting(self, q: parser.Select, inputs: list[DataFrame], paths: list[DataFrame], where: Predicate) -> list[DataFrame]:
        """A table with a hash index of all its columns that an equality links to another is read by that index's buckets."""
        out = list(paths)
        for i, df in enumerate(inputs):
            if len(inputs) == 1 or paths[i] is not df:
                continue
            for name, x in sorted(self._fresh(q.tables[i]).items()):
                keys = isinstance(x, layouts.Hashed) and self._linked(x.columns, df, [(d, p) for j, (d, p) in enumerate(zip(inputs, paths)) if j != i], where)
                if keys:
                    other, names = keys
                    out[i], read = x.meeting(relational.select(other, where.on(other.columns)), names)
                    self.used.append(name)
                    self.buckets_read[name] = read, x.buckets
                    break
        return out

    def _linked(self, columns: tuple[str, ...], df: DataFrame, others: list[tuple[DataFrame, DataFrame]], where: Predicate) -> tuple[DataFrame, list[str]] | None:
        """The first other table with a column of the same type equal to each of the columns, and those columns."""
        kind = lambda d, c: d.schema[c].dataType
        for other, path in others:
            names = [next((n for n in sorted(where.equated(c)) if n in other.columns and kind(other, n) == kind(df, c)), None) for c in columns]
            if all(names) and not any(kind(df, c).typeName() in ("float", "double", "array") for c in columns):
                return path, names
        return None

    def _path(self, i: int, inputs: list[DataFrame], where: Predicate, q: parser.Select) -> DataFrame:
        """The rows of a table that a query can need: by the index that covers the most of its terms, or all."""
        table, df = q.tables[i], inputs[i]
        own = self._fresh(table)
        if not own:
            return df
        near = q.order[0].by if q.order and isinstance(q.order[0].by, parser.Near) else None
        if near and near.distance == "euclidean" and q.limit and q.group is None and not q.aggregates and near.column in df.columns:
            for name, x in sorted(own.items()):
                if isinstance(x, layouts.Cells) and x.columns == (near.column,) and x.index is not None:
                    self.used.append(name)
                    if len(q.tables) == 1 and not where.terms and not self.exact:
                        return x.near(near.query, q.limit)
                    passed = lambda rows: self._join([rows if j == i else d for j, d in enumerate(inputs)], where)
                    rows, cells = x.browse(near.query, q.limit, where.on(df.columns), passed)
                    self.cells_read = cells, len(x.index.centroids)
                    return rows
        mine = where.on(df.columns)
        kinds = {n: (self.catalog.indexes[n].kind, x.columns) for n, x in own.items()}
        best = layouts.best(kinds, mine)
        if best is None or own[best].expected(mine) > 0.5:
            return df
        self.used.append(best)
        return own[best].lookup(mine)

    def _join(self, inputs: list[DataFrame], where: Predicate) -> DataFrame:
        """Joins tables that a term links before those that none does; other terms filter as soon as they can."""
        left, waiting = inputs[0], list(inputs[1:])
        used: set[Term] = set()
        own = where.on(left.columns)
        left, used = relational.select(left, own), used | set(own.terms)
        while waiting:
            linked = next((d for d in waiting if where.between(left.columns, d.columns).terms), waiting[0])
            waiting.remove(linked)
            own, both = where.on(linked.columns), where.between(left.columns, linked.columns)
            left = relational.theta_join(left, relational.select(linked, own), both)
            used |= {*own.terms, *both.terms}
        rest = [t for t in where.terms if t not in used]
        return relational.select(left, Predicate(tuple(rest))) if rest else left

    def _sort_keys(self, s: parser.Sort) -> list[tuple[Column, bool]]:
        if isinstance(s.by, parser.Near):
            name = "cosine_similarity" if s.by.distance == "cosine" and self.similarity else s.by.distance
            return [(vectors.distance(name, F.col(s.by.column), vectors.literal(s.by.query)), True)]
        name = relational.aggregate_name(s.by.fn, s.by.column) if isinstance(s.by, parser.Aggregate) else s.by
        return [(F.col(f"`{name}`"), s.ascending)]

    # ---- verification

    def _kind(self, operand: Operand, fields: dict[str, T.StructField]) -> str:
        if isinstance(operand, Constant):
            return operand.kind
        if operand.name not in fields:
            raise BadSemantics(f"no column {operand.name}")
        return types.kind_of(fields[operand.name])

    def _verify_terms(self, where: Predicate, fields: dict[str, T.StructField]) -> None:
        for t in where.terms:
            a, b = self._kind(t.left, fields), self._kind(t.right, fields)
            if a != b and not (types.is_number(a) and types.is_number(b)):
                raise BadSemantics(f"{a} compared with {b}")
            if a == "vector" and t.op != "=":
                raise BadSemantics("vectors have no order")

    def _verify(self, q: parser.Select, fields: dict[str, T.StructField]) -> None:
        def known(name: str) -> str:
            return self._kind(Name(name), fields)

        self._verify_terms(q.where, fields)
        grouped = q.group is not None or bool(q.aggregates)
        for g in q.group or ():
            known(g)
        for a in q.aggregates:
            kind = known(a.column)
            if kind == "vector" and a.fn not in ("count", "count_distinct") or a.fn in relational.NUMERIC and not types.is_number(kind):
                raise BadSemantics(f"no {a.fn} of a {kind}")
        for c in q.columns:
            if isinstance(c, str):
                known(c)
                if grouped and c not in (q.group or ()):
                    raise BadSemantics(f"{c} is neither grouped nor aggregated")
        for s in q.order:
            if isinstance(s.by, parser.Aggregate):
                if s.by not in q.aggregates:
                    raise BadSemantics("an ordering aggregate must be selected")
                continue
            name = s.by.column if isinstance(s.by, parser.Near) else s.by
            kind = known(name)
            if grouped and name not in (q.group or ()):
                raise BadSemantics(f"{name} is not there to order by")
            if (kind == "vector") != isinstance(s.by, parser.Near):
                raise BadSemantics(f"{name} is a {kind}")
            size = fields[name].metadata.get("dimension") if isinstance(s.by, parser.Near) else None
            if size is not None and size != len(s.by.query):
                raise BadSemantics(f"{name} has dimension {size}")

    # ---- changes

    @contextmanager
    def transaction(self, isolation: str = "serializable") -> Iterator[Catalog]:
        """All changes in it are one, or none; indexes follow when it has ended."""
        with self.catalog.transaction(isolation) as catalog:
            changed = catalog.txn.pending
            yield catalog
        for table in changed:
            self.follow(table)

    def follow(self, table: str) -> None:
        """Brings the indexes of a table to its newest version, whichever sessions changed it.

        The files that two versions do not share say which rows went and came.  Of
        two sessions that do so at once, the first state counts.  Within a transaction
        indexes are not read of tables that it has changed, and follow when it ends.
        """
        if self.catalog.txn:
            return
        for name, i in self.catalog.indexes.items():
            if i.table == table and i.number:
                self._catch_up(name, i)

    def _catch_up(self, name: str, i: Index) -> None:
        x, new = self._opened(name, i), self.catalog.manifest(i.table)
        if x.version == new["version"]:
            return
        before, now = set(self.catalog.manifest(i.table, x.version)["files"]), set(new["files"])
        gone = sorted(f.rsplit("/", 1)[1] for f in before - now)
        try:
            if len(x.dead) + len(gone) > MOST_DEAD:
                return self._build(name, i)
            came = self.spark.read.schema(self.catalog.schema(i.table)).parquet(*sorted(now - before)) if now - before else None
            x.follow(gone, came, new["version"])
            self._publish(name, i, x)
        except Conflict:  # another session was first: its state is read next
            self.built.pop(name, None)
            self.published.pop(name, None)

    def _own(self, table: str) -> dict[str, T.StructField]:
        if self.read_only:
            raise BadSemantics("this session only reads")
        if table in self.catalog.external:
            raise BadSemantics(f"{table} is not stored here")
        if self.catalog.view(table) or not self.catalog.versions(table):
            raise BadSemantics(f"no table {table}")
        return {f.name: f for f in self.catalog.schema(table)}

    def _insert(self, s: parser.Insert) -> int:
        fields = self._own(s.table)
        if len(s.columns) != len(s.values) or sorted(s.columns) != sorted(fields):
            raise BadSemantics(f"each column of {s.table} needs one value")
        row = [types.written(column(v), fields[c], v.kind).alias(c) for c, v in zip(s.columns, s.values)]
        return self.insert(s.table, self.spark.range(1).select(*row))

    def insert(self, table: str, df: DataFrame) -> int:
        """Appends rows in bulk: only new files are written."""
        fields = self._own(table)
        m = self.catalog.manifest(table)
        kinds = {f.name: types.kind_of(f) for f in df.schema}
        if set(kinds) != set(fields):
            raise BadSemantics(f"each column of {table} needs a value")
        rows = df.select(*(types.written(F.col(c), f, kinds[c]).alias(c) for c, f in fields.items()))
        files = self.catalog.write(table, rows)
        schema = T.StructType(list(fields.values()))
        n = self.spark.read.schema(schema).parquet(*files).count() if files else 0
        self.catalog.commit(table, schema, m["files"] + files, m["version"])
        self.follow(table)
        if files:
            self.statistics.added(table, self.spark.read.schema(schema).parquet(*files), n)
        return n

    def _delete(self, s: parser.Delete) -> int:
        return self._rewrite(s.table, s.where, None)

    def _update(self, s: parser.Update) -> int:
        fields = self._own(s.table)
        changes: dict[str, Column] = {}
        for target, value in s.changes:
            if target not in fields or target in changes:
                raise BadSemantics(f"{target} can't be set")
            if isinstance(value, parser.Arithmetic):
                made, kind = arithmetic.apply(value.op, column(value.left), self._kind(value.left, fields), column(value.right), self._kind(value.right, fields))
            else:
                made, kind = column(value), self._kind(value, fields)
            changes[target] = types.written(made, fields[target], kind)
        return self._rewrite(s.table, s.where, changes)

    def _rewrite(self, table: str, where: Predicate, changes: dict[str, Column] | None) -> int:
        """A new version without the rows that meet the predicate, or with them changed; all from the old rows."""
        fields = self._own(table)
        self._verify_terms(where, fields)
        m = self.catalog.manifest(table)
        schema = T.StructType(list(fields.values()))
        if not m["files"]:
            return 0
        met = F.coalesce(where.column(), F.lit(False))
        touched = {f.rsplit("/", 1)[1]: n for f, n in touched_files(self.catalog.read(table), met).items()}
        if not touched:
            return 0
        old = [f for f in m["files"] if f.rsplit("/", 1)[1] in touched]
        df = self.spark.read.schema(schema).parquet(*old)
        if changes is None:
            df = df.where(~met)
        else:
            df = df.withColumn("_met", met).select(*(F.when(F.col("_met"), changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in fields))
        files = self.catalog.write(table, df)
        self.catalog.commit(table, schema, [f for f in m["files"] if f not in set(old)] + files, m["version"])
        self.follow(table)
        self.statistics.changed(table, sum(touched.values()))
        return sum(touched.values())

    def _create_table(self, s: parser.CreateTable) -> int:
        names = [c for c, _, _ in s.columns]
        if len(set(names)) != len(names) or any(len(n) > LONGEST_NAME for n in names):
            raise BadSemantics("column names must differ and be short")
        self.catalog.create(s.table, T.StructType([types.field(*c) for c in s.columns]))
        return 0

    def _create_view(self, s: parser.CreateView) -> int:
        self.catalog.fresh(s.view)
        self.query(s.query)  # what it names must be there
        self.catalog.create_view(s.view, s.text)
        return 0

    def _create_index(self, s: parser.CreateIndex) -> int:
        if s.table not in self.catalog.external:
            self._own(s.table)
        have = {f.name: f for f in self.catalog.schema(s.table)}
        if s.index in self.catalog.indexes or missing(s.columns, have):
            raise BadSemantics(f"index {s.index} can't be made")
        if s.kind == "ivf" and (len(s.columns) != 1 or types.kind_of(have[s.columns[0]]) != "vector"):
            raise BadSemantics("ivf is for one vector column")
        self._build(s.index, Index(s.table, s.columns, s.kind))
        return 0

    def refresh_index(self, name: str) -> None:
        """Builds an index anew, of the rows there are."""
        self._build(name, self.catalog.indexes[name])

    def _build(self, name: str, i: Index) -> None:
        stored = i.table not in self.catalog.external
        made = layouts.KINDS[i.kind](self.spark, i.columns, f"{self.catalog.root}/_indexes/{name}-{uuid.uuid4().hex}", self.catalog.schema(i.table))
        made.stored = stored
        made.version = self.catalog.manifest(i.table)["version"] if stored else 0
        made.build(self.catalog.read(i.table))
        self._publish(name, i, made)


def missing(names: tuple[str, ...], have: dict) -> bool:
    return any(n not in have for n in names)


