"""What an index is here: a copy of rows that lies in files so that Spark's scans read few of them.

An index is built by ``build``, grows by ``append`` and is read by ``lookup`` (or
``near`` for distances, ``meeting`` for joins); ``expected`` says how many rows a lookup
reads.  Kinds are in ``KINDS``, to which others can be added.

What is written in one go is a part, and each row names its part.  ``state`` lists the
parts an index has, so a session that opens it with ``reopen`` reads those and no rows
that another session adds meanwhile or left behind when it was lost.

Rows of stored tables also name the file they came from.  A table is changed by new
files in the place of old ones, so an index ``follow``s it by the rows of the new files
as a part, and by leaving out rows of the old ones when it is read.
"""

from __future__ import annotations

import base64
import math
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import vectors
from tessera.operators import ivf
from tessera.operators.knn import pair_distances
from tessera.operators.predicates import Predicate

#: Buckets of a hash index: the fewest, the most, and the bytes of one that more are made for.
BUCKETS, MOST_BUCKETS, BUCKET_BYTES = 100, 65_536, 256 << 20
#: Rows that a task may take of one bucket in a join, whatever its share.
BUCKET_ROWS = 1_000_000


def sorted_files(df: DataFrame, keys: Sequence[str], path: str, files: int | None = None) -> None:
    """Ranges of the keys, sorted within each file: row groups' bounds then skip what a range predicate excludes."""
    ranged = df.repartitionByRange(files, *keys) if files else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


def hashed_table(df: DataFrame, keys: Sequence[str], table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Buckets by all keys: equality lookups read one bucket, joins of equally bucketed tables don't shuffle."""
    writer = df.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def best(indexes: dict[str, tuple[str, tuple[str, ...]]], predicate: Predicate) -> str | None:
    """The index, of name: (kind, keys), with the most keys the predicate bounds.

    A btree serves any comparison with constants on its leading keys, a hash
    only equality on all keys; ivf serves orderings by distance, not predicates.
    """
    scored = []
    for name, (kind, keys) in sorted(indexes.items()):
        bounds = [[b for t in predicate.terms if (b := t.bound(k))] for k in keys]
        if kind == "hash" and all(any(op == "=" for op, _ in b) for b in bounds):
            scored.append((len(keys), name))
        elif kind == "btree":
            lead = next((i for i, b in enumerate(bounds) if not b), len(keys))
            if lead:
                scored.append((lead, name))
    return max(scored, key=lambda s: s[0])[1] if scored else None


@dataclass
class Layout:
    """An index of a table's rows; ``version`` is the table's that it shows."""

    spark: SparkSession
    columns: tuple[str, ...]
    path: str
    schema: T.StructType
    version: int = 0
    parts: list[str] = field(default_factory=list)
    stored: bool = False  # whether rows come from files of a stored table
    dead: list[str] = field(default_factory=list)  # files whose rows are not the table's any more

    def build(self, df: DataFrame) -> None:
        self.append(df)

    def append(self, df: DataFrame) -> None:
        raise NotImplementedError

    def lookup(self, predicate: Predicate) -> DataFrame:
        """Rows that include all that meet the predicate."""
        raise NotImplementedError

    def expected(self, predicate: Predicate) -> float:
        """The share of rows that a lookup reads, by rule: statistics may say more."""
        raise NotImplementedError

    def state(self) -> dict:
        """What another session needs to read the index, as JSON takes it."""
        return {"path": self.path, "version": self.version, "parts": self.parts, "dead": self.dead}

    def reopen(self, state: dict) -> None:
        """Reads what ``state`` tells, of an index of the same columns and schema."""
        self.path, self.version, self.parts = state["path"], state["version"], list(state["parts"])
        self.stored, self.dead = True, list(state["dead"])

    def follow(self, gone: Sequence[str], df: DataFrame | None, version: int) -> None:
        """The table's next version, without the rows of files ``gone`` and with those of new files."""
        self.dead += gone
        if df is not None:
            self.append(df)
        self.version = version

    def _part(self, df: DataFrame) -> DataFrame:
        """The rows as a part of their own, which counts from now on."""
        self.parts.append(uuid.uuid4().hex)
        file = F.substring_index(F.input_file_name(), "/", -1) if self.stored else F.lit("")
        return df.withColumn("_file", file).withColumn("_part", F.lit(self.parts[-1]))

    def _live(self, df: DataFrame) -> DataFrame:
        """Of what lies in the index's files, the rows that are the table's."""
        df = df.where(F.col("_part").isin(self.parts))
        return df.where(~F.col("_file").isin(self.dead)) if self.dead else df

    def _read(self) -> DataFrame:
        return self._live(self.spark.read.parquet(self.path))


class Sorted(Layout):
    """btree: ranges of the keys; bounds of row groups skip what a comparison of leading keys excludes."""

    def append(self, df: DataFrame) -> None:
        self._part(df).repartitionByRange(*self.columns).sortWithinPartitions(*self.columns).write.mode("append").parquet(self.path)

    def lookup(self, predicate: Predicate) -> DataFrame:
        return self._read().where(predicate.on(self.columns).column()).select(*self.schema.names)

    def expected(self, predicate: Predicate) -> float:
        out = 1.0
        for c in self.columns:
            ops = {b[0] for t in predicate.terms if (b := t.bound(c))}
            if not ops:
                break
            out *= 0.01 if "=" in ops else 0.1
        return out


@dataclass
class Hashed(Layout):
    """hash: a folder for each hash of all keys, and the same as Spark's buckets.

    Equality reads one folder.  A join on all keys reads the buckets where they are, so
    that only the other side is shuffled, and only folders that the other side has keys
    in.  There are as many buckets as the rows need when the index is built, at least BUCKETS.
    """

    buckets: int = 0
    sizes: dict[int, int] = field(default_factory=dict)

    def state(self) -> dict:
        return super().state() | {"buckets": self.buckets, "sizes": sorted(self.sizes.items())}

    def reopen(self, state: dict) -> None:
        super().reopen(state)
        self.buckets, self.sizes = state["buckets"], dict(map(tuple, state["sizes"]))

    @property
    def name(self) -> str:
        """The table of this session that tells Spark of the buckets."""
        return "index_" + self.path.rstrip("/").rsplit("-", 1)[1]

    def _bucket(self, values: list) -> object:
        return F.pmod(F.hash(*values), F.lit(self.buckets)).cast("int")

    def build(self, df: DataFrame) -> None:
        width = df._jdf.schema().defaultSize()  # bytes of a row by its types
        self.buckets = min(MOST_BUCKETS, max(BUCKETS, math.ceil(df.count() * width / BUCKET_BYTES)))
        self.append(df)

    def append(self, df: DataFrame) -> None:
        """A part of the rows, dealt by bucket; adaptive execution splits hot buckets over tasks and files."""
        self._table()
        rows = self._part(df).withColumn("_bucket", self._bucket([F.col(c) for c in self.columns]))
        dealt = rows.hint("rebalance", "_bucket")
        dealt.write.mode("append").format("parquet").partitionBy("_bucket").bucketBy(self.buckets, *self.columns).sortBy(*self.columns).saveAsTable(self.name)
        self._count()

    def follow(self, gone: Sequence[str], df: DataFrame | None, version: int) -> None:
        super().follow(gone, df, version)
        if df is None:
            self._count()

    def _count(self) -> None:
        self.sizes = {r["_bucket"]: r.n for r in self._read().groupBy("_bucket").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a bucket

    def _table(self) -> None:
        if self.spark.catalog.tableExists(self.name):
            return
        quoted = [f"`{c}`" for c in self.columns]
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*self.schema, T.StructField("_file", T.StringType()), T.StructField("_part", T.StringType()), T.StructField("_bucket", T.IntegerType())])
        keys = ", ".join(quoted)
        self.spark.sql(f"create table {self.name} ({fields}) using parquet partitioned by (_bucket) clustered by ({keys}) sorted by ({keys}) into {self.buckets} buckets location '{self.path}'")
        if self.parts:
            self.spark.catalog.recoverPartitions(self.name)

    def _read(self) -> DataFrame:
        # by its schema, as an index of no rows has no folders
        schema = T.StructType([*self.schema, *(T.StructField(c, T.StringType()) for c in ("_file", "_part")), T.StructField("_bucket", T.IntegerType())])
        return self._live(self.spark.read.schema(schema).parquet(self.path))

    def lookup(self, predicate: Predicate) -> DataFrame:
        wanted = [F.lit(next(b[1] for t in predicate.terms if (b := t.bound(c)) and b[0] == "=")).cast(self.schema[c].dataType) for c in self.columns]
        return self._read().where(F.col("_bucket") == self._bucket(wanted)).select(*self.schema.names)

    def meeting(self, other: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, int]:
        """The rows that can meet ``other`` on equal keys, ``keys`` being its names in the order of ours, and the number of buckets read.

        One count of the other side's keys by bucket, summed in its tasks first, says
        which buckets are needed.  The rows come in Spark's buckets, unless a bucket of
        either side is hot: then as plain files, which adaptive execution can split.
        """
        counts = other.where(" and ".join(f"`{k}` is not null" for k in keys)).groupBy(self._bucket([F.col(k) for k in keys]).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        asked = {r.b: r.n for r in counts.collect()}  # a row a bucket
        needed = sorted(asked.keys() & self.sizes.keys())
        even = not any(max(n.values(), default=0) > max(BUCKET_ROWS, 4 * sum(n.values()) / self.buckets) for n in (asked, self.sizes))
        if even:
            self._table()
            self.spark.catalog.recoverPartitions(self.name)
            rows = self._live(self.spark.table(self.name))
        else:
            rows = self._read()
        if len(needed) < len(self.sizes):
            rows = rows.where(F.col("_bucket").isin(needed) if needed else F.lit(False))
        return rows.select(*self.schema.names), len(needed)

    def expected(self, predicate: Predicate) -> float:
        return 1 / max(self.buckets, BUCKETS)


@dataclass
class Cells(Layout):
    """ivf: cells of nearest centroids, four times the root of the rows in number; the nearest are probed.

    How many is measured when the index is built: the fewest that reach a recall
    of ``least`` against brute force over at most ``asked`` of the rows, as queries;
    that is more than the 0.9 that other queries, which were not measured, should reach.
    """

    least: float = 0.95
    asked: int = 200
    index: ivf.Ivf | None = None
    probe: int = 1
    recall: float = 0.0
    sizes: dict[int, int] = field(default_factory=dict)
    radii: dict[int, float] = field(default_factory=dict)

    def state(self) -> dict:
        i = self.index
        centroids = i and {"shape": i.centroids.shape, "doubles": base64.b64encode(np.ascontiguousarray(i.centroids, dtype="<f8").tobytes()).decode()}
        return super().state() | {"centroids": centroids, "probe": self.probe, "recall": self.recall, "sizes": sorted(self.sizes.items()), "radii": sorted(self.radii.items())}

    def reopen(self, state: dict) -> None:
        super().reopen(state)
        if found := state["centroids"]:
            centroids = np.frombuffer(base64.b64decode(found["doubles"]), "<f8").reshape(found["shape"])
            self.index = ivf.Ivf(self.path, centroids, self._id(), self.columns[0], self._live)
        self.probe, self.recall = state["probe"], state["recall"]
        self.sizes, self.radii = dict(map(tuple, state["sizes"])), dict(map(tuple, state["radii"]))

    def follow(self, gone: Sequence[str], df: DataFrame | None, version: int) -> None:
        """Cells stay, and how many are probed; a cell's radius holds for the rows that are left of it."""
        super().follow(gone, df, version)
        if df is None and self.index is not None:
            self._count()

    def _id(self) -> str:
        return next(f.name for f in self.schema if f.name not in self.columns)

    def build(self, df: DataFrame) -> None:
        n = df.count()
        if not n:
            return
        cells = max(1, min(n, 4096, round(4 * n**0.5)))
        self.index = replace(ivf.build(self._part(df), self.path, cells, self._id(), self.columns[0]), keep=self._live)
        drawn = F.pmod(F.xxhash64(self._id()), F.lit(1 << 20))
        queries = df.where(drawn <= min(1.0, 2 * self.asked / n) * (1 << 20)).orderBy(drawn).limit(self.asked)
        self.probe, self.recall = ivf.probe_for(self.spark, self.index, df, queries, 20, self.least, self._id())
        self._count()

    def append(self, df: DataFrame) -> None:
        if self.index is None:
            return self.build(df)
        ivf.append(self._part(df), self.index)
        self._count()

    def _count(self) -> None:
        found = self.index.rows(self.spark).groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect()  # a row a cell
        self.sizes, self.radii = {r.cell: r.n for r in found}, {r.cell: r.far for r in found}

    def _of(self, cells: Sequence[int]) -> DataFrame:
        return self.index.rows(self.spark).where(F.col("cell").isin([int(c) for c in cells])).select(*self.schema.names)

    def near(self, query: Sequence[float], k: int) -> DataFrame:
        """The rows of the nearest ``probe`` cells, or of as many as have k rows."""
        order = self.index.cells_near([list(query)], len(self.index.centroids))[0]
        taken, held = [], 0
        for cell in order:
            if len(taken) >= self.probe and held >= k:
                break
            taken.append(int(cell))
            held += self.sizes.get(int(cell), 0)
        return self._of(taken)

    def near_each(self, queries: DataFrame, k: int, query_id: str) -> DataFrame:
        """What ``near`` reads for each of many queries (query_id and a vector named as the index's), ranked: one job for all."""
        return ivf.search_batch(self.spark, self.index, queries, k, self.probe, query_id, self.sizes)

    def browse(self, query: Sequence[float], k: int, predicate: Predicate, passed: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """The rows of all cells that can hold one of the k nearest that pass, and the number of these cells; exact.

        Cells are read in rings, those first whose rows can be nearest: no row is
        nearer than its cell's centroid less the cell's radius.  A count of the
        rows that meet ``predicate`` by cell, of narrow columns, says which cells are empty
        and how many the first ring needs; ``passed`` then filters and joins a
        ring's rows.  Rings end when k rows are found and no unread cell can have a
        nearer or equally near one; only k distances a ring reach the driver.
        """
        centre = pair_distances(self.index.centroids, np.array([list(query)], float), "euclidean")[:, 0]
        rows = self.index.rows(self.spark)
        held = {r.cell: r.n for r in rows.where(predicate.column()).groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()} if predicate.terms else self.sizes  # a row a cell
        least = {c: centre[c] - self.radii[c] - 1e-9 * (1 + centre[c]) for c in held}
        order = sorted(held, key=lambda c: (least[c], centre[c]))
        distance = vectors.distance("euclidean", F.col(self.columns[0]), vectors.literal(query))
        near: list[float] = []
        at, ring, enough = 0, 0, 0
        while ring < len(order) and enough < 2 * k:
            enough += held[order[ring]]
            ring += 1
        while at < len(order) and not (len(near) == k and least[order[at]] > near[-1]):
            stop = at + ring
            if len(near) == k:
                stop = min(stop, next((i for i in range(at, len(order)) if least[order[i]] > near[-1]), len(order)))
            found = passed(self._of(order[at:stop])).select(distance.alias("d")).where("d is not null").orderBy("d").limit(k).collect()  # k numbers
            near = sorted([*near, *(r.d for r in found)])[:k]
            at, ring = stop, 2 * ring
        at = min(at, len(order))
        return self._of(order[:at]), at

    def lookup(self, predicate: Predicate) -> DataFrame:
        return self.index.rows(self.spark).select(*self.schema.names)

    def expected(self, predicate: Predicate) -> float:
        return 1.0


KINDS: dict[str, type[Layout]] = {"btree": Sorted, "hash": Hashed, "ivf": Cells}


def index_join(spark: SparkSession, left: str, right: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Joins tables made by ``hashed_table`` on their bucket keys: neither side is shuffled."""
    a, b = spark.table(left), spark.table(right).hint("merge")
    return a.join(b, [a[x] == b[y] for x, y in pairs])
