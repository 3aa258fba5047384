"""Aggregates with init, update, merge and finish, of which no task sees a whole group.

Tasks update one state a group, batch by batch, and emit the states as bytes; a
task that holds too many groups emits them early.  States of a group meet
under a salt first, some ``SPREAD`` at a time, and then their merged states, so
that even one group of all rows is merged from a state a task.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Groups that a task holds at once, and states that are merged at once under a salt.
GROUPS, SPREAD = 10_000, 64


class Mergeable:
    """An aggregate of one column; a state is anything that pickles, or override ``dump`` and ``load``."""

    #: The type of its result; None is a null.
    returns: T.DataType = T.DoubleType()
    #: Whether it is of numbers only.
    numeric = False

    def init(self) -> object:
        raise NotImplementedError

    def update(self, state: object, values: pa.Array) -> object:
        """The state with some more values, nulls among them."""
        raise NotImplementedError

    def merge(self, a: object, b: object) -> object:
        raise NotImplementedError

    def finish(self, state: object) -> object:
        raise NotImplementedError

    def dump(self, state: object) -> bytes:
        return pickle.dumps(state)

    def load(self, data: bytes) -> object:
        return pickle.loads(data)


class Variance(Mergeable):
    """Population variance: counts, means and squared deviations merge without cancelling."""

    numeric = True

    def init(self) -> tuple[int, float, float]:
        return 0, 0.0, 0.0

    def update(self, state, values):
        x = values.drop_null().cast(pa.float64()).to_numpy()
        return self.merge(state, (len(x), float(x.mean()), float(((x - x.mean()) ** 2).sum()))) if len(x) else state

    def merge(self, a, b):
        if not a[0] or not b[0]:
            return b if not a[0] else a
        n, off = a[0] + b[0], b[1] - a[1]
        return n, a[1] + off * b[0] / n, a[2] + b[2] + off * off * a[0] * b[0] / n

    def finish(self, state):
        return state[2] / state[0] if state[0] else None


class Extent(Mergeable):
    """The largest value less the smallest."""

    numeric = True

    def init(self) -> tuple[float, float]:
        return float("inf"), float("-inf")

    def update(self, state, values):
        x = values.drop_null().cast(pa.float64()).to_numpy()
        return self.merge(state, (float(x.min()), float(x.max()))) if len(x) else state

    def merge(self, a, b):
        return min(a[0], b[0]), max(a[1], b[1])

    def finish(self, state):
        return state[1] - state[0] if state[0] <= state[1] else None


class Partial(Mergeable):
    """A function of a pandas Series that is asked of a batch's values at a time; ``combine`` makes one result of two.

    Nulls are left out, and the result of no value is null.
    """

    def __init__(self, function: Callable[[pd.Series], object], combine: Callable[[object, object], object], returns: T.DataType | None = None) -> None:
        self.function, self.combine, self.returns = function, combine, returns or T.DoubleType()

    def init(self) -> None:
        return None

    def update(self, state, values):
        x = values.drop_null()
        return self.merge(state, self.function(x.to_pandas())) if len(x) else state

    def merge(self, a, b):
        return b if a is None else a if b is None else self.combine(a, b)

    def finish(self, state):
        return state


def _groups(keys: list[pa.Array], rows: int) -> tuple[list[int], list[np.ndarray]]:
    """The first row of each group of a batch and the rows of each; nulls are a value."""
    if not keys:
        return [0], [np.arange(rows)]
    codes = []
    for column in keys:
        if pa.types.is_floating(column.type):  # -0.0 is 0.0
            column = pa.array(np.where(np.asarray(column.fill_null(1)) == 0, 0.0, np.asarray(column.fill_null(1))), mask=np.asarray(column.is_null()))
        codes.append(column.dictionary_encode().indices.fill_null(-1).to_numpy())
    _, first, group = np.unique(np.column_stack(codes), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(group.ravel(), kind="stable")
    return first.tolist(), np.split(order, np.cumsum(np.bincount(group.ravel()))[:-1])


def aggregate(df: DataFrame, keys: Sequence[str], made: Sequence[tuple[str, Mergeable, str]]) -> DataFrame:
    """keys and, for each (name, aggregate, column), its result; without keys one row."""
    keys, kinds = list(keys), [m for _, m, _ in made]
    own = T.StructType([df.schema[k] for k in keys])
    states = T.StructType([T.StructField(f"_s{i}", T.BinaryType()) for i in range(len(kinds))])
    n = len(keys)

    def row(key: tuple, key_types: list[pa.DataType], some: list) -> list[pa.Array]:
        return [*(pa.array([v], t) for v, t in zip(key, key_types)), *(pa.array([m.dump(s)], pa.binary()) for m, s in zip(kinds, some))]

    names = [*keys, *states.names]

    def partial(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = pa.array([TaskContext.get().partitionId() // SPREAD], pa.int32())
        held: dict[tuple, list] = {}
        types: list[pa.DataType] = []

        def out() -> Iterator[pa.RecordBatch]:
            for key, some in held.items():
                yield pa.RecordBatch.from_arrays([*row(key, types, some), salt], names=[*names, "_salt"])

        for batch in source:
            if not batch.num_rows:
                continue
            types = [c.type for c in batch.columns[:n]]
            for first, rows in zip(*_groups(batch.columns[:n], batch.num_rows)):
                key = tuple(c[first].as_py() for c in batch.columns[:n])
                some = held.get(key) or [m.init() for m in kinds]
                at = pa.array(rows)
                held[key] = [m.update(s, c.take(at)) for m, s, c in zip(kinds, some, batch.columns[n:])]
            if len(held) > GROUPS:
                yield from out()
                held.clear()
        yield from out()

    def merged(group: pa.Table) -> list:
        out = []
        for i, m in enumerate(kinds):
            state = None
            for data in group.column(f"_s{i}"):
                one = m.load(data.as_py())
                state = one if state is None else m.merge(state, one)
            out.append(state)
        return out

    def salted(group: pa.Table) -> pa.Table:
        return pa.Table.from_arrays([*(group.column(k)[:1] for k in keys), *(pa.array([m.dump(s)], pa.binary()) for m, s in zip(kinds, merged(group)))], names=names)

    results = T.StructType([T.StructField(name, m.returns) for name, m, _ in made])

    def finish(group: pa.Table) -> pa.Table:
        from pyspark.sql.pandas.types import to_arrow_type

        values = [pa.array([m.finish(s)], to_arrow_type(m.returns)) for m, s in zip(kinds, merged(group))]
        return pa.Table.from_arrays([*(group.column(k)[:1] for k in keys), *values], names=[*keys, *results.names])

    columns = [*(F.col(f"`{k}`") for k in keys), *(F.col(f"`{c}`").alias(f"_v{i}") for i, (_, _, c) in enumerate(made))]
    parts = df.select(*columns).mapInArrow(partial, T.StructType([*own.fields, *states.fields, T.StructField("_salt", T.IntegerType())]))
    middle = parts.groupBy(*keys, "_salt").applyInArrow(salted, T.StructType([*own.fields, *states.fields]))
    done = middle.groupBy(*keys).applyInArrow(finish, T.StructType([*own.fields, *results.fields]))
    if n or not df.isEmpty():
        return done
    return df.sparkSession.createDataFrame([tuple(m.finish(m.init()) for m in kinds)], results)  # no task may be there to make a state
