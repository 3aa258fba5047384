"""The dialect's five types: int, long, double, varchar(n) and vector(n).

Values written to a column take its type the way a fixed-width store would:
fractions are cut off, integers saturate at their type's bounds, texts over the
declared length and vectors of another dimension raise.  There are no nulls in
the dialect; columns read from elsewhere may have some.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.errors import BadSemantics

BOUNDS = {"int": (-(1 << 31), (1 << 31) - 1), "long": (-(1 << 63), (1 << 63) - 1)}


def field(name: str, kind: str, size: int | None = None) -> T.StructField:
    """A column of a declared type; the size is kept as metadata."""
    if kind == "varchar":
        return T.StructField(name, T.StringType(), True, {"length": size})
    if kind == "vector":
        return T.StructField(name, T.ArrayType(T.FloatType()), True, {"dimension": size})
    plain = {"int": T.IntegerType(), "long": T.LongType(), "double": T.DoubleType()}
    if kind not in plain:
        raise BadSemantics(f"no type {kind}")
    return T.StructField(name, plain[kind], True)


def kind_of(f: T.StructField) -> str:
    """The dialect's name of a column's type; what it has no name for is 'other'."""
    if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType)):
        return "vector"
    return {T.IntegerType: "int", T.ShortType: "int", T.ByteType: "int", T.LongType: "long", T.DoubleType: "double", T.FloatType: "double", T.StringType: "varchar"}.get(type(f.dataType), "other")


def is_number(kind: str) -> bool:
    return kind in ("int", "long", "double")


def written(value: Column, f: T.StructField, source: str) -> Column:
    """``value``, of dialect type ``source``, as it is stored in column ``f``."""
    kind = kind_of(f)
    if is_number(kind):
        if not is_number(source):
            raise BadSemantics(f"{f.name} is a number")
        if kind == "double":
            return value.cast("double")
        low, high = BOUNDS[kind]
        if source == "double":
            # NaN is 0, as are fractions under 1; casts of what is in bounds can't overflow
            whole = F.when(F.isnan(value), 0).when(value >= float(high), high).when(value <= float(low), low)
            return whole.otherwise(F.when((value < float(high)) & (value > float(low)) & ~F.isnan(value), value).cast(f.dataType)).cast(f.dataType)
        return F.least(F.greatest(value, F.lit(low)), F.lit(high)).cast(f.dataType)
    if kind != source:
        raise BadSemantics(f"{f.name} is a {kind}, not a {source}")
    if kind == "varchar":
        length = f.metadata.get("length")
        too_long = F.raise_error(F.concat(F.lit(f"over {length} characters for {f.name}: "), F.left(value, F.lit(40))))
        return value if length is None else F.when(F.char_length(value) > length, too_long).otherwise(value)
    dimension = f.metadata.get("dimension")
    vector = value.cast(f.dataType)
    return vector if dimension is None else F.when(F.size(vector) != dimension, F.raise_error(F.lit(f"{f.name} has dimension {dimension}"))).otherwise(vector)


def declaration(f: T.StructField) -> tuple[str, int]:
    """Type name and argument for the catalog; 0 where the type has none."""
    return kind_of(f), int(f.metadata.get("length") or f.metadata.get("dimension") or 0)
