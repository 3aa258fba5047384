"""Vector columns: array<float> or array<double> of one length.

All of these are SQL higher-order functions, so stay inside the JVM; sums are
taken in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F



def literal(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _checked(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).otherwise(F.raise_error(F.lit("vectors of different dimensions")))


def dot(a: Column, b: Column) -> Column:
    return _checked(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def euclidean(a: Column, b: Column) -> Column:
    def square(x: Column, y: Column) -> Column:
        d = x.cast("double") - y.cast("double")
        return d * d

    return _checked(a, b, F.sqrt(_sum(F.zip_with(a, b, square))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """NaN where either vector is zero."""
    lengths = norm(a) * norm(b)
    return F.when(lengths == 0, F.lit(float("nan"))).otherwise(dot(a, b) / lengths)


def cosine(a: Column, b: Column) -> Column:
    """Cosine distance: 0 for the same direction."""
    return 1 - cosine_similarity(a, b)


#: Distances by name, and their names between angle brackets in statements.
DISTANCES: dict[str, Callable[[Column, Column], Column]] = {"euclidean": euclidean, "cosine": cosine, "cosine_similarity": cosine_similarity}
SHORT = {"euc": "euclidean", "cos": "cosine"}


def distance(name: str, a: Column, b: Column) -> Column:
    """By name; ``cosine_similarity`` ascending puts the least similar first."""
    return DISTANCES[name](a, b)


def register_distance(name: str, short: str, make: Callable[[Column, Column], Column]) -> None:
    """A new distance of two vectors; ``short`` is its name in statements.  Vectors of different dimensions raise."""
    if name in DISTANCES or short in SHORT:
        raise ValueError(f"{name} or {short} is there already")
    DISTANCES[name] = lambda a, b: _checked(a, b, make(a, b))
    SHORT[short] = name


def manhattan(a: Column, b: Column) -> Column:
    return _checked(a, b, _sum(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double")))))


def add(a: Column, b: Column) -> Column:
    return _checked(a, b, F.zip_with(a, b, lambda x, y: x + y))


def sub(a: Column, b: Column) -> Column:
    return _checked(a, b, F.zip_with(a, b, lambda x, y: x - y))


def div(a: Column, divisor: Column) -> Column:
    """Each component over an integer; 0 gives infinities and NaN, as floating-point numbers do."""
    by = divisor.cast("double")

    def over(x: Column) -> Column:
        y = x.cast("double")
        zero = F.when((y == 0) | F.isnan(y), float("nan")).when(y > 0, float("inf")).otherwise(float("-inf"))
        return F.when(by == 0, zero).otherwise(F.try_divide(y, by))

    return F.transform(a, over)


def bands(a: Column, n: int, buckets: int, step: float = 0.5) -> Column:
    """A bucket number for each of n slices of the vector, its components rounded to ``step``."""

    def band(i: Column) -> Column:
        size = F.ceil(F.size(a) / n).cast("int")
        part = F.transform(F.slice(a, (i * size + 1).cast("int"), size), lambda x: F.round(x.cast("double") / step).cast("int"))
        return F.pmod(F.hash(part, i), F.lit(buckets))

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), band)


def normal(dimension: int, seed: int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """A random vector, components rounded to two decimals."""
    return F.array(*(F.round(F.randn(seed + i) * deviation + mean, 2).cast("float") for i in range(dimension)))


def uniform(dimension: int, seed: int, high: int = 9999) -> Column:
    """A random vector of whole numbers from 0 to high - 1."""
    return F.array(*(F.floor(F.rand(seed + i) * high).cast("float") for i in range(dimension)))


def perturbed(a: Column, dimension: int, seed: int, deviation: float = 1.0) -> Column:
    """The vector plus normal noise rounded to two decimals: a search near a known point."""
    return add(a.cast("array<double>"), normal(dimension, seed, 0.0, deviation).cast("array<double>"))


def from_text(line: Column) -> Column:
    """A vector from components separated by white space."""
    return F.transform(F.filter(F.split(F.trim(line), r"\s+"), lambda s: s != ""), lambda s: s.cast("float"))
