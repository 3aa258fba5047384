"""Conjunctive predicates: terms of two operands, split, ranges and closures.

Catalyst does the pushing down; these forms exist for the verifier, for
estimates and for callers that build predicates without SQL text.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions import vectors

OPERATORS = ("=", "<", "<=", ">", ">=")
MIRROR = {"=": "=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}


@dataclass(frozen=True)
class Name:
    """A column."""

    name: str


@dataclass(frozen=True)
class Constant:
    """A number, a text, or a vector as a tuple."""

    value: int | float | str | tuple[float, ...]

    @property
    def kind(self) -> str:
        if isinstance(self.value, bool):
            raise TypeError("no booleans")
        if isinstance(self.value, int):
            return "int" if -(1 << 31) <= self.value < 1 << 31 else "long"
        return {float: "double", str: "varchar", tuple: "vector"}[type(self.value)]


Operand = Name | Constant


def column(operand: Operand) -> Column:
    if isinstance(operand, Name):
        return F.col(f"`{operand.name}`")
    return vectors.literal(operand.value) if isinstance(operand.value, tuple) else F.lit(operand.value)


@dataclass(frozen=True)
class Term:
    left: Operand
    op: str
    right: Operand

    def column(self) -> Column:
        a, b = column(self.left), column(self.right)
        if any(isinstance(x, Constant) and x.kind == "vector" for x in (self.left, self.right)):
            a, b = a.cast("array<double>"), b.cast("array<double>")
        return {"=": a == b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[self.op]

    def names(self) -> set[str]:
        return {x.name for x in (self.left, self.right) if isinstance(x, Name)}

    def bound(self, name: str) -> tuple[str, int | float | str] | None:
        """(operator, constant) if the term compares the column with one."""
        for a, op, b in ((self.left, self.op, self.right), (self.right, MIRROR[self.op], self.left)):
            if a == Name(name) and isinstance(b, Constant) and b.kind != "vector":
                return op, b.value
        return None


@dataclass(frozen=True)
class Range:
    """An interval of numbers or texts; None is unbounded."""

    low: int | float | str | None = None
    high: int | float | str | None = None
    low_open: bool = False
    high_open: bool = False

    def valid(self) -> bool:
        if self.low is None or self.high is None:
            return True
        return self.low < self.high or (self.low == self.high and not (self.low_open or self.high_open))

    def contains(self, value: int | float | str) -> bool:
        above = self.low is None or value > self.low or (value == self.low and not self.low_open)
        below = self.high is None or value < self.high or (value == self.high and not self.high_open)
        return above and below

    def intersect(self, other: Range) -> Range:
        low = max(((x.low, x.low_open) for x in (self, other) if x.low is not None), default=(None, False), key=lambda x: (x[0], x[1]))
        high = min(((x.high, x.high_open) for x in (self, other) if x.high is not None), default=(None, False), key=lambda x: (x[0], not x[1]))
        return Range(low[0], high[0], low[1], high[1])

    def union(self, other: Range) -> Range:
        """The least range over both."""
        low = None if self.low is None or other.low is None else min(((x.low, x.low_open) for x in (self, other)), key=lambda x: (x[0], x[1]))
        high = None if self.high is None or other.high is None else max(((x.high, x.high_open) for x in (self, other)), key=lambda x: (x[0], not x[1]))
        return Range(low[0] if low else None, high[0] if high else None, bool(low and low[1]), bool(high and high[1]))

    def overlaps(self, other: Range) -> bool:
        return self.intersect(other).valid()

    def apply(self, op: str, value: int | float | str) -> Range:
        """Narrowed by one comparison."""
        own = {"=": Range(value, value), "<": Range(None, value, False, True), "<=": Range(None, value), ">": Range(value, None, True), ">=": Range(value, None)}[op]
        return self.intersect(own)

    def length(self) -> float:
        return float(self.high) - float(self.low)

    def column(self, name: str) -> Column:
        c, out = F.col(name), F.lit(True)
        if self.low is not None:
            out = out & (c > self.low if self.low_open else c >= self.low)
        if self.high is not None:
            out = out & (c < self.high if self.high_open else c <= self.high)
        return out


@dataclass(frozen=True)
class Predicate:
    """All of its terms; none is true."""

    terms: tuple[Term, ...] = ()

    def column(self) -> Column:
        return reduce(and_, (t.column() for t in self.terms)) if self.terms else F.lit(True)

    def names(self) -> set[str]:
        return set().union(*(t.names() for t in self.terms)) if self.terms else set()

    def on(self, columns: Iterable[str]) -> Predicate:
        """The terms that one table's columns decide."""
        have = set(columns)
        return Predicate(tuple(t for t in self.terms if t.names() <= have))

    def between(self, left: Iterable[str], right: Iterable[str]) -> Predicate:
        """The terms that need two tables' columns."""
        a, b = set(left), set(right)
        return Predicate(tuple(t for t in self.terms if t.names() <= a | b and not t.names() <= a and not t.names() <= b))

    def range_of(self, name: str) -> Range | None:
        """All comparisons of a column with constants as one range; None if they contradict."""
        out = Range()
        for t in self.terms:
            if found := t.bound(name):
                out = out.apply(*found)
        return out if out.valid() else None

    def equated(self, name: str) -> set[str]:
        """All columns equal to this one, directly or through others."""
        out, new = {name}, {name}
        while new:
            new = {x for t in self.terms if t.op == "=" and len(t.names()) == 2 and t.names() & new for x in t.names()} - out
            out |= new
        return out - {name}

    def closed(self) -> Predicate:
        """With every comparison of a column with a constant also said of the columns equal to it."""
        extra = []
        for t in self.terms:
            names = t.names()
            if len(names) == 1 and (found := t.bound(name := next(iter(names)))):
                extra += [Term(Name(other), found[0], Constant(found[1])) for other in sorted(self.equated(name))]
        return Predicate(tuple(dict.fromkeys([*self.terms, *extra])))
