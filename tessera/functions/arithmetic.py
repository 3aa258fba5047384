"""add, sub, mul and div of UPDATE expressions.

int with int stays int and wraps around, anything with a long is a long,
anything with a double a double; whole division cuts off; a double over 0 is an
infinity or NaN; add of texts joins them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.errors import BadSemantics
from tessera.functions import vectors
from tessera.types import is_number

WIDER = {"int": 0, "long": 1, "double": 2}


def _wrapped_int(value: Column) -> Column:
    """A 64-bit value's low 32 bits, signed."""
    low = value.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(low >= F.lit(1 << 31), low - F.lit(1 << 32)).otherwise(low).cast("int")


def _wrapped_long(value: Column) -> Column:
    """A decimal's low 64 bits, signed."""
    span = F.lit(str(1 << 64)).cast("decimal(38,0)")
    low = F.pmod(value, span)
    return F.when(low >= F.lit(str(1 << 63)).cast("decimal(38,0)"), low - span).otherwise(low).cast("long")


def _whole(op: str, a: Column, b: Column, kind: str) -> Column:
    if op == "div":
        return F.when(b == 0, F.raise_error(F.lit("division by zero"))).otherwise(_quotient(a, b, kind))
    if kind == "int":
        x, y = a.cast("long"), b.cast("long")
        return _wrapped_int({"add": x + y, "sub": x - y, "mul": x * y}[op])
    x, y = a.cast("decimal(19,0)"), b.cast("decimal(19,0)")
    return _wrapped_long({"add": x + y, "sub": x - y, "mul": x * y}[op].cast("decimal(38,0)"))


def _quotient(a: Column, b: Column, kind: str) -> Column:
    """Whole division by other than 0; the least value over -1 wraps to itself."""
    x, y = a.cast("long"), b.cast("long")
    by = F.when((y == 0) | (y == -1), 1).otherwise(y)
    negated = _wrapped_long(-x.cast("decimal(38,0)"))
    value = F.when(y == -1, negated).otherwise(F.call_function("div", x, by))
    return _wrapped_int(value) if kind == "int" else value


def apply(op: str, a: Column, ka: str, b: Column, kb: str) -> tuple[Column, str]:
    """The value of op(a, b) and its type."""
    if is_number(ka) and is_number(kb):
        kind = max(ka, kb, key=WIDER.__getitem__)
        if kind != "double":
            return _whole(op, a, b, kind), kind
        x, y = a.cast("double"), b.cast("double")
        if op != "div":
            return {"add": x + y, "sub": x - y, "mul": x * y}[op], kind
        zero = F.when((x == 0) | F.isnan(x) | F.isnan(y), float("nan")).when(x > 0, float("inf")).otherwise(float("-inf"))
        return F.when(y == 0, zero).otherwise(F.try_divide(x, y)), kind
    if ka == kb == "varchar" and op == "add":
        return F.concat(a, b), "varchar"
    if ka == kb == "vector" and op in ("add", "sub"):
        return getattr(vectors, op)(a, b), "vector"
    if ka == "vector" and kb == "int" and op == "div":
        return vectors.div(a, b), "vector"
    raise BadSemantics(f"no {op} of {ka} and {kb}")
