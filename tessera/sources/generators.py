"""Columns for synthetic workloads; all are functions of a seed, so runs repeat."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Syllables of customer last names, and the alphabet of random strings.
SYLLABLES = ("BAR", "OUGHT", "ABLE", "PRI", "PRES", "ESE", "ANTI", "CALLY", "ATION", "EING")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def whole(low: int, high: int, seed: int) -> Column:
    """Uniform, both ends included."""
    return (F.floor(F.rand(seed) * (high - low + 1)) + low).cast("bigint")


def whole_but(low: int, high: int, excluded: int, seed: int) -> Column:
    """Uniform without one value."""
    x = whole(low, high - 1, seed)
    # both uses of x are taken for each row, so stay the same number
    return x + (x >= excluded).cast("bigint")


def fixed(low: float, high: float, decimals: int, seed: int) -> Column:
    unit = 10**decimals
    return whole(round(low * unit), round(high * unit), seed) / unit


def weighted(values: Sequence[str], weights: Sequence[float], seed: int) -> Column:
    """One of the values, by weight in thousandths."""
    total, bound, place = sum(weights), 0.0, F.lit(1)
    x = F.floor(F.rand(seed) * 1000)
    for w in weights[:-1]:
        bound += 1000 * w / total
        # a sum, not a choice: every use of x is then taken for each row and stays the same number
        place = place + (x >= round(bound)).cast("int")
    return F.element_at(F.array(*map(F.lit, values)), place)


def text(low: int, high: int, seed: int, alphabet: str = ALPHABET) -> Column:
    # one random number a row, hashed with each letter's place: as long an expression for any length
    letters = F.transform(F.array_repeat(F.rand(seed + 1), high), lambda u, i: F.substring(F.lit(alphabet), (F.pmod(F.xxhash64(u, i), F.lit(len(alphabet))) + 1).cast("int"), F.lit(1)))
    return F.left(F.array_join(letters, ""), whole(low, high, seed).cast("int"))


def digits(n: int, seed: int) -> Column:
    return text(n, n, seed, "0123456789")


def zip_code(seed: int) -> Column:
    return F.concat(digits(4, seed), F.lit("11111"))


def skewed(a: int, low: int, high: int, c: int, seed: int) -> Column:
    """Non-uniform random: the bitwise OR of two uniform numbers makes some values likelier."""
    return ((whole(0, a, seed).bitwiseOR(whole(low, high, seed + 1)) + c) % (high - low + 1)) + low


def last_name(number: Column) -> Column:
    part = lambda n: F.element_at(F.array(*map(F.lit, SYLLABLES)), (n % 10 + 1).cast("int"))
    return F.concat(part(F.floor(number / 100)), part(F.floor(number / 10)), part(number))


def zipfian(spark: SparkSession, rows: int, items: int, exponent: float = 0.99, seed: int = 1, latest: bool = False, table: int = 1_000_000) -> DataFrame:
    """key: Zipf-distributed ranks 1..items, or with ``latest`` the highest ids hottest.

    The first ``table`` ranks are drawn exactly; the rest of the mass by the
    continuous inverse, so the driver's table has a fixed size.
    """
    head = min(items, table)
    weights = np.arange(1, head + 1, dtype=float) ** -exponent
    rest = 0.0 if items == head else (items ** (1 - exponent) - head ** (1 - exponent)) / (1 - exponent) if exponent != 1 else float(np.log(items / head))
    total = weights.sum() + rest
    steps = np.cumsum(weights) / total
    sent = spark.sparkContext.broadcast(steps)

    def draw(source):
        import pyarrow as pa

        for batch in source:
            u = batch.column(0).to_numpy()
            rank = np.searchsorted(sent.value, u, "right") + 1
            over = rank > len(sent.value)
            if over.any():
                left = (u[over] * total - weights.sum()) if exponent == 1 else (u[over] - sent.value[-1]) * total
                far = head * np.exp(left) if exponent == 1 else (head ** (1 - exponent) + left * (1 - exponent)) ** (1 / (1 - exponent))
                rank[over] = np.clip(np.ceil(far), head + 1, items).astype(np.int64) if items > head else head
            yield pa.RecordBatch.from_arrays([pa.array(rank.astype(np.int64))], names=["key"])

    keys = spark.range(rows).select(F.rand(seed).alias("u")).mapInArrow(draw, "key bigint")
    return keys.select((F.lit(items + 1) - F.col("key")).alias("key")) if latest else keys


def permutation(spark: SparkSession, items: int, seed: int) -> DataFrame:
    """0..items-1 in a random order."""
    return spark.range(items).orderBy(F.rand(seed))


def hot_or_cold(items: int, hot: int, share: float, seed: int) -> Column:
    """A key among the first ``hot`` with probability ``share``, else among the others."""
    return F.when(F.rand(seed) < share, whole(1, hot, seed + 1)).otherwise(whole(hot + 1, items, seed + 2))


def plain_decimal(value: float) -> str:
    """A number without an exponent, which the dialect can't read: the shortest text that gives it back."""
    from decimal import Decimal

    return format(Decimal(repr(value)), "f")


def plain(column: Column) -> Column:
    """As plain_decimal, for numbers of up to 28 digits before the point and 10 after."""
    text = column.cast("decimal(38,10)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", ".0")
