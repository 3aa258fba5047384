"""Canonical exact digests of documents, with DataFrame and SQL functions only.

The canonical text is the Unicode-composed, case-folded text with each run of
white space as one space and none at the ends.  Its fingerprint is two
differently seeded 64-bit xxhashes.  Rows whose hashes are equal are compared
byte by byte; should a bucket hold different texts, all but the first get a
number appended, so equal fingerprints mean equal canonical texts.

Defined cases: a null text counts as empty; repeated rows have one fingerprint;
an empty table gives no rows; a null id is a document like others, the last in
descending order; ties of ids go by their texts; very long texts are taken whole;
other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.cluster import partitions, table


def canonical(text: Column) -> Column:
    """Canonical caseless matching: fold the case of the decomposed text, compose, then white space."""
    whole = F.coalesce(text, F.lit(""))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), whole, F.lit(False)), F.lit(True))
    composed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), folded, F.lit(False))
    # texts of plain ASCII take the short way, which gives them the same
    plain = F.octet_length(whole) == F.char_length(whole)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(whole)).otherwise(composed), r"(?U)\s+", " "))


def digest(canon: Column) -> Column:
    """32 hexadecimal digits: two xxhash64 of different seeds."""
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(canon)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), canon)), 16, "0")))


def clashes(rows: DataFrame) -> DataFrame | None:
    """key, canon and number (from 1) of the canonical texts in a bucket that also has a lesser, different text.

    Each task reduces its rows to distinct (bucket, text) pairs before anything
    moves, so a hot group of copies is a row a task; equal buckets are then
    compared by their texts' bytes.  None if all buckets hold one text each.
    """
    texts = rows.groupBy("key", "canon").agg(F.count("*").alias("copies"))
    several = table(texts.groupBy("key").agg(F.count("*").alias("texts")).where("texts > 1").select("key"))
    if several.isEmpty():
        return None
    number = F.row_number().over(Window.partitionBy("key").orderBy("canon")) - 1
    return texts.join(several, "key").select("key", "canon", number.alias("number")).where("number > 0")


def neighbours(df: DataFrame, order: str, carried: list[str], ranges: int | None = None) -> DataFrame:
    """``df`` with next_<c>: column c of the row after it in descending ``order``, the first after the last.

    Rows are dealt to ranges of the order by quantiles; the first row of each
    range goes, as a ghost, also to the range before it.  So each range is
    sorted on its own, and only the range bounds reach the driver.
    """
    spark = df.sparkSession
    n = ranges or 2 * partitions(spark)
    if n > 1:
        bounds = df.agg(F.percentile_approx(order, [i / n for i in range(n)], 10 * n)).first()[0]  # n values
        edges = sorted(set(bounds or []))
    else:
        edges = []
    least, most = (edges[0], edges[-1]) if edges else (0, 0)
    width = max(1, (most - least) // max(1, len(edges)) + 1)
    cells: list[list[int]] = [[] for _ in range((most - least) // width + 1)]
    for e in edges:
        cells[(e - least) // width].append(e)
    before, passed = [], 0
    for c in cells:
        before.append(passed)
        passed += len(c)
    known = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)  # noqa: E731  folded into a literal
    inside = F.expr(f"cast((cast(`{order}` as decimal(20,0)) - {least}BD) div {width}BD as int)")
    cell = F.when(F.col(order) <= least, 0).when(F.col(order) >= most, len(cells) - 1).otherwise(inside)
    up = F.coalesce(F.get(known(before, "array<int>"), cell) + F.size(F.filter(F.get(known(cells, "array<array<bigint>>"), cell), lambda e: e <= F.col(order))), F.lit(0))
    # a higher range number comes earlier; rows under the least edge and null orders are range 0
    ranged = df.withColumns({"_range": up, "_ghost": F.lit(0)})
    firsts = ranged.groupBy("_range").agg(F.max(F.struct(F.col(order).isNotNull().alias("set"), F.col(order).alias("at"))).alias("top"))
    tops = sorted((r["_range"], r["top"]["at"]) for r in firsts.collect())  # a row for each range
    # the range that the first row of a range follows: the next higher one, the lowest for the highest
    first_of, goes = [None] * (len(edges) + 1), [0] * (len(edges) + 1)
    for i, (r, at) in enumerate(tops):
        first_of[r], goes[r] = at, tops[(i + 1) % len(tops)][0]
    target = F.when(F.col(order).eqNullSafe(F.get(known(first_of, "array<bigint>"), F.col("_range"))), F.get(known(goes, "array<int>"), F.col("_range")))
    ranged = ranged.withColumn("_to", target)
    copies = F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")))
    both = F.when(F.col("_to").isNotNull(), F.array(F.struct(F.col("_range").alias("r"), F.lit(0).alias("g")), F.struct(F.col("_to").alias("r"), F.lit(1).alias("g")))).otherwise(copies)
    dealt = ranged.withColumn("_copy", F.explode(both)).withColumns({"_range": F.col("_copy.r"), "_ghost": F.col("_copy.g")}).drop("_copy", "_to")
    w = Window.partitionBy("_range").orderBy("_ghost", F.desc_nulls_last(order), *[c for c in carried if c != order])
    return dealt.withColumns({f"next_{c}": F.lead(c).over(w) for c in carried}).where("_ghost = 0").drop("_range", "_ghost")


def numbered(rows: DataFrame, found: DataFrame | None, pairs: dict[str, str]) -> DataFrame:
    """``rows`` with the number of a clashing text appended to its key; ``pairs`` are key and canonical text columns."""
    if found is None:
        return rows
    for key, canon in pairs.items():
        extra = found.select(F.col("key").alias("_key"), F.col("canon").alias("_canon"), "number")
        rows = rows.join(extra, (rows[key] == extra["_key"]) & (rows[canon] == extra["_canon"]), "left")
        rows = rows.withColumn(key, F.concat(key, F.coalesce(F.concat(F.lit("-"), F.col("number").cast("string")), F.lit("")))).drop("_key", "_canon", "number")
    return rows


def keyed(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = df.select(df[doc_id].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    return rows.withColumn("canon", canonical(F.col("text"))).withColumn("key", digest(F.col("canon")))


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of each row."""
    rows = keyed(df, doc_id, text)
    return numbered(rows, clashes(rows), {"key": "canon"}).select("doc_id", F.col("key").alias("fingerprint"))


def edits(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edit: its last third replaced by the next document's beginning.

    Likeness of exact digests is 1 for the same canonical text, 0 otherwise.
    """
    rows = keyed(df, doc_id, text)
    found = clashes(rows)
    near = neighbours(rows.drop("canon"), "doc_id", ["text", "key"])
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    near = near.withColumns({"n_chars": n.cast("bigint"), "edited": F.concat(F.left("text", n - third), F.left("next_text", third))})
    near = near.withColumns({"canon": canonical(F.col("text")), "edited_canon": canonical(F.col("edited"))}).withColumn("edited_key", digest(F.col("edited_canon")))
    same_next = (F.col("key") == F.col("next_key")) & ((F.col("text") == F.col("next_text")) | (F.col("canon") == canonical(F.col("next_text"))))
    near = near.withColumns({"near_edited": (F.col("canon") == F.col("edited_canon")).cast("double"), "near_next": same_next.cast("double"), "edited_sha256": F.sha2(F.col("edited").cast("binary"), 256)})
    return numbered(near, found, {"key": "canon", "edited_key": "edited_canon"}).select("doc_id", "n_chars", "edited_sha256", F.col("key").alias("fingerprint"), F.col("edited_key").alias("edited_fingerprint"), "near_edited", "near_next")
