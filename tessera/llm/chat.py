"""Chat formatting by schema fingerprints, with DataFrame and SQL functions only.

A layout is known by its fingerprint: the xxhash64 of its nested field paths, in
order of their names, whatever their depth and the types at their ends.  The
fingerprint selects a declarative mapping, a dictionary of SQL expressions from
hashes, that turns the layout into canonical turns: an array of (role, text) in
order.  A table has the fingerprint of its schema; where that has the columns of
several layouts, each row has that of its columns that are not null.  Each JSON
record has its own, and is parsed once.  Canonical turns are
then written in one template whose marks can't be made by a text: control
strings inside texts get a backslash after their first character, control
strings with backslashes there get one more, and reading takes one away.

Template: <s>[INST] text [/INST]</s> for user turns, <s>[ANS] text [/ANS]</s>
for assistant turns, <s>[TURN:role] text [/TURN]</s> for any other role.

Defined cases: a null text is empty and a null role is the empty role; turns
with equal numbers are ordered by role, then text; repeated rows are turns
each; a conversation whose id is null is one conversation; an empty table gives
no rows; a layout with no mapping raises for a table, gives a null for a row or
record.  A table's columns that no layout has are ignored, as is its id.  Very
long conversations are one value each, so must fit in a task.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def paths(kind: T.DataType, at: str = "") -> list[str]:
    """The nested field paths of a type; an array's elements are at []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{at}[]")
    return [at]


def _pair(question: str, answer: str) -> str:
    return f"array(named_struct('role', 'user', 'text', {question}), named_struct('role', 'assistant', 'text', {answer}))"


#: A layout's nested field paths and its turns, array<struct<role, text>>, as SQL over the record {r}.
LAYOUTS: dict[tuple[str, ...], str] = {
    ("messages[].content", "messages[].role"): "transform({r}.messages, m -> named_struct('role', m.role, 'text', m.content))",
    ("conversations[].from", "conversations[].value"): "transform({r}.conversations, m -> named_struct('role', CASE m.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.`from` END, 'text', m.value))",
    ("prompt", "response"): _pair("{r}.prompt", "{r}.response"),
    ("completion", "prompt"): _pair("{r}.prompt", "{r}.completion"),
    ("answer", "question"): _pair("{r}.question", "{r}.answer"),
    ("instruction", "output"): _pair("{r}.instruction", "{r}.output"),
    ("input", "instruction", "output"): _pair("concat_ws('\\n\\n', {r}.instruction, nullif({r}.input, ''))", "{r}.output"),
    ("prompt", "response", "system"): "concat(array(named_struct('role', 'system', 'text', {r}.system)), " + _pair("{r}.prompt", "{r}.response") + ")",
}
#: A row for each turn: a conversation's rows are its turns.
TURN_ROWS = ("role", "text", "turn")


def shape(layout: tuple[str, ...] | set[str]) -> str:
    """Nested field paths as one text: fields by name, what they hold in brackets, the types at the ends left out."""
    tree: dict = {}
    for p in layout:
        at = tree
        for part in p.replace("[]", ".[]").split("."):
            at = at.setdefault(part, {})

    def written(t: dict) -> str:
        if "[]" in t:
            return f"ARRAY<{written(t['[]'])}>"
        return "OBJECT<" + ", ".join(n + (f": {inner}" if (inner := written(x)) else "") for n, x in sorted(t.items())) + ">" if t else ""

    return written(tree)


def fingerprint(shape_: str) -> int:
    """The hash of a shape, as xxhash64 of SQL gives it."""
    h = xxhash.xxh64_intdigest(shape_.encode(), seed=42)
    return h - (1 << 64) if h >= 1 << 63 else h


#: The layouts by their fingerprints; turns in rows of their own are one of them.
MAPPINGS = {fingerprint(shape(layout)): layout for layout in [TURN_ROWS, *LAYOUTS]}


def _type(layout: tuple[str, ...]) -> str:
    """A layout as a type, its ends strings."""

    def written(inner: dict) -> str:
        if "[]" in inner:
            return f"array<{written(inner['[]'])}>"
        return "struct<" + ", ".join(f"`{n}`: {written(x)}" for n, x in inner.items()) + ">" if inner else "string"

    tree: dict = {}
    for p in layout:
        at = tree
        for part in p.replace("[]", ".[]").split("."):
            at = at.setdefault(part, {})
    return written(tree)


def record_fingerprint(variant: Column) -> Column:
    """The fingerprint of a parsed JSON value of any depth."""
    kind = F.schema_of_variant(variant)
    return F.xxhash64(F.regexp_replace(F.regexp_replace(kind, r"(: |<)(?!OBJECT<|ARRAY<)[A-Z_]+(?:\([0-9, ]*\))?(?=[,>])", "$1"), ": (?=[,>])", ""))


def _mapped(rows: DataFrame, records: dict[tuple[str, ...], Column]) -> DataFrame:
    """conv_id and turns of rows with conv_id and _layout, a fingerprint that selects one of ``records``."""
    known = [(h, layout) for h, layout in MAPPINGS.items() if layout in records]
    picked = rows.select("conv_id", *(F.when(F.col("_layout") == h, records[layout]).alias(f"_r{i}") for i, (h, layout) in enumerate(known)))
    as_text = "t -> named_struct('role', cast(t.role as string), 'text', cast(t.text as string))"
    turns = (F.expr(f"CASE WHEN _r{i} IS NOT NULL THEN transform({LAYOUTS[layout].format(r=f'_r{i}')}, {as_text}) END") for i, (_, layout) in enumerate(known))
    return picked.select("conv_id", F.coalesce(F.lit(None), *turns).alias("turns"))


def turns_of_records(df: DataFrame, record: str = "record", conv_id: str = "conv_id") -> DataFrame:
    """conv_id and turns of JSON records of any mix of known layouts; turns is null for an unknown one."""
    parsed = df.select(df[conv_id].cast("bigint").alias("conv_id"), F.try_parse_json(df[record]).alias("_v"))
    rows = parsed.withColumn("_layout", record_fingerprint(F.col("_v")))
    return _mapped(rows, {layout: F.try_variant_get("_v", "$", _type(layout)) for layout in LAYOUTS})


def turns_of_table(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id and turns of a table, by the fingerprint of its schema, or of each row where the schema has none of its own."""
    have = {p for p in paths(df.schema) if p != conv_id}
    ids = df[conv_id].cast("bigint").alias("conv_id")
    if MAPPINGS.get(fingerprint(shape(have & set(TURN_ROWS)))) == TURN_ROWS:
        turn = F.struct(df["turn"].alias("turn"), df["role"].alias("role"), df["text"].alias("text"))
        rows = df.select(ids, turn.alias("t")).groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
        return rows.select("conv_id", F.transform("ts", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
    told = have & {p for layout in LAYOUTS for p in layout}
    columns = sorted({p.split("[]")[0].split(".")[0] for p in told})
    record = lambda layout: F.struct(*(df[c] for c in dict.fromkeys(p.split("[]")[0].split(".")[0] for p in layout)))
    own = fingerprint(shape(told))
    if own in MAPPINGS:
        return _mapped(df.select(ids, F.lit(own).alias("_layout"), *(df[c] for c in columns)), {MAPPINGS[own]: record(MAPPINGS[own])})
    fits = [layout for h, layout in MAPPINGS.items() if set(layout) <= told]
    if not fits:
        raise ValueError(f"no mapping for a layout with the paths {sorted(have)}")
    inner = {c: shape({p for p in told if p.split("[]")[0].split(".")[0] == c})[len("OBJECT<") : -1] for c in columns}
    there = F.concat_ws(", ", *(F.when(df[c].isNotNull(), inner[c]) for c in columns))
    rows = df.select(ids, F.xxhash64(F.concat(F.lit("OBJECT<"), there, F.lit(">"))).alias("_layout"), *(df[c] for c in columns))
    return _mapped(rows, {layout: record(layout) for layout in fits})


#: What follows the first character of a control string, after any backslashes.
CONTROL = r"(?:/?s>|/?INST\]|/?ANS\]|TURN:|/TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*{CONTROL})", r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*{CONTROL})", "$1$2")


def format_turns(df: DataFrame) -> DataFrame:
    """conv_id, formatted and loss_mask: for each turn the characters before, in and after its part of the loss."""

    def marked(turn: Column) -> Column:
        role, text = F.coalesce(turn["role"], F.lit("")), escape(F.coalesce(turn["text"], F.lit("")))
        head = F.when(role == "user", "<s>[INST] ").when(role == "assistant", "<s>[ANS] ").otherwise(F.concat(F.lit("<s>[TURN:"), F.url_encode(role), F.lit("] ")))
        tail = F.when(role == "user", " [/INST]</s>").when(role == "assistant", " [/ANS]</s>").otherwise(" [/TURN]</s>")
        return F.struct((role == "assistant").alias("loss"), head.alias("head"), text.alias("text"), tail.alias("tail"))

    def part(m: Column) -> Column:
        h, x, t = (F.char_length(m[k]) for k in ("head", "text", "tail"))
        return F.struct(F.when(m["loss"], h).otherwise(h + x + t).alias("before"), F.when(m["loss"], x).otherwise(0).alias("inside"), F.when(m["loss"], t).otherwise(0).alias("after"))

    rows = df.select("conv_id", F.transform("turns", marked).alias("m"))
    return rows.select("conv_id", F.array_join(F.transform("m", lambda m: F.concat(m["head"], m["text"], m["tail"])), "").alias("formatted"), F.transform("m", part).alias("loss_mask"))


def read_back(df: DataFrame) -> DataFrame:
    """conv_id, turns and loss_texts from conv_id, formatted and loss_mask alone."""
    pieces = df.withColumn("pieces", F.regexp_extract_all("formatted", F.lit(r"(?s)<s>.*?</s>"), F.lit(0)))

    def turn(piece: Column) -> Column:
        named = F.regexp_extract(piece, r"^<s>\[TURN:([^\]]*)\] ", 1)
        role = F.when(F.startswith(piece, F.lit("<s>[INST] ")), "user").when(F.startswith(piece, F.lit("<s>[ANS] ")), "assistant").otherwise(F.url_decode(named))
        text = F.regexp_extract(piece, r"(?s)^<s>\[[^\]]*\] (.*) \[/[A-Z]+\]</s>$", 1)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    under = F.zip_with("pieces", "loss_mask", lambda p, m: F.when(m["inside"] > 0, unescape(F.substr(p, m["before"] + 1, m["inside"]))).otherwise(""))
    return pieces.select("conv_id", "formatted", F.transform("pieces", turn).alias("turns"), under.alias("loss_texts"))


def summary(formatted: DataFrame) -> DataFrame:
    """Counts and digests of what ``read_back`` finds."""
    back = read_back(formatted)
    loss = F.array_join("loss_texts", "")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )
