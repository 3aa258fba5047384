"""A console: statements from standard input, one a line or ended by a semicolon, and their results as tables.

    python -m tessera.console [FOLDER]     registers the Parquet tables of a folder
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from tessera.errors import DialectError
from tessera.plans import parser
from tessera.plans.engine import Engine

MOST = 1000


def statements(lines: Iterable[str]) -> Iterator[str]:
    """Texts up to a semicolon that ends a line, or up to an empty line; ``exit`` stands alone."""
    held: list[str] = []
    for line in lines:
        text = line.strip()
        if text:
            held.append(text.removesuffix(";"))
        if held and (not text or text.endswith(";") or held == [text] and text.lower() in ("exit", "quit")):
            yield " ".join(held)
            held = []
    if held:
        yield " ".join(held)


def run(engine: Engine, lines: Iterable[str], show=print) -> int:
    """Runs statements until ``exit``; errors are shown and counted."""
    wrong = 0
    for text in statements(lines):
        if text.lower() in ("exit", "quit"):
            break
        try:
            if isinstance(parser.parse(text), parser.Select):
                df = engine.sql(text)
                show(" | ".join(df.columns))
                for n, row in enumerate(df.limit(MOST + 1).toLocalIterator()):
                    show("..." if n == MOST else " | ".join(map(str, row)))
            else:
                show(f"{engine.execute(text)} rows")
        except DialectError as why:
            wrong += 1
            show(f"error: {why}")
    return wrong


def main() -> None:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("tessera").getOrCreate()
    engine = Engine(spark)
    if len(sys.argv) > 1:
        from tessera.plans.catalog import Folder

        for name in Folder(spark, sys.argv[1]).names():
            if name.endswith(".parquet"):
                engine.register(name.removesuffix(".parquet"), spark.read.parquet(f"{sys.argv[1]}/{name}"))
    sys.exit(run(engine, sys.stdin) > 0)


if __name__ == "__main__":
    main()
