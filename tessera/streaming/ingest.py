"""Vectors that arrive as a stream, appended to a stored table and an index while searches go on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators import ivf
from tessera.plans.engine import Engine


def append(stream: DataFrame, engine: Engine, table: str, checkpoint: str, index: ivf.Ivf | None = None, once: bool = True) -> StreamingQuery:
    """Each micro-batch becomes one version of the table; a batch that comes again after a failure is not taken twice.

    The batch's number is kept in the table's column ``batch``.
    """

    def take(batch: DataFrame, number: int) -> None:
        # first the index, whose files have the batch's number in their name and are written over, then the table:
        # a batch that fails between the two comes again, and neither has it twice or not at all
        if index is not None:
            ivf.append_batch(batch, index, number)
        done = engine.catalog.read(table).where(F.col("batch") == number).limit(1).count()
        if not done:
            engine.insert(table, batch.withColumn("batch", F.lit(number).cast("bigint")))

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, at: str, late: str, width: str, slide: str | None = None, by: list[str] | None = None) -> DataFrame:
    """Rows in tumbling or sliding event-time windows, late ones dropped after the watermark."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, late).groupBy(window, *(by or [])).agg(F.count(F.lit(1)).alias("n"))
