"""Structured Streaming forms: event-time windows, latest state by key, and transitions as micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(events: DataFrame, time: str, width: str, keys: list[str], late: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts and sums of `value` by window and keys; `late` sets a watermark on a stream."""
    source = events.withWatermark(time, late) if late else events
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return source.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, time: str, gap: str, keys: list[str], late: str | None = None) -> DataFrame:
    source = events.withWatermark(time, late) if late else events
    return source.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("start"), "n")


def first_seen(events: DataFrame, time: str, key: str, late: str) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def transitions(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], step: Callable[[DataFrame, DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Run a table-to-table transition on each micro-batch until the input is used up.

    `write` gets the batch's number, so that a batch that is run again replaces its own output.
    """
    return stream.writeStream.foreachBatch(lambda batch, number: write(step(read(), batch), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def as_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")
