"""Findings of arriving documents counted by time window, with state.

A document seen before is dropped by its key, which is kept as long as the watermark allows it to come
again. Windows are written once, when the watermark has passed their end, so the state holds the
open windows and the keys of the last ``delay`` alone. What comes later than that is left out,
and counted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from maskwright.operators.detect import detect

COUNTED = "window_start timestamp, window_end timestamp, entity_type string, findings long, documents long"


def findings_by_window(docs: DataFrame, time: str = "time", window: str = "1 hour", text: str = "text") -> DataFrame:
    """window_start, window_end, entity_type, findings and documents; of a stream or a table."""
    found = detect(docs.select(time, text), text=text)
    kinds = F.expr("map_entries(aggregate(spans, CAST(map() AS map<string,bigint>), (acc, s) -> map_concat(map_filter(acc, (k, v) -> k <> s.entity_type), map(s.entity_type, coalesce(try_element_at(acc, s.entity_type), 0L) + 1L))))")
    each = found.select(time, F.explode(kinds).alias("kind"))
    counts = each.groupBy(F.window(time, window).alias("w"), F.col("kind.key").alias("entity_type"))
    counts = counts.agg(F.sum("kind.value").alias("findings"), F.count("*").alias("documents"))
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "entity_type", "findings", "documents")


def count_stream(
    docs: DataFrame,
    output: str,
    checkpoint: str,
    key: str = "doc_id",
    time: str = "time",
    window: str = "1 hour",
    delay: str = "10 minutes",
    text: str = "text",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Count a stream of documents (``key``, ``time``, ``text``) into a table of closed windows.

    The table and the checkpoint go together: a restart goes on where the stream ended.
    """
    once = docs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
    return (
        findings_by_window(once, time, window, text)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def read_counts(spark: SparkSession, output: str) -> DataFrame:
    """The closed windows; none before the first has closed."""
    return spark.read.schema(COUNTED).parquet(output)


def late_rows(query: StreamingQuery) -> int:
    """How many rows this run of a stream left out because they came too late."""
    operators = (op for progress in query.recentProgress for op in progress["stateOperators"])
    return sum(op.get("numRowsDroppedByWatermark", 0) for op in operators)
