"""Masking of newly arriving documents."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from maskwright.functions.spans import compute, name
from maskwright.functions.text import output_path, report_path
from maskwright.operators import audit
from maskwright.operators.audit_log import append_events
from maskwright.operators.mask import masking_error
from maskwright.operators.report import type_counts


def document_stream(
    spark: SparkSession, path: str, schema: T.StructType, glob: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Parquet files as they arrive in a folder."""
    reader = spark.readStream.schema(schema)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", str(files_per_batch))
    return reader.parquet(path)


def table_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """The files of one table, which may be a single file or a folder of them."""
    # Spark takes a plain path for a folder; a pattern may name either
    return document_stream(spark, f"{path[:-1]}[{path[-1]}]", schema, files_per_batch=files_per_batch)


def protect_stream(
    docs: DataFrame,
    transform: Callable[[DataFrame, datetime], DataFrame],
    documents: str,
    audit_log: str,
    checkpoint: str,
    mode: str,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    user: str | None = None,
    trigger: dict | None = None,
    path: Column | None = None,
    by: str = "doc_id",
) -> StreamingQuery:
    """Mask a stream of documents with the same row-wise ``transform`` as a batch.

    ``transform`` gives ``masked`` and ``spans``. Each micro-batch replaces its own folder of the
    document table, and its events are committed to the audit log as one run, so a batch that is run
    again after a loss leaves no doubles. The events are those of a batch job, one per document, named
    by ``path``. There is no state, hence nothing that grows and no watermark.
    """
    path = path if path is not None else F.concat(F.lit("doc_"), F.col(by).cast("string"), F.lit(".md"))
    stream = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        now = clock()
        counted = compute(transform(batch, now), {"pii_total": f"size({name('spans')})", "entity_counts": type_counts()})
        folder = f"{documents}/batch={batch_id}"
        stored = counted.withColumns({"path": path, "error": masking_error()}).withColumn("n_spans", F.col("pii_total"))
        stored.drop("text", "spans").write.mode("overwrite").parquet(folder)
        written = batch.sparkSession.read.parquet(folder)
        out = output_path(F.col("path"))
        events = audit.pii_events(written, F.col("path"), mode, out, report_path(out), now, user)
        append_events(events, audit_log, f"stream-{stream}-{batch_id}")

    return (
        docs.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
