"""Audit events, one common table for all operations; metadata only, never content. The log is in ``audit_log``."""

from __future__ import annotations

import os
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.functions.text import basename

# Names and order of the fields of an event.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("directory", T.StringType()),
        T.StructField("input_file", T.StringType()),
        T.StructField("user", T.StringType()),
        T.StructField("mode", T.StringType()),
        T.StructField("pii_total", T.IntegerType()),
        T.StructField("entity_counts", T.MapType(T.StringType(), T.LongType())),
        T.StructField("markers_found", T.IntegerType()),
        T.StructField("markers_decrypted", T.IntegerType()),
        T.StructField("output_file", T.StringType()),
        T.StructField("report_file", T.StringType()),
        T.StructField("retention_days", T.IntegerType()),
        T.StructField("files_deleted", T.LongType()),
        T.StructField("errors", T.LongType()),
        T.StructField("dry_run", T.BooleanType()),
        T.StructField("s3_uri", T.StringType()),
        T.StructField("encryption", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def current_user() -> str:
    return os.getenv("USER") or os.getenv("USERNAME") or "unknown"


def stamp(now: datetime) -> str:
    """ISO time in UTC with ``Z``."""
    return now.astimezone(timezone.utc).replace(tzinfo=None).isoformat() + "Z"


def _event(df: DataFrame, now: datetime, operation: Column, user: str | None, **fields: Column) -> DataFrame:
    given = {"timestamp": F.lit(stamp(now)), "operation": operation, "user": F.lit(user or current_user()), **fields}
    return df.select(
        *[
            given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENT_SCHEMA.fields
        ]
    )


def pii_events(docs: DataFrame, path: Column, mode: str, output: Column, report: Column, now: datetime,
               user: str | None = None) -> DataFrame:
    """One event per document; ``docs`` has ``pii_total`` and ``entity_counts``.

    If there is a column ``error``, a document that has one failed: its event says so, and tells of no
    findings and no output.
    """
    error = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    done = error.isNull()
    return _event(
        docs, now, F.lit(f"pii_{mode}"), user,
        file=basename(path), mode=F.lit(mode), pii_total=F.when(done, F.col("pii_total")),
        entity_counts=F.when(done, F.col("entity_counts")), output_file=F.when(done, basename(output)),
        report_file=F.when(done, basename(report)), status=F.when(~done, "error"), error=error,
    )


def decrypt_events(docs: DataFrame, path: Column, output: Column, now: datetime, user: str | None = None) -> DataFrame:
    """One event per restored document, with the markers found and those that did decrypt."""
    return _event(
        docs, now, F.lit("pii_decrypt"), user,
        file=basename(path), output_file=basename(output),
        markers_found=F.col("markers_found"), markers_decrypted=F.col("markers_decrypted"),
    )


def cleanup_events(summary: DataFrame, directory: str, retention_days: int, dry_run: bool, now: datetime,
                   user: str | None = None) -> DataFrame:
    """The event of a retention run; written with zeros, too, when nothing had expired."""
    return _event(
        summary, now, F.lit("cleanup"), user,
        directory=F.lit(directory), retention_days=F.lit(retention_days),
        files_deleted=F.col("files_deleted"), errors=F.col("errors"), dry_run=F.lit(dry_run),
    )


def upload_events(manifest: DataFrame, now: datetime, user: str | None = None) -> DataFrame:
    return _event(
        manifest, now, F.lit("s3_upload"), user,
        file=basename(F.col("path")), s3_uri=F.col("s3_uri"), encryption=F.col("encryption"),
    )


def job_events(jobs: DataFrame, mode: str, now: datetime, user: str | None = None) -> DataFrame:
    """Start and end of each document's job; ``jobs`` has ``path`` and ``error`` (NULL = success)."""
    mode_col, failed = F.lit(mode), F.col("error").isNotNull()
    phase = F.explode(F.array(F.lit("start"), F.lit("end"))).alias("_phase")
    rows = jobs.select("path", "error", phase)
    ended = F.col("_phase") == "end"
    operation = (
        F.when(~ended, "container_start").when(failed, "container_error").otherwise("container_complete")
    )
    return _event(
        rows, now, operation, user,
        input_file=basename(F.col("path")),
        mode=F.when(~ended | ~failed, mode_col),
        status=F.when(ended & ~failed, "success"),
        error=F.when(ended, F.col("error")),
    )


def union_events(*events: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), events)


def event_json(events: DataFrame) -> DataFrame:
    """One JSON object per event; fields an operation does not have are left out."""
    return events.select("operation", F.to_json(F.struct(*[f.name for f in EVENT_SCHEMA.fields])).alias("event"))

