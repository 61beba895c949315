"""The whole job: read, detect, mask, write, report, audit; and back again."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.fernet import KeyRing
from maskwright.functions.spans import compute, name
from maskwright.functions.text import decrypted_path, normalize_text, output_path, report_path
from maskwright.operators import audit
from maskwright.operators.audit_log import append_events
from maskwright.operators.detect import detect
from maskwright.operators.extract import extract_text
from maskwright.operators.mask import mask, masking_error
from maskwright.operators.report import report, type_counts
from maskwright.operators.unmask import unmask
from maskwright.sources.documents import decode_documents, route
from maskwright.sources.sinks import is_complete, write_documents, write_reports


@dataclass(frozen=True)
class Outputs:
    """Where a run writes."""

    documents: str
    reports: str | None = None
    audit_log: str | None = None


def texts_of(files: DataFrame, extractors=()) -> DataFrame:
    """Binary files (``path``, ``content``) to ``path, text, error``: PDFs through the
    extractors, anything else as UTF-8 text."""
    routed = route(files)
    pdf = routed.where(F.col("route") == "pdf")
    plain = decode_documents(routed.where(F.col("route") == "text").select("path", "content"))
    if not extractors:
        pdf_text = pdf.select("path", F.lit(None).cast("string").alias("text"), F.lit("no extractor").alias("error"))
    else:
        pdf_text = extract_text(pdf, extractors).select("path", "text", "error")
    return plain.select("path", "text", "error").unionByName(pdf_text)


def protect(
    docs: DataFrame,
    mode: str = "encrypt",
    keys: KeyRing | None = None,
    now: datetime | None = None,
    entities: Iterable[str] | None = None,
    policy: Mapping[str, str] | None = None,
    salt: str | None = None,
    key_id: str | None = None,
    by: str = "doc_id",
    normalize: bool = False,
) -> DataFrame:
    """Documents with ``spans``, ``masked``, ``items``, ``pii_total`` and ``entity_counts``.

    One narrow stage from the scan: no shuffle, and each text is searched once.
    """
    if normalize:
        docs = docs.withColumn("text", normalize_text(F.col("text")))
    found = detect(docs, entities=entities)
    masked = mask(found, mode, keys=keys, key_id=key_id, policy=policy, salt=salt, now=now, by=by)
    return compute(masked, {"pii_total": f"size({name('spans')})", "entity_counts": type_counts()})


def run_name(operation: str, documents: str, now: datetime) -> str:
    """The name of a run that is the same when the run is done again."""
    return f"{operation}-{hashlib.sha256(f'{documents} {audit.stamp(now)}'.encode()).hexdigest()[:24]}"


def run_protect(
    docs: DataFrame,
    outputs: Outputs,
    mode: str,
    now: datetime,
    path: Column | None = None,
    by: str = "doc_id",
    user: str | None = None,
    partition_by: Iterable[str] = (),
    run: str | None = None,
    resume: bool = False,
    **options,
) -> None:
    """Write masked documents, reports and audit events.

    The masked table is written first, with the counts but without the matched text, and with ``error``
    for documents that could not be masked; the audit events, failures among them, come from it.
    The reports detect anew rather than store the matched text beside the masked one; they leave the
    text out when the masking is irreversible. The log holds the events of a ``run`` once, by
    default named by its time and its table; with ``resume``, what a killed run has completed is left as it is.
    """
    path = path if path is not None else F.concat(F.lit("doc_"), F.col(by).cast("string"), F.lit(".md"))
    done = protect(docs.withColumn("path", path), mode, now=now, by=by, **options)
    error = masking_error() if "error" not in docs.columns else F.coalesce("error", masking_error())
    spark = docs.sparkSession
    if not (resume and is_complete(spark, outputs.documents)):
        mode_of = "overwrite" if resume else "errorifexists"
        write_documents(done.withColumn("error", error).drop("text", "spans"), outputs.documents, tuple(partition_by), mode=mode_of)
    out = output_path(F.col("path"))
    if outputs.reports is not None and not (resume and is_complete(spark, outputs.reports)):
        found = detect(docs.withColumn("path", path), entities=options.get("entities"))
        written = report(found, F.element_at(F.split(out, "/"), -1), keep=(by, "path"), include_text=mode == "encrypt")
        write_reports(written, outputs.reports, mode="overwrite" if resume else "errorifexists")
    if outputs.audit_log is not None:
        masked = spark.read.parquet(outputs.documents)
        events = audit.pii_events(masked, F.col("path"), mode, out, report_path(out), now, user)
        append_events(events, outputs.audit_log, run or run_name(f"pii_{mode}", outputs.documents, now))


def run_restore(
    masked: DataFrame,
    outputs: Outputs,
    keys: KeyRing,
    now: datetime,
    by: str = "doc_id",
    key_id: str | None = None,
    user: str | None = None,
    run: str | None = None,
) -> None:
    """Write restored documents and audit events for the holder of the keys."""
    restored = unmask(masked, keys, key_id=key_id, by=by)
    write_documents(restored.drop("masked", "items"), outputs.documents)
    if outputs.audit_log is not None:
        stored = masked.sparkSession.read.parquet(outputs.documents)
        events = audit.decrypt_events(stored, F.col("path"), decrypted_path(F.col("path")), now, user)
        append_events(events, outputs.audit_log, run or run_name("pii_decrypt", outputs.documents, now))
