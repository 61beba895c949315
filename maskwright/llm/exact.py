"""Exact deduplication by a 128-bit content hash, with the bytes compared inside groups.

Results in special cases: a null text counts as empty; null ids rank below all others, and
a group with no id at all has a null ``keep_id``; rows that repeat the id which stays are
all marked as kept, while ``deduplicate`` returns one of them; texts may have any length, and are
compared whole; an empty table gives an empty result; other columns do not matter, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import attach_groups


def _body(text: str) -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def content_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per distinct text: h128, sha256, keep_id (largest id) and group_size.

    The 128-bit hash deals rows to tasks and the aggregation compares whole texts, so two
    texts of one hash stay apart. Copies are combined before the shuffle. The SHA-256 names
    a text in the small tables that follow; two texts of one SHA-256 end the job.
    """
    body = _body(text)
    texts = (
        docs.select(F.col(doc_id).cast("long").alias("_id"), body.alias("_body"))
        .withColumn("h128", F.unhex(F.md5("_body")))
        .groupBy("h128", "_body")
        .agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("h128", F.unhex(F.sha2("_body", 256)).alias("sha256"), "keep_id", "group_size")
    )
    named = texts.groupBy("h128", "sha256").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count("*").alias("_texts")
    )
    safe = F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(
        F.raise_error(F.lit("two texts share both hashes")).cast("long")
    )
    return named.select("h128", "sha256", "keep_id", safe.alias("group_size"))


def find_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    body = _body(text)
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.unhex(F.md5(body)).alias("h128"), F.unhex(F.sha2(body, 256)).alias("sha256")
    )
    groups = content_groups(docs, text, doc_id)
    return attach_groups(rows, groups, ["h128", "sha256"], "doc_id", "keep_id", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One whole row of ``docs`` per distinct text, that with the largest id."""
    rest = [c for c in docs.columns if c != text]
    body = docs.select(
        _body(text).alias("_body"),
        F.col(text).isNull().alias("_null"),
        F.struct(*[F.col(f"`{c}`") for c in rest]).alias("_rest"),
        F.struct(F.col(doc_id), F.to_json(F.struct(*[F.col(f"`{c}`") for c in rest]))).alias("_order"),
    )
    best = (
        body.withColumn("_h128", F.unhex(F.md5("_body")))
        .groupBy("_h128", "_body")
        .agg(F.max_by(F.struct("_null", "_rest"), "_order").alias("_best"))
    )
    own = F.when(~F.col("_best._null"), F.col("_body"))
    return best.select(*[own.alias(c) if c == text else F.col(f"_best._rest.`{c}`").alias(c) for c in docs.columns])
