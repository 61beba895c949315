"""Reports and counts over detected spans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import compute, name, with_line_column


def type_counts(spans: str = "spans") -> str:
    """SQL for a map of entity type to number of spans, in order of the types."""
    kinds = f"array_sort(array_distinct(transform({name(spans)}, s -> s.entity_type)))"
    entry = f"struct(kind, CAST(size(filter({name(spans)}, s -> s.entity_type = kind)) AS bigint))"
    return f"map_from_entries(transform({kinds}, kind -> {entry}))"


def with_counts(docs: DataFrame, spans: str = "spans") -> DataFrame:
    """Add ``pii_total`` and the map ``entity_counts``; in the row, without a shuffle."""
    return compute(docs, {"pii_total": f"size({name(spans)})", "entity_counts": type_counts(spans)})


def entity_counts(docs: DataFrame, keep: Iterable[str] = ("doc_id",), spans: str = "spans") -> DataFrame:
    """One row per document and entity type."""
    return docs.select(*keep, F.expr(f"explode({type_counts(spans)}) AS (entity_type, n)"))


def entity_rollup(docs: DataFrame, dims: Iterable[str] = ("source", "lang"), spans: str = "spans") -> DataFrame:
    """Counts for each level of ``dims`` and the entity type, with NULL for "all".

    Each row is reduced to its counts before the shuffle, and partial sums are shuffled, so
    a source that holds a large share of the documents costs no more than a small one.
    """
    dims = tuple(dims)
    counted = entity_counts(docs, dims, spans)
    return counted.rollup(*dims, "entity_type").agg(
        F.sum("n").alias("n_spans"), F.count("*").alias("n_doc_types")
    )


def top_docs(docs: DataFrame, k: int, by: str = "doc_id", spans: str = "spans") -> DataFrame:
    """The ``k`` documents with most findings; each task keeps its own ``k``, ties go to the lower id."""
    sized = compute(docs.select(by, spans), {"n": f"size({name(spans)})"}).select(by, "n")
    return sized.orderBy(F.desc("n"), F.asc(by)).limit(k)


def report(
    docs: DataFrame,
    file: Column,
    keep: Iterable[str] = ("doc_id",),
    text: str = "text",
    spans: str = "spans",
    include_text: bool = True,
) -> DataFrame:
    """One report per document: file name, number of matches, the matches with their place.

    With ``include_text`` the report holds the matched personal data; leave it off where
    the masking is meant to be irreversible.
    """
    placed = with_line_column(name(text), name(spans))
    fields = ["start", "end", "entity_type", "score", "text", "line", "column"]
    if not include_text:
        fields.remove("text")
    row = "named_struct(" + ", ".join(f"'{f}', m.{f}" for f in fields) + ")"
    made = compute(
        docs.select(*keep, text, spans, file.alias("file")),
        {"total": f"size({name(spans)})", "matches": f"transform({placed}, m -> {row})"},
    )
    return made.select(*keep, "file", "total", "matches")


def report_json(reports: DataFrame, keep: Iterable[str] = ("doc_id",), pretty: bool = False) -> DataFrame:
    """Each report as one JSON text; non-ASCII characters stay as they are."""
    options = {"pretty": "true"} if pretty else {}
    return reports.select(*keep, F.to_json(F.struct("file", "total", "matches"), options).alias("report"))
