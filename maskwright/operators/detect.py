"""Detection: documents to documents with a ``spans`` column."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.recognizers import CONTEXT_WINDOW, RECOGNIZERS, Recognizer, recognized, select_recognizers
from maskwright.functions.spans import (
    SPAN,
    compute,
    drop_in_protected,
    empty,
    let,
    name,
    quoted,
    resolve_overlaps,
    with_line_column,
)
from maskwright.session import lookup_join

# The marker format, so that markers of either side can be read by the other.
MARKER_OPEN = "{{ENC:"
MARKER_CLOSE = "}}"
MARKER_PATTERN = r"\{\{ENC:([A-Z_]+):([A-Za-z0-9_\-]+=*)\}\}"


def detect(
    docs: DataFrame,
    text: str = "text",
    entities: Iterable[str] | None = None,
    recognizers: Iterable[Recognizer] = RECOGNIZERS,
    overlaps: str = "resolve",
    into: str = "spans",
    also: str | None = None,
    context_window: int = CONTEXT_WINDOW,
) -> DataFrame:
    """Add ``spans``, in start order. ``entities`` restricts the types; unwanted recognizers
    are not even planned. ``overlaps`` is ``resolve`` (disjoint spans, ready for masking) or
    ``keep``. ``also`` names a column of further spans, e.g. of a model or a dictionary; where it
    is NULL, its findings are unknown, and so are the ``spans``. A context word raises a score within
    ``context_window`` characters on either side.
    """
    if overlaps not in ("resolve", "keep"):
        raise ValueError("overlaps must be 'resolve' or 'keep'")
    source = name(text)
    # Existing markers are areas to keep off: they must not be masked again.
    parts = [recognized(source, select_recognizers(entities, recognizers), (MARKER_OPEN, MARKER_PATTERN), context_window)]
    if also is not None:
        parts.append(f"CAST({name(also)} AS array<{SPAN}>)")
    settle = resolve_overlaps if overlaps == "resolve" else drop_in_protected
    kept = f"filter({settle('ordered')}, s -> s.entity_type <> '')"
    kept = let("ordered", "if(size(raw) > 1, array_sort(raw), raw)", kept)
    spans = let("raw", f"concat({', '.join(parts)})", f"if(size(raw) > 0, {kept}, {empty(SPAN)})")
    if also is not None:
        spans = f"if({name(also)} IS NOT NULL, {spans}, NULL)"
    return compute(docs, {into: spans})


def filter_entities(docs: DataFrame, entities: Iterable[str] | None, spans: str = "spans") -> DataFrame:
    """Keep spans of the wanted types; no types given keeps all."""
    wanted = sorted(set(entities or ()))
    if not wanted:
        return docs
    return compute(docs, {spans: f"filter({name(spans)}, s -> s.entity_type IN ({', '.join(map(quoted, wanted))}))"})


def filter_by_list(
    docs: DataFrame, allowed: DataFrame, on: str, by: str = "doc_id", spans: str = "spans", small: bool | None = None
) -> DataFrame:
    """Keep spans of the types that ``allowed`` (columns ``on``, ``entity_type``) names for the
    document's value of ``on``; a value without a list keeps all."""
    lists = allowed.groupBy(on).agg(F.collect_set("entity_type").alias("_allowed"))
    listed = lookup_join(docs, lists, on, small=small, salt_by=by)
    kept = f"filter({name(spans)}, s -> _allowed IS NULL OR array_contains(_allowed, s.entity_type))"
    return compute(listed, {spans: kept}).drop("_allowed")


def matches(docs: DataFrame, keep: Iterable[str] = ("doc_id",), text: str = "text", spans: str = "spans") -> DataFrame:
    """One row per match, with line and column."""
    return docs.select(*keep, F.expr(f"inline({with_line_column(name(text), name(spans))})"))
