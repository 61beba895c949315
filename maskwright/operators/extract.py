"""Text of binary documents: pages put together, extractors tried in turn."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import first_nonempty, normalize_text
from maskwright.operators.dictionary import _parts
from maskwright.session import lean_workers

PAGES_PER_CHUNK = 256


def assemble_pages(
    pages: DataFrame, doc: str = "doc_id", page_no: str = "page_no", text: str = "text", into: str = "text"
) -> DataFrame:
    """The pages of a document in order, with a blank line between; a page without text is empty.

    Runs of pages are joined first, by tasks of their own, so that a document with a very
    large number of pages is sorted and joined in parts.
    """
    chunk = F.floor(F.col(page_no) / F.lit(PAGES_PER_CHUNK)).alias("_chunk")
    page = F.struct(F.col(page_no).alias("no"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parts = pages.groupBy(doc, chunk).agg(_joined(page).alias("text"))
    part = F.struct(F.col("_chunk").alias("no"), F.col("text"))
    return parts.groupBy(doc).agg(_joined(part).alias(into))


def _joined(numbered):
    ordered = F.array_sort(F.collect_list(numbered))
    return F.array_join(F.transform(ordered, lambda p: p["text"]), "\n\n")


def extract_text(
    files: DataFrame,
    extractors: Sequence[tuple[str, Callable[[bytes], str | None]]],
    content: str = "content",
    keep: Sequence[str] = ("path",),
) -> DataFrame:
    """Run text extractors on binary content; the first that gives text wins.

    Each extractor takes the bytes and returns a text or None; what it raises counts as
    None. The result has ``text`` (normalised), ``extractor``, ``error`` and, where no text was found,
    ``reasons``, what the extractors raised. Parsers are
    imported inside the extractors, on the workers. A later extractor runs only on the
    documents which the earlier ones could not read. A worker holds the bytes of one document at a time
    and the texts of a few beside Spark's batch.
    """
    named = list(extractors)
    lean_workers(files.sparkSession)

    def read(data: bytes | None) -> tuple[str | None, str | None, str | None]:
        raised = []
        for label, extractor in named:
            try:
                text = extractor(data) if data is not None else None
            except Exception as exc:
                text = None
                raised.append(f"{label}: {exc}")
            if text:
                return text, label, "; ".join(raised) or None
        return None, None, "; ".join(raised) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(content)), 0).to_numpy()
            for a, b in _parts(sizes):
                part = batch.slice(a, b - a)
                told = [read(data.as_py()) for data in part.column(content)]
                texts = [pa.array(column, pa.string()) for column in zip(*told, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.select(list(keep)).columns, *texts], [*keep, "_text", "extractor", "reasons"])

    kept = files.select(*keep, content)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)
    found = kept.mapInArrow(run, f"{schema}, _text string, extractor string, reasons string")
    text = first_nonempty(F.col("_text"))
    return found.select(
        *keep,
        F.when(text.isNotNull(), normalize_text(text)).alias("text"),
        "extractor",
        F.when(text.isNull(), "no extractor gave text").alias("error"),
        F.when(text.isNull(), F.col("reasons")).alias("reasons"),
    )
