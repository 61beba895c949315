"""Names, places and organisations by dictionary.

A dictionary of checked size goes to the workers as an automaton, and each text is walked
once, where it lies. Of a larger one a filter of bounded size goes there, and the word sequences
that pass it are joined to the terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.automaton import Automaton, TermFilter, Words
from maskwright.functions.spans import SPAN, compute, empty, let, located, name, quoted, record, with_text
from maskwright.session import BROADCAST_BYTES, BROADCAST_ROWS, fits_broadcast, lookup_join, written

# A word is a run of letters, digits and the signs that occur inside names.
WORD = r"[\p{L}\p{N}_#&.'-]+"
WORD_END = r"[.'-]+$"
TERM_SALTS = 8
PART_BYTES = 400_000
WORDS = "struct<start:int,end:int,text:string>"


def normal_term(term: str) -> str:
    """SQL for a term as it is compared: its words, without final dots, one space between."""
    words = f"transform(regexp_extract_all({term}, {quoted(WORD)}, 0), w -> regexp_replace(w, {quoted(WORD_END)}, ''))"
    return f"array_join(filter({words}, w -> w <> ''), ' ')"


def _lexicon(terms: DataFrame) -> DataFrame:
    normal = terms.select(F.expr(normal_term("term")).alias("_gram"), "entity_type").where("_gram <> ''")
    # shuffled first, so that no task that reads terms holds the distinct ones of all it reads
    return normal.repartition("_gram", "entity_type").distinct()


def find_terms(
    docs: DataFrame, lexicon: DataFrame, text: str = "text", into: str = "dictionary_spans", score: float = 0.85
) -> DataFrame:
    """Add the spans of all terms of ``lexicon``, which has to be of checked size; ``docs`` are not shuffled."""
    told = [(r["_gram"], r["entity_type"]) for r in lexicon.collect()]
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(told))
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64()), ("text", pa.string())])

    def found(batch: pa.Array) -> pa.Array:
        known = automaton.value
        texts = [t or "" for t in batch.to_pylist()]
        owner, start, end, term = known.find(texts)
        stands = [texts[o][a:b] for o, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)]
        kinds = [known.terms[t][1] for t in term.tolist()]
        columns = [pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(kinds, pa.string()), pa.array(np.full(len(term), float(score))), pa.array(stands, pa.string())]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(struct)))

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [found(batch.slice(a, b - a)) for a, b in _parts(pc.fill_null(pc.binary_length(batch), 0).to_numpy())]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(struct))

    column = F.arrow_udf(spans, f"array<{SPAN}>")
    return docs.withColumn(into, column(F.col(text)))


def _parts(sizes: np.ndarray, limit: int = PART_BYTES) -> list[tuple[int, int]]:
    """Ranges of texts with about ``limit`` bytes."""
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // limit)) + 1
    edges = [0, *cuts.tolist(), len(sizes)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def with_dictionary(
    docs: DataFrame,
    terms: DataFrame,
    by: str = "doc_id",
    text: str = "text",
    into: str = "dictionary_spans",
    score: float = 0.85,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Add the spans of all terms (``term``, ``entity_type``), for ``detect(..., also=into)``.

    With a dictionary of checked size texts stay where they are; with a larger one they are joined
    to the spans that are found, by id and text, as ids may be repeated or NULL.
    """
    lexicon = _lexicon(terms)
    if fits_broadcast(lexicon, broadcast_rows):
        return find_terms(docs, lexicon, text, into, score)
    keyed = docs.withColumn("_row", F.xxhash64(F.col(by), F.col(text)))
    spans = _joined_spans(keyed, written(lexicon, "lexicon"), "_row", text, score)
    return attach_spans(keyed, spans, "_row", text, into).drop("_row")


def dictionary_spans(
    docs: DataFrame,
    terms: DataFrame,
    by: str = "doc_id",
    text: str = "text",
    score: float = 0.85,
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int = TERM_SALTS,
) -> DataFrame:
    """One row ``(by, start, end, entity_type, score, text)`` per occurrence of a term.

    ``terms`` has ``term`` and ``entity_type``; ``text`` is the term found. Each document
    gives its words, in the row. Those that begin a term give word sequences up to the length
    of the longest term, and the sequences meet the terms in an equi-join. A dictionary of
    checked size is broadcast, and nothing is shuffled. A larger one is joined by shuffle, to the
    sequences that pass a filter.
    """
    lexicon = _lexicon(terms)
    size, bytes_, longest = lexicon.agg(
        F.count("*"), F.sum(F.octet_length("_gram")), F.max(F.size(F.split("_gram", " ")))
    ).first()
    if size > broadcast_rows or (bytes_ or 0) > BROADCAST_BYTES:
        return _joined_spans(docs, written(lexicon, "lexicon"), by, text, score, salts)
    found = let(
        "gaps", f"split({name(text)}, {quoted(WORD)}, -1)", located("found", "gaps", "''", lambda gap: "0D")
    )
    trimmed = f"regexp_replace(w.text, {quoted(WORD_END)}, '')"
    words = (
        f"filter(transform({let('found', f'regexp_extract_all({name(text)}, {quoted(WORD)}, 0)', found)},"
        f" w -> named_struct('start', w.start, 'end', w.start + length({trimmed}), 'text', {trimmed})), w -> w.text <> '')"
    )
    tokenized = compute(docs.select(by, text), {"_words": f"coalesce({words}, {empty(WORDS)})"})
    heads = lexicon.select(F.substring_index("_gram", " ", 1).alias("_head")).distinct()
    # Each word takes along as many words as the longest term has, not the whole document.
    ahead = record(_head="_words[i].text", _next=f"slice(_words, i + 1, {int(longest or 1)})")
    each = f"if(size(_words) > 0, transform(sequence(0, size(_words) - 1), i -> {ahead}), array())"
    starts = tokenized.selectExpr(name(by), f"inline({each})")
    # Most words begin no term; they are gone before any sequence is put together.
    starts = starts.join(F.broadcast(heads), "_head", "left_semi")
    gram = record(
        start="_next[0].start",
        end="_next[n - 1].end",
        _gram="array_join(transform(slice(_next, 1, n), w -> w.text), ' ')",
    )
    grams = f"transform(sequence(1, size(_next)), n -> {gram})"
    rows = starts.selectExpr(name(by), f"inline({grams})")
    return _span_rows(lookup_join(rows, lexicon, "_gram", "inner", small=True), by, score)


def _span_rows(hits: DataFrame, by: str, score: float) -> DataFrame:
    return hits.select(
        by, "start", "end", "entity_type", F.lit(float(score)).alias("score"), F.col("_gram").alias("text")
    )


def term_filter(lexicon: DataFrame) -> TermFilter:
    """A filter that lets all terms of ``lexicon`` pass; the driver gets its bits, of bounded number."""
    size = lexicon.count()
    lengths = [r[0] for r in lexicon.select(F.size(F.split("_gram", " "))).distinct().collect()]
    places = TermFilter.places_for(size)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = batch.column(0)
            for a, b in _parts(pc.binary_length(grams).to_numpy()):
                at = TermFilter.spots(Words(grams.slice(a, b - a).to_pylist()).whole_hashes(), places).ravel()
                slots, bit = (at >> np.uint64(6)).astype(np.int32), (np.uint64(1) << (at & np.uint64(63))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(bit)], ["slot", "bits"])

    told = lexicon.select("_gram").mapInArrow(bits, "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    held = np.zeros(places >> 6, np.uint64)
    held[told.column("slot").to_numpy()] = told.column("bits").to_numpy().view(np.uint64)
    return TermFilter(held, tuple(sorted(lengths)))


def _joined_spans(docs: DataFrame, lexicon: DataFrame, by: str, text: str, score: float, salts: int = TERM_SALTS) -> DataFrame:
    """The rows of ``dictionary_spans`` for a ``lexicon`` of any size, which is read more than once.

    Word sequences that pass the filter are nearly always terms; they meet the terms in an
    equi-join, so what was let through wrongly is gone.
    """
    shared = docs.sparkSession.sparkContext.broadcast(term_filter(lexicon))
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("_gram", pa.string())])

    def passed(batch: pa.Array) -> pa.Array:
        texts = [t or "" for t in batch.to_pylist()]
        words = Words(texts)
        first, last = shared.value.passed(words)
        owner = words.owner[first]
        at = words.first[owner]
        grams = [words.text(a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        columns = [pa.array(words.start[first] - at, pa.int32()), pa.array(words.end[last] - at, pa.int32()), pa.array(grams, pa.string())]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(struct)))

    def sequences(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [passed(batch.slice(a, b - a)) for a, b in _parts(pc.fill_null(pc.binary_length(batch), 0).to_numpy())]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(struct))

    column = F.arrow_udf(sequences, "array<struct<start:int,end:int,_gram:string>>")
    rows = docs.select(by, column(F.col(text)).alias("_passed")).selectExpr(name(by), "inline(_passed)")
    return _span_rows(lookup_join(rows, lexicon, "_gram", "inner", small=False, salt_by=(by, "start"), salts=salts), by, score)


def attach_spans(
    docs: DataFrame, spans: DataFrame, by: str = "doc_id", text: str = "text", into: str = "dictionary_spans"
) -> DataFrame:
    """Bring span rows back to their documents, with the text as it stands there, for
    ``detect(..., also=into)``. Documents without spans are joined to nothing; if the others
    are few, no document is shuffled."""
    span = F.struct("start", "end", "entity_type", "score", "text").cast(SPAN)
    collected = written(spans.groupBy(by).agg(F.array_sort(F.collect_set(span)).alias("_found")), "spans")
    joined = docs.join(F.broadcast(collected) if fits_broadcast(collected) else collected, by, "left")
    found = f"coalesce({with_text(name(text), '_found')}, {empty(SPAN)})"
    return compute(joined, {into: found}).drop("_found")
