"""Names, places and organisations by a tagger of our own, trained from spans that are known.

Training is iterative parameter mixing: each of ``SHARDS`` tasks makes a pass of an averaged
structured perceptron over its share of a bounded sample of documents, from the weights that all
agreed on, and the weights of all tasks are averaged. Tagging is an expression over the row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.functions.spans import SPAN
from maskwright.functions.tagging import Model, Sentences, decode, labels_of, spans_of, train_pass
from maskwright.operators.dictionary import _parts
from maskwright.session import written

TYPES = ("LOCATION", "ORGANIZATION", "PERSON")
SHARDS = 8
SAMPLE = 4_000  # documents that train, about
PASSES = 4
TRAIN_CHARS = 4_000  # of a document that trains, what lies this far around its known spans
WEIGHTS = "shard int, emit binary, move binary, late_emit binary, late_move binary"


def _around(text: str, spans: list[dict], reach: int) -> tuple[str, list[tuple[int, int, str]]]:
    """The whole lines of a text that lie within ``reach`` of its spans, or its begin if it has none."""
    low = min((s["start"] for s in spans), default=0)
    high = max((s["end"] for s in spans), default=0)
    a = text.rfind("\n", 0, max(low - reach, 0)) + 1
    b = text.find("\n", min(high + reach, len(text)))
    return text[a : b if b >= 0 else len(text)], [(s["start"] - a, s["end"] - a, s["entity_type"]) for s in spans]


def train_tagger(
    docs: DataFrame, types: Sequence[str] = TYPES, spans: str = "spans", text: str = "text", by: str = "doc_id",
    sample: int = SAMPLE, passes: int = PASSES, shards: int = SHARDS, label: Callable[[DataFrame], DataFrame] | None = None,
) -> Model:
    """A model of documents whose ``spans`` are known; those of other types count as outside.

    With ``label`` the documents have no spans yet: it adds them to those that train.

    At most about ``sample`` documents train, picked by a hash of their id; what the driver gets in a pass
    are the weights of each of the ``shards``, of fixed size.
    """
    kinds = tuple(sorted(types))
    rows = docs.where(F.col(text).isNotNull())
    share = min(1.0, sample / max(1, rows.select(by).count()))
    # the ids decide before spans are looked for, and what is picked is written once for all passes
    picked = rows if share >= 1 else rows.where(F.pmod(F.xxhash64(by), F.lit(1 << 20)) < int(share * (1 << 20)))
    if label is not None:
        picked = label(written(picked.select(by, text), "picked"))
    picked = picked.select(by, F.col(text).alias("text"), F.col(spans).alias("spans"))
    shard = F.pmod(F.xxhash64(F.col(by), F.lit(1)), F.lit(shards)).cast("int")
    kept = written(picked.where(F.col("spans").isNotNull()).select(shard.alias("shard"), by, "text", "spans"), "training")
    dealt = kept.repartition(shards, "shard").sortWithinPartitions("shard", by, "text")
    sparkc = docs.sparkSession.sparkContext
    model = average = Model.blank(kinds)
    for _ in range(passes):
        sent = sparkc.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held: dict[int, tuple[list, list]] = {}  # a bounded sample: ``sample`` documents of bounded length
            for batch in batches:
                for row in batch.to_pylist():
                    near, found = _around(row["text"], row["spans"], TRAIN_CHARS)
                    texts, told = held.setdefault(row["shard"], ([], []))
                    texts.append(near)
                    told.append(found)
            for number, (texts, told) in sorted(held.items()):
                sentences = Sentences(texts)
                now, mean = train_pass(sent.value, sentences.features, labels_of(sentences, told, kinds), sentences.begin, sentences.size)
                weights = [pa.array([w.tobytes()], pa.binary()) for w in (now.emit, now.move, mean.emit, mean.move)]
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), *weights], ["shard", "emit", "move", "late_emit", "late_move"])

        told = sorted(dealt.mapInArrow(run, WEIGHTS).collect(), key=lambda r: r["shard"])
        if not told:
            return model
        mixed = {c: np.mean([np.frombuffer(r[c], np.float32) for r in told], axis=0) for c in ("emit", "move", "late_emit", "late_move")}
        model = Model(kinds, mixed["emit"].reshape(model.emit.shape), mixed["move"].reshape(model.move.shape))
        average = Model(kinds, mixed["late_emit"].reshape(model.emit.shape), mixed["late_move"].reshape(model.move.shape))
    return average


def tag(docs: DataFrame, model: Model, text: str = "text", into: str = "tagged_spans", score: float = 0.6) -> DataFrame:
    """Add the spans that the model tells, for ``detect(..., also=into)``; a text that is NULL has none."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    struct = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("entity_type", pa.string()), ("score", pa.float64()), ("text", pa.string())])

    def found(batch: pa.Array) -> pa.Array:
        texts = [t or "" for t in batch.to_pylist()]
        sentences = Sentences(texts)
        known = shared.value
        owner, start, end, kind = spans_of(sentences, decode(known, sentences.features, sentences.begin, sentences.size))
        stands = [texts[o][a:b] for o, a, b in zip(owner.tolist(), start.tolist(), end.tolist(), strict=True)]
        columns = [
            pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array([known.types[k] for k in kind.tolist()], pa.string()),
            pa.array(np.full(len(start), float(score))), pa.array(stands, pa.string()),
        ]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(struct)))

    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            parts = [found(batch.slice(a, b - a)) for a, b in _parts(pc.fill_null(pc.binary_length(batch), 0).to_numpy(), 100_000)]
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.list_(struct))

    return docs.withColumn(into, F.arrow_udf(spans, f"array<{SPAN}>")(F.col(text)))
