"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from maskwright.session import lean_workers, scratch_path

SALTS = 16
BROADCAST_IDS = 1_000_000
BASE = 0x9E3779B97F4A7C15
CHUNK_CHARS = 200_000
ROW_BYTES = 400
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(h: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that looks random."""
    h = (h ^ (h >> np.uint64(30))) * M1
    h = (h ^ (h >> np.uint64(27))) * M2
    return h ^ (h >> np.uint64(31))


def word_hashes(codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of some words, which follow each other in ``codes``, of any length.

    Each character is mixed with its place in the word before the sum, so that, unlike polynomials
    modulo 2^64, no pattern of characters cancels.
    """
    size = end - start
    if not len(size):
        return np.zeros(0, np.uint64)
    begin = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(begin, size)
    h = mix((place.astype(np.uint64) << np.uint64(21) | codes[place + np.repeat(start, size)]) * np.uint64(BASE) + M2)
    return np.add.reduceat(h, begin) + mix(size.astype(np.uint64))


def window_hashes(values: np.ndarray, n: int, base: int = BASE) -> np.ndarray:
    """Polynomial of the ``n`` values from each position, by doubling."""
    piece, width, out, done = values.astype(np.uint64), 1, None, 0
    while True:
        if n & width:
            if out is None:
                out = piece
            else:
                size = len(values) - done - width + 1
                out = out[: max(size, 0)] + np.uint64(pow(base, done, 1 << 64)) * piece[done : done + max(size, 0)]
            done += width
        if width * 2 > n:
            return out
        piece = piece[:-width] + np.uint64(pow(base, width, 1 << 64)) * piece[width:]
        width *= 2


def in_chunks(sizes: Sequence[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of neighbouring texts with about ``limit`` characters; a longer text is a range of its own."""
    begin, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > limit:
            yield begin, i
            begin, held = i, 0
        held += n
    if begin < len(sizes):
        yield begin, len(sizes)


def map_texts(
    rows: DataFrame,
    run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]],
    schema: str,
    column: str = "text",
    limit: int = CHUNK_CHARS,
) -> DataFrame:
    """``mapInPandas`` over frames of about ``limit`` bytes of ``column``, however large Arrow's batches are.

    A row counts ``ROW_BYTES`` besides, so frames of short texts are bounded too. Integers with nulls among them stay exact.
    """
    lean_workers(rows.sparkSession)
    made = to_arrow_schema(StructType.fromDDL(schema))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def frames() -> Iterator[pd.DataFrame]:
            for batch in batches:
                sizes = (pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy() + ROW_BYTES).tolist()
                for a, b in in_chunks(sizes, limit):
                    yield batch.slice(a, b - a).to_pandas(integer_object_nulls=True)

        for frame in run(frames()):
            yield pa.RecordBatch.from_pandas(frame, made, preserve_index=False)

    return rows.mapInArrow(mapped, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given folder; also lets Python workers of this machine import the package."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    lean_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df`` written to the cluster's shared folder and read back.

    Cuts the lineage in a way that survives the loss of executors, and lets a table that is
    used several times be computed once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    row_id: str,
    one_row: str,
    size: str,
    salts: int = SALTS,
) -> DataFrame:
    """Inner join of ``rows`` with one row per group, where a group may hold most rows.

    Rows are salted by their id. Groups with more than one row (``size``) are repeated for
    each salt; for a group of one row the id of that row (column ``one_row`` of ``groups``)
    tells the salt. So no key is one task, and the small side stays small.
    """
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    left = rows.withColumn("_salt", salt(F.col(row_id)))
    right = groups.withColumn("_salt", F.explode(F.when(F.col(size) > 1, every).otherwise(F.array(salt(F.col(one_row))))))
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def plain_rows(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """doc_id and text of every row; a null text is empty."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def row_digest(docs: DataFrame, text: str) -> Column:
    """Tells rows of one ``doc_id`` apart by their text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, text: str = "text", limit: int = BROADCAST_IDS) -> DataFrame:
    """``docs`` without the rows named in ``dropped`` (doc_id, text_hash).

    Up to ``limit`` rows (16 bytes each) are broadcast, so that no text is shuffled; more
    are joined by shuffle.
    """
    name = uuid.uuid4().hex  # no column of the caller's is called so
    gone = dropped.select(F.col("doc_id").alias(f"id_{name}"), F.col("text_hash").alias(f"hash_{name}"))
    if gone.limit(limit + 1).count() <= limit:
        gone = F.broadcast(gone)
    marked = docs.withColumn(f"own_{name}", row_digest(docs, text))
    on = marked["doc_id"].eqNullSafe(gone[f"id_{name}"]) & (marked[f"own_{name}"] == gone[f"hash_{name}"])
    return marked.join(gone, on, "left_anti").drop(f"own_{name}")
