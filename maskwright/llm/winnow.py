"""Document fingerprints by winnowing.

Every run of ``gram`` code points is hashed, each window of ``window`` neighbouring hashes
selects its least one (the rightmost of equals), and the selected hashes are kept with their
positions. Two texts that share a run of ``gram + window - 1`` code points (39 by default)
share a selected hash of that run; a text of at least twice that length shares one with each
text that has its first half.

Results in special cases: a null or empty text has no hashes; a text shorter than ``gram``
has the hash of the whole text; two texts without hashes are alike (1.0), one without and
one with are not (0.0); rows of one id are ordered by their text, and rows without an id
come last; a single row follows itself; repeated rows are compared like others; an empty table gives an
empty result; a text of any length is hashed whole, with some 100 bytes of memory a character; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import CHUNK_CHARS, map_texts, plain_rows, window_hashes

GRAM = 24
WINDOW = 16
BASE = 0x2545F4914F6CDD1D
COARSE = 64


def winnow(texts: list[str], gram: int = GRAM, window: int = WINDOW) -> list[tuple[np.ndarray, np.ndarray]]:
    """Selected hashes (32 bits) of each text and their positions, in order of position."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    # a text shorter than a gram is filled up with zeros
    held = np.where(lens > 0, np.maximum(lens, gram), 0)
    first = np.cumsum(held) - held
    flat = np.zeros(int(held.sum()), np.uint64)
    flat[np.arange(len(codes)) + np.repeat(first - (np.cumsum(lens) - lens), lens)] = codes + np.uint64(1)
    grams = np.where(lens > 0, np.maximum(lens - gram + 1, 1), 0)
    # grams of all texts in a row, each text followed by a gap that no window looks across
    room = grams + window
    begin = np.cumsum(room) - room
    key = np.full(int(room.sum()), np.iinfo(np.uint64).max, np.uint64)
    count = int(grams.sum())
    pos = np.arange(count) - np.repeat(np.cumsum(grams) - grams, grams)
    h = window_hashes(flat, gram, BASE)[pos + np.repeat(first, grams)] if count else np.zeros(0, np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    key[pos + np.repeat(begin, grams)] = (h & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - pos.astype(np.uint64))
    least, width = key, 1
    while width < window:
        step = min(width, window - width)
        least = least.copy()
        least[:-step] = np.minimum(least[:-step], least[step:])
        width += step
    windows = np.where(grams > 0, np.maximum(grams - window + 1, 1), 0)
    chosen = least[np.arange(int(windows.sum())) + np.repeat(begin - (np.cumsum(windows) - windows), windows)]
    owner = np.repeat(np.arange(len(texts)), windows)
    fresh = np.ones(len(chosen), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])
    chosen, owner = chosen[fresh], owner[fresh]
    hashes, places = (chosen >> np.uint64(32)).astype(np.uint32), 0xFFFFFFFF - (chosen & np.uint64(0xFFFFFFFF)).astype(np.int64)
    cuts = np.searchsorted(owner, np.arange(1, len(texts)))
    return list(zip(np.split(hashes, cuts), np.split(places, cuts), strict=True))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, each sorted and distinct."""
    if not len(a) and not len(b):
        return 1.0
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def fingerprint(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and prints (hash, pos) of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = winnow(batch.pop("text").tolist(), gram, window)
            yield batch.assign(prints=[[{"hash": int(h), "pos": int(p)} for h, p in zip(*f, strict=True)] for f in found])

    return map_texts(plain_rows(docs, text, doc_id), run, "doc_id long, prints array<struct<hash:long,pos:long>>")


def _ranges(docs: DataFrame) -> list[int]:
    """Ids of the table that cut it into ranges of about equal numbers of rows; the last is the largest id."""
    n = min(20_000, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [i / n for i in range(1, n)]
    cut = docs.agg(F.percentile_approx("doc_id", shares, 50 * n).alias("at"), F.max("doc_id").alias("top")).first()
    return sorted({*(cut["at"] or []), cut["top"]} - {None})


def _range_of(bounds: list[int]):
    """Number of bounds below an id, searched in two steps."""
    coarse = F.array(*[F.lit(b) for b in bounds[COARSE - 1 :: COARSE]]) if len(bounds) >= COARSE else F.array().cast("array<bigint>")
    skipped = F.size(F.filter(coarse, lambda b: b < F.col("doc_id"))) * COARSE
    fine = F.slice(F.array(*map(F.lit, bounds)), skipped + 1, F.lit(COARSE))
    return F.coalesce(skipped + F.size(F.filter(fine, lambda b: b < F.col("doc_id"))), F.lit(0))


def compare_with_next(docs: DataFrame, gram: int = GRAM, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of each text, of its edited text, and how alike they are; see the query's contract.

    ``places`` has where the chosen grams begin, in order, as little-endian unsigned 32-bit integers: two
    of them are never more than ``window`` apart.

    The next document of each is that of the next smaller id. Rows are dealt by ranges of
    ids that end at ids of the table; the row at the end of a range also goes, as a guest,
    to the range above. So texts are shuffled once, and tasks stream through sorted rows.
    """
    rows = plain_rows(docs, text, doc_id)
    bounds = _ranges(rows)
    own = F.struct(F.col("_range"), F.lit(0).alias("guest"))
    if bounds:
        at_end = F.col("doc_id").isin(bounds[-1:]) if len(bounds) == 1 else F.array_contains(F.array(*map(F.lit, bounds)), F.col("doc_id"))
        above = F.struct(F.pmod(F.col("_range") + 1, F.lit(len(bounds))).alias("_range"), F.lit(1).alias("guest"))
        targets = F.when(at_end, F.array(own, above)).otherwise(F.array(own))
        dealt = rows.withColumn("_range", _range_of(bounds))
    else:
        targets, dealt = F.array(own), rows.withColumn("_range", F.lit(0))
    placed = dealt.select("doc_id", "text", F.explode(targets).alias("_to")).select("doc_id", "text", "_to.*")
    ordered = placed.repartition("_range").sortWithinPartitions("_range", "guest", F.col("doc_id").desc_nulls_last(), "text")

    def compared(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
        halves = [len(t) // 2 for t in texts]
        edited = [t[: len(t) - h] + n[:h] for t, n, h in zip(texts, following, halves, strict=True)]
        prints = winnow(texts + edited + following[-1:], gram, window)
        sets = [np.unique(f[0]) for f in prints]
        n = len(texts)
        after = [sets[i + 1] if following[i] is texts[i + 1] else None for i in range(n - 1)] + [sets[-1]]
        for i in [i for i, s in enumerate(after) if s is None]:
            after[i] = np.unique(winnow([following[i]], gram, window)[0][0])
        return pd.DataFrame(
            {
                "doc_id": pd.array(ids, dtype="Int64"),
                "n_chars": [len(t) for t in texts],
                "edited_sha256": [hashlib.sha256(e.encode()).hexdigest() for e in edited],
                "fingerprint": [s.astype(">u4").tobytes().hex() for s in sets[:n]],
                "edited_fingerprint": [s.astype(">u4").tobytes().hex() for s in sets[n : 2 * n]],
                "near_edited": [likeness(sets[i], sets[n + i]) for i in range(n)],
                "near_next": [likeness(sets[i], after[i]) for i in range(n)],
                "places": [f[1].astype("<u4").tobytes() for f in prints[:n]],
            }
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, head = None, None  # the row that waits for its next one; the first row of its range
        ids, texts, following, size = [], [], [], 0

        def take(after: str) -> None:
            nonlocal held, size
            ids.append(held[0])
            texts.append(held[1])
            following.append(after)
            size += len(held[1])
            held = None

        for batch in batches:
            for i, t, r, g in zip(batch["doc_id"].tolist(), batch["text"].tolist(), batch["_range"].tolist(), batch["guest"].tolist(), strict=True):
                if held is not None:
                    take(t if held[2] == r else head[1])
                if head is None or head[2] != r:
                    head = (i, t, r)
                if not g:
                    held = (None if pd.isna(i) else int(i), t, r)
                if size > CHUNK_CHARS:
                    yield compared(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
        if held is not None:
            take(head[1])
        if ids:
            yield compared(ids, texts, following)

    return ordered.mapInPandas(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, places binary",
    )
