"""Packing of token sequences by a configuration linear program over the length histogram.

Documents are encoded, ended by id 0, and cut only where they are longer than a sequence.
The histogram of lengths (at most ``capacity`` rows) is all the driver sees. Over classes of
lengths, a covering program whose columns are fillings of one sequence is solved by
multiplicative weights, with a knapsack by dynamic programming as pricing. The solution is
rounded down to whole fillings of true lengths; what is left, with the short pieces held
back for the gaps, goes best-fit into what has room. The plan is a list of fillings with
multiplicities, whose size depends on the number of lengths and not of documents; each
piece finds its place by its rank among the pieces of its length.

Results in special cases: a null or empty text is the single id 0; repeated rows are pieces
like others; an empty table gives an empty result; other columns are ignored; a text of any
length is encoded whole and cut into pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.bpe import encoder
from maskwright.llm.common import map_texts, plain_rows, staged

CAPACITY = 2048
END_ID = 0
UNIT = 16
HELD_BACK = 96
ROWS_PER_BUCKET = 20_000
Fillings = list[tuple[tuple[int, ...], int]]


# -- the program, over a histogram ------------------------------------------------------


def _knapsack(weights: np.ndarray, sizes: np.ndarray, room: int) -> np.ndarray:
    """How often each class is taken in the most valuable filling."""
    best, take = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        fit = int(np.searchsorted(sizes, c, side="right"))
        if fit:
            value = best[c - sizes[:fit]] + weights[:fit]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], take[c] = value[k], k
    counts = np.zeros(len(sizes), np.int64)
    c = room
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            counts[take[c]] += 1
            c -= sizes[take[c]]
    return counts


def fractional_cover(sizes: np.ndarray, demand: np.ndarray, room: int, step: float = 0.25, rounds: int = 800) -> list[tuple[np.ndarray, float]]:
    """Fillings and how often each is used, so that every class is covered; by multiplicative weights."""
    covered, used = np.zeros(len(sizes)), {}
    sharp = np.log(len(sizes) + 1) / step
    for _ in range(rounds):
        price = np.exp(-step * sharp * (covered - covered.min())) / demand
        config = _knapsack(price, sizes, room)
        held = config > 0
        amount = float(step * (demand[held] / config[held]).min())
        key = config.tobytes()
        used[key] = used.get(key, 0.0) + amount
        covered += config * amount / demand
        if covered.min() >= sharp:
            break
    low = covered.min()
    return [(np.frombuffer(k, np.int64), x / low) for k, x in used.items()] if low > 0 else []


def _round_down(left: np.ndarray, capacity: int, unit: int, held_back: int) -> Fillings:
    """Whole fillings of true lengths from the fractional solution; takes them from ``left``."""
    out: Fillings = []
    room = capacity // unit
    lengths = np.arange(len(left))
    group = np.minimum(-(-lengths // unit), room)  # a class is as long as its longest length
    for _ in range(3):
        demand = np.bincount(group[held_back + 1 :], weights=left[held_back + 1 :], minlength=room + 1)
        sizes = np.flatnonzero(demand)
        if not len(sizes):
            break
        plan = fractional_cover(sizes, demand[sizes], room)
        before = left.sum()
        for config, x in sorted(plan, key=lambda p: (-p[1], p[0].tobytes())):
            times = int(x)
            slots = np.repeat(sizes, config)
            while times > 0 and len(slots):
                chosen: list[int] = []
                wanted: dict[int, int] = {}
                for g in slots.tolist():
                    low, high = max((g - 1) * unit + 1, held_back + 1), min(g * unit, capacity)
                    if len(chosen) == len(slots) - 1:  # the longest piece of all that fit closes the sequence
                        low, high = held_back + 1, capacity - sum(chosen)
                    for n in range(high, low - 1, -1):
                        if left[n] > wanted.get(n, 0):
                            wanted[n] = wanted.get(n, 0) + 1
                            chosen.append(n)
                            break
                if len(chosen) < len(slots):
                    break
                if capacity - sum(chosen) > unit // 8:
                    break  # too much room: left to the next program or to best fit
                m = min(times, *(int(left[n]) // k for n, k in wanted.items()))
                for n, k in wanted.items():
                    left[n] -= m * k
                out.append((tuple(chosen), m))
                times -= m
        if left.sum() > 0.9 * before:
            break
    return out


def best_fit(left: np.ndarray, fillings: Fillings, capacity: int) -> Fillings:
    """Put what is left, longest first, where it leaves least room; many sequences at a time."""
    by_room: list[list[tuple[tuple[int, ...], int]]] = [[] for _ in range(capacity + 1)]
    for items, count in fillings:
        by_room[capacity - sum(items)].append((items, count))
    for n in range(capacity, 0, -1):
        c, room = int(left[n]), n
        while c and room <= capacity:
            if not by_room[room]:
                room += 1
                continue
            items, count = by_room[room].pop()
            m = min(c, count)
            if count > m:
                by_room[room].append((items, count - m))
            by_room[room - n].append(((*items, n), m))
            c -= m
            if room - n >= n:  # what is left there fits more tightly
                room -= n
        if c:
            each = capacity // n
            if c // each:
                by_room[capacity - each * n].append(((n,) * each, c // each))
            if c % each:
                by_room[capacity - (c % each) * n].append(((n,) * (c % each), 1))
    return [g for groups in by_room for g in groups]


def solve(histogram: dict[int, int], capacity: int = CAPACITY, unit: int = UNIT, held_back: int = HELD_BACK) -> Fillings:
    """Fillings with multiplicities that hold exactly the pieces of the histogram."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, c in histogram.items():
        counts[n] = c
    left = counts.copy()
    whole = _round_down(left, capacity, unit, min(held_back, capacity // 8))
    return best_fit(left, whole, capacity)


# -- tables -----------------------------------------------------------------------------


def cut_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document; ``ids`` themselves by ``encode_table``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        end = np.array([END_ID], "<u4")
        for batch in batches:
            names = batch["doc_id"].to_numpy()
            out = []
            ids, counts = enc.encode(batch["text"].tolist())
            for k, row in enumerate(np.split(ids.astype("<u4"), np.cumsum(counts)[:-1])):
                row = np.concatenate([row, end])
                for p, s in enumerate(range(0, len(row), capacity)):
                    part = row[s : s + capacity]
                    out.append((names[k], p, s, len(part), zlib.crc32(part.tobytes())))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
        enc.forget()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    return map_texts(plain_rows(docs, text, doc_id), run, schema)


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id and offset; reads them twice, so they should be a written table.

    The ranks of a length that holds many pieces are counted in several buckets.
    """
    spark = pieces.sparkSession
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    if not histogram:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    keys, seqs, offsets = [], [], []
    used, base = dict.fromkeys(histogram, 0), 0
    for items, count in solve(histogram, capacity):
        at = 0
        for n in items:
            keys.append((n, used[n]))
            seqs.append(base)
            offsets.append(at)
            used[n] += count
            at += n
        base += count
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    slot_n = np.array([keys[i][0] for i in order], np.int64)
    slot_rank = np.array([keys[i][1] for i in order], np.int64)
    slot_seq, slot_at = np.array(seqs, np.int64)[order], np.array(offsets, np.int64)[order]
    slot_key = slot_n << 48 | slot_rank

    sizes = [(n, max(1, -(-c // ROWS_PER_BUCKET))) for n, c in histogram.items()]
    buckets = spark.createDataFrame(sizes, "length long, _of int")  # at most ``capacity`` rows
    dealt = pieces.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_of")))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base_of = counts.select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("_rank", F.row_number().over(within) - 1).join(base_of, ["length", "_bucket"])
    ranked = ranked.select(*pieces.columns, (F.col("_base") + F.col("_rank")).alias("_rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n, rank = batch["length"].to_numpy(np.int64), batch.pop("_rank").to_numpy(np.int64)
            at = np.searchsorted(slot_key, n << 48 | rank, side="right") - 1
            yield batch.assign(sequence_id=slot_seq[at] + rank - slot_rank[at], offset=slot_at[at])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(place, f"{fields}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places in as few sequences as the plan finds."""
    return assign(staged(cut_pieces(docs, path, capacity), "pieces"), capacity)
