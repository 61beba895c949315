"""Similarity join of word n-gram sets by PartEnum signatures.

Two sets of Jaccard similarity 0.8 or more whose larger one has at most ``u`` members differ in
at most ``k = 2u/9`` members. Sizes are cut into bands, ``u`` being the end of a band; a set
takes part in the bands where a larger partner may lie. For a band, the domain of n-grams is
hashed into first-level partitions, and each of those (in bands of small sets) into
second-level ones. By the pigeonhole principle similar sets agree on a first-level partition
but for one second-level partition, so each subset that leaves one out is a signature.
Empty projections agree for unrelated sets; there are more partitions than needed, and only
sets whose non-empty ones could all differ emit the empty ones too. So no pair is lost.

Sets that share a signature are one cell, named by its least set. A signature that a share
``HEAVY`` or more of a sample of sets hold gets its least set by sums before the shuffle and a
table of bounded size, all others by sorting; the sample decides only on the way. The members of a cell are first compared with
its least set, many tasks sharing a large cell. Sets that these links connect, also through other
cells, need not be compared with each other. The rest of a cell are compared, in blocks of bounded size, with
each other and with those connected with the least set, so a family of near copies costs time in
proportion to its size if these links connect most of it. Before sets are shuffled, sketches rule out pairs that differ too much.
Sketches are small, so a set goes into one block of them for each ``SIFT_ROWS`` / 2 others of its cell; what they leave is cut
into smaller blocks of whole sets, each with those that have a partner in it. Sets that share signatures without being
linked through centers remain pairs to be ruled out, in time that grows with the square of their number. Of the
links found in a block, only a spanning star per component leaves the task. Equal sets are
merged before all this. Components are then found over these edges. Sets are
compared as sets of 64-bit hashes of n-grams, words of any length being hashed character by character.

Results in special cases: a null text, or one without words, has an empty set and is linked
with nothing; with fewer words than ``gram`` the whole sequence is the one member; rows of one
id count as one document in the links; rows without an id have no component; repeated rows
are equal sets; an empty table gives an empty result; texts may have any length, and one is
worked on whole, with some 100 bytes of memory a character; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.llm.common import BASE, BROADCAST_IDS, M1, M2, attach_groups, map_texts, mix, plain_rows, row_digest, staged, without, word_hashes

GRAM = 5
NUMBER, OF = 4, 5  # similarity of at least 4/5
BAND = 1.4
SPARE = 1.15
SMALL = 300
BLOCK_ROWS, BLOCK_MEMBERS = 800, 400_000
SIFT_ROWS, SIFT_MEMBERS = 6000, 16_000_000  # of sketches, which have a few bytes for many members
TILE_CELLS = 1_000_000
HEAVY, SAMPLED = 0.001, 64

KEY = ["center", "lo", "hi"]
PART = [*KEY, "part"]

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def shingles(texts: list[str], gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram hashes of all texts in a row, and the text each belongs to."""
    raw = [t.encode() for t in texts]
    whole = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    bounds = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
    gap = (whole == 32) | ((whole >= 9) & (whole <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    word = word_hashes(_FOLD[whole], start, end)
    owner = np.searchsorted(bounds, start, side="right")
    count = np.bincount(owner, minlength=len(texts))
    grams = np.where(count >= gram, count - gram + 1, (count > 0).astype(np.int64))
    first = np.cumsum(count) - count
    of = np.repeat(np.arange(len(texts)), grams)
    at = np.arange(len(of)) - np.repeat(np.cumsum(grams) - grams, grams) + np.repeat(first, grams)
    h = np.zeros(len(of), np.uint64)
    stop = first[of] + count[of]
    padded = np.concatenate([word, np.zeros(gram, np.uint64)])
    for k in range(gram):
        h = h * np.uint64(BASE) + np.where(at + k < stop, padded[at + k], np.uint64(k + 1))
    h = mix(h)
    code, distinct = pd.factorize(h ^ (of.astype(np.uint64) * M1))
    keep = np.empty(len(distinct), np.int64)
    keep[code[::-1]] = np.arange(len(code))[::-1]
    keep.sort()
    return h[keep], of[keep]


def _bands() -> np.ndarray:
    """Last size of each band."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND)))
    return np.array(ends, np.int64)


ENDS = _bands()


def shape(band: int) -> tuple[int, int, int, int]:
    """Bound on differences, first- and second-level partitions, and differences that a subset tolerates."""
    k = int(2 * ENDS[band] * (OF - NUMBER) // (OF + NUMBER))
    left_out = 1 if 0 < k and ENDS[band] <= SMALL else 0
    first = 1 if k == 0 else int(np.ceil(SPARE * (k // (1 + left_out) + 1)))
    return k, first, 3 if left_out else 1, left_out


def signatures(hashes: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets 0..n-1 and the set each belongs to."""
    size = np.bincount(of, minlength=n)
    low = np.searchsorted(ENDS, size)
    high = np.searchsorted(ENDS, size * OF // NUMBER)
    sigs, owners = [], []
    for band in np.unique(np.concatenate([np.unique(low[size > 0]), np.unique(high[size > 0])])).tolist():
        k, first, second, left_out = shape(band)
        here = np.flatnonzero((size > 0) & (low <= band) & (band <= high))
        if not len(here):
            continue
        place = np.full(n, -1, np.int64)
        place[here] = np.arange(len(here))
        mine = place[of] >= 0
        h = mix(hashes[mine] + np.uint64((band * 2 + 1) * int(M2) % (1 << 64)))
        cell = place[of[mine]] * (first * second) + ((h >> np.uint64(33)) % np.uint64(first * second)).astype(np.int64)
        cells = len(here) * first * second
        value = mix(h ^ M1)
        total = np.zeros(cells, np.uint64)
        np.add.at(total, cell, value)
        held = np.bincount(cell, minlength=cells).reshape(len(here), first, second)
        total = total.reshape(len(here), first, second)
        if left_out:
            total = total.sum(axis=2, keepdims=True, dtype=np.uint64) - total
            held = held.sum(axis=2, keepdims=True) - held
        full = held > 0
        few = full.all(axis=2).sum(axis=1) <= k // (1 + left_out)
        emit = full | few[:, None, None]
        seed = mix(np.arange(first * second, dtype=np.uint64).reshape(first, second) + np.uint64(band) * np.uint64(1 << 32) + M1)
        sigs.append(mix(total ^ seed[None])[emit])
        owners.append(np.broadcast_to(here[:, None, None], emit.shape)[emit])
    if not sigs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(sigs), np.concatenate(owners)


def _sums(values: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of the values of each set; ``of`` is sorted."""
    out = np.zeros(n, np.uint64)
    here, begin = np.unique(of, return_index=True)
    if len(here):
        out[here] = np.add.reduceat(values, begin)
    return out


def sketches(hashes: np.ndarray, of: np.ndarray, size: np.ndarray) -> list[bytes]:
    """Parities of the members that fall on each of a power of two of bits, at least one bit a member.

    Each member that only one of two sets has flips one bit, so two sets differ in at least
    as many members as their sketches differ in bits. Folding a sketch halves its bits.
    """
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64))
    begin = np.cumsum(bits) - bits
    spot = begin[of] + (mix(hashes ^ M2) & (bits[of] - 1).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(spot, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8), bitorder="little")
    return [packed[a : a + n].tobytes() for a, n in zip((begin // 8).tolist(), (bits // 8).tolist(), strict=True)]


def _close(apart: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets of sizes ``a`` and ``b`` that differ in ``apart`` members or more may be similar enough."""
    return (apart * (OF + NUMBER) <= (a + b) * (OF - NUMBER)) & (np.minimum(a, b) * OF >= np.maximum(a, b) * NUMBER)


def near_pairs(size: np.ndarray, held: list[bytes], other: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """A set and those that, by sizes and sketches, may be similar enough; each pair once.

    With ``other`` (whether a set is of the second of two blocks), only pairs of sets of different blocks.
    """
    words = np.fromiter((len(b) // 8 for b in held), np.int64, len(held))
    for n in np.unique(words).tolist():
        small, large = np.flatnonzero(words == n), np.flatnonzero(words == 2 * n)
        rows = np.frombuffer(b"".join(held[i] for i in small), np.uint64).reshape(len(small), n)
        folded = np.frombuffer(b"".join(held[i] for i in large), np.uint64).reshape(len(large), 2, n)
        every = np.concatenate([rows, folded[:, 0] ^ folded[:, 1]])
        who = np.concatenate([small, large])
        if other is None:
            partners = lambda k, i: (every[k + 1 :], who[k + 1 :])
        else:  # sets of one sketch size meet once, those of the first block being first
            second, longer = other[who], np.arange(len(who)) >= len(small)
            of_side = [(every[there], who[there]) for there in (second, ~second & longer)]
            partners = lambda k, i: of_side[int(other[i])]
        for k, i in enumerate(small.tolist()):
            sketch, rest = partners(k, i)
            apart = np.bitwise_count(sketch ^ every[k]).sum(axis=1, dtype=np.int64)
            close = rest[_close(apart, size[i], size[rest])]
            if len(close):
                yield i, close


def may_link(size: np.ndarray, held: list[bytes]) -> np.ndarray:
    """Which of some sets have a partner that, by sizes and sketches, may be similar enough."""
    found = np.zeros(len(held), bool)
    for i, close in near_pairs(size, held):
        found[i] = True
        found[close] = True
    return found


def narrow(size: np.ndarray, held: list[bytes], other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of bounded size in which all pairs of ``near_pairs`` meet: a row and its block, for each row that a block needs."""
    rows, before = np.arange(len(held)), np.cumsum(size) - size
    _, chunk = np.unique(np.stack([rows // max(1, BLOCK_ROWS // 2), before // max(1, BLOCK_MEMBERS // 2)]), axis=1, return_inverse=True)
    chunk = chunk.reshape(-1)
    chunks = int(chunk.max(initial=0)) + 1
    needs = np.zeros((len(held), chunks), bool)
    for i, close in near_pairs(size, held, other):
        needs[i, chunk[close]] = True
        needs[close, chunk[i]] = True
    found = needs.any(axis=1)
    if found.sum() <= BLOCK_ROWS and size[found].sum() <= BLOCK_MEMBERS:
        return np.flatnonzero(found), np.zeros(int(found.sum()), np.int64)
    row, with_ = np.nonzero(needs)
    return row, np.minimum(chunk[row], with_) * chunks + np.maximum(chunk[row], with_)


def pairs_may_link(size: np.ndarray, held: list[bytes], other_size: np.ndarray, other: list[bytes]) -> np.ndarray:
    """Whether the two sets of each pair may be similar enough, by sizes and sketches."""
    lens = np.array([(len(a) // 8, len(b) // 8) for a, b in zip(held, other, strict=True)], np.int64).reshape(-1, 2)
    ok = np.zeros(len(held), bool)
    for n, m in np.unique(lens, axis=0).tolist():
        if max(n, m) > 2 * min(n, m):
            continue
        here = np.flatnonzero((lens == (n, m)).all(axis=1))
        least = min(n, m)
        sides = [np.frombuffer(b"".join(side[i] for i in here), np.uint64).reshape(len(here), -1, least) for side in (held, other)]
        a, b = (np.bitwise_xor.reduce(side, axis=1) for side in sides)
        ok[here] = _close(np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64), size[here], other_size[here])
    return ok


def set_facts(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """doc_id, text_hash, n_shingles, a 128-bit digest of the set (d1, d2), and its sketch; ``docs`` has doc_id and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            h, of = shingles(batch.pop("text").tolist(), gram)
            d1, d2 = (_sums(mix(h + s), of, n).view(np.int64) for s in (M1, M2))
            size = np.bincount(of, minlength=n)
            yield batch.assign(n_shingles=size, d1=d1, d2=d2, sketch=sketches(h, of, size))

    rows = docs.select("doc_id", row_digest(docs, "text").alias("text_hash"), "text")
    return map_texts(rows, run, "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, sketch binary")


def set_signatures(docs: DataFrame, gram: int = GRAM, heavy: np.ndarray | None = None, only: bool = False) -> DataFrame:
    """sig, doc_id: signatures of each document; without those in ``heavy`` (sorted), or ``only`` those."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].to_numpy()
            h, of = shingles(batch["text"].tolist(), gram)
            sig, owner = signatures(h, of, len(ids))
            sig = sig.view(np.int64)
            if heavy is not None and len(heavy):
                known = heavy[np.minimum(np.searchsorted(heavy, sig), len(heavy) - 1)] == sig
                sig, owner = sig[known == only], owner[known == only]
            yield pd.DataFrame({"sig": sig, "doc_id": ids[owner]})

    return map_texts(docs.select("doc_id", "text"), run, "sig long, doc_id long")


def member_sets(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """doc_id and the set itself, as 64-bit hashes in a binary."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = len(batch)
            h, of = shingles(batch.pop("text").tolist(), gram)
            yield batch.assign(members=[p.tobytes() for p in np.split(h, np.searchsorted(of, np.arange(1, n)))])

    return map_texts(docs.select("doc_id", "text"), run, "doc_id long, members binary")


def block_links(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Edges that join each set to the first of its component among these sets."""
    g = len(sets)
    size = np.fromiter(map(len, sets), np.int64, g)
    code, distinct = pd.factorize(np.concatenate(sets))
    row = np.repeat(np.arange(g), size)
    often = np.bincount(code, minlength=len(distinct)) > 1
    row, code = row[often[code]], code[often[code]]
    column = np.cumsum(often) - 1
    code = column[code]
    both = np.zeros((g, g), np.float32)
    wide = int(often.sum())
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    step = max(64, TILE_CELLS // g)
    for at in range(0, wide, step):
        a, b = np.searchsorted(code, [at, at + step])
        x = np.zeros((g, min(step, wide - at)), np.float32)
        x[row[a:b], code[a:b] - at] = 1
        both += x @ x.T
    union = size[:, None] + size[None, :] - both
    linked = both * OF >= union * NUMBER
    np.fill_diagonal(linked, True)
    label = np.arange(g)
    while True:
        new = np.where(linked, label[None, :], g).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = np.minimum(label, new)
    return [(int(ids[i]), int(ids[label[i]])) for i in range(g) if label[i] != i]


def heavy_signatures(docs: DataFrame, gram: int = GRAM, share: float = HEAVY, sampled: int = SAMPLED) -> np.ndarray:
    """Signatures that a large share of a sample of documents hold, sorted; at most the signatures of 1 / ``share`` documents."""
    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sampled)) == 0)
    seen = staged(set_signatures(sample, gram).groupBy("sig").agg(F.count("*").alias("n")), "sampled")
    size = sample.count()
    found = seen.where(F.col("n") >= max(8, size * share)).select("sig").collect()
    return np.sort(np.array([r["sig"] for r in found], np.int64))


def cells(docs: DataFrame, gram: int = GRAM, heavy: np.ndarray | None = None) -> DataFrame:
    """center, doc_id: every set with the least set of each signature that it shares.

    Sets that share a signature are all in the cell of that signature's center.
    """
    least = F.min("doc_id").over(Window.partitionBy("sig"))
    light = set_signatures(docs, gram, heavy).withColumn("center", least).where("doc_id <> center").select("center", "doc_id").distinct()
    if heavy is None or not len(heavy):
        return light
    rows = set_signatures(docs, gram, heavy, only=True)
    # one row for each heavy signature, whose number is bounded
    centers = rows.groupBy("sig").agg(F.min("doc_id").alias("center"))
    dense = rows.join(F.broadcast(centers), "sig").where("doc_id <> center").select("center", "doc_id").distinct()
    return light.unionByName(dense).distinct()


def _only(rows: DataFrame, ids: DataFrame, limit: int) -> DataFrame:
    """The ``rows`` whose doc_id is in ``ids``; up to ``limit`` of these are broadcast, so that ``rows`` are not shuffled."""
    ids = ids.select("doc_id").distinct()
    if ids.limit(limit + 1).count() <= limit:
        ids = F.broadcast(ids)
    return rows.join(ids, "doc_id", "left_semi")


def _tasks(spark) -> int:
    """Tasks for work that takes much time for few bytes, which adaptive execution would put into few."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _blocks(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """The rows of one block after the other, from rows sorted by block."""
    now, held = None, []
    for batch in batches:
        for key, part in batch.groupby(by, sort=False):
            if key != now and held:
                yield now, pd.concat(held)
                held = []
            now = key
            held.append(part)
    if held:
        yield now, pd.concat(held)


def linked_with_center(docs: DataFrame, found: DataFrame, facts: DataFrame, gram: int, limit: int) -> DataFrame:
    """center, doc_id: the rows of ``found`` (center, doc_id) that are linked; cells are dealt to tasks by bounded parts."""
    seen = facts.select("doc_id", F.col("n_shingles").alias("n"), "sketch").distinct()  # an id may have several sets
    groups = found.groupBy("center").agg(F.count("*").alias("size"), F.min("doc_id").alias("one"))
    groups = groups.join(seen.select(F.col("doc_id").alias("center"), F.col("n").alias("center_n"), F.col("sketch").alias("center_sketch")), "center")
    pairs = attach_groups(found.join(seen, "doc_id"), groups, ["center"], "doc_id", "one", "size")

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ok = pairs_may_link(batch["n"].to_numpy(), batch["sketch"].tolist(), batch["center_n"].to_numpy(), batch["center_sketch"].tolist())
            yield batch.loc[ok, ["center", "doc_id", "part"]]

    parts = F.ceil(F.col("size") / BLOCK_ROWS)
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("doc_id"), parts).cast("int"))
    pairs = pairs.select("center", "doc_id", "part", "n", "sketch", "center_n", "center_sketch")
    close = staged(pairs.mapInPandas(sift, "center long, doc_id long, part int").distinct(), "close")
    sent = close.withColumn("role", F.lit(1)).unionByName(close.select("center", F.col("center").alias("doc_id"), "part", F.lit(0).alias("role")).distinct())
    sets = member_sets(_only(docs.select("doc_id", "text"), sent, limit), gram)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, centers = None, []  # the sets of the center, which is one row but for ids with several texts
        for batch in batches:
            ok = np.zeros(len(batch), bool)
            rows = zip(batch["center"].tolist(), batch["part"].tolist(), batch["role"].tolist(), batch["members"], strict=True)
            for k, (c, part, role, members) in enumerate(rows):
                own = np.frombuffer(members, np.uint64)
                if role == 0:
                    key, centers = (c, part), [*(centers if key == (c, part) else []), np.sort(own)]
                    continue
                for center in centers:
                    both = int((center[np.minimum(np.searchsorted(center, own), len(center) - 1)] == own).sum())
                    ok[k] |= both * OF >= (len(own) + len(center) - both) * NUMBER
            yield batch.loc[ok, ["center", "doc_id"]]

    ordered = sets.join(sent, "doc_id").repartition(_tasks(docs.sparkSession), "center", "part").sortWithinPartitions("center", "part", "role", "doc_id")
    return staged(ordered.select("center", "part", "role", "doc_id", "members").mapInPandas(compare, "center long, doc_id long").distinct(), "linked")


def links(docs: DataFrame, facts: DataFrame, gram: int = GRAM, limit: int = BROADCAST_IDS) -> DataFrame:
    """src, dst: edges whose components are those of all links between ``docs`` (distinct sets, with an id).

    ``facts`` has doc_id, n_shingles and sketch of at least these. Up to ``limit`` ids are broadcast, so
    that only the sets of cells are shuffled.
    """
    found = staged(cells(docs, gram, heavy_signatures(docs, gram)), "cells")
    linked = linked_with_center(docs, found, facts, gram, limit)
    stars = linked.select(F.col("doc_id").alias("src"), F.col("center").alias("dst"))

    # those that these links connect with the center, be it through other cells, need not be compared with
    # each other; the rest of a cell, against each other and them
    known = staged(components(stars), "known").withColumnRenamed("node", "doc_id")
    own = found.join(known, "doc_id", "left").select("center", "doc_id", F.coalesce("component", "doc_id").alias("_own"))
    groups = found.groupBy("center").agg(F.count("*").alias("_size"), F.min("doc_id").alias("_one"))
    groups = groups.join(known.withColumnRenamed("doc_id", "center"), "center", "left")
    groups = groups.select("center", "_size", "_one", F.coalesce("component", "center").alias("_theirs"))
    both = attach_groups(own, groups, ["center"], "doc_id", "_one", "_size")
    both = staged(both.select("center", "doc_id", (F.col("_own") == F.col("_theirs")).cast("int").alias("side")), "sides")
    sized = both.join(facts.groupBy("doc_id").agg(F.max("n_shingles").alias("_n")), "doc_id")
    half = lambda side: F.greatest(
        F.ceil(2 * F.count(F.when(F.col("side") == side, 1)) / SIFT_ROWS), F.ceil(2 * F.sum(F.when(F.col("side") == side, F.col("_n")).otherwise(0)) / SIFT_MEMBERS)
    )
    counts = sized.groupBy("center").agg(half(0).cast("int").alias("_rest"), half(1).cast("int").alias("_kin"), F.count("*").alias("_size"), F.min("doc_id").alias("_one"))
    counts = counts.where("_rest > 0 AND _size > 1")
    # blocks of the rest are numbered from 0, those of the linked ones after them
    mixed = F.xxhash64("doc_id")
    block = F.when(F.col("side") == 0, F.pmod(mixed, F.col("_rest"))).otherwise(F.col("_rest") + F.pmod(mixed, F.greatest("_kin", F.lit(1)))).cast("int")
    others = F.sequence(F.lit(0), F.when(F.col("side") == 0, F.col("_rest") + F.col("_kin") - 1).otherwise(F.col("_rest") - 1))
    dealt = attach_groups(both, counts, ["center"], "doc_id", "_one", "_size").select("center", "doc_id", block.alias("_own"), F.explode(others).alias("_other"))
    lo, hi = F.least("_own", "_other"), F.greatest("_own", "_other")
    dealt = staged(dealt.select("center", "doc_id", lo.alias("lo"), hi.alias("hi"), (F.col("_own") > lo).alias("other")), "blocks")

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (_, lo, hi), block in _blocks(batches, KEY):
            # two blocks are compared with each other here, and each with itself elsewhere
            row, part = narrow(block["n_shingles"].to_numpy(), block["sketch"].tolist(), block["other"].to_numpy(bool) if lo < hi else None)
            yield block[["doc_id", *KEY]].iloc[row].assign(part=part)

    tasks = _tasks(docs.sparkSession)
    rows = _only(facts.select("doc_id", "n_shingles", "sketch"), dealt, limit)
    ordered = rows.join(dealt, "doc_id").repartition(tasks, *KEY).sortWithinPartitions(*KEY, "doc_id")
    close = staged(ordered.mapInPandas(sift, "doc_id long, center long, lo int, hi int, part long").distinct(), "close")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, block in _blocks(batches, PART):
            edges = block_links(block["doc_id"].to_numpy(), [np.frombuffer(m, np.uint64) for m in block["members"]])
            yield pd.DataFrame(edges, columns=["src", "dst"]).astype("int64")

    sets = member_sets(_only(docs.select("doc_id", "text"), close, limit), gram).join(close, "doc_id")
    ordered = sets.repartition(tasks, *PART).sortWithinPartitions(*PART, "doc_id").select(*PART, "doc_id", "members")
    return stars.unionByName(ordered.mapInPandas(compare, "src long, dst long")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that can be reached, for every node of ``edges`` (src, dst)."""
    stars, before = edges.select("src", "dst").where("src <> dst"), None
    while True:
        # every node shows its larger neighbours the least of its neighbourhood, then all smaller ones
        sym = stars.unionByName(stars.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = sym.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m"))
        large = sym.where(F.col("dst") > F.col("src")).join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        large = large.distinct()
        least = large.groupBy("src").agg(F.min("dst").alias("m"))
        small = large.join(least, "src").select(F.col("dst").alias("src"), F.col("m").alias("dst"))
        small = small.unionByName(least.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        stars = staged(small, "stars")
        after = stars.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if after == before:
            return stars.select(F.col("src").alias("node"), F.col("dst").alias("component"))
        before = after


def near_groups(docs: DataFrame, gram: int = GRAM, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id reachable by links) of every row."""
    rows = plain_rows(docs, text, doc_id)
    facts = staged(set_facts(rows, gram), "sets")
    linked = facts.where("n_shingles > 0 AND doc_id IS NOT NULL")
    digest = ["d1", "d2", "n_shingles"]
    reps = linked.groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = staged(attach_groups(linked, reps.where("copies > 1"), digest, "doc_id", "rep", "copies").where("doc_id <> rep"), "copies")
    distinct = without(rows.where("doc_id IS NOT NULL"), copies)
    edges = links(distinct, linked, gram)
    found = components(edges)
    named = reps.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component_id", F.coalesce("component", "rep"))
    grouped = attach_groups(linked, named, digest, "doc_id", "rep", "copies").select("doc_id", "n_shingles", "component_id")
    alone = facts.where("n_shingles = 0 OR doc_id IS NULL")
    lone = F.when(F.col("n_shingles") == 0, F.col("doc_id")).alias("component_id")
    return grouped.unionByName(alone.select("doc_id", "n_shingles", lone))


def keep_one(docs: DataFrame, gram: int = GRAM) -> DataFrame:
    """One row of every group of near duplicates, that of the least id, and all rows without an id.

    Rows of one id with different texts are judged each for itself; equal rows stay or go together. Rows are told apart by a
    64-bit hash of id and text.
    """
    rows = plain_rows(docs, "text", "doc_id").where("doc_id IS NOT NULL").withColumn("text_hash", row_digest(docs, "text"))
    rows = rows.withColumn("node", F.xxhash64("doc_id", "text"))
    found = near_groups(rows.select("node", "text"), gram, "text", "node").where("doc_id IS NOT NULL")
    grouped = found.select(F.col("doc_id").alias("node"), "component_id").where("component_id IS NOT NULL").distinct()
    # only nodes in groups of several; the others stay as they are
    groups = grouped.groupBy("component_id").agg(F.count("*").alias("size"), F.min("node").alias("one")).where("size > 1")
    several = staged(attach_groups(grouped, groups, ["component_id"], "node", "one", "size").select("node", "component_id"), "grouped")
    named = several.join(rows.select("node", "doc_id", "text_hash").distinct(), "node")
    named = staged(named, "near_rows")
    first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first"), F.count("*").alias("size"), F.min("node").alias("one"))
    gone = attach_groups(named, first, ["component_id"], "node", "one", "size").where(F.col("node") != F.col("first.node"))
    return without(docs, staged(gone.select("doc_id", "text_hash").distinct(), "near_copies")).select(*docs.columns)
