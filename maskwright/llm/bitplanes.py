"""Centroid clustering of integer vectors by bit planes and popcounts.

The 64 components of a vector are integers in two's complement; bit ``i`` of all of them is
one plane, a 64-bit word. A dot product is the sum, over pairs of planes, of the weights of
both planes times the set bits that the planes have in common, so it is exact, and so is
the distance |x|^2 + |c|^2 - 2 x.c. The number of planes follows from the largest component of
the table. Only the planes are stored between rounds. A task adds up how often each bit is
set in each cluster, which gives the exact sums of the components; what reaches the driver in a
round is one number per cluster and component.

Results in special cases: vectors that are null, have other than ``DIMENSIONS`` components,
or hold a null, NaN or infinite component are left out; equal distances go to the smaller
cluster; rows without an id are assigned like others but are no first centroids; rows of one
id are vectors of their own (as first centroids, the one of the least planes first); with fewer
rows than centroids there are as many centroids as rows; an empty table gives an empty result; other columns are ignored. A
component beyond 2^27 in size ends the job with an error, as its squared distances would not fit
a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import staged

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
SEED = 2
LARGEST = 1 << 27
CHUNK = 2048


def weights(planes: int) -> np.ndarray:
    """What a set bit of each plane is worth; the last plane is the sign."""
    w = np.left_shift(np.int64(1), np.arange(planes, dtype=np.int64))
    w[-1] = -w[-1]
    return w


def pack(values: np.ndarray, planes: int) -> np.ndarray:
    """The planes of integer vectors of 64 components, as one row of words per vector."""
    bits = (values[:, None, :] >> np.arange(planes, dtype=np.int64)[None, :, None]) & 1
    return np.packbits(bits.astype(np.uint8), axis=2, bitorder="little").view("<u8")[:, :, 0]


def unpack(words: np.ndarray) -> np.ndarray:
    """The bits of planes: vector, plane, component."""
    words = np.ascontiguousarray(words, "<u8")
    return np.unpackbits(words.view(np.uint8).reshape(*words.shape, 8), axis=2, bitorder="little")


def values_of(words: np.ndarray) -> np.ndarray:
    """The integer vectors that planes stand for."""
    return np.einsum("npd,p->nd", unpack(words).astype(np.int64), weights(words.shape[1]))


def dot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Dot products of all vectors of ``left`` with all of ``right``, both as planes.

    Pairs of planes of one magnitude are counted together before they are weighted; pairs with
    one sign plane count negative.
    """
    planes = left.shape[1]
    out = np.zeros((len(left), len(right)), np.int64)
    for s in range(2 * planes - 1):
        counts = np.zeros(out.shape, np.int16)
        for i in range(max(0, s - planes + 1), min(s, planes - 1) + 1):
            common = np.bitwise_count(left[:, i, None] & right[None, :, s - i])
            if (i == planes - 1) != (s - i == planes - 1):
                counts -= common
            else:
                counts += common
        out += counts.astype(np.int64) << s
    return out


def norms(words: np.ndarray) -> np.ndarray:
    """Squared lengths."""
    planes, w = words.shape[1], weights(words.shape[1])
    out = np.zeros(len(words), np.int64)
    for i in range(planes):
        for j in range(i, planes):
            out += np.bitwise_count(words[:, i] & words[:, j]).astype(np.int64) * (w[i] * w[j] * (1 + (i != j)))
    return out


def nearest(words: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, the first of equal ones, and the squared distance."""
    apart = norms(centroids)[None, :] - 2 * dot(words, centroids)
    which = apart.argmin(axis=1)
    return which, apart[np.arange(len(words)), which] + norms(words)


def _planes_of(column: pa.Array, planes: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u8").reshape(-1, planes)


def components(embedding: Column) -> Column:
    """The integer components of a vector, or null if the vector is not to be kept."""
    real = embedding.cast("array<double>")
    bad = F.exists(real, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    small = F.forall(real, lambda x: F.abs(x * SCALE) < LARGEST)
    whole = F.transform(real, lambda x: F.floor(x * SCALE))
    refused = F.raise_error(F.lit(f"a component of {LARGEST // SCALE} or more has no distance that fits a long"))
    kept = (F.size(real) == DIMENSIONS) & ~bad
    return F.when(kept & small, whole).when(kept, refused.cast("array<bigint>"))


def pack_table(vectors: DataFrame, embedding: str = "embedding", vec_id: str = "vec_id") -> tuple[DataFrame, int]:
    """vec_id and planes (binary) of all vectors that are kept, and the number of planes."""
    whole = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), components(F.col(embedding)).alias("x")).where("x IS NOT NULL")
    low, high = whole.agg(F.min(F.array_min("x")), F.max(F.array_max("x"))).first()
    planes = max((low or 0).bit_length(), (high or 0).bit_length(), (~(low or 0)).bit_length()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
                words = pack(flat.astype(np.int64).reshape(-1, DIMENSIONS), planes)
                packed = pa.array([w.tobytes() for w in words], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), packed], ["vec_id", "planes"])

    return whole.mapInArrow(run, "vec_id long, planes binary"), planes


def first_centroids(packed: DataFrame, planes: int, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """Planes of the vectors whose ids hash lowest, at most ``count``."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    least = packed.where("vec_id IS NOT NULL").select(hashed.alias("h"), "planes").orderBy("h", "planes").limit(count).collect()
    return np.frombuffer(b"".join(r["planes"] for r in least), "<u8").reshape(len(least), planes)


def bit_sums(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, place, n: members of each cluster that have each bit set; place -1 counts the members."""
    planes = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((len(centroids), planes * DIMENSIONS + 1), np.int64)
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                words = _planes_of(batch.column("planes").slice(at, CHUNK), planes)
                which, _ = nearest(words, centroids)
                order = np.argsort(which, kind="stable")
                here, begin = np.unique(which[order], return_index=True)
                bits = unpack(words[order]).reshape(len(words), -1)
                held[here, :-1] += np.add.reduceat(bits, begin, axis=0, dtype=np.int64)
                held[:, -1] += np.bincount(which, minlength=len(centroids))
        cluster, place = np.nonzero(held)
        n = held[cluster, place]
        place = np.where(place == planes * DIMENSIONS, -1, place)
        yield pa.RecordBatch.from_arrays([pa.array(cluster), pa.array(place), pa.array(n)], ["cluster", "place", "n"])

    return packed.select("planes").mapInArrow(run, "cluster long, place long, n long").groupBy("cluster", "place").agg(F.sum("n").alias("n"))


def next_centroids(packed: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Floors of the componentwise means of the clusters; a cluster without members stays."""
    planes = centroids.shape[1]
    worth = weights(planes).tolist()
    count: dict[int, int] = {}
    sums = [[0] * DIMENSIONS for _ in centroids]
    for cluster, place, n in bit_sums(packed, centroids).collect():
        if place < 0:
            count[cluster] = n
        else:
            sums[cluster][place % DIMENSIONS] += n * worth[place // DIMENSIONS]
    moved = centroids.copy()
    for cluster, n in count.items():
        moved[cluster] = pack(np.array([[s // n for s in sums[cluster]]], np.int64), planes)[0]
    return moved


def assign(packed: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    planes = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), CHUNK):
                part = batch.slice(at, CHUNK)
                which, apart = nearest(_planes_of(part.column("planes"), planes), centroids)
                columns = [part.column("vec_id"), pa.array(which, pa.int32()), pa.array(apart)]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return packed.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that is kept.

    ``vectors`` has vec_id and embedding. The table of clusters that is broadcast has ``count`` rows
    at most, and so has what the driver gets for it.
    """
    spark = vectors.sparkSession
    packed, planes = pack_table(vectors)
    packed = staged(packed, "planes")
    centroids = first_centroids(packed, planes, count, seed)
    if not len(centroids):
        centroids = np.zeros((1, planes), np.uint64)  # rows without an id alone: one centroid, which becomes their mean
    for _ in range(rounds):
        centroids = next_centroids(packed, centroids)
    assigned = staged(assign(packed, centroids), "assigned")
    said = [(k, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for k, v in enumerate(values_of(centroids).tolist())]
    sums = {r["cluster"]: r["s"] for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(k, sums[k], sum(sums.values()), digest) for k, digest in said if k in sums]
    per_cluster = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
