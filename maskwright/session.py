"""Session settings, scratch space and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20
SALTS = 64
ARROW_ROWS, ARROW_BYTES = "2000", "4m"
#: large blocks go back to the system when they are freed, and Arrow takes its own from the same place
WORKER_MEMORY = {"MALLOC_MMAP_THRESHOLD_": "4000000", "MALLOC_TRIM_THRESHOLD_": "32000000", "MALLOC_ARENA_MAX": "2", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def build_session(app: str = "maskwright", master: str | None = None) -> SparkSession:
    """A session for local work; on a cluster, take the one the cluster gives."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master is not None:
        builder = builder.master(master)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder of the cluster (``spark.checkpoint.dir``).

    Only where that is unset, as in tests, a folder of this machine is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not (spark.sparkContext.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="maskwright-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def lean_workers(spark: SparkSession) -> None:
    """Small Arrow batches, and Python workers that give memory back; before the first Python function of a session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    for name, value in WORKER_MEMORY.items():
        spark.sparkContext.environment.setdefault(name, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of ``df``, written to scratch space and read back: computed once, and safe from lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores for an input that arrives in fewer partitions than there are cores.

    Text expressions are CPU-bound, and one small file is one task. A large input already
    has more splits than cores and is returned as it is, so no text is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def fits_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and ``size`` bytes of data of unbounded width.

    Takes no more than one row beyond the bound; what an aggregate below it has to read, it reads.
    """
    nested = ("array", "map", "struct")
    wide = [F.octet_length(f"`{f.name}`") for f in df.schema if f.dataType.typeName() in ("string", "binary")]
    wide += [F.octet_length(F.to_json(F.struct(f"`{f.name}`"))) for f in df.schema if f.dataType.typeName() in nested]
    total = sum((F.coalesce(w, F.lit(0)) for w in wide), F.lit(0))
    count, held = df.limit(rows + 1).agg(F.count("*"), F.coalesce(F.sum(total), F.lit(0))).first()
    return count <= rows and held <= size


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: str,
    how: str = "left",
    small: bool | None = None,
    salt_by: str | Sequence[str] = "doc_id",
    salts: int = SALTS,
) -> DataFrame:
    """Join a large table to a lookup table.

    A lookup of checked size is broadcast. A larger one is joined by shuffle; a key that holds a
    large share of the rows is not one task, as Spark splits skewed partitions of the left side.
    Where it is told not to, the left rows of each key are spread over ``salts`` partitions by
    ``salt_by`` and the lookup is repeated for each. ``small`` is the outcome of the check where
    the caller has made it.
    """
    if small is None:
        small = fits_broadcast(right)
    if small:
        return left.join(F.broadcast(right), on, how)
    if splits_skew(left.sparkSession):
        return left.join(right, on, how)
    by = [salt_by] if isinstance(salt_by, str) else salt_by
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*by), F.lit(salts)).cast("int"))
    repeated = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return salted.join(repeated, [on, "_salt"], how).drop("_salt")


def splits_skew(spark: SparkSession) -> bool:
    """Whether Spark splits the partitions of a join that are much larger than others."""
    return all(spark.conf.get(f"spark.sql.adaptive.{k}", "true").lower() == "true" for k in ("enabled", "skewJoin.enabled"))
