"""Tables whose rows are deleted where they lie.

A version of a table is a list of its Parquet files. To delete rows, the files that hold any of
them are found by a scan of the key column alone; only those are written anew, without the rows,
and a new list is published. Files that hold none stay as they are, under their names.
Readers of an older version are not disturbed; ``vacuum`` removes what no list names.

    <path>/data/<write>/part-*.parquet
    <path>/versions/<number>.txt
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.sources.commits import files, publish


class Conflict(RuntimeError):
    """Another writer published the version first; nothing was changed."""


def _write(rows: DataFrame, path: str, per_file: int | None) -> list[str]:
    """Write rows to a folder of their own; the files, relative to the table."""
    folder = f"data/{uuid.uuid4().hex}"
    writer = rows.write if per_file is None else rows.write.option("maxRecordsPerFile", per_file)
    writer.parquet(f"{path}/{folder}")
    fs, at = files(rows.sparkSession, f"{path}/{folder}")
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    return [f"{folder}/{n}" for n in sorted(names) if n.startswith("part-")]


def latest(spark: SparkSession, path: str) -> int:
    """The number of the newest version."""
    fs, at = files(spark, f"{path}/versions")
    numbers = [int(n[:-4]) for s in fs.listStatus(at) if (n := s.getPath().getName()).endswith(".txt") and n[:-4].isdigit()]
    return max(numbers)


def files_of(spark: SparkSession, path: str, version: int | None = None) -> list[str]:
    """The files of a version, relative to the table; as many names as Spark itself lists to read them."""
    number = latest(spark, path) if version is None else version
    return sorted(r["value"] for r in spark.read.text(f"{path}/versions/{number:08d}.txt").collect() if r["value"])


def create(rows: DataFrame, path: str, per_file: int | None = None) -> int:
    """A new table; ``per_file`` bounds the rows of a file."""
    names = _write(rows, path, per_file)
    if not publish(rows.sparkSession, f"{path}/versions/{0:08d}.txt", "\n".join(names)):
        raise Conflict(path)
    return 0


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version, by default the newest."""
    return spark.read.parquet(*(f"{path}/{n}" for n in files_of(spark, path, version)))


def delete_rows(spark: SparkSession, path: str, gone: DataFrame, key: str, per_file: int | None = None) -> int:
    """Delete the rows whose ``key`` is in ``gone``; the number of the version without them.

    A NULL key is in no list, so its rows stay. A writer who comes second gets a ``Conflict``.
    """
    number = latest(spark, path)
    names = files_of(spark, path, number)
    ids = gone.select(key).where(F.col(key).isNotNull()).distinct()
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    hits = read(spark, path, number).select(key, name.alias("_file")).join(ids, key, "left_semi").select("_file").distinct()
    hit = {r["_file"] for r in hits.collect()}  # of the files listed above
    if not hit:
        return number
    touched = [n for n in names if n.rsplit("/", 1)[-1] in hit]
    left = spark.read.parquet(*(f"{path}/{n}" for n in touched)).join(ids, key, "left_anti")
    kept = [n for n in names if n.rsplit("/", 1)[-1] not in hit]
    fresh = _write(left, path, per_file)
    if not publish(spark, f"{path}/versions/{number + 1:08d}.txt", "\n".join(kept + fresh)):
        raise Conflict(path)
    return number + 1


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> list[str]:
    """Remove the files that only versions before the last ``keep`` have, and those versions; gives the files."""
    last = latest(spark, path)
    old = [v for v in range(max(0, last - keep + 1)) if _has(spark, path, v)]
    kept = {n for v in range(max(0, last - keep + 1), last + 1) for n in files_of(spark, path, v)}
    gone = sorted({n for v in old for n in files_of(spark, path, v)} - kept)
    for name in [*(f"versions/{v:08d}.txt" for v in old), *gone]:
        fs, at = files(spark, f"{path}/{name}")
        fs.delete(at, False)
    return gone


def _has(spark: SparkSession, path: str, version: int) -> bool:
    fs, at = files(spark, f"{path}/versions/{version:08d}.txt")
    return fs.exists(at)
