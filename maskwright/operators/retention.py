"""Retention: which files or rows have expired, and what their removal leaves empty."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import basename


def matches_patterns(path: Column, patterns: Iterable[str] | None) -> Column:
    """Whether the file name contains any of the patterns; no patterns match everything."""
    wanted = list(patterns or ())
    if not wanted:
        return F.lit(True)
    return F.exists(F.array(*[F.lit(p) for p in wanted]), lambda p: F.contains(basename(path), p))


def expired(days: int, now: Column, patterns: Iterable[str] | None = None, mtime: str = "mtime") -> Column:
    """Whether a file was last changed more than ``days`` before ``now`` (strictly) and matches.

    The time is compared bare, so that the filter reaches the scan.
    """
    return (F.col(mtime) < now - F.make_dt_interval(days=F.lit(days))) & matches_patterns(F.col("path"), patterns)


def old_files(
    files: DataFrame, days: int, now: Column, patterns: Iterable[str] | None = None, mtime: str = "mtime"
) -> DataFrame:
    """The expired files, with their age in days."""
    age = F.timestamp_diff("MICROSECOND", F.col(mtime), now) / F.lit(86_400_000_000.0)
    return files.where(expired(days, now, patterns, mtime)).withColumn("age_days", age)


MISSING = "missing"


def deletion_plan(old: DataFrame) -> DataFrame:
    """A dry run: every file counts as deleted."""
    return old.select("path", "age_days", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))


def delete_files(old: DataFrame, dry_run: bool = True) -> DataFrame:
    """Delete each file from a mounted file system, where its row lies; gives ``ok`` and ``error``.

    A file which is not there is not ok, with the error ``missing``: a retried task may have
    deleted it before, or the worker lacks the mount. Paths of other file systems are refused.
    The deletion happens when the result is computed: write it once, then read it.
    """
    if dry_run:
        return deletion_plan(old)
    foreign = old.where(F.rlike("path", F.lit("^[A-Za-z][A-Za-z0-9+.-]*:")) & ~F.col("path").startswith("file:"))
    strange = foreign.select("path").first()
    if strange is not None:
        raise ValueError(f"only mounted files can be deleted here, not {strange[0]}")

    def remove(batches):
        import os
        from urllib.parse import unquote, urlparse

        for batch in batches:
            ok, errors = [], []
            for path in batch["path"]:
                local = unquote(urlparse(path).path) if path.startswith("file:") else path
                try:
                    os.remove(local)
                except FileNotFoundError:
                    ok.append(False)
                    errors.append(MISSING)
                    continue
                except OSError as exc:
                    ok.append(False)
                    errors.append(str(exc))
                    continue
                ok.append(True)
                errors.append(None)
            yield batch.assign(ok=ok, error=errors)

    return old.select("path", "age_days").mapInPandas(remove, "path string, age_days double, ok boolean, error string")


def deletion_summary(outcome: DataFrame) -> DataFrame:
    return outcome.agg(
        F.count_if(F.col("ok")).alias("files_deleted"), F.count_if(~F.col("ok")).alias("errors")
    )


def retained(table: DataFrame, expired: DataFrame, key: str) -> DataFrame:
    """The rows whose key has not expired. The sizes decide the join, at run time."""
    return table.join(expired.select(key), key, "left_anti")


def emptied_dirs(files: DataFrame, gone: Column, root: str) -> DataFrame:
    """Directories below ``root`` that the deletion of the files with ``gone`` leaves without
    a file, at any depth.

    One scan; files are first counted per directory, so that what is spread to the ancestors
    is one row per directory, not per file.
    """
    base = root.rstrip("/")
    folder = F.regexp_replace("path", r"/[^/]*\z", "")
    per_dir = files.groupBy(folder.alias("dir")).agg(F.count("*").alias("n"), F.count_if(gone).alias("gone"))
    below = F.substring("dir", F.lit(len(base) + 2), F.length("dir"))
    parts = F.split(below, "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda depth: F.concat(F.lit(base + "/"), F.array_join(F.slice(parts, F.lit(1), depth), "/")),
    )
    inside = F.startswith(F.col("dir"), F.lit(base + "/"))
    spread = per_dir.where(inside).select(F.explode(ancestors).alias("dir"), "n", "gone")
    return (
        spread.groupBy("dir")
        .agg(F.sum("n").alias("files"), F.sum("gone").alias("expired"))
        .where(F.col("files") == F.col("expired"))
    )
