"""The audit log: runs are committed as a whole, once, and changes to what was committed are found.

A run writes its events as JSON lines to a folder of its own attempt, then one manifest that names
the attempt, the number of events and the root of a Merkle tree over the lines. Readers take only
what a manifest names, so an attempt that was killed leaves nothing, and a run that is done again
after its commit changes nothing. Batch jobs and streams write the same events.

    <log>/data/run=<run>/attempt=<attempt>/*.json
    <log>/manifests/<run>.json
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.operators.audit import EVENT_SCHEMA
from maskwright.sources.commits import exists, publish

LEAVES = 512
MANIFEST = "run string, attempt string, events long, depth int, root string"
_RUN = T.StructType([T.StructField("run", T.StringType()), T.StructField("attempt", T.StringType())])


def _hex(*parts: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", *parts))), ","), 256)


def merkle_roots(lines: DataFrame, depth: int, *by: str) -> DataFrame:
    """``by``, events, root of the ``value`` lines of each group, by a tree over the prefixes of their digests.

    Equal lines are one leaf with its number; a leaf's place is its digest, so the order of lines
    does not matter, and no node has more than some ``LEAVES`` (at the bottom) or 16 parts.
    """
    leaf = F.sha2("value", 256).alias("_leaf")
    leaves = lines.groupBy(*by, leaf).agg(F.count("*").alias("events"))
    place = F.substring("_leaf", 1, depth) if depth else F.lit("")
    nodes = leaves.groupBy(*by, place.alias("_at")).agg(F.sum("events").alias("events"), _hex(F.col("_leaf"), F.col("events").cast("string")).alias("_node"))
    for level in range(depth - 1, -1, -1):
        above = F.substring("_at", 1, level) if level else F.lit("")
        nodes = nodes.groupBy(*by, above.alias("_up")).agg(F.sum("events").alias("events"), _hex(F.col("_at"), F.col("_node")).alias("_node"))
        nodes = nodes.withColumnRenamed("_up", "_at")
    return nodes.select(*by, "events", F.col("_node").alias("root"))


def _depth(events: int) -> int:
    depth = 0
    while events > LEAVES << 4 * depth:
        depth += 1
    return depth


def _name(run: str) -> str:
    """A file name of a run: itself if it is plain, else with a digest of it."""
    return run if re.fullmatch(r"[0-9A-Za-z][0-9A-Za-z_-]*", run) else f"run-{hashlib.sha256(run.encode()).hexdigest()[:32]}"


def committed(spark: SparkSession, log: str, run: str) -> bool:
    return exists(spark, f"{log}/manifests/{_name(run)}.json")


def stage_events(events: DataFrame, log: str, run: str) -> str:
    """Write the events of an attempt of a run, which nobody reads yet; returns the attempt."""
    attempt = uuid.uuid4().hex
    lines = events.select(F.to_json(F.struct(*[f.name for f in EVENT_SCHEMA.fields])).alias("value"))
    lines.write.text(f"{log}/data/run={_name(run)}/attempt={attempt}")
    return attempt


def commit_events(spark: SparkSession, log: str, run: str, attempt: str) -> None:
    """Make an attempt the run's events, unless another one is already.

    The number and the root are those of the lines as they were written.
    """
    lines = spark.read.text(f"{log}/data/run={_name(run)}/attempt={attempt}")
    events = lines.count()
    depth = _depth(events)
    found = merkle_roots(lines, depth).first() if events else None
    said = {"run": _name(run), "attempt": attempt, "events": events, "depth": depth, "root": found["root"] if found else hashlib.sha256().hexdigest()}
    publish(spark, f"{log}/manifests/{_name(run)}.json", json.dumps(said))


def append_events(events: DataFrame, log: str, run: str | None = None) -> None:
    """Append the events of a run, once: a run that is committed is left as it is."""
    spark, run = events.sparkSession, run or uuid.uuid4().hex
    if not committed(spark, log, run):
        commit_events(spark, log, run, stage_events(events, log, run))


def manifests(spark: SparkSession, log: str) -> DataFrame:
    """A row per committed run."""
    if not exists(spark, f"{log}/manifests"):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).json(f"{log}/manifests")


def _of_committed(spark: SparkSession, log: str, schema: T.StructType, format: str) -> DataFrame:
    whole = T.StructType([*schema.fields, *_RUN.fields])
    if not exists(spark, f"{log}/data"):
        return spark.createDataFrame([], whole)
    rows = spark.read.schema(whole).format(format).load(f"{log}/data")
    return rows.join(manifests(spark, log).select("run", "attempt"), ["run", "attempt"], "left_semi")


def read_events(spark: SparkSession, log: str) -> DataFrame:
    """The events of all committed runs."""
    return _of_committed(spark, log, EVENT_SCHEMA, "json").select(*[f.name for f in EVENT_SCHEMA.fields])


def verify(spark: SparkSession, log: str) -> DataFrame:
    """run, events, found and ok for every committed run: whether its lines are those that were committed."""
    told = manifests(spark, log)
    lines = _of_committed(spark, log, T.StructType([T.StructField("value", T.StringType())]), "text")
    depths = [r["depth"] for r in told.select("depth").distinct().collect()]  # a handful
    roots = [merkle_roots(lines.join(told.where(F.col("depth") == d).select("run"), "run", "left_semi"), d, "run") for d in depths]
    if not roots:
        return told.select("run", "events", F.col("events").alias("found"), F.lit(True).alias("ok"))
    found = reduce(DataFrame.unionByName, roots).select("run", F.col("events").alias("found"), F.col("root").alias("_root"))
    same = F.coalesce(F.col("root") == F.col("_root"), F.lit(False)) | ((F.col("events") == 0) & F.col("found").isNull())
    return told.join(found, "run", "left").select("run", "events", F.coalesce("found", F.lit(0)).alias("found"), same.alias("ok"))
