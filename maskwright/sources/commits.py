"""Small files that appear as a whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = files(spark, path)
    return fs.exists(at)


def publish(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under its name in one step; False, and nothing changed, if the name is taken."""
    fs, at = files(spark, path)
    fs.mkdirs(at.getParent())
    if fs.exists(at):
        return False
    new = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}.{uuid.uuid4().hex}")
    out = fs.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(at) or not fs.rename(new, at):
        fs.delete(new, False)
        return False
    return True
