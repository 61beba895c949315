"""Writing documents and reports, locally or to encrypted object storage."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from maskwright.sources.commits import exists, files, publish

# The encryption names that callers use, and those of the s3a file system.
ENCRYPTIONS = {"AES256": "AES256", "aws:kms": "SSE-KMS"}


def check_encryption(encryption: str = "AES256", kms_key_id: str | None = None) -> None:
    if encryption not in ENCRYPTIONS:
        raise ValueError(f"encryption must be one of {', '.join(ENCRYPTIONS)}")
    if encryption == "aws:kms" and not kms_key_id:
        raise ValueError("aws:kms needs a key id")


def encryption_settings(bucket: str, encryption: str = "AES256", kms_key_id: str | None = None) -> dict[str, str]:
    """File system settings that make every write to the bucket encrypted by the server."""
    check_encryption(encryption, kms_key_id)
    prefix = f"fs.s3a.bucket.{bucket}.encryption"
    settings = {f"{prefix}.algorithm": ENCRYPTIONS[encryption]}
    if encryption == "aws:kms":
        settings[f"{prefix}.key"] = kms_key_id
    return settings


def use_encryption(spark: SparkSession, bucket: str, encryption: str = "AES256", kms_key_id: str | None = None) -> None:
    """Apply :func:`encryption_settings` to the session, before the first write to the bucket."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for key, value in encryption_settings(bucket, encryption, kms_key_id).items():
        conf.set(key, value)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a table was written to its end."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def write_documents(
    docs: DataFrame, path: str, partition_by: Sequence[str] = (), format: str = "parquet", mode: str = "errorifexists"
) -> None:
    """A table of documents, not one file per document."""
    docs.write.mode(mode).partitionBy(*partition_by).format(format).save(path)


def store_table(
    docs: DataFrame, path: str, metadata: Mapping[str, str], encryption: str = "AES256", kms_key_id: str | None = None
) -> None:
    """Write a table with a manifest beside its data: who wrote it how, in ``_manifest.json``, which readers leave out.

    The store encrypts both if ``use_encryption`` was called for its bucket; the manifest comes last, so a
    table that has one is complete. A table that has one is not written again.
    """
    check_encryption(encryption, kms_key_id)
    spark, at = docs.sparkSession, f"{path.rstrip('/')}/_manifest.json"
    if exists(spark, at):
        raise FileExistsError(path)
    write_documents(docs, path, mode="overwrite")
    said = {"metadata": dict(metadata), "encryption": encryption, "kms_key_id": kms_key_id if encryption == "aws:kms" else None}
    if not publish(spark, at, json.dumps(said | {"rows": spark.read.parquet(path).count()}, sort_keys=True)):
        raise FileExistsError(path)


def table_manifest(spark: SparkSession, path: str) -> dict:
    """What the manifest of a stored table says."""
    fs, at = files(spark, f"{path.rstrip('/')}/_manifest.json")
    stream = fs.open(at)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def write_reports(reports: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One report per line, as JSON; see ``operators.report.report``."""
    reports.write.mode(mode).json(path)
