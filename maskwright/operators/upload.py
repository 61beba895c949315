"""Upload manifests: where each output goes, and how it is encrypted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import basename, parse_key_values
from maskwright.sources.sinks import check_encryption


def s3_uri(bucket: Column, key: Column, path: Column) -> Column:
    """``s3://bucket/key``; without a key, the file name is the key."""
    return F.concat(F.lit("s3://"), bucket, F.lit("/"), F.coalesce(key, basename(path)))


def upload_manifest(
    files: DataFrame,
    bucket: Column,
    key: Column | None = None,
    metadata: Column | None = None,
    encryption: str = "AES256",
    kms_key_id: str | None = None,
    path: str = "path",
) -> DataFrame:
    """Add ``s3_uri``, ``encryption``, ``kms_key_id`` and ``metadata`` (from ``key=value`` strings)."""
    check_encryption(encryption, kms_key_id)
    object_key = key if key is not None else F.lit(None).cast("string")
    pairs = parse_key_values(metadata) if metadata is not None else F.lit(None).cast("map<string,string>")
    return files.withColumns(
        {
            "s3_uri": s3_uri(bucket, object_key, F.col(path)),
            "encryption": F.lit(encryption),
            "kms_key_id": F.lit(kms_key_id if encryption == "aws:kms" else None).cast("string"),
            "metadata": pairs,
        }
    )
