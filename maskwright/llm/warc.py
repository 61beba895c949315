"""Content-addressed WARC archive: payloads once by digest, exact headers apart.

An archive is a folder with two tables. ``payloads`` holds each distinct payload once under
its SHA-256, ``records`` the exact header block of every record with the digest of its
payload. Reading recomputes the digests from the stored bytes, and records are rebuilt by
joining the two.

Results in special cases: a null html is an empty payload; a null url leaves out the
target header, and line breaks in a url are written as %0D and %0A; a null page_id gives a
record without a page number, which can be a response only if its payload has no other
page; of repeated rows with the largest id all are responses; an empty table gives an empty archive;
pages may have any length, each being a value of one row; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm.common import attach_groups

MIN_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"
PAGE = "urn:page:"


def _payload(html: str) -> Column:
    return F.encode(F.coalesce(F.col(html).cast("string"), F.lit("")), "UTF-8")


def _header(is_revisit: Column, date: str) -> Column:
    """The exact header block of a record; ``concat_ws`` leaves out absent headers."""
    uri = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(
        EOL,
        F.lit("WARC/1.1"),
        F.when(is_revisit, F.lit("WARC-Type: revisit")).otherwise(F.lit("WARC-Type: response")),
        F.concat(F.lit(f"WARC-Record-ID: <{PAGE}"), number("page_id"), F.lit(">")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(is_revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(is_revisit, F.concat(F.lit(f"WARC-Refers-To: <{PAGE}"), number("keeper"), F.lit(">"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), F.when(is_revisit, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
    )


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT, date: str = DATE) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``.

    Copies of a payload are combined before the shuffle, by comparing whole payloads; the
    shuffle of the records themselves carries no payload.
    """
    spark = pages.sparkSession
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", _payload("html").alias("content"))
    (
        held.groupBy(F.unhex(F.sha2("content", 256)).alias("sha256"), "content")
        .agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .write.parquet(f"{path}/payloads")
    )
    groups = spark.read.parquet(f"{path}/payloads").select("sha256", "keeper", "copies")
    rows = held.select(
        "page_id",
        "url",
        F.unhex(F.sha2("content", 256)).alias("sha256"),
        F.sha1("content").alias("sha1"),
        F.octet_length("content").cast("long").alias("bytes"),
    )
    revisit = (F.col("bytes") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    (
        attach_groups(rows, groups, ["sha256"], "page_id", "keeper", "copies")
        .select("sha256", _header(revisit, date).alias("header"))
        .write.parquet(f"{path}/records")
    )


def _field(name: str) -> Column:
    """The value of a header, or null."""
    value = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.col("header").contains(f"\r\n{name}: "), value)


def _page(name: str) -> Column:
    return F.regexp_extract(_field(name), rf"^<{PAGE}(-?\d+)>$", 1).try_cast("long")


def _checked(payloads: DataFrame) -> DataFrame:
    """Payloads with their digests computed again; a mismatch or a second holder ends the job."""
    good = F.unhex(F.sha2("content", 256)) == F.col("sha256")
    verified = F.when(good, F.sha1("content")).otherwise(F.raise_error(F.lit("stored payload does not match its digest")))
    return payloads.withColumn("sha1", verified).withColumn("bytes", F.octet_length("content").cast("long"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """What the records of an archive say, with size and digest of their full payload.

    Digest and size come from the stored bytes, once per distinct payload; only these facts
    are joined to the headers.
    """
    facts = _checked(spark.read.parquet(f"{path}/payloads")).select("sha256", "sha1", "bytes", "keeper", "copies")
    one = facts.groupBy("sha256").agg(
        F.first("sha1").alias("sha1"), F.first("bytes").alias("bytes"), F.max("keeper").alias("keeper"),
        F.max("copies").alias("copies"), F.count("*").alias("_held"),
    )
    once = F.when(F.col("_held") == 1, F.col("sha1")).otherwise(F.raise_error(F.lit("two payloads share a SHA-256")))
    records = spark.read.parquet(f"{path}/records").withColumn("page_id", _page("WARC-Record-ID"))
    joined = attach_groups(records, one.withColumn("sha1", once), ["sha256"], "page_id", "keeper", "copies")
    said = F.concat(F.lit("sha1:"), F.col("sha1")) == _field("WARC-Payload-Digest")
    return joined.select(
        "page_id",
        F.col("bytes").alias("payload_bytes"),
        F.when(said, F.col("sha1")).otherwise(F.raise_error(F.lit("header and payload disagree"))).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _page("WARC-Refers-To").alias("refers_to"),
        _field("WARC-Target-URI").alias("url"),
    )


def restore_records(spark: SparkSession, path: str) -> DataFrame:
    """Every original record: page_id, record (exact bytes, without a block for revisits), payload (always full)."""
    held = _checked(spark.read.parquet(f"{path}/payloads")).select("sha256", "content", "keeper", "copies")
    records = spark.read.parquet(f"{path}/records").withColumn("page_id", _page("WARC-Record-ID"))
    joined = attach_groups(records, held, ["sha256"], "page_id", "keeper", "copies")
    end = F.encode(F.lit(EOL * 2), "UTF-8")
    block = F.when(_field("WARC-Type") == "response", F.col("content")).otherwise(F.encode(F.lit(""), "UTF-8"))
    return joined.select(
        "page_id", F.concat(F.encode("header", "UTF-8"), end, block, end).alias("record"), F.col("content").alias("payload")
    )
