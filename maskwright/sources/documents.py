"""Reading documents and files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.functions.text import is_pdf, unify_newlines
from maskwright.sources.listing import can_list, expand_globs, hidden_files, list_tree


def read_files(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Whole files as ``path, mtime, length, content``; columns not asked for are not read.

    Files that vanish during the scan are left out. Files that Spark's readers leave out (names that begin with a dot or an underscore, and
    all in folders of such names) are rows without content, hence errors for those who read it.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    paths = [path] if isinstance(path, str) else list(path)
    files = reader.load(paths).withColumnRenamed("modificationTime", "mtime")
    hidden = hidden_files(spark, paths, glob)
    return files.unionByName(hidden.withColumn("content", F.lit(None).cast("binary")))


def file_inventory(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The files of a directory tree with time and size; their content is not read.

    Where tasks can list the store, hidden files are listed with all others, in one walk.
    """
    folders, files = expand_globs(spark, [path] if isinstance(path, str) else list(path))
    if files or not all(map(can_list, folders)):
        return read_files(spark, path).select("path", "mtime", "length")
    return list_tree(spark, folders).select("path", "mtime", "length")


def decode_text(content: Column) -> Column:
    """UTF-8 bytes to text with unified newlines; NULL where the bytes are not valid UTF-8."""
    return unify_newlines(F.try_validate_utf8(content.cast("string")))


def decode_documents(files: DataFrame, content: str = "content") -> DataFrame:
    """Add ``text`` and ``error``; a file that is not UTF-8 is marked, not an end of the job."""
    text = decode_text(F.col(content))
    failed = F.when(F.col(content).isNull(), "no content").when(text.isNull(), "invalid UTF-8")
    return files.withColumns({"text": text, "error": failed}).drop(content)


def read_documents(spark: SparkSession, path: str | Sequence[str], glob: str | None = None) -> DataFrame:
    """Text files as ``path, mtime, length, text, error``; see :func:`quarantine` for the errors."""
    return decode_documents(read_files(spark, path, glob))


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The good rows without ``error``, and the bad ones with it."""
    return docs.where(F.col("error").isNull()).drop("error"), docs.where(F.col("error").isNotNull())


def route(files: DataFrame, path: str = "path") -> DataFrame:
    """Add ``route``: ``pdf`` goes to text extraction, everything else is read as text."""
    return files.withColumn("route", F.when(is_pdf(F.col(path)), "pdf").otherwise("text"))


def load_split(spark: SparkSession, path: str, split: str = "train", format: str = "parquet") -> DataFrame:
    """A named split of a dataset laid out as one folder per split."""
    return spark.read.format(format).load(f"{path.rstrip('/')}/{split}")
