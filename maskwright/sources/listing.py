"""Listing of folder trees by Spark, in rounds: each task lists folders, and those found are the next round.

Nothing but the roots is on the driver, so a tree may have any number of files; a round is one
level of the tree. Folders are listed through the file systems of pyarrow, local ones
directly. All files count, hidden ones too. What cannot be listed is a row with an error, and
what vanishes in between is left out.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from datetime import datetime, timezone
from functools import reduce
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.session import written

LISTED = "path string, folder boolean, mtime timestamp, length long, hidden boolean, error string"
#: how the file systems of pyarrow name what Hadoop names so
SCHEMES = {"s3a": "s3", "s3n": "s3", "s3": "s3", "gs": "gs", "hdfs": "hdfs", "abfss": "abfss"}


_SCHEME = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):/")
_LOCAL_HEAD = re.compile(r"^file:/+")


def _scheme(uri: str) -> str:
    found = _SCHEME.match(uri)
    return found[1] if found else ""


def is_hidden(name: str) -> bool:
    """Whether Spark's readers leave out files and folders of this name."""
    if name.startswith(("_common_metadata", "_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _local(path: str) -> Iterator[tuple]:
    with os.scandir(path) as found:
        for entry in found:
            at = f"file:{entry.path}"
            try:
                if entry.is_dir(follow_symlinks=False):
                    yield at, True, None, None, is_hidden(entry.name), None
                elif entry.is_file():  # links to folders are not followed
                    stat = entry.stat()
                    yield at, False, datetime.fromtimestamp(stat.st_mtime, timezone.utc), stat.st_size, is_hidden(entry.name), None
            except FileNotFoundError:
                continue
            except OSError as exc:
                yield at, False, None, None, is_hidden(entry.name), exc.strerror


def _remote(uri: str, scheme: str) -> Iterator[tuple]:
    system, path = pafs.FileSystem.from_uri(uri.replace(f"{scheme}:", f"{SCHEMES[scheme]}:", 1))
    root = uri[: len(uri) - len(urlsplit(uri).path)]
    for info in system.get_file_info(pafs.FileSelector(path)):
        key = info.path[info.path.index("/") :] if scheme.startswith(("s3", "gs")) and "/" in info.path else info.path
        folder = info.type == pafs.FileType.Directory
        changed = None if folder or info.mtime is None else info.mtime
        yield root + key, folder, changed, None if folder else info.size, is_hidden(info.base_name), None


def list_folder(uri: str) -> Iterator[tuple]:
    """What lies in one folder, as rows of ``LISTED``; a folder that is gone is empty, another error is a row."""
    scheme = _scheme(uri)
    try:
        # the path as it is: signs that mean something in addresses may be part of names
        yield from _local(_LOCAL_HEAD.sub("/", uri)) if scheme in ("", "file") else _remote(uri, scheme)
    except FileNotFoundError:
        return
    except OSError as exc:
        yield uri, False, None, None, False, exc.strerror or str(exc)


def can_list(uri: str) -> bool:
    """Whether tasks can list this place; else only Hadoop's file systems on the driver can."""
    return _scheme(uri) in ("", "file", *SCHEMES)


def list_tree(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """path, mtime, length, hidden and error of all files below some folders.

    ``hidden`` files are those that Spark's readers leave out, also by the name of a folder above them.
    """
    columns = LISTED.replace(" folder boolean,", "")
    if not roots:
        return spark.createDataFrame([], columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for above in batch.to_pylist():
                rows = []
                for row in list_folder(above["path"]):
                    rows.append(row)
                    if len(rows) == 10_000:  # a folder may hold any number of files
                        yield _rows(rows, above["hidden"])
                        rows = []
                yield _rows(rows, above["hidden"])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    todo = spark.createDataFrame([(r, False) for r in roots], "path string, hidden boolean")
    found = []
    while True:
        # folders differ in size, so they are dealt one by one
        listed = written(todo.repartition(tasks, "path").mapInArrow(run, LISTED), "listing")
        found.append(listed.where("NOT folder").drop("folder"))
        todo = listed.where("folder").select("path", "hidden")
        if todo.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _rows(rows: list[tuple], hidden: bool) -> pa.RecordBatch:
    kinds = (
        ("path", pa.string()), ("folder", pa.bool_()), ("mtime", pa.timestamp("us", "UTC")),
        ("length", pa.int64()), ("hidden", pa.bool_()), ("error", pa.string()),
    )
    columns = [[r[k] for r in rows] for k in range(len(kinds))]
    columns[4] = [hidden or h for h in columns[4]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)], [n for n, _ in kinds])


def expand_globs(spark: SparkSession, paths: Sequence[str]) -> tuple[list[str], list[str]]:
    """Folders and files that some paths or patterns name, through Hadoop's file systems."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    folders, files = [], []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        for status in at.getFileSystem(conf).globStatus(at) or []:
            (folders if status.isDirectory() else files).append(status.getPath().toString())
    return folders, files


def hidden_files(spark: SparkSession, paths: Sequence[str], glob: str | None = None) -> DataFrame:
    """path, mtime and length of the files that Spark's readers leave out; unreadable ones too, without length."""
    folders, files = expand_globs(spark, paths)
    listable = [f for f in folders if can_list(f)]
    found = list_tree(spark, listable).where(F.col("hidden") | F.col("error").isNotNull()).select("path", "mtime", "length")
    rest = [*(f for f in folders if not can_list(f)), *(f for f in files if is_hidden(f.rsplit("/", 1)[-1]))]
    if rest:
        found = found.unionByName(_walked(spark, rest))
    if glob is not None:
        name = F.element_at(F.split("path", "/"), -1)
        found = found.where(F.regexp_like(name, F.lit(glob_pattern(glob))))
    return found


def glob_pattern(glob: str) -> str:
    """A Java regular expression for a file name pattern of ``*``, ``?``, ``[...]`` and ``{a,b}``."""
    out, open_ = "", 0
    i = 0
    while i < len(glob):
        c = glob[i]
        if c == "\\" and i + 1 < len(glob):
            out += "\\" + glob[i + 1]
            i += 1
        elif c in "*?":
            out += ".*" if c == "*" else "."
        elif c == "[" and "]" in glob[i + 1 :]:
            end = glob.index("]", i + 1)
            body = glob[i + 1 : end]
            out += "[" + ("^" + body[1:] if body[:1] in "!^" else body) + "]"
            i = end
        elif c == "{":
            out, open_ = out + "(?:", open_ + 1
        elif c == "}" and open_:
            out, open_ = out + ")", open_ - 1
        elif c == "," and open_:
            out += "|"
        else:
            out += c if c.isalnum() or c in "_-" or ord(c) > 127 else "\\" + c
        i += 1
    return f"^{out}$"


def _walked(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """The same by Hadoop's file systems on the driver, for stores that tasks cannot list."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    rows = []
    for root in roots:
        at = jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(conf)
        todo = [(fs.getFileStatus(at), False)]
        todo = [(s, s.isFile()) for s, _ in todo]
        while todo:
            status, hidden = todo.pop()
            if status.isDirectory():
                todo += [(x, hidden or is_hidden(x.getPath().getName())) for x in fs.listStatus(status.getPath())]
            elif hidden:
                rows.append((status.getPath().toString(), datetime.fromtimestamp(status.getModificationTime() / 1000, timezone.utc), status.getLen()))
    return spark.createDataFrame(rows, "path string, mtime timestamp, length long")
