"""Findings by time window of a stream with late and repeated documents, and a restart."""

from datetime import datetime, timezone

from maskwright.streaming.protect_stream import document_stream
from maskwright.streaming.window_counts import count_stream, findings_by_window, late_rows, read_counts

SCHEMA = "doc_id long, time timestamp, text string"


def at(hour, minute=0):
    return datetime(2025, 1, 1, hour, minute, tzinfo=timezone.utc)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_windows_late_rows_and_restart(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))

    def arrive(rows_):
        spark.createDataFrame(rows_, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = document_stream(spark, source, spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)
        query = count_stream(stream, out, checkpoint)
        query.awaitTermination()
        return query

    first = [(1, at(8, 5), "a@b.com c@d.com"), (2, at(8, 50), "1.2.3.4"), (2, at(8, 50), "1.2.3.4"), (3, at(9, 10), None), (4, at(10), "a@b.com")]
    arrive(first)
    assert late_rows(run()) == 0
    closed = rows(read_counts(spark, out))
    assert [(r[2], r[3], r[4]) for r in closed] == [("EMAIL_ADDRESS", 2, 1), ("IP_ADDRESS", 1, 1)]
    second = [(5, at(8, 20), "late@b.com"), (4, at(10), "a@b.com"), (6, at(9, 55), "x@y.org none"), (7, at(12), "a@b.com")]
    arrive(second)
    assert late_rows(run()) == 1
    kept = [r for r in {*first, *second} if r[0] != 5]
    whole = rows(findings_by_window(spark.createDataFrame(kept, SCHEMA)))
    got = rows(read_counts(spark, out))
    assert got == [r for r in whole if r[1].replace(tzinfo=timezone.utc) <= at(11, 50)] and len(got) == 4
    assert late_rows(run()) == 0 and rows(read_counts(spark, out)) == got
