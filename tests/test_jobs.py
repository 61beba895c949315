"""Retention, audit, whole jobs, streaming."""

import json
import os

import pytest
from datetime import datetime, timezone

from pyspark.sql import functions as F

from checks.queries import queries
from maskwright.functions.fernet import key_ring
from maskwright.functions.text import normalize_text
from maskwright.operators import audit, audit_log, retention
from maskwright.operators.detect import detect
from maskwright.operators.mask import mask
from maskwright.operators.report import report, report_json, top_docs, with_counts
from maskwright.plans.protect import Outputs, protect, run_protect, run_restore, texts_of
from maskwright.sources.documents import file_inventory
from maskwright.streaming.protect_stream import document_stream, protect_stream

KEY = "cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="
NOW = datetime(2025, 1, 1, 12, 0, tzinfo=timezone.utc)


def files_with_age(spark, tmp_path, days):
    for name, age in days.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("x")
        os.utime(path, (NOW.timestamp() - age * 86400,) * 2)
    return file_inventory(spark, str(tmp_path))


def test_retention_on_files(spark, tmp_path):
    days = {"a/old.md": 10, "a/b/older.json": 30.5, "c/old.md": 7.001, "c/new.md": 7, "c/odd.txt": 99, "top.md": 50}
    files = files_with_age(spark, tmp_path, days)
    now = F.lit(NOW)
    old = retention.old_files(files, 7, now, [".md", ".json"])
    names = {os.path.relpath(r["path"].replace("file:", ""), tmp_path): round(r["age_days"], 3) for r in old.collect()}
    assert names == {"a/old.md": 10.0, "a/b/older.json": 30.5, "c/old.md": 7.001, "top.md": 50.0}
    assert retention.old_files(files, 7, now, []).count() == 5
    root = "file:" + str(tmp_path)
    emptied = {r["dir"][len(root):] for r in retention.emptied_dirs(files, retention.expired(7, now, [".md", ".json"]), root).collect()}
    assert emptied == {"/a", "/a/b"}
    assert retention.deletion_summary(retention.delete_files(old)).first().asDict() == {"files_deleted": 4, "errors": 0}
    assert (tmp_path / "top.md").exists()
    (tmp_path / "gone.md").mkdir()
    doomed = old.select("path", "age_days").unionAll(
        spark.createDataFrame([(f"{root}/gone.md", 9.0), (f"{root}/never.md", 9.0)], "path string, age_days double")
    )
    summary = retention.deletion_summary(retention.delete_files(doomed, dry_run=False)).first()
    assert summary.asDict() == {"files_deleted": 4, "errors": 2}  # a folder, and a file that is not there
    far = spark.createDataFrame([("s3a://bucket/x.md", 9.0)], "path string, age_days double")
    with pytest.raises(ValueError, match="mounted"):
        retention.delete_files(far, dry_run=False)
    assert not (tmp_path / "top.md").exists() and (tmp_path / "c" / "new.md").exists()


def test_retained_rows(spark):
    table = spark.range(100).withColumnRenamed("id", "k")
    expired = spark.createDataFrame([(i,) for i in [3, 3, 5, 200]], "k long")
    assert retention.retained(table, expired, "k").count() == 98


def test_events(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("USER", "")
    monkeypatch.setenv("USERNAME", "ann")
    assert audit.current_user() == "ann"
    monkeypatch.delenv("USERNAME")
    assert audit.current_user() == "unknown"
    docs = spark.createDataFrame([("/in/a.md", "a@b.com"), ("/in/b.md", "none")], "path string, text string")
    counted = with_counts(detect(docs))
    out = F.col("path")
    pii = audit.pii_events(counted, out, "encrypt", out, F.concat(out, F.lit(".pii.json")), NOW)
    none = spark.createDataFrame([(0, 0)], "files_deleted long, errors long")
    cleanup = audit.cleanup_events(none, "/data", 7, True, NOW, "bob")
    jobs = audit.job_events(docs.withColumn("error", F.when(F.col("text") == "none", "bad")), "encrypt", NOW, "bob")
    log = str(tmp_path / "audit")
    audit_log.append_events(audit.union_events(pii, cleanup), log)
    audit_log.append_events(jobs, log)
    stored = audit_log.read_events(spark, log)
    assert stored.count() == 7
    events = [json.loads(r["event"]) for r in audit.event_json(stored).collect()]
    first = next(e for e in events if e.get("file") == "a.md")
    assert first == {
        "timestamp": "2025-01-01T12:00:00Z", "operation": "pii_encrypt", "file": "a.md", "user": "unknown", "mode": "encrypt",
        "pii_total": 1, "entity_counts": {"EMAIL_ADDRESS": 1}, "output_file": "a.md", "report_file": "a.md.pii.json",
    }
    zero = next(e for e in events if e["operation"] == "cleanup")
    assert zero["files_deleted"] == 0 and zero["dry_run"] is True and "file" not in zero
    ends = sorted((e["operation"], e.get("status"), e.get("error"), e.get("mode")) for e in events if "container" in e["operation"])
    assert ends == sorted(
        [("container_start", None, None, "encrypt")] * 2
        + [("container_complete", "success", None, "encrypt"), ("container_error", None, "bad", None)],
    )


def test_report(spark):
    docs = detect(spark.createDataFrame([(1, "é\n a@b.com"), (2, "")], "doc_id int, text string"))
    made = report(docs, F.lit("x.md"))
    rows = {r["doc_id"]: json.loads(r["report"]) for r in report_json(made, pretty=True).collect()}
    assert rows[1] == {
        "file": "x.md", "total": 1,
        "matches": [{"start": 3, "end": 10, "entity_type": "EMAIL_ADDRESS", "score": 1.0, "text": "a@b.com", "line": 2, "column": 2}],
    }
    assert rows[2]["matches"] == []
    assert "text" not in report(docs, F.lit("x"), include_text=False).first()["matches"][0].asDict()
    assert [r["doc_id"] for r in top_docs(docs, 1).collect()] == [1]


def test_whole_job_and_back(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source")
    keys = key_ring(spark, {"k": KEY})
    out = Outputs(*(str(tmp_path / n) for n in ("masked", "reports", "audit")))
    run_protect(docs, out, "encrypt", NOW, keys=keys, user="ann", partition_by=["source"])
    masked = spark.read.parquet(out.documents)
    assert "text" not in masked.columns and "spans" not in masked.columns
    reports = spark.read.json(out.reports)
    total = masked.agg(F.sum("pii_total")).first()[0]
    assert total > 0 and reports.agg(F.sum("total")).first()[0] == total
    assert audit_log.read_events(spark, out.audit_log).agg(F.sum("pii_total")).first()[0] == total
    back = Outputs(str(tmp_path / "restored"), audit_log=str(tmp_path / "audit2"))
    run_restore(masked, back, keys, NOW, user="ann")
    restored = spark.read.parquet(back.documents)
    same = restored.select("doc_id", F.col("text").alias("restored")).join(docs, "doc_id").where("restored = text")
    assert same.count() == docs.count()
    events = audit_log.read_events(spark, back.audit_log)
    assert events.agg(F.sum("markers_decrypted")).first()[0] == total


def test_files_to_texts_to_masked(spark):
    files = spark.createDataFrame(
        [("/i/a.md", bytearray(b"a@b.com\r\n")), ("/i/b.pdf", bytearray(b"pdf 1.2.3.4  ")), ("/i/c.md", bytearray(b"\xff"))],
        "path string, content binary",
    )
    texts = texts_of(files, [("stub", lambda data: data.decode())])
    rows = {r["path"]: (r["text"], r["error"]) for r in texts.collect()}
    assert rows == {"/i/a.md": ("a@b.com\n", None), "/i/b.pdf": ("pdf 1.2.3.4\n", None), "/i/c.md": (None, "invalid UTF-8")}
    done = protect(texts.where("error IS NULL"), "redact", by="path", normalize=True)
    assert {r["masked"] for r in done.collect()} == {"<EMAIL_ADDRESS>\n", "pdf <IP_ADDRESS>\n"}
    assert {r[0] for r in texts_of(files).where("path LIKE '%pdf'").select("error").collect()} == {"no extractor"}


def test_stream_in_several_batches(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    source = str(tmp_path / "in")
    docs.repartition(5, "doc_id").write.parquet(source)
    keys = key_ring(spark, {"k": KEY})

    def transform(batch, now):
        return mask(detect(batch), "encrypt", keys=keys, now=now)

    out = {n: str(tmp_path / n) for n in ("documents", "audit", "checkpoint")}

    def run():
        stream = document_stream(spark, source, docs.schema, files_per_batch=2)
        protect_stream(stream, transform, out["documents"], out["audit"], out["checkpoint"], "encrypt",
                       clock=lambda: NOW, user="ann").awaitTermination()

    run()
    batch = mask(detect(docs), "encrypt", keys=keys, now=NOW).select("doc_id", "masked")
    streamed = spark.read.parquet(out["documents"])
    assert streamed.select("batch").distinct().count() == 3
    assert streamed.select("doc_id", "masked").exceptAll(batch).count() == 0
    assert streamed.count() == docs.count()
    run()
    docs.limit(0).unionAll(spark.createDataFrame([(10**6, "new a@b.com")], docs.schema)).write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out["documents"]).count() == docs.count() + 1
    log = audit_log.read_events(spark, out["audit"])
    assert log.count() == docs.count() + 1 and log.where("file = 'doc_1000000.md'").first()["pii_total"] == 1
    # a batch that is run again after it was written replaces its folder, and its events stay as they are
    assert audit_log.manifests(spark, out["audit"]).count() == 4
    assert audit_log.verify(spark, out["audit"]).where("NOT ok").count() == 0


def test_log_of_killed_repeated_and_changed_runs(spark, tmp_path):
    log = str(tmp_path / "audit")
    docs = spark.createDataFrame([(i, i % 3) for i in range(3000)], "doc_id long, pii_total int").withColumn("entity_counts", F.create_map(F.lit("URL"), F.col("pii_total").cast("long")))
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"))
    events = audit.pii_events(docs, path, "redact", path, path, NOW, "ann")
    assert audit_log.read_events(spark, log).count() == audit_log.verify(spark, log).count() == 0
    killed = audit_log.stage_events(events, log, "a")
    assert audit_log.read_events(spark, log).count() == 0
    audit_log.append_events(events, log, "a")
    audit_log.append_events(events, log, "a")
    audit_log.append_events(events.limit(0), log, "nothing")
    audit_log.append_events(events.limit(5).unionAll(events.limit(5)), log, "odd name / ü")
    audit_log.commit_events(spark, log, "a", killed)
    stored = sorted(r["event"] for r in audit.event_json(audit_log.read_events(spark, log)).collect())
    told = [r["event"] for r in audit.event_json(events).collect()]
    assert len(stored) == 3010 and set(stored) == set(told)
    assert sorted((r["events"], r["found"], r["ok"]) for r in audit_log.verify(spark, log).collect()) == [(0, 0, True), (10, 10, True), (3000, 3000, True)]
    attempt = audit_log.manifests(spark, log).where("run = 'a'").first()["attempt"]
    assert attempt != killed
    folder = f"{log}/data/run=a/attempt={attempt}"
    part = sorted(f for f in os.listdir(folder) if f.startswith("part-"))[0]
    text = open(f"{folder}/{part}", encoding="utf-8").read()
    with open(f"{folder}/{part}", "w", encoding="utf-8") as f:
        f.write(text.replace('"user":"ann"', '"user":"bob"', 1))
    crc = f"{folder}/.{part}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    assert {(r["run"], r["ok"]) for r in audit_log.verify(spark, log).collect()} >= {("a", False), ("nothing", True)}


def test_failures_are_logged_as_failures(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a@b.com", "k"), (2, "a@b.com", "lost"), (3, "none", "lost"), (4, None, "k")], "doc_id long, text string, key string")
    out = Outputs(*(str(tmp_path / n) for n in ("masked", "reports", "audit")))
    for _ in range(2):
        run_protect(docs, out, "encrypt", NOW, keys=key_ring(spark, {"k": KEY}), key_id="key", user="ann", resume=True)
    said = {r["file"]: (r["status"], r["error"], r["pii_total"], r["output_file"]) for r in audit_log.read_events(spark, out.audit_log).collect()}
    assert audit_log.read_events(spark, out.audit_log).count() == 4
    assert said["doc_1.md"] == (None, None, 1, "doc_1.md") and said["doc_3.md"] == (None, None, 0, "doc_3.md")
    assert said["doc_2.md"] == ("error", "unknown key", None, None)
    assert {r["doc_id"]: r["error"] for r in spark.read.parquet(out.documents).collect()}[2] == "unknown key"


def test_salt_is_asked_for_and_in_no_plan(spark):
    found = detect(spark.createDataFrame([(1, "a@b.com")], "doc_id long, text string"))
    with pytest.raises(ValueError, match="salt"):
        mask(found, "anonymize")
    masked = mask(found, "anonymize", salt="very secret")
    assert "secret" not in masked._jdf.queryExecution().toString() and "_salt" not in masked.columns


def test_normalized_before_detection(spark):
    docs = spark.createDataFrame([(1, "a@b.com  \r\n\r\n\r\nx")], "doc_id int, text string")
    row = protect(docs, "redact", normalize=True).first()
    assert row["masked"] == "<EMAIL_ADDRESS>\n\nx\n"
    assert row["entity_counts"] == {"EMAIL_ADDRESS": 1}
    assert docs.select(normalize_text(F.col("text")).alias("t")).first()["t"] == row["text"]


@pytest.mark.parametrize("files", [1, 3])
def test_streams_of_tables_in_folders(spark, tmp_path, files):
    rows = [(k, None if k == 4 else f"mail a{k}@b.com" if k % 2 else "none") for k in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.repartition(files).write.parquet(str(tmp_path / "documents.parquet"))
    masked = queries()["stream_mask"](spark, str(tmp_path))
    assert masked.count() == 9 and masked.where("masked like 'mail [EMAIL_ADDRESS_%'").count() == 4
    events = spark.sql("SELECT id AS event_id, timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int)) AS ts, id AS user_id FROM range(60)")
    events.repartition(files).write.parquet(str(tmp_path / "events.parquet"))
    counts = queries()["stream_windows"](spark, str(tmp_path))
    assert counts.agg(F.sum("documents")).first()[0] > 0
