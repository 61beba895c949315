"""Files, extraction, models, dictionary, sinks."""

import os
import sys
import types

import pytest
from pyspark.sql import functions as F

from maskwright.operators.detect import detect, matches
from maskwright.operators.dictionary import attach_spans, dictionary_spans
from maskwright.operators.extract import assemble_pages, extract_text
from maskwright.operators.mask import mask
from maskwright.operators.models import detect_with_model, first_working, locate_entities, model_extract, parse_entities
from maskwright.operators.training import chat_messages, masking_prompt, with_split
from maskwright.operators.upload import upload_manifest
from maskwright.session import fits_broadcast, lookup_join, scratch_path
from maskwright.sources.documents import file_inventory, load_split, quarantine, read_documents, read_files, route
from maskwright.sources.pdf import PDF_EXTRACTORS
from maskwright.sources.sinks import check_encryption, encryption_settings, use_encryption, write_documents


def test_read_documents(spark, tmp_path):
    (tmp_path / "deep" / "er").mkdir(parents=True)
    (tmp_path / "a.md").write_bytes("é\r\nx\ry\n".encode())
    (tmp_path / "deep" / "b.md").write_bytes(b"ok \xff")
    (tmp_path / "deep" / "er" / "c.PDF").write_bytes(b"%PDF")
    docs = read_documents(spark, str(tmp_path), glob="*.md")
    good, bad = quarantine(docs)
    assert [r["text"] for r in good.collect()] == ["é\nx\ny\n"]
    assert [(os.path.basename(r["path"]), r["error"]) for r in bad.collect()] == [("b.md", "invalid UTF-8")]
    routed = {os.path.basename(r["path"]): r["route"] for r in route(file_inventory(spark, str(tmp_path))).collect()}
    assert routed == {"a.md": "text", "b.md": "text", "c.PDF": "pdf"}
    plan = file_inventory(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[1]


def test_hidden_files_are_listed_and_reported(spark, tmp_path):
    (tmp_path / "_tmp" / "er").mkdir(parents=True)
    (tmp_path / ".git").mkdir()
    names = [".env", "_x.md", "_tmp/c.md", "_tmp/er/d.md", ".git/e.md", "_a=b.md", "f.md"]
    for k, name in enumerate(names):
        (tmp_path / name).write_bytes(b"x" * (k + 1))
    listed = file_inventory(spark, str(tmp_path)).collect()
    assert sorted((r["path"].split(f"{tmp_path}/")[1], r["length"]) for r in listed) == sorted((n, k + 1) for k, n in enumerate(names))
    for r in listed:
        at = r["path"].removeprefix("file:")
        assert abs(r["mtime"].timestamp() - os.path.getmtime(at)) < 1
    good, bad = quarantine(read_documents(spark, str(tmp_path), glob="*.md"))
    assert sorted(os.path.basename(r["path"]) for r in good.collect()) == ["_a=b.md", "f.md"]
    assert sorted((os.path.basename(r["path"]), r["error"]) for r in bad.collect()) == [(x, "no content") for x in ("_x.md", "c.md", "d.md", "e.md")]
    only = file_inventory(spark, [f"{tmp_path}/.git", f"{tmp_path}/_x.md"]).collect()
    assert sorted(os.path.basename(r["path"]) for r in only) == ["_x.md", "e.md"]


def test_load_split_and_write(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "train"))
    assert load_split(spark, str(tmp_path)).count() == 3
    out = str(tmp_path / "out")
    write_documents(spark.createDataFrame([(1, "a"), (2, "b")], "id int, source string"), out, ["source"])
    assert sorted(p for p in os.listdir(out) if p.startswith("source")) == ["source=a", "source=b"]
    with pytest.raises(Exception):
        write_documents(spark.range(1), out)


def test_encryption_settings(spark):
    assert encryption_settings("b") == {"fs.s3a.bucket.b.encryption.algorithm": "AES256"}
    kms = encryption_settings("b", "aws:kms", "k")
    assert kms == {"fs.s3a.bucket.b.encryption.algorithm": "SSE-KMS", "fs.s3a.bucket.b.encryption.key": "k"}
    for wrong in (("none", None), ("aws:kms", None), ("aws:kms", "")):
        with pytest.raises(ValueError):
            check_encryption(*wrong)
    use_encryption(spark, "bucket-x", "aws:kms", "k")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    assert conf.get("fs.s3a.bucket.bucket-x.encryption.key") == "k"


def test_upload_manifest(spark):
    df = spark.createDataFrame([("/x/a.md", None, ["v=1", "bad"]), ("/x/b.md", "k/b", None)], "path string, k string, m array<string>")
    rows = upload_manifest(df, F.lit("bk"), F.col("k"), F.col("m")).orderBy("path").collect()
    assert [r["s3_uri"] for r in rows] == ["s3://bk/a.md", "s3://bk/k/b"]
    assert rows[0]["metadata"] == {"v": "1"} and rows[0]["kms_key_id"] is None


def test_extract_text(spark):
    files = spark.createDataFrame(
        [("a", bytearray(b"A:x \n")), ("b", bytearray(b"B:y")), ("c", bytearray(b"?")), ("d", None), ("e", bytearray(b"A:"))],
        "path string, content binary",
    )

    def first(data):
        return data[2:].decode() if data.startswith(b"A:") else None

    def second(data):
        if not data.startswith(b"B:"):
            raise RuntimeError("cannot read")
        return data[2:].decode()

    rows = {r["path"]: (r["text"], r["extractor"], r["error"]) for r in extract_text(files, [("1", first), ("2", second)]).collect()}
    assert rows["a"] == ("x\n", "1", None)
    assert rows["b"] == ("y\n", "2", None)
    for lost in "cde":
        assert rows[lost] == (None, None, "no extractor gave text")


def test_assemble_many_pages(spark):
    pages = [(1, n, f"p{n}" if n % 5 else None) for n in range(1200)] + [(2, 7, "only")]
    df = spark.createDataFrame(pages, "doc_id int, page_no int, text string").repartition(7)
    got = {r["doc_id"]: r["text"] for r in assemble_pages(df).collect()}
    assert got == {1: "\n\n".join(t or "" for _, _, t in pages[:1200]), 2: "only"}


def test_model_is_loaded_once_per_worker(spark, tmp_path):
    log = str(tmp_path)

    def load():
        import os
        import uuid

        open(os.path.join(log, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [[(0, 3, "PERSON", None)] if t.startswith("Ann") else [] for t in texts]

    df = spark.createDataFrame([(i, "Ann a@b.com" if i % 2 else None) for i in range(40)], "doc_id int, text string").repartition(8)
    for _ in range(2):
        found = detect_with_model(df, load, f"m-{log}")
        resolved = detect(found, also="model_spans")
        kinds = [tuple(s["entity_type"] for s in r["spans"]) for r in resolved.orderBy("doc_id").collect()]
        assert kinds == [(), ("PERSON", "EMAIL_ADDRESS")] * 20
    pids = [name.split("-")[0] for name in os.listdir(log)]
    assert len(pids) == len(set(pids))


def test_first_model_that_works(spark):
    def missing():
        raise ImportError("not installed")

    def broken():
        return lambda texts: 1 / 0

    def good():
        return lambda texts: [[(0, 1, "PERSON", 0.5)] for _ in texts]

    load = first_working([missing, broken, good])
    df = spark.createDataFrame([(1, "x")], "doc_id int, text string")
    assert detect_with_model(df, load, "chain").first()["model_spans"][0]["entity_type"] == "PERSON"
    with pytest.raises(RuntimeError):
        first_working([missing, broken])()


def test_pdf_extractors_read_with_what_is_installed(monkeypatch):
    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            return self.text

    reader = types.SimpleNamespace(PdfReader=lambda stream: types.SimpleNamespace(pages=[Page("a"), Page(None), Page("b")]))
    monkeypatch.setitem(sys.modules, "pypdf", reader)
    monkeypatch.setitem(sys.modules, "pdfminer.high_level", None)
    by_name = dict(PDF_EXTRACTORS)
    assert list(by_name) == ["pymupdf", "pdfminer", "pypdf"]
    assert by_name["pypdf"](b"%PDF") == "a\n\n\n\nb"
    with pytest.raises(ImportError):
        by_name["pdfminer"](b"%PDF")


def test_model_answers(spark):
    def load():
        return lambda prompts, limits, temperature: [f"{n}|{temperature}|{p[-4:]}" for p, n in zip(prompts, limits)]

    df = spark.createDataFrame([(1, "one two three"), (2, "x")], "doc_id int, text string")
    got = {r["doc_id"]: r["answer"] for r in model_extract(df, load, "answers").collect()}
    assert got == {1: "None|0.1|ee'\n", 2: "None|0.1|'x'\n"}
    limited = model_extract(df, load, "answers", max_tokens=9).collect()
    assert all(r["answer"].startswith("9|") for r in limited)


def test_parse_and_locate_entities(spark):
    text = "Al (x+y) met Al. (x+y)"
    answers = [
        '[{"entity": "Al", "category": "person name"}, {"entity": "(x+y)", "category": "FORMULA"}]',
        "[{'entity': 'Al', 'category': 'PERSON'}]",
        "[]",
        "none",
        '[{"entity": "Al"',
        '{"entity": "Al", "category": "X"}',
        "[1, 2]",
        None,
    ]
    df = spark.createDataFrame([(i, text, a) for i, a in enumerate(answers)], "doc_id int, text string, answer string")
    parsed = parse_entities(df)
    read = [r["entities"] for r in parsed.orderBy("doc_id").collect()]
    assert [None if e is None else len(e) for e in read] == [2, 1, 0, None, None, None, None, None]
    located = locate_entities(parsed).orderBy("doc_id").collect()
    spans = [(s["start"], s["end"], s["entity_type"], s["text"]) for s in located[0]["model_spans"]]
    assert spans == [
        (0, 2, "PERSON_NAME", "Al"), (3, 8, "FORMULA", "(x+y)"), (13, 15, "PERSON_NAME", "Al"), (17, 22, "FORMULA", "(x+y)"),
    ]
    assert [r["model_spans"] for r in located[2:]] == [None if r["entities"] is None else [] for r in located[2:]]
    masked = mask(detect(locate_entities(parsed), also="model_spans"), "redact").orderBy("doc_id").first()["masked"]
    assert masked == "<PERSON_NAME> <FORMULA> met <PERSON_NAME>. <FORMULA>"


@pytest.mark.parametrize("bound", [200_000, 2, 0])
def test_dictionary(spark, bound):
    terms = spark.createDataFrame(
        [("San Jose Holdings Co.", "ORGANIZATION"), ("Ann Example", "PERSON"), ("San Jose", "LOCATION"), ("Ümit", "PERSON")],
        "term string, entity_type string",
    )
    texts = ["Tenant: Ann Example | Signer: San Jose Holdings Co.", "Ümit, Ann  Example.", "San San Jose", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    spans = dictionary_spans(docs, terms, broadcast_rows=bound)
    got = sorted((r["doc_id"], texts[r["doc_id"]][r["start"] : r["end"]], r["entity_type"]) for r in spans.collect())
    assert got == [
        (0, "Ann Example", "PERSON"), (0, "San Jose", "LOCATION"), (0, "San Jose Holdings Co", "ORGANIZATION"),
        (1, "Ann  Example", "PERSON"), (1, "Ümit", "PERSON"), (2, "San Jose", "LOCATION"),
    ]
    if bound:
        resolved = detect(attach_spans(docs, spans), also="dictionary_spans")
        redacted = mask(resolved, "redact").orderBy("doc_id").collect()
        assert redacted[0]["masked"] == "Tenant: <PERSON> | Signer: <ORGANIZATION>."
        assert len(matches(resolved).collect()) == 5


def test_hot_lookup_key(spark):
    left = spark.range(2000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, 0).otherwise(F.col("id")).alias("k"))
    right = spark.range(1990).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small, large = lookup_join(left, right, "k", small=True), lookup_join(left, right, "k", small=False)
    assert sorted(small.collect()) == sorted(large.select(small.columns).collect())
    assert fits_broadcast(right) and not fits_broadcast(right, rows=10)
    assert not fits_broadcast(spark.createDataFrame([("x" * 100,)], "s string"), size=50)


def test_scratch_path_follows_the_session(spark):
    class Cluster:
        class conf:
            @staticmethod
            def get(key, default=None):
                return {"spark.checkpoint.dir": "/shared/x/"}.get(key, default)

    assert scratch_path(Cluster, "t").startswith("/shared/x/t-")
    assert os.path.isdir(os.path.dirname(scratch_path(spark, "t")))


def test_training_rows(spark):
    df = spark.createDataFrame([("t '{target_text}'", [("a", "X")])], "source_text string, entities array<struct<entity:string,category:string>>")
    messages = chat_messages(df).first()["messages"]
    assert [m["role"] for m in messages] == ["user", "assistant"]
    assert messages[0]["content"].endswith("'t '{target_text}''\n")
    assert messages[1]["content"] == '[{"entity":"a","category":"X"}]'
    prompt = df.select(masking_prompt(F.col("source_text"), F.lit("m")).alias("p")).first()["p"]
    assert prompt.endswith("Text: t '{target_text}'\n\nRewritten: m\n")
    rows = spark.range(5000).withColumnRenamed("id", "doc_id")
    one, two = with_split(rows, "doc_id"), with_split(rows.repartition(7), "doc_id")
    assert sorted(one.collect()) == sorted(two.collect())
    assert 900 < one.where("split = 'test'").count() < 1100


def test_listing_equals_a_walk(spark, tmp_path):
    """Hidden files and folders, links, unreadable folders and odd names, at several depths."""
    from maskwright.sources.listing import list_tree

    names = ["a.md", ".env", "_x.md", "_tmp/c.md", "d/e/f/g.txt", "d/.h/i", "d/part=1/j.md", "d/e/k é.md", "d/e/l%20.md", "m._COPYING_", "d#1/n?.md"]
    for name in names:
        at = tmp_path / "tree" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(name)
    (tmp_path / "tree" / "empty").mkdir()
    (tmp_path / "tree" / "link").symlink_to(tmp_path / "tree" / "d")
    (tmp_path / "tree" / "gone").symlink_to(tmp_path / "nowhere")
    root = str(tmp_path / "tree")
    want = {os.path.join(d, f) for d, _, files in os.walk(root) for f in files if os.path.exists(os.path.join(d, f))}
    listed = {r["path"].removeprefix("file:"): r for r in list_tree(spark, [root]).collect()}
    assert set(listed) == want and all(r["length"] == os.path.getsize(p) and r["error"] is None for p, r in listed.items())
    assert {p.removeprefix(root + "/") for p, r in listed.items() if r["hidden"]} == {".env", "_x.md", "_tmp/c.md", "d/.h/i", "m._COPYING_"}
    assert abs(listed[f"{root}/a.md"]["mtime"].timestamp() - os.path.getmtime(f"{root}/a.md")) < 90_000
    assert list_tree(spark, []).count() == list_tree(spark, [str(tmp_path / "nowhere")]).count() == 0
    inventory = {r["path"].removeprefix("file:") for r in file_inventory(spark, root).collect()}
    assert inventory == want
    markdown = {r["path"].rsplit("/", 1)[-1] for r in read_files(spark, root, glob="*.md").select("path").collect()}
    assert {"a.md", "_x.md", "c.md", "j.md"} <= markdown and ".env" not in markdown


def test_folders_that_cannot_be_listed_are_reported(monkeypatch, tmp_path):
    from maskwright.sources import listing

    def refuse(path):
        raise PermissionError(13, "Permission denied")

    monkeypatch.setattr(listing.os, "scandir", refuse)
    assert list(listing.list_folder(str(tmp_path))) == [(str(tmp_path), False, None, None, False, "Permission denied")]


@pytest.mark.parametrize("glob,yes,no", [("*.md", "a.md", "a.mdx"), ("a?[0-9].{md,txt}", "ab1.txt", "ab1.pdf"), ("[!a]*", "b", "ab"), ("a.b", "a.b", "axb")])
def test_glob_patterns(glob, yes, no):
    import re

    from maskwright.sources.listing import glob_pattern

    assert re.match(glob_pattern(glob), yes) and not re.match(glob_pattern(glob), no)


def test_extractors_get_one_document_at_a_time(spark):
    """A large Arrow batch is not turned into Python objects as a whole: what is read goes on in parts."""
    class Said(str):
        live = 0

        def __init__(self, _):
            Said.live += 1

        def __del__(self):
            Said.live -= 1

    files = spark.range(400, numPartitions=1).select(F.col("id").cast("string").alias("path"), F.when(F.col("id") % 9 != 4, F.expr("cast(concat(id, repeat('x', 20000)) as binary)")).alias("content"))

    def held(data):
        return Said(f"{data[:3].decode()} {Said.live}")

    got = extract_text(files, [("held", held)]).collect()
    said = {r["path"]: r for r in got}
    assert len(said) == 400 and all((r["text"] is None) == (int(p) % 9 == 4) and (r["error"] is None) == (int(p) % 9 != 4) for p, r in said.items())
    assert all(r["text"].startswith(f"{p}xxx"[:3]) for p, r in said.items() if r["text"])
    assert max(int(r["text"].split()[1]) for r in got if r["text"]) <= 50  # two parts of 400 kB
    assert not extract_text(files.limit(0), [("held", held)]).collect()
