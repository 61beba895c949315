"""Masking and restoring."""

import hashlib
import re
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from maskwright.functions import fernet
from maskwright.functions.fernet import KeyRing, ensure_key, key_ring
from maskwright.operators.detect import detect
from maskwright.operators.mask import mask, mask_numbered, masking_error, placeholder_counts
from maskwright.operators.unmask import count_markers, unmask, unmask_items

KEY = "cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="
NOW = datetime(2025, 1, 1, tzinfo=timezone.utc)
# The example of the public Fernet specification.
SPEC_TOKEN = "gAAAAAAdwJ6wAAECAwQFBgcICQoLDA0ODy021cpGVWKZ_eEwCGM4BLLF_5CV9dOPmrhuVUPgJobwOz7JcbmrR64jVmpU4IwqDA=="
TEXT = "é\U0001f600 a@b.com, 4111 1111 1111 1111;\nagain a@b.com and 10.0.0.1"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def encrypted(spark, df, key=KEY):
    return mask(detect(df), "encrypt", keys=key_ring(spark, {"k": key}), now=NOW)


def test_specification_vector(spark):
    row = key_ring(spark, {"k": KEY}).table.selectExpr(
        fernet.encrypt("'hello'", "499162800", "unhex('000102030405060708090a0b0c0d0e0f')") + " AS token",
        fernet.decrypt(f"'{SPEC_TOKEN}'") + " AS plain",
    ).first()
    assert row["token"] == SPEC_TOKEN
    assert row["plain"] == "hello"


def test_damaged_tokens_do_not_decrypt(spark):
    bad = [SPEC_TOKEN[:-10] + "A" + SPEC_TOKEN[-9:], SPEC_TOKEN[:40], "", "abc", "h" + SPEC_TOKEN[1:], "=" * 8]
    tokens = spark.createDataFrame([(b, "k") for b in bad], "token string, key_id string")
    rows = tokens.join(F.broadcast(key_ring(spark, {"k": KEY}).table), "key_id")
    assert [r[0] for r in rows.select(F.expr(fernet.decrypt("token"))).collect()] == [None] * len(bad)


def test_keys_are_checked(spark):
    assert ensure_key(KEY) == KEY.encode()
    assert len(ensure_key()) == 44 and ensure_key() != ensure_key("")
    for bad in ("abc", "!", "YWJj"):
        with pytest.raises(ValueError):
            ensure_key(bad)
    with pytest.raises(ValueError):
        key_ring(spark, {"k": ""})


def test_round_trip_and_items(spark):
    df = docs(spark, TEXT, "nothing here", "", None)
    masked = encrypted(spark, df)
    keys = key_ring(spark, {"k": KEY})
    rows = {r["doc_id"]: r for r in masked.collect()}
    assert rows[3]["masked"] is None
    marker = re.compile(r"\{\{ENC:([A-Z_]+):[A-Za-z0-9_\-]+=*\}\}")
    assert [m.group(1) for m in marker.finditer(rows[0]["masked"])] == [
        "EMAIL_ADDRESS", "CREDIT_CARD", "EMAIL_ADDRESS", "IP_ADDRESS",
    ]
    for item in rows[0]["items"]:
        assert marker.fullmatch(rows[0]["masked"][item["start"] : item["end"]]).group(1) == item["entity_type"]
    stripped = masked.drop("text", "spans")
    for restored in (unmask(stripped, keys), unmask_items(stripped, keys)):
        assert {r["doc_id"]: r["text"] for r in restored.collect()} == {0: TEXT, 1: "nothing here", 2: "", 3: None}


def test_equal_values_get_different_tokens_and_runs_the_same(spark):
    df = docs(spark, TEXT)
    first, second = encrypted(spark, df).first()["masked"], encrypted(spark, df.repartition(3)).first()["masked"]
    assert first == second
    tokens = re.findall(r"EMAIL_ADDRESS:([^}]+)", first)
    assert len(set(tokens)) == 2


def test_other_key_leaves_markers(spark):
    masked = encrypted(spark, docs(spark, TEXT)).drop("text", "spans")
    other = unmask(masked, key_ring(spark, {"k": ensure_key()})).first()
    assert other["text"] == other["masked"]
    assert (other["markers_found"], other["markers_decrypted"]) == (4, 0)
    assert count_markers(masked).first()["markers_found"] == 4


def test_masking_again_changes_nothing(spark):
    masked = encrypted(spark, docs(spark, TEXT + " https://x.example/a")).select("doc_id", F.col("masked").alias("text"))
    for again in (encrypted(spark, masked), mask(detect(masked), "anonymize", salt="s")):
        assert again.first()["masked"] == masked.first()["text"]
    assert detect(masked, overlaps="keep").first()["spans"] == []


def test_nothing_detectable_is_left(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    for mode in ("anonymize", "redact"):
        left = detect(mask(detect(df), mode, salt="s").select("doc_id", F.col("masked").alias("text")))
        assert left.where("size(spans) > 0").count() == 0


def test_anonymize_is_stable_and_salted(spark):
    def placeholder(kind, text, salt, modulus=10_000):
        return f"[{kind}_{int(hashlib.sha256((salt + text).encode()).hexdigest()[:15], 16) % modulus}]"

    df = detect(docs(spark, "a@b.com x a@b.com"))
    one = placeholder("EMAIL_ADDRESS", "a@b.com", "s")
    assert mask(df, "anonymize", salt="s").first()["masked"] == f"{one} x {one}"
    assert mask(df, "anonymize", salt="s", modulus=7).first()["masked"].startswith(placeholder("EMAIL_ADDRESS", "a@b.com", "s", 7))


def test_policy(spark):
    df = detect(docs(spark, TEXT))
    policy = {"EMAIL_ADDRESS": "redact", "IP_ADDRESS": "keep", "CREDIT_CARD": "encrypt"}
    row = mask(df, "anonymize", salt="s", policy=policy, keys=key_ring(spark, {"k": KEY}), now=NOW).first()
    assert "<EMAIL_ADDRESS>" in row["masked"] and "10.0.0.1" in row["masked"] and "{{ENC:CREDIT_CARD:" in row["masked"]
    assert [i["entity_type"] for i in row["items"]] == ["EMAIL_ADDRESS", "CREDIT_CARD", "EMAIL_ADDRESS"]
    only = mask(df, "keep", policy={"IP_ADDRESS": "redact"}).first()
    assert only["masked"] == TEXT.replace("10.0.0.1", "<IP_ADDRESS>")
    with pytest.raises(ValueError):
        mask(df, "shred")
    with pytest.raises(ValueError):
        mask(df, "encrypt")


def test_numbered_and_placeholder_counts(spark):
    df = detect(docs(spark, "a@b.com 1.2.3.4 c@d.com", "e@f.com"))
    assert [r["masked"] for r in mask_numbered(df).orderBy("doc_id").collect()] == [
        "EMAIL_ADDRESS_1 IP_ADDRESS_1 EMAIL_ADDRESS_2", "EMAIL_ADDRESS_1",
    ]
    counts = placeholder_counts(mask_numbered(df, brackets=True))
    assert {r["placeholder"]: r["n"] for r in counts.collect()} == {
        "EMAIL_ADDRESS_1": 2, "EMAIL_ADDRESS_2": 1, "IP_ADDRESS_1": 1,
    }


def keyed(spark):
    df = spark.createDataFrame([(i, "a@b.com", f"t{i % 3}") for i in range(30)], "doc_id int, text string, tenant string")
    return detect(df), key_ring(spark, {"t0": KEY, "t1": ensure_key(b"MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY=")})


def test_key_per_tenant_and_missing_key(spark):
    df, keys = keyed(spark)
    masked = mask(df, "encrypt", keys=keys, key_id="tenant", now=NOW)
    rows = masked.collect()
    assert len(rows) == 30
    assert all((r["masked"] is None) == (r["tenant"] == "t2") for r in rows)
    restored = unmask(masked.drop("text", "spans"), keys, key_id="tenant").where("masked IS NOT NULL")
    assert {r["text"] for r in restored.collect()} == {"a@b.com"}
    with pytest.raises(ValueError):
        mask(df, "encrypt", keys=keys, now=NOW)


def test_key_table_too_large_to_broadcast(spark):
    df, keys = keyed(spark)
    large = KeyRing(keys.table, small=False)
    by_shuffle = mask(df, "encrypt", keys=large, key_id="tenant", now=NOW)
    by_broadcast = mask(df, "encrypt", keys=keys, key_id="tenant", now=NOW)
    columns = ["doc_id", "masked"]
    assert sorted(map(tuple, by_shuffle.select(columns).collect()), key=str) == sorted(
        map(tuple, by_broadcast.select(columns).collect()), key=str
    )


def test_plan_holds_no_key_and_no_nested_loop(spark):
    plan = encrypted(spark, docs(spark, TEXT))._jdf.queryExecution().toString()
    raw = fernet.base64.urlsafe_b64decode(KEY)
    assert KEY not in plan and raw[16:].hex() not in plan.lower()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "BroadcastHashJoin" in plan


def test_filters_do_not_repeat_the_detection(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    masked = mask(detect(df), "anonymize", salt="s").where("masked LIKE '%[%' AND size(spans) > 0 AND lang = 'en'")
    plan = masked.select("doc_id", "masked")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all(text") < 2 * 12
    assert "EqualTo(lang,en)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_long_text_with_many_spans(spark):
    text = "".join(f"é{'x' * (i % 900)} u{i}@example.com\n" for i in range(2500))
    row = mask(detect(docs(spark, text)), "redact").first()
    assert row["masked"] == re.sub(r"u\d+@example\.com", "<EMAIL_ADDRESS>", text)
    assert all(row["masked"][i["start"] : i["end"]] == "<EMAIL_ADDRESS>" for i in row["items"])


def test_unknown_findings_give_no_text(spark):
    docs = spark.createDataFrame([(1, "mail a@b.com"), (2, "nothing here")], "doc_id int, text string")
    unknown = docs.withColumn("spans", F.expr("CAST(NULL AS array<struct<start:int,end:int,entity_type:string,score:double,text:string>>)"))
    for row in mask(unknown, "redact").withColumn("error", masking_error()).collect():
        assert (row["masked"], row["error"]) == (None, "no findings")
    assert {r["masked"] for r in mask_numbered(unknown).collect()} == {None}


def test_digits_are_enough_to_look_for_numbers(spark):
    docs = spark.createDataFrame([(1, "+12222, x")], "doc_id int, text string")
    assert [s["text"] for s in detect(docs).first()["spans"]] == ["+12222"]
