"""Digits encrypted to digits, keys that change over time, and manifests beside tables."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from maskwright.functions.fernet import key_ring
from maskwright.functions.fpe import decrypt_digits, encrypt_digits
from maskwright.operators.detect import detect
from maskwright.operators.mask import mask
from maskwright.operators.rotation import rotate, token_versions, unmask_versions, version_ring
from maskwright.operators.unmask import restore_preserved, unmask
from maskwright.sources.sinks import store_table, table_manifest

KEY = "cw_0x689RpI-jtRR7oE8h_eQsKImvJapLeSbXpwF4e4="
OTHER = "MDEyMzQ1Njc4OWFiY2RlZjAxMjM0NTY3ODlhYmNkZWY="


def day(year, month=1):
    return datetime(year, month, 1, tzinfo=timezone.utc)


def test_published_vector_and_back(spark):
    key = "unhex('2B7E151628AED2A6ABF7158809CF4F3C')"
    rng = random.Random(1)
    digits = ["0123456789"] + ["".join(rng.choice("0123456789") for _ in range(n)) for n in range(6, 37) for _ in range(4)]
    df = spark.createDataFrame([(d,) for d in digits], "d string").selectExpr("d", f"{encrypt_digits('d', key)} AS c")
    rows = df.selectExpr("d", "c", f"{decrypt_digits('c', key)} AS back").collect()
    assert rows[0]["c"] == "2433477484"
    assert all(r["back"] == r["d"] and len(r["c"]) == len(r["d"]) and r["c"].isdigit() for r in rows)
    assert sum(r["c"] != r["d"] for r in rows) > len(rows) - 3


def test_preserved_numbers_keep_their_form(spark):
    text = "card 4111 1111 1111 1111, call +1 (743) 555-3824, mail a@b.com, ssn 123-45-6789; 4111111111111111."
    docs = spark.createDataFrame([(1, text), (2, "none"), (3, None), (4, "call 5551234567")], "doc_id long, text string")
    keys = key_ring(spark, {"k": KEY})
    masked = mask(detect(docs), "preserve", keys=keys).cache()
    said = {r["doc_id"]: r["masked"] for r in masked.collect()}
    blank = lambda t: "".join("0" if c.isdigit() else c for c in t)
    assert blank(said[1]).replace("<EMAIL_ADDRESS>", "a@b.com") == blank(text) and said[1] != text
    assert said[2] == "none" and said[3] is None and said[4] != "call 5551234567"
    cards = masked.where("doc_id = 1").selectExpr("inline(items)", "masked").where("entity_type = 'CREDIT_CARD'")
    digits = F.expr("regexp_replace(substring(masked, start + 1, end - start), '[^0-9]', '')")
    found = [r[0] for r in cards.select(digits).collect()]
    assert len(found) == 2 and found[0] == found[1] and cards.where(~F.expr("luhn_check(regexp_replace(substring(masked, start + 1, end - start), '[^0-9]', ''))")).count() == 0
    back = {r["doc_id"]: r["text"] for r in restore_preserved(masked.drop("text", "spans"), keys).collect()}
    assert back[1] == text.replace("a@b.com", "<EMAIL_ADDRESS>") and back[4] == "call 5551234567" and back[3] is None
    assert restore_preserved(masked.drop("text", "spans"), key_ring(spark, {"k": OTHER})).where("doc_id = 1").first()["text"] != text
    with pytest.raises(ValueError, match="keys"):
        mask(detect(docs), "preserve")


def test_keys_that_change(spark):
    ring = version_ring(spark, [("a", day(2024), KEY), ("a", day(2025), OTHER), ("b", day(2025), KEY)])
    docs = detect(spark.createDataFrame([(1, "a", "x@y.org 1.2.3.4"), (2, "b", "x@y.org"), (3, "c", "x@y.org"), (4, None, "x@y.org"), (5, "a", "none")], "doc_id long, owner string, text string"))
    early = mask(docs, "encrypt", keys=key_ring(spark, {"k": KEY}), now=day(2024, 6)).drop("spans")
    late = mask(docs, "encrypt", keys=key_ring(spark, {"k": OTHER}), now=day(2025)).drop("spans").where("owner = 'a'").withColumn("doc_id", F.col("doc_id") + 10)
    both = early.unionByName(late).withColumnRenamed("text", "plain")
    stamps = {"x": None, "2024": int(day(2024).timestamp()), "2025": int(day(2025).timestamp())}
    chosen = sorted(((r["doc_id"], r["n"], r["valid_from"]) for r in token_versions(both, ring, "owner").collect()), key=str)
    assert chosen == sorted(
        [(1, 0, stamps["2024"]), (1, 1, stamps["2024"]), (2, 0, None), (3, 0, None), (4, 0, None), (11, 0, stamps["2025"]), (11, 1, stamps["2025"])], key=str
    )
    opened = {r["doc_id"]: (r["text"] == r["plain"], r["markers_found"], r["markers_decrypted"]) for r in unmask_versions(both, ring, "owner").collect()}
    assert opened == {1: (True, 2, 2), 2: (False, 1, 0), 3: (False, 1, 0), 4: (False, 1, 0), 5: (True, 0, 0), 11: (True, 2, 2), 15: (True, 0, 0)}
    fresh = key_ring(spark, {"n": OTHER})
    turned = rotate(both, ring, "owner", fresh, day(2026)).drop("markers_found", "markers_decrypted")
    assert set(turned.columns) == set(both.columns)
    restored = {r["doc_id"]: (r["text"] == r["plain"], r["markers_decrypted"]) for r in unmask(turned, fresh).collect()}
    assert restored == {1: (True, 2), 2: (False, 0), 3: (False, 0), 4: (False, 0), 5: (True, 0), 11: (True, 2), 15: (True, 0)}
    again = rotate(both, ring, "owner", fresh, day(2026)).select("doc_id", "masked")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, turned.select("doc_id", "masked").collect()))


def test_tables_with_a_manifest(spark, tmp_path):
    path = str(tmp_path / "t")
    store_table(spark.range(5), path, {"type": "pii-masked"}, "aws:kms", "key-1")
    assert table_manifest(spark, path) == {"metadata": {"type": "pii-masked"}, "encryption": "aws:kms", "kms_key_id": "key-1", "rows": 5}
    assert spark.read.parquet(path).count() == 5
    with pytest.raises(FileExistsError):
        store_table(spark.range(1), path, {})
    with pytest.raises(ValueError):
        store_table(spark.range(1), path, {}, "aws:kms")
