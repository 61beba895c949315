"""Versioned tables, numbers across documents, and scores of findings."""

import os
import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators.detect import detect
from maskwright.operators.evaluate import best_matches, overlap_pairs, scores
from maskwright.operators.numbering import mask_with_numbers, number_texts
from maskwright.session import written
from maskwright.sources import versioned
from maskwright.sources.commits import publish


def values(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_deletion_rewrites_only_the_files_that_hold_the_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(1000).coalesce(1).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") != 5, F.col("id")).alias("key"))
    versioned.create(rows, path, per_file=100)
    with pytest.raises(versioned.Conflict):
        versioned.create(rows, path)
    first = versioned.files_of(spark, path)
    assert len(first) == 10
    gone = spark.createDataFrame([(150,), (151,), (151,), (None,), (5000,)], "key long")
    assert versioned.delete_rows(spark, path, gone, "key") == 1
    second = versioned.files_of(spark, path)
    assert len(set(first) & set(second)) == 9 and len(second) == 10
    assert values(versioned.read(spark, path), "id") == [(i,) for i in sorted(set(range(1000)) - {150, 151}, key=lambda i: str((i,)))]
    assert versioned.read(spark, path, 0).count() == 1000
    assert versioned.delete_rows(spark, path, gone, "key") == 1  # done again: nothing to do
    assert versioned.delete_rows(spark, path, spark.range(200, 300).select(F.col("id").alias("key")), "key") == 2
    assert versioned.read(spark, path).count() == 898
    removed = versioned.vacuum(spark, path)
    assert len(removed) == 2 and not any(os.path.exists(f"{path}/{n}") for n in removed)
    assert versioned.read(spark, path).count() == 898
    assert versioned.delete_rows(spark, path, versioned.read(spark, path).where("id < 800"), "id") == 3


def test_the_second_of_two_writers_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versioned.create(spark.range(10).select(F.col("id").alias("key")), path)
    write = versioned._write

    def meanwhile(*args):
        publish(spark, f"{path}/versions/00000001.txt", "\n".join(versioned.files_of(spark, path, 0)))
        return write(*args)

    monkeypatch.setattr(versioned, "_write", meanwhile)
    with pytest.raises(versioned.Conflict):
        versioned.delete_rows(spark, path, spark.createDataFrame([(1,)], "key long"), "key")
    assert versioned.read(spark, path).count() == 10


def test_numbers_are_dense_and_stay(spark):
    rng = random.Random(1)
    found = [(rng.choice("AB"), rng.choice(["x", "é", "X", "日", f"t{rng.randint(0, 300)}"])) for _ in range(2000)]
    df = spark.createDataFrame([*found, ("A", None)], "entity_type string, text string")
    numbers = number_texts(df)
    want = {(k, t, n + 1) for k in "AB" for n, t in enumerate(sorted({t for kind, t in found if kind == k}, key=str.encode))}
    assert set(values(numbers, "entity_type", "text", "number")) == want
    for node in numbers._jdf.queryExecution().executedPlan().toString().split("\n"):
        assert "windowspecdefinition(specifiedwindowframe" not in node
    held = written(numbers, "numbers")
    more = number_texts(df.unionByName(spark.createDataFrame([("A", "new"), ("A", "a new"), ("C", "first")], df.schema)), held)
    later = set(values(more, "entity_type", "text", "number"))
    top = max(n for k, _, n in want if k == "A")
    assert later - want == {("A", "a new", top + 1), ("A", "new", top + 2), ("C", "first", 1)} and want <= later
    assert number_texts(df.limit(0)).count() == 0


def test_masking_with_numbers(spark):
    rows = [(1, "a@b.com and c@d.org, a@b.com"), (2, "c@d.org"), (2, "none"), (3, None), (None, "c@d.org 1.2.3.4"), (2, "c@d.org")]
    found = detect(spark.createDataFrame(rows, "doc_id long, text string"))
    numbers = number_texts(found.select(F.expr("inline(spans)")))
    for small in (True, False):
        masked = values(mask_with_numbers(found, numbers, small=small), "doc_id", "masked")
        assert masked == sorted(
            [(1, "[EMAIL_ADDRESS_1] and [EMAIL_ADDRESS_2], [EMAIL_ADDRESS_1]"), (2, "[EMAIL_ADDRESS_2]"), (2, "[EMAIL_ADDRESS_2]"), (2, "none"), (3, None), (None, "[EMAIL_ADDRESS_2] [IP_ADDRESS_1]")],
            key=str,
        )
    with pytest.raises(Exception, match="no number"):
        mask_with_numbers(found, numbers.where("number = 1")).collect()


def random_spans(rng, n):
    return [(rng.randint(0, 3), a := rng.randint(0, 900), a + rng.randint(0, 400), rng.choice("PL")) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_pairs_and_matches_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    left, right = (sorted(set(random_spans(rng, 40))) for _ in range(2))
    schema = "doc_id long, start int, end int, entity_type string"
    pairs = written(overlap_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right + right[:3], schema), width=64), "pairs")
    columns = ("doc_id", "left_start", "left_end", "left_type", "right_start", "right_end", "right_type")
    want = [(a[0], *a[1:], *b[1:]) for a in left for b in right if a[0] == b[0] and max(a[1], b[1]) < min(a[2], b[2])]
    assert values(pairs, *columns) == sorted(want, key=str)
    alike = lambda p: (min(p[2], p[5]) - max(p[1], p[4])) / (max(p[2], p[5]) - min(p[1], p[4]))
    taken, greedy = set(), []
    for p in sorted(want, key=lambda p: (alike(p), -p[1], -p[4], -p[2], -p[5], p[3], p[6]), reverse=True):
        ends = {("left", p[0], *p[1:4]), ("right", p[0], *p[4:])}
        if not ends & taken:
            taken |= ends
            greedy.append(p)
    assert values(best_matches(pairs), *columns) == sorted(greedy, key=str)


def test_scores(spark):
    schema = "doc_id long, start int, end int, entity_type string"
    known = spark.createDataFrame([(1, 0, 10, "P"), (1, 20, 30, "P"), (2, 0, 5, "L"), (3, 0, 4, "X")], schema)
    found = spark.createDataFrame([(1, 1, 10, "P"), (1, 20, 30, "L"), (2, 0, 2, "L"), (4, 0, 9, "Y")], schema)
    got = {r["entity_type"]: (r["found"], r["known"], r["right"], r["precision"], r["recall"]) for r in scores(found, known).collect()}
    assert got == {"P": (1, 2, 1, 1.0, 0.5), "L": (2, 1, 0, 0.0, 0.0), "X": (0, 1, 0, None, 0.0), "Y": (1, 0, 0, 0.0, None)}
    assert scores(found.limit(0), known.limit(0)).count() == 0
