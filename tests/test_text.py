"""Text and path functions against small independent Python functions."""

import os

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from maskwright.functions import text as tx

CHARS = st.sampled_from(list("ab \t\n\r.") + ["\r\n", "\n\n\n", " ", "　", "\x1c", "\x0b", "é", "\U0001f600"])
TEXTS = st.lists(st.lists(CHARS, max_size=30).map("".join), min_size=1, max_size=40)
SPARK = settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, name="text"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, {name} string")


def apply(spark, values, expression):
    rows = column(spark, values).select("id", expression(F.col("text")).alias("out")).collect()
    return [r["out"] for r in sorted(rows, key=lambda r: r["id"])]


def expected_normal(text):
    lines, blank = [], 0
    for line in text.replace("\r\n", "\r").replace("\r", "\n").split("\n"):
        line = line.rstrip()
        blank = blank + 1 if not line else 0
        if blank < 2:
            lines.append(line)
    return "\n".join(lines).strip() + "\n"


@SPARK
@given(TEXTS)
def test_normalize(spark, texts):
    assert apply(spark, texts, tx.normalize_text) == [expected_normal(t) for t in texts]


def test_every_blank_is_stripped(spark):
    blanks = [chr(c) for c in range(0x10000) if chr(c).isspace()]
    assert sorted(tx.BLANKS) == sorted(blanks)
    assert apply(spark, [b + "x" + b for b in blanks], tx.normalize_text) == ["x\n"] * len(blanks)
    assert apply(spark, ["", " \n\t"], tx.normalize_text) == ["\n", "\n"]


PATHS = ["/a/b/c.md", "c.md", "/c.PDF", "a/.bashrc", "x/..md", "x/a..md", "no_ext", "d.ir/file", "/a/b.tar.gz", "//a.b", "a.b."]


def test_paths(spark):
    assert apply(spark, PATHS, tx.basename) == [os.path.basename(p) for p in PATHS]
    assert apply(spark, PATHS, tx.dirname) == [os.path.dirname(p) for p in PATHS]
    assert apply(spark, PATHS, tx.extension) == [os.path.splitext(os.path.basename(p))[1] for p in PATHS]
    stems = [os.path.splitext(os.path.basename(p))[0] for p in PATHS]
    assert apply(spark, PATHS, tx.stem) == stems
    dirs = [os.path.join(os.path.dirname(p), s) for p, s in zip(PATHS, stems)]
    assert apply(spark, PATHS, tx.output_dir) == dirs
    assert apply(spark, PATHS, tx.output_path) == [os.path.join(d, s + ".md") for d, s in zip(dirs, stems)]
    assert apply(spark, ["c.md", "/x/c.md"], tx.decrypted_path) == ["./c.decrypted.md", "/x/c.decrypted.md"]
    assert apply(spark, ["c.md"], lambda c: tx.decrypted_path(c, "/o")) == ["/o/c.decrypted.md"]


def test_key_values(spark):
    df = spark.createDataFrame([(["a=1", "bad", "b=x=y", "a=2", "=v", "c="],)], "items array<string>")
    row = df.select(tx.parse_key_values(F.col("items")).alias("m"), tx.invalid_key_values(F.col("items")).alias("n")).first()
    assert row["m"] == {"a": "2", "b": "x=y", "": "v", "c": ""}
    assert row["n"] == 1


def test_first_nonempty_and_template(spark):
    df = spark.createDataFrame([("", None, "x"), ("a", "b", None), ("", "", None)], "a string, b string, c string")
    got = [r[0] for r in df.select(tx.first_nonempty(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == ["x", "a", None]
    assert apply(spark, ["$1 {x} \\"], lambda c: tx.fill_template("'{original_text}'!", c)) == ["'$1 {x} \\'!"]
