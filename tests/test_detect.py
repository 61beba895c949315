"""Detection, overlaps and positions against brute force in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from maskwright.functions.recognizers import RECOGNIZERS, Recognizer, select_recognizers
from maskwright.functions.spans import resolve_overlaps, with_line_column
from maskwright.operators.detect import detect, filter_by_list, filter_entities, matches

DEMO = [
    "Write to jane.roe@example.com or ask for Jane Roe at the desk, 7 Elm Road. Reference 542873775.",
    "The SSN on file is 542873775.",
    "Owner: Ann Example, acting for Lakeside Holdings.",
    "",
    None,
]


def docs(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, text string")


def found(df, *columns):
    columns = columns or ("doc_id", "start", "end", "entity_type", "score", "text")
    return sorted(tuple(r[c] for c in columns) for r in matches(df).collect())


def types_of(spark, text):
    return [(s["entity_type"], s["text"], s["score"]) for s in detect(docs(spark, [text])).first()["spans"]]


def test_demo_texts(spark):
    got = found(detect(docs(spark, DEMO)))
    assert got == [
        (0, 9, 29, "EMAIL_ADDRESS", 1.0, "jane.roe@example.com"),
        (0, 85, 94, "US_SSN", 0.05, "542873775"),
        (1, 19, 28, "US_SSN", 0.4, "542873775"),
    ]


@pytest.mark.parametrize(
    "text, expected",
    [
        ("card 4111 1111 1111 1111.", ["CREDIT_CARD"]),
        ("card 4111-1111-1111-1111", ["CREDIT_CARD"]),
        ("card 4111111111111112", []),
        ("amex 3782 822463 10005", ["CREDIT_CARD"]),
        ("x4111111111111111", []),
        ("41111111111111114111111111111111", []),
        ("pay GB82WEST12345698765432 now", ["IBAN_CODE"]),
        ("pay GB82 WEST 1234 5698 7654 32", ["IBAN_CODE"]),
        ("pay GB83WEST12345698765432", []),
        ("ssn 123-45-6789", ["US_SSN"]),
        ("000-45-6789 666-12-1234 123-00-1234 123-45-0000", []),
        ("tax 912-70-1234", ["US_ITIN"]),
        ("host 192.168.0.255 or 256.1.1.1", ["IP_ADDRESS"]),
        ("fe80::1 and 2001:db8:0:0:0:0:2:1, at 12:30:45", ["IP_ADDRESS", "IP_ADDRESS"]),
        ("see (https://a.example/x?y=1), ok", ["URL"]),
        ("+1 (743) 555-3824", ["PHONE_NUMBER"]),
        ("+49 30 1234 5678", ["PHONE_NUMBER"]),
        ("(415) 555-1234 and 415.555.1234", ["PHONE_NUMBER", "PHONE_NUMBER"]),
        ("a.b+c@mail.example.org,d_e@x.co", ["EMAIL_ADDRESS", "EMAIL_ADDRESS"]),
        ("no@tld and @nobody.com", []),
    ],
)
def test_recognizers(spark, text, expected):
    assert [t[0] for t in types_of(spark, text)] == expected


def test_trailing_punctuation_is_not_part_of_a_url(spark):
    assert types_of(spark, "(https://a.example/x?y=1).")[0][1] == "https://a.example/x?y=1"


def test_context_raises_the_score(spark):
    assert types_of(spark, "SSN 123-45-6789")[0][2] == 0.85
    assert types_of(spark, "no. 123-45-6789")[0][2] == 0.5
    assert types_of(spark, "call 415-555-1234")[0][2] == 0.75


def test_own_recognizer_and_subset(spark):
    own = Recognizer("BADGE", "B-[0-9]{4}", 0.9, check="right({match}, 1) <> '0'")
    df = detect(docs(spark, ["B-1234 B-1230 a@b.com"]), recognizers=(*RECOGNIZERS, own))
    assert [s["text"] for s in df.first()["spans"]] == ["B-1234", "a@b.com"]
    only = detect(docs(spark, ["B-1234 a@b.com"]), entities=["EMAIL_ADDRESS"])
    assert [s["text"] for s in only.first()["spans"]] == ["a@b.com"]
    assert "IP_ADDRESS" not in only._jdf.queryExecution().toString()
    assert len(select_recognizers()) == len(RECOGNIZERS)
    with pytest.raises(ValueError):
        select_recognizers(["NO_SUCH_TYPE"])
    with pytest.raises(ValueError):
        Recognizer("bad-type", "x", 1.0)
    kept = filter_entities(detect(docs(spark, ["1.2.3.4 a@b.com"])), ["IP_ADDRESS"])
    assert [s["text"] for s in kept.first()["spans"]] == ["1.2.3.4"]


@pytest.mark.parametrize("small", [None, False])
def test_lists_by_tenant(spark, small):
    df = spark.createDataFrame([(i, "1.2.3.4 a@b.com", f"t{i}") for i in range(3)], "doc_id int, text string, tenant string")
    allowed = spark.createDataFrame([("t0", "IP_ADDRESS"), ("t1", "URL")], "tenant string, entity_type string")
    kept = filter_by_list(detect(df), allowed, "tenant", small=small)
    got = {r["doc_id"]: [s["entity_type"] for s in r["spans"]] for r in kept.collect()}
    assert got == {0: ["IP_ADDRESS"], 1: [], 2: ["IP_ADDRESS", "EMAIL_ADDRESS"]}


def test_offsets_are_code_points(spark):
    text = "\U0001f600é a@b.com \U0001f600\n1.2.3.4"
    for s in detect(docs(spark, [text])).first()["spans"]:
        assert text[s["start"] : s["end"]] == s["text"]


def test_many_spans_in_one_text(spark):
    text = "é ".join(f"u{i}@example.com line\n" for i in range(3000))
    got = found(detect(docs(spark, [text])), "start", "end", "line", "column")
    want = []
    for m in re.finditer(r"[a-z0-9]+@example\.com", text):
        before = text[: m.start()]
        want.append((m.start(), m.end(), before.count("\n") + 1, m.start() - (before.rfind("\n") + 1) + 1))
    assert got == sorted(want)


def greedy(spans):
    kept = []
    for s in sorted(spans, key=lambda s: (s[2] != "", s[0] - s[1], -s[3], s[0], s[2])):
        if all(s[1] <= k[0] or k[1] <= s[0] for k in kept):
            kept.append(s)
    return sorted(kept)


def test_overlaps_like_brute_force(spark):
    rng = random.Random(7)
    cases = []
    for case in range(60):
        spans = set()
        for _ in range(rng.choice([0, 1, 3, 20, 400])):
            start = rng.randrange(0, 900)
            spans.add((start, start + rng.randrange(1, 30), rng.choice(["A", "B", ""]), rng.choice([0.1, 0.5, 1.0])))
        cases.append((case, [(*s, "t") for s in sorted(spans)]))
    df = spark.createDataFrame(
        cases, "id int, spans array<struct<start:int,end:int,entity_type:string,score:double,text:string>>"
    )
    for row in df.select("id", F.expr(resolve_overlaps("spans")).alias("kept")).collect():
        got = [(s["start"], s["end"], s["entity_type"], s["score"]) for s in row["kept"]]
        assert got == greedy([c[:4] for c in cases[row["id"]][1]])


def test_line_column_of_equal_starts(spark):
    text = "ab\ncd"
    df = spark.createDataFrame(
        [(text, [(3, 4, "A", 0.0, "c"), (3, 5, "B", 0.0, "cd"), (4, 5, "C", 0.0, "d")])],
        "text string, spans array<struct<start:int,end:int,entity_type:string,score:double,text:string>>",
    )
    rows = df.select(F.expr(with_line_column("text", "spans")).alias("p")).first()["p"]
    assert [(r["line"], r["column"]) for r in rows] == [(2, 1), (2, 1), (2, 2)]


def test_reserved_column_names_are_refused(spark):
    with pytest.raises(ValueError):
        detect(docs(spark, ["x"]).withColumnRenamed("text", "gaps"), text="gaps")
