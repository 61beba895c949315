"""Names by dictionary and by tagger."""

import itertools
import random

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from checks import queries as own
from maskwright.functions.automaton import RUN, Automaton, TermFilter, Words
from maskwright.functions.tagging import FORBIDDEN, Model, Sentences, allowed, labels_of, spans_of, viterbi
from maskwright.operators.detect import detect
from maskwright.operators.dictionary import with_dictionary
from maskwright.operators.mask import mask
from maskwright.operators.tagger import tag, train_tagger
from maskwright.session import lookup_join

WORD = regex.compile(r"[\p{L}\p{N}_#&.'-]+")


def words_of(text):
    cut = [(m.start(), m.group().rstrip(".'-")) for m in WORD.finditer(text)]
    return [(s, s + len(w), w) for s, w in cut if w]


def brute_terms(texts, terms):
    lexicon = {(" ".join(w for _, _, w in words_of(t)), kind) for t, kind in terms} - {("", k) for _, k in terms}
    longest = max((t.count(" ") + 1 for t, _ in lexicon), default=0)
    out = []
    for i, text in enumerate(texts):
        words = words_of(text)
        for a in range(len(words)):
            for b in range(a, min(len(words), a + longest)):
                gram = " ".join(w for _, _, w in words[a : b + 1])
                out += [(i, words[a][0], words[b][1], *t) for t in lexicon if t[0] == gram]
    return sorted(out)


@pytest.mark.parametrize("seed", range(12))
def test_automaton_finds_all_terms(seed):
    rng = random.Random(seed)
    parts = ["a", "b", "c", "é", "d.", "x'", "--", "A&B", "日本", "ﬁ́"]
    terms = [(" ".join(rng.choice(parts) for _ in range(rng.randint(1, 6))), rng.choice("PL")) for _ in range(rng.randint(0, 30))]
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "  ", "\n", ", "]) for _ in range(rng.choice([0, 3, 50, 3 * RUN]))) for _ in range(6)]
    known = Automaton(terms)
    found = sorted((int(i), int(a), int(b), *known.terms[t]) for i, a, b, t in zip(*known.find(texts), strict=True))
    assert found == brute_terms(texts, terms)


def test_automaton_without_terms_or_texts():
    assert [len(x) for x in Automaton([]).find(["a b"])] == [len(x) for x in Automaton([("--", "P")]).find(["a"])] == [0] * 4
    assert [len(x) for x in Automaton([("a", "P")]).find([])] == [len(x) for x in Automaton([("a", "P")]).find(["", " ."])] == [0] * 4


def test_dictionary_beyond_the_bound_gives_the_same(spark):
    rows = [(1, "Ann Lee met Ann Lee. of Rome"), (2, "nobody"), (3, None), (4, "Rome 'Rome' Ann\nLee"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = spark.createDataFrame([("Ann Lee", "PERSON"), ("Ann  Lee.", "PERSON"), ("Rome", "LOCATION"), ("", "PERSON"), (None, "PERSON")], "term string, entity_type string")
    here, joined = (with_dictionary(docs, terms, broadcast_rows=n) for n in (100, 1))
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan
    said = {r["doc_id"]: [tuple(s) for s in r["dictionary_spans"]] for r in here.collect()}
    assert said == {r["doc_id"]: [tuple(s) for s in r["dictionary_spans"]] for r in joined.collect()}
    assert said[1] == [(0, 7, "PERSON", 0.85, "Ann Lee"), (12, 19, "PERSON", 0.85, "Ann Lee"), (24, 28, "LOCATION", 0.85, "Rome")]
    assert said[4][-1][4] == "Ann\nLee" and said[3] == []
    masked = {r["doc_id"]: r["masked"] for r in mask(detect(here, also="dictionary_spans"), "redact").collect()}
    assert masked[1] == "<PERSON> met <PERSON>. of <LOCATION>"


@pytest.mark.parametrize("seed", range(8))
def test_viterbi_is_the_best_of_all_paths(seed):
    rng = np.random.default_rng(seed)
    labels, sizes = 5, np.array([1, 4, 2, 5, 3])
    begin = np.cumsum(sizes) - sizes
    scores = rng.normal(0, 2, (int(sizes.sum()), labels)).astype(np.float32)
    move = rng.normal(0, 1, (labels + 1, labels)).astype(np.float32) + allowed(labels)
    best = viterbi(scores, move, begin, sizes)
    for b, n in zip(begin, sizes, strict=True):

        def worth(path, b=b):
            return scores[b, path[0]] + move[-1, path[0]] + sum(move[p, q] + scores[b + k + 1, q] for k, (p, q) in enumerate(itertools.pairwise(path)))

        top = max(itertools.product(range(labels), repeat=int(n)), key=worth)
        assert worth(best[b : b + n].tolist()) == pytest.approx(worth(top), abs=1e-4)
        assert worth(top) > FORBIDDEN / 2


def test_labels_and_spans_are_each_others_inverse():
    texts = ["Ann Lee of Rome. Bob", "", "x y z"]
    told = [[(0, 7, "PERSON"), (11, 15, "LOCATION"), (17, 20, "PERSON")], [], [(2, 3, "PERSON"), (4, 5, "PERSON"), (0, 1, "OTHER")]]
    kinds = ("LOCATION", "PERSON")
    sentences = Sentences(texts)
    labels = labels_of(sentences, told, kinds)
    back = [(int(o), int(a), int(b), kinds[k]) for o, a, b, k in zip(*spans_of(sentences, labels), strict=True)]
    assert back == [(k, *s) for k, spans in enumerate(told) for s in spans if s[2] in kinds]


def test_tagger_finds_names_it_has_not_seen(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs = own.planted_documents(spark, sf).cache()
    model = own.tagger_of(spark, sf)
    parties = own.named_parties(spark, sf)
    fields = [F.struct(F.lit(k).alias("entity_type"), F.col(c).alias("text")) for c, k in (("person", "PERSON"), ("place", "LOCATION"), ("firm", "ORGANIZATION"))]
    held = docs.where("c_custkey % 3 = 1")
    want = held.join(parties, "c_custkey").select("doc_id", "text", F.explode(F.array(*fields)).alias("e")).where(F.expr("contains(text, e.text)"))
    want = {(r["doc_id"], *r["e"]) for r in want.select("doc_id", "e").collect()}
    got = {(r["doc_id"], r["entity_type"], r["text"]) for r in own.span_rows(tag(held, model), spans="tagged_spans").collect()}
    both = len(want & got)
    assert len(want) > 50 and 2 * both / (len(want) + len(got)) > 0.9


def test_tagger_of_little(spark):
    schema = "doc_id long, text string, spans array<struct<start:int,end:int,entity_type:string,score:double,text:string>>"
    none = train_tagger(spark.createDataFrame([], schema), passes=1)
    assert isinstance(none, Model)
    odd = spark.createDataFrame([(1, None, None), (2, "", []), (3, "..", []), (4, "one " * 500, [])], schema)
    model = train_tagger(odd, passes=1)
    assert [r["tagged_spans"] for r in tag(odd, model).orderBy("doc_id").collect()] == [[]] * 4


@pytest.mark.parametrize("seed", range(6))
def test_filter_lets_all_terms_pass_and_little_else(seed):
    rng = random.Random(seed)
    parts = ["a", "b", "c", "é", "d.", "x'", "--", "A&B", "日本"]
    grams = sorted({" ".join(w for _, _, w in words_of(" ".join(rng.choice(parts) for _ in range(rng.choice([1, 2, 5]))))) for _ in range(30)} - {""})
    texts = ["".join(rng.choice(parts) + rng.choice([" ", "  ", "\n"]) for _ in range(rng.choice([0, 3, 50]))) for _ in range(6)]
    places = TermFilter.places_for(len(grams))
    held = np.zeros(places >> 6, np.uint64)
    for spot in TermFilter.spots(Words(grams).whole_hashes(), places).ravel().tolist():
        held[spot >> 6] |= np.uint64(1 << (spot & 63))
    words = Words(texts)
    first, last = TermFilter(held, tuple({g.count(" ") + 1 for g in grams})).passed(words)
    passed = [(int(words.owner[a]), words.text(a, b)) for a, b in zip(first, last, strict=True)]
    want = [(i, g) for i, _, _, g, _ in brute_terms(texts, [(g, "P") for g in grams])]
    assert sorted(p for p in passed if p[1] in grams) == sorted(want)
    assert len(passed) - len(want) <= 0.05 * 4 * len(words.owner) + 3


def test_large_dictionary_with_repeated_and_missing_ids(spark):
    rows = [(1, "Ann Lee"), (1, "of Rome and Ann Lee"), (None, "Rome"), (None, "by Ann Lee"), (2, "Ann Lee"), (2, "Ann Lee"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = spark.createDataFrame([("Ann Lee", "PERSON"), ("Rome", "LOCATION")], "term string, entity_type string")
    told = [sorted(map(str, with_dictionary(docs, terms, broadcast_rows=n).collect())) for n in (100, 1)]
    assert told[0] == told[1]


def test_large_lookups_are_not_repeated(spark):
    left = spark.range(3000).withColumnRenamed("id", "doc_id").withColumn("k", F.col("doc_id") % 7)
    right = spark.range(5000).select(F.col("id").alias("k"), F.col("id").cast("string").alias("v"))
    joined = lookup_join(left, right, "k", small=False)
    assert "Generate" not in joined._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
    try:
        salted = lookup_join(left, right, "k", small=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.skewJoin.enabled")
    assert "Generate" in salted._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(joined.collect()) == sorted(salted.select(joined.columns).collect())


def test_only_documents_that_train_are_labelled(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("Signed by Ann Lee, no. "), F.col("id").cast("string")).alias("text"))
    terms = spark.createDataFrame([("Ann Lee", "PERSON")], "term string, entity_type string")
    seen = []

    def label(picked):
        seen.append(picked.count())
        return with_dictionary(picked, terms, into="spans", broadcast_rows=0)

    late = train_tagger(docs, passes=1, sample=300, label=label)
    early = train_tagger(with_dictionary(docs, terms, into="spans"), passes=1, sample=300)
    assert 150 < seen[0] < 450 and np.array_equal(late.emit, early.emit) and np.array_equal(late.move, early.move)
