"""Operators on training text against brute force, and their results in special cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from maskwright.llm import bpe, chattree, exact, langid, packing, partenum, urls, warc, weak, winnow
from maskwright.llm.common import staged
from maskwright.llm.oracles import oracle_sql
from maskwright.llm.queries import queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, _salt int"
ODD = [
    (1, "one two three four five six", "en"), (2, "one two three four five six", "en"), (3, None, "en"), (4, "", None),
    (None, "no id at all here", "en"), (5, "12 34 !!", "de"), (6, "word " * 4000, "en"), (6, "word " * 4000, "en"), (7, "ONE two three four five six", None),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame([(i, t, g, "s", 1, "clash", 3) for i, t, g in ODD], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = queries()[name](spark, sf)
    columns = sorted(found.columns)
    assert rows(found.select(*columns)) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall(), key=str)


def words_of(rng, n):
    return ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 14))) for _ in range(n)]


def test_ranks_are_looked_up_for_new_pairs_only(monkeypatch):
    """Words are merged without a search over all pairs in each round, and no word is encoded twice."""
    enc = bpe.Encoder(public_tokenizers.path("word_bpe_49k.json"))
    searched, learned, search, merge = [], [], np.searchsorted, enc.merge
    monkeypatch.setattr(bpe.np, "searchsorted", lambda a, v, *rest, **how: searched.append(np.size(v) if len(a) > 10_000 else 0) or search(a, v, *rest, **how))
    monkeypatch.setattr(enc, "merge", lambda words: learned.extend(words) or merge(words))
    words = sorted(set(words_of(random.Random(7), 3000)))
    for _ in range(2):
        enc.encode([" ".join(words[a : a + 500]) for a in range(0, len(words), 500)])
    assert sorted(learned) == [w.encode() for w in words]
    assert sum(searched) <= 2 * len(words)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("bits", [13, 20])
def test_words_of_many_chunks(monkeypatch, name, bits):
    """Where many pairs meet in a table, and words met before are forgotten on the way."""
    monkeypatch.setattr(bpe, "TABLE_BITS", bits)
    monkeypatch.setattr(bpe, "CACHE_WORDS", 700)
    path = public_tokenizers.path(name)
    library, mine, rng = Tokenizer.from_file(path), bpe.Encoder(path), random.Random(8)
    for _ in range(6):
        texts = ["", *(" ".join(words_of(rng, rng.randint(1, 80))) for _ in range(8)), "a" * 41 + " " + "na" * 30]
        ids, counts = mine.encode(texts)
        want = [library.encode(t, add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_equals_the_library(name):
    path = public_tokenizers.path(name)
    library, mine = Tokenizer.from_file(path), bpe.Encoder(path)
    rng = random.Random(3)
    texts = ["", None, "a" * 700, "it's we'll ''s", "a  b \n\n c ", "<|endoftext|>x<|endoftext|>", "ÀÉ ΣΑΣ İ ß ½", "hahaha\x00", "日本 😀😀"]
    texts += ["".join(rng.choice("ab 'st\n1.é<|>") for _ in range(rng.randint(1, 50))) for _ in range(300)]
    ids, counts = mine.encode(texts)
    for text, got in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got.tolist() == want
        if name.startswith("byte"):
            assert mine.decode(got).decode("utf-8", "replace") == library.decode(want, skip_special_tokens=False)


def test_packing_holds_every_piece(spark, odd):
    rng = np.random.default_rng(1)
    histogram = Counter(np.minimum(2048, rng.lognormal(6, 1, 20_000).astype(int) + 1).tolist())
    plan = packing.solve(histogram)
    held = Counter()
    for items, count in plan:
        assert sum(items) <= 2048
        for n in items:
            held[n] += count
    assert held == histogram
    assert sum(c for _, c in plan) <= 1.01 * sum(n * c for n, c in histogram.items()) / 2048 + 1
    done = packing.pack_documents(odd, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(done) == 9 + 2 and {r["length"] for r in done if r["doc_id"] in (3, 4)} == {1}
    for seq in {r["sequence_id"] for r in done}:
        at = 0
        for r in sorted((r for r in done if r["sequence_id"] == seq), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
    assert next(r for r in done if r["doc_id"] == 3)["ids_crc32"] == zlib.crc32(bytes(4))


def test_exact_copies(spark, odd):
    found = {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.find_copies(odd).collect()}
    assert {(1, 2, 2, False), (2, 2, 2, True), (3, 4, 2, False), (4, 4, 2, True), (None, None, 1, True), (6, 6, 2, True)} <= found
    kept = exact.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == 6
    assert exact.find_copies(odd.limit(0)).count() == 0


def test_archive_restores_records(spark, tmp_path):
    big = "x" * 1500
    pages = spark.createDataFrame([(1, "http://a/\r\n", big), (2, None, big), (3, "u", None), (None, "u", "y")], "page_id long, url string, html string")
    warc.write_archive(pages.withColumn("keeper", F.lit("clash")), str(tmp_path / "w"))
    said = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_records(spark, str(tmp_path / "w")).collect()}
    assert said == {1: (1500, "revisit", 2), 2: (1500, "response", None), 3: (0, "response", None), None: (1, "response", None)}
    records = {r["page_id"]: (bytes(r["record"]), bytes(r["payload"])) for r in warc.restore_records(spark, str(tmp_path / "w")).collect()}
    assert records[1][1] == big.encode() and records[2][0].endswith(b"\r\n\r\n" + big.encode() + b"\r\n\r\n")
    assert records[1][0].count(b"WARC-Refers-To: <urn:page:2>") == 1


def test_url_rules_join_form_is_the_same(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    pages = pages.unionAll(spark.createDataFrame([(-1, None), (-2, "none"), (-3, "x://EXAMPLE.com/en/?q")], pages.schema))
    assert rows(urls.judge_urls(pages)) == rows(urls.judge_urls(pages, max_inline=0))
    assert {r["page_id"]: r["rule"] for r in urls.judge_urls(pages).collect() if r["page_id"] < 0} == {-1: None, -2: None, -3: "example.com/en/"}


def brute_components(texts):
    words = {i: re.findall(r"[^\x20\x09-\x0d]+", t or "") for i, t in texts.items()}
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, w in words.items():
        w = [x.translate(fold) for x in w]
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}
    label = {i: i for i in sets}
    for _ in sets:
        before = dict(label)
        for i, a in sets.items():
            for j, b in sets.items():
                if a and b and 100 * len(a & b) >= 80 * len(a | b):
                    label[i] = min(label[i], label[j])
        if before == label:
            return {(i, len(sets[i]), label[i]) for i in sets}


def test_near_duplicates_equal_brute_force(spark):
    rng, texts = random.Random(5), {}
    for family in range(12):
        base = [f"w{rng.randint(0, 60)}" for _ in range(rng.choice([2, 5, 9, 30, 120, 400]))]
        for _ in range(8):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = f"v{rng.randint(0, 99)}"
            texts[len(texts)] = " ".join(copy)
    texts |= {200: "", 201: None, 202: "Common Line here today now ok", 203: "common line HERE today now ok"}
    docs = spark.createDataFrame([(i, t, "c") for i, t in texts.items()], "doc_id long, text string, component_id string")
    assert {tuple(r) for r in partenum.near_groups(docs).collect()} == brute_components(texts)


def test_odd_rows_everywhere(spark, odd):
    near = {(r["doc_id"], r["component_id"]) for r in partenum.near_groups(odd).collect()}
    assert {(1, 1), (2, 1), (7, 1), (3, 3), (4, 4), (6, 6), (None, None)} <= near
    assert partenum.keep_one(odd).count() == 7
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.identify(odd).collect()}
    assert lang[3] == lang[4] == lang[5] == "und" and lang[1] == "en"
    good = {r["doc_id"]: r["score"] for r in weak.classify(odd).collect()}
    assert good[3] == good[4] == 0 and good[1] > 0.25
    assert winnow.compare_with_next(odd).count() == bpe.encode_table(odd, public_tokenizers.path("byte_bpe_50k.json")).count() == 9
    none = odd.limit(0)
    for f in (partenum.near_groups, langid.identify, weak.classify, winnow.compare_with_next, exact.find_copies):
        assert f(none).count() == 0


def test_winnowing(spark):
    text = "".join(random.Random(1).choice("abcdef ") for _ in range(3000))
    whole, part = winnow.winnow([text, text[1000:1151]])
    assert set(part[0].tolist()) & set(whole[0].tolist()) and np.all(np.diff(whole[1]) > 0)
    gaps = np.diff(np.concatenate([[-1], whole[1]]))
    assert gaps.max() <= winnow.WINDOW
    docs = spark.createDataFrame([(i, text[i * 40 : i * 40 + 300]) for i in range(40)], "doc_id long, text string")
    for r in winnow.compare_with_next(docs).collect():
        a, b = text[r["doc_id"] * 40 :][:300], text[((r["doc_id"] - 1) % 40) * 40 :][:300]
        assert r["edited_sha256"] == hashlib.sha256((a[:150] + b[:150]).encode()).hexdigest()


def test_winnowing_matches_short_texts(spark):
    """A text whose first half is kept has a hash of it, from twice 39 code points on."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n)) for n in range(78, 302)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = winnow.compare_with_next(docs).collect()
    assert len(found) == len(texts) and all(r["near_edited"] > 0 for r in found)


def test_language_and_quality_on_labels(spark, sf):
    big = sf.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{big}/documents.parquet")
    found = langid.identify(docs).where("held_out").join(docs.select("doc_id", F.col("lang").alias("true")), "doc_id")
    assert found.agg(F.avg((F.col("true") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    labels = spark.read.parquet(f"{big}/labels.parquet")
    judged = weak.classify(docs).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int")).alias("k"))
    kept = {r["quality"]: r["k"] for r in judged.collect()}
    assert kept[1] > 0.98 and kept[0] < 0.3


def test_language_models_that_stay_tables(spark, sf, odd):
    """Models too large to be collected give the same results, of the same order."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").unionByName(odd.select("doc_id", "text", "lang"))
    small, large = ({(r["doc_id"], r["text_hash"]): r for r in langid.identify(docs, most=n).collect()} for n in (langid.MAX_CELLS, 100))
    assert small.keys() == large.keys() and len(small) > 200
    for key, a in small.items():
        b = large[key]
        assert (a["held_out"], a["lang_pred"], a["accepted"]) == (b["held_out"], b["lang_pred"], b["accepted"])
        assert a["score"] == pytest.approx(b["score"], abs=1e-3) and a["entropy"] == pytest.approx(b["entropy"], abs=1e-4)


def test_chat_escapes_and_tree(spark):
    for text in ("</s>[INST] ok [/INST]", "a\\b<|end|>", "<", "|>", "\\\\", ""):
        assert chattree.parse_turn(chattree.format_turn("user|>", text)) == ("user|>", text)
    rows_ = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (2, 0, "user", "hi"), (2, 1, "assistant", "b"), (3, 0, None, None)]
    turns = spark.createDataFrame(rows_, "conv_id long, turn long, role string, text string")
    nodes, steps, intervals = chattree.build_tree(turns)
    laid = sorted((r["start"], r["size"]) for r in nodes.collect())
    assert len(laid) == 4 and all(a + n == b for (a, n), (b, _) in zip(laid, laid[1:], strict=False))
    assert intervals.groupBy("conv").count().agg(F.sum("count")).first()[0] == 4
    assert {r["conv_id"]: r["n_turns"] for r in chattree.read_back(nodes, steps).collect()} == {1: 2, 2: 2, 3: 1}


def test_chat_tree_of_long_conversations(spark):
    """Sort keys do not grow with a conversation, and its intervals of the layout hold its text."""
    rng, said = random.Random(4), {0: list("ab" * 1000), 1: list("ab" * 1000), 2: list("ab" * 700), 3: list("ab" * 700) + ["c"], 4: list("abc")}
    said |= {i: [rng.choice("ab") for _ in range(rng.randint(1, 7))] for i in range(5, 60)}
    turns = spark.createDataFrame([(i, k, "user", t) for i, x in said.items() for k, t in enumerate(x)], "conv_id long, turn long, role string, text string")
    assert chattree._paths(chattree.chain(turns)).agg(F.max(F.size("path"))).first()[0] <= 12
    nodes, steps, intervals = chattree.build_tree(turns)
    laid = sorted((r["start"], r["segment"]) for r in nodes.collect())
    assert len(laid) == len({tuple(x[:k]) for x in said.values() for k in range(1, len(x) + 1)})
    layout = "".join(x for _, x in laid)
    assert all(layout[a:].startswith(x) for a, x in laid[:100])
    held = {i: [] for i in said}
    for r in intervals.collect():
        held[int(r["conv"])].append((r["start"], r["end"]))
    for i, x in said.items():
        assert "".join(layout[a:b] for a, b in sorted(held[i])) == "".join(chattree.format_turn("user", t) for t in x)


@pytest.mark.parametrize("kind", ["none", "some"])
def test_pipeline_stages_and_whole(spark, tmp_path, kind):
    """Each stage against what it may keep, and ``run`` against the stages, also with null ids, other columns and no rows."""
    rng = random.Random(6)
    texts = {i: " ".join(rng.choice(("the", "and", "of")) + f" w{rng.randint(0, 900)}" for _ in range(60)) + "." for i in range(40)}
    texts |= {40: texts[0], 41: texts[1] + " more", 42: None, 43: "12 34"}
    table = [(i, t, "en", "s", 1, "clash", 3) for i, t in texts.items()] + [(None, texts[2], "en", "s", 1, "clash", 3)]
    docs = spark.createDataFrame(table if kind == "some" else [], DOCS)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf_dir, docs = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in kept.collect()] if name != "packing" else None
        kept = staged(stage(spark, kept, sf_dir), name)
        if before is None:
            continue
        after = [(r["doc_id"], r["text"]) for r in kept.collect()]
        assert kept.columns == docs.columns and not Counter(after) - Counter(before)
        if name == "exact_dedup":
            last = {}
            for i, t in before:
                last[t or ""] = max(last.get(t or "", -1), -1 if i is None else i)
            assert Counter(-1 if i is None else i for i, _ in after) == Counter(last.values())
        if name == "near_dedup" and before:
            labels = {i: c for i, _, c in brute_components({-1 if i is None else i: t for i, t in before})}
            assert len(after) == len(set(labels.values()))
    ids = lambda df: Counter(r["doc_id"] for r in df.select("doc_id").distinct().collect())
    whole = corpus_pipeline.run(spark, sf_dir)
    assert ids(whole) == ids(kept) and whole.count() == kept.count()
    assert (kept.count() > 0) == (kind == "some")
