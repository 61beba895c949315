"""Operators that SQL cannot express, against plain loops that follow their definitions."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskwright.llm import chattree, common, langid, weak, winnow
from maskwright.llm.queries import queries

M64 = (1 << 64) - 1


def documents(spark, sf):
    return [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]


# -- fingerprints ----------------------------------------------------------------------------


def plain_prints(text, gram=winnow.GRAM, window=winnow.WINDOW):
    """Hashes and places by the definition: the least of each window, of equal ones the last."""

    def digest(piece):
        h = sum((ord(c) + 1) * pow(winnow.BASE, k, 1 << 64) for k, c in enumerate(piece)) & M64
        h ^= h >> 32
        h = h * 0xD6E8FEB86659FD93 & M64
        h ^= h >> 32
        return (h * 0xD6E8FEB86659FD93 & M64) >> 32

    hashes = [digest(text[i : i + gram]) for i in range(max(len(text) - gram + 1, 1))] if text else []
    chosen = set()
    for a in range(max(len(hashes) - window + 1, 1) if hashes else 0):
        chosen.add(min(range(a, min(a + window, len(hashes))), key=lambda i: (hashes[i], -i)))
    return [(hashes[i], i) for i in sorted(chosen)]


def test_fingerprints_by_definition(spark, sf):
    rng = random.Random(8)
    texts = {i: t for i, t in documents(spark, sf) if len(t) < 700}
    texts |= {10_000 + i: "".join(rng.choice("ab é") for _ in range(n)) for i, n in enumerate([0, 1, 2, 23, 24, 25, 39, 40, 41, 90])}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    order = sorted(texts, reverse=True)
    found = {r["doc_id"]: r for r in winnow.compare_with_next(docs).collect()}
    assert len(found) == len(texts) > 40
    for k, i in enumerate(order):
        text, after = texts[i], texts[order[(k + 1) % len(order)]]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        prints, changed, next_ = (plain_prints(t) for t in (text, edited, after))
        line = lambda p: "".join(f"{h:08x}" for h in sorted({h for h, _ in p}))
        likeness = lambda p, q: len({h for h, _ in p} & {h for h, _ in q}) / len({h for h, _ in p} | {h for h, _ in q}) if p or q else 1.0
        row = found[i]
        assert (row["n_chars"], row["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (row["fingerprint"], row["edited_fingerprint"]) == (line(prints), line(changed))
        assert row["near_edited"] == pytest.approx(likeness(prints, changed)) and row["near_next"] == pytest.approx(likeness(prints, next_))
        assert np.frombuffer(row["places"], "<u4").tolist() == [p for _, p in prints]


def test_fingerprint_table_is_the_same(spark):
    texts = ["some text that is long enough for several grams to be chosen from it", "", None, "short"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in winnow.fingerprint(docs).collect():
        assert [(p["hash"], p["pos"]) for p in r["prints"]] == plain_prints(texts[r["doc_id"]] or "")


# -- weak labels -----------------------------------------------------------------------------


def test_estimates_by_plain_loops():
    rng = random.Random(3)
    patterns = [[a, b, c] for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    counts = [rng.randint(1, 900) for _ in patterns]
    low = [0.9 if any(p) else 0.02 for p in patterns]
    for _ in range(7):
        total = [sum(n * (1 - q) for n, q in zip(counts, low, strict=True)), sum(n * q for n, q in zip(counts, low, strict=True))]
        prior = (total[1] + 1) / (sum(counts) + 2)
        table = []
        for k in (0, 1):
            rows = []
            for j in range(3):
                votes = [0.5, 0.5]
                for p, n, q in zip(patterns, counts, low, strict=True):
                    votes[p[j]] += n * (q if k else 1 - q)
                rows.append([v / sum(votes) for v in votes])
            table.append(rows)
        new = []
        for p in patterns:
            odds = [(1 - prior) * math.prod(table[0][j][p[j]] for j in range(3)), prior * math.prod(table[1][j][p[j]] for j in range(3))]
            new.append(odds[1] / sum(odds))
        low = new
    got_prior, got = weak.estimate(np.array(patterns), np.array(counts, float), rounds=7)
    assert got_prior == pytest.approx(prior) and got == pytest.approx(np.array(table))
    assert weak.posterior(np.array(patterns), got_prior, got) == pytest.approx(np.array(low))


def test_scorer_stands_where_its_loss_is_least():
    """Beyond the fit, small steps in any direction do not lower the loss much."""
    rng = np.random.default_rng(0)
    rows = rng.normal(0, 1, (400, 6)).astype(np.float32)
    low = (1 / (1 + np.exp(-(rows @ np.array([2, -1, 0, 0.5, 0, 1]) - 1)))).astype(np.float32)
    w = weak.fit(rows, low, steps=4000).astype(float)
    x = np.hstack([rows, np.ones((400, 1))]).astype(float)
    share = low.mean()
    weight = low * 0.5 / share + (1 - low) * 0.5 / (1 - share)
    scale = np.append(np.maximum(rows.std(axis=0), 1e-3), 1)

    def loss(v):
        # the gradient of the fit is (p - low) * weight, which is that of this loss
        z = x @ v
        return (weight * (np.log1p(np.exp(z)) - low * z)).mean() + 0.5e-4 * ((v * scale) ** 2).sum()

    slopes = [(loss(w + 1e-4 * np.eye(7)[k]) - loss(w - 1e-4 * np.eye(7)[k])) / 2e-4 for k in range(7)]
    assert np.abs(slopes).max() < 2e-3


def test_shares_of_words_by_plain_loops():
    texts = ["the the cat sat sat on a mat !! --", "", "A B C d,. e", "one two " * 40]
    shares = weak.Batch(texts).shares()
    for k, text in enumerate(texts):
        words = text.split()
        repeated = sum(a == b for a, b in zip(words, words[1:], strict=False))
        assert shares["repeated"][k] == pytest.approx(repeated / (len(words) + weak.PRIOR_WORDS))


# -- language models -------------------------------------------------------------------------


def plain_models(counts, order):
    """log2 P(last | rest) by dictionaries: interpolated Kneser-Ney over the counts of full sequences by language."""
    langs = sorted(counts)
    levels = {x: {order: dict(counts[x])} for x in langs}
    for x in langs:
        for n in range(order - 1, 0, -1):
            levels[x][n] = Counter(s[1:] for s in levels[x][n + 1])
    letters = {s for x in langs for s in levels[x][1]}

    def prob(x, seq):
        n = len(seq)
        if n == 0:
            return 1 / (len(letters) + 1)
        held = levels[x][n]
        ones, twos = sum(v == 1 for v in held.values()), sum(v == 2 for v in held.values())
        discount = ones / (ones + 2 * twos) if ones else 0.5
        same = {s: v for s, v in held.items() if s[:-1] == seq[:-1]}
        if not same:
            return prob(x, seq[1:])
        total = sum(same.values())
        return max(held.get(seq, 0) - discount, 0) / total + discount * len(same) / total * prob(x, seq[1:])

    return lambda seq: [math.log2(prob(x, seq)) for x in langs]


def test_language_models_by_dictionaries():
    import pandas as pd

    rng = random.Random(4)
    order, counts = 3, defaultdict(Counter)
    for lang, letters in (("a", "abc "), ("b", "bcd ")):
        for _ in range(80):
            counts[lang]["".join(rng.choice(letters) for _ in range(order))] += rng.randint(1, 3)
    table = pd.DataFrame([(x, s, n) for x, c in counts.items() for s, n in c.items()], columns=["lang", "seq", "n"])
    models, plain = langid.Models(table, order), plain_models(counts, order)
    for _ in range(200):
        seq = "".join(rng.choice("abcdz ") for _ in range(order))
        got = models.log2(np.array([ord(c) for c in seq], np.uint32), np.array([0]))[0]
        assert got == pytest.approx(plain(seq), abs=1e-4), seq


def test_scores_in_tiles_are_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    models = langid.learn(docs)
    texts = [t for _, t in documents(spark, sf)][:30] + [None, "", "12 3"]
    whole = langid._judged(models, texts)
    monkeypatch.setattr(langid, "TILE", 7)
    parts = langid._judged(models, texts)
    assert whole["lang_pred"] == parts["lang_pred"] and whole["letters"] == parts["letters"]
    assert whole["entropy"] == pytest.approx(parts["entropy"], abs=1e-5)


# -- registered queries ----------------------------------------------------------------------


def test_encoding_query_equals_the_library(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = {r["doc_id"]: r for r in queries()["op2_bpe"](spark, sf).collect()}
    texts = documents(spark, sf)
    assert len(found) == len(texts)
    for i, text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        row = found[i]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packing_query_equals_the_library(spark, sf):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, text in documents(spark, sf):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.add((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    found = queries()["op4_best_fit"](spark, sf).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found} == want and len(found) == len(want)
    held = defaultdict(list)
    for r in found:
        held[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in held.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
    assert len(held) <= 1.02 * sum(r["length"] for r in found) / 2048 + 1


@pytest.mark.parametrize("name", ["op3_quality", "op7_ngram_join", "op8_fingerprints", "op10_language_id"])
def test_registered_queries_keep_every_document(spark, sf, name):
    ids = sorted(r["doc_id"] for r in queries()[name](spark, sf).select("doc_id").collect())
    assert ids == sorted(i for i, _ in documents(spark, sf))


def test_position_ids_that_do_not_follow_are_refused(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "a")], "conv_id long, turn long, role string, text string")
    nodes, steps, intervals = chattree.build_tree(turns)
    assert [r["attended_chars"] for r in chattree.attended(intervals).collect()] == [r["formatted_chars"] for r in chattree.read_back(nodes, steps).collect()]
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="expected at"):
        chattree.read_back(nodes.withColumn("position", F.col("position") + 1), steps).collect()


def test_operators_on_empty_tables(spark):
    from maskwright.llm import bpe, urls

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_table(docs, path, decoded=True).count() == bpe.decode_table(bpe.encode_table(docs, path), path).count() == 0
    assert urls.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
    nodes, steps, intervals = chattree.build_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == chattree.read_back(nodes, steps).count() == intervals.count() == 0
    assert common.map_texts(docs, lambda frames: frames, "doc_id long, text string").count() == 0


def test_quality_scorer_holds_its_rows_once():
    import tracemalloc

    rng = np.random.default_rng(5)
    rows = rng.random((4000, 600)).astype(np.float16)
    low = (rows[:, 0] > 0.5).astype(np.float32)
    want = weak.fit(rows, low, steps=20)
    tracemalloc.start()
    parts = [rows[a : a + 500].copy() for a in range(0, 4000, 500)]
    got = weak.fit(parts, low, steps=20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not parts and np.array_equal(want, got)
    assert peak < 4000 * 600 * 4 + 2 * 1000 * 600 * 8  # the matrix and little else
