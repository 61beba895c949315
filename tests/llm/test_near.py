"""The similarity join where cells are large, signatures are held by many, and words or rows are chosen to mislead."""

import random

import numpy as np
import pytest

from maskwright.llm import common, partenum
from .test_llm import brute_components


def groups(spark, texts, **how):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {tuple(r) for r in partenum.near_groups(docs, **how).collect()}


def family(rng, n, words, edits):
    base = [f"w{i}" for i in range(words)]
    out = {}
    for i in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"v{rng.randint(0, 10**6)}"
        out[i] = " ".join(copy)
    return out


def test_a_large_family_of_near_copies(spark, monkeypatch):
    """Most members are linked with the center, some with others only, some with none."""
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 40)
    monkeypatch.setattr(partenum, "BLOCK_MEMBERS", 3000)
    rng = random.Random(1)
    texts = family(rng, 300, 60, 3) | {1000 + i: t for i, t in family(rng, 60, 400, 40).items()}
    found = groups(spark, texts)
    assert found == brute_components(texts)
    assert 5 < len({c for _, _, c in found}) < 300


def test_rows_dealt_to_blocks_follow_the_size_of_a_family(spark, monkeypatch):
    """Most members share signatures but are linked with nothing; a block of whole sets holds few of them."""
    monkeypatch.setattr(partenum, "BLOCK_ROWS", 40)
    monkeypatch.setattr(partenum, "BLOCK_MEMBERS", 3000)
    rows, staged = {}, common.staged

    def counted(df, name):
        out = staged(df, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(partenum, "staged", counted)
    texts = family(random.Random(4), 160, 60, 16)
    assert groups(spark, texts) == brute_components(texts)
    assert 0 < rows["blocks"] <= 2 * rows["sides"]  # with the rest, and with those linked with the center


@pytest.mark.parametrize("sift", [(30, 10**6), (10**6, 1500), (10**6, 10**6)])
def test_blocks_of_sketches_and_of_sets(spark, monkeypatch, sift):
    """Links within and between blocks are found, whichever bound cuts them."""
    for name, value in zip(["SIFT_ROWS", "SIFT_MEMBERS", "BLOCK_ROWS", "BLOCK_MEMBERS"], [*sift, 16, 1200], strict=True):
        monkeypatch.setattr(partenum, name, value)
    rng = random.Random(5)
    texts = family(rng, 120, 60, 9) | {500 + i: t for i, t in family(rng, 60, 70, 9).items()} | {900: "a b c d e"}
    found = groups(spark, texts)
    assert found == brute_components(texts)
    assert 5 < len({c for _, _, c in found}) < len(texts)


def test_near_pairs_are_all_pairs_that_may_link():
    rng = random.Random(6)
    hashes = [np.array([rng.getrandbits(63) % 400 for _ in range(n)], np.uint64) for n in [60] * 30 + [70] * 30 + [9] * 10 + [130] * 5]
    hashes += [np.concatenate([h[: len(h) - 4], np.arange(5, dtype=np.uint64) + np.uint64(1000 * k)]) for k, h in enumerate(hashes)]
    sets = [np.unique(h) for h in hashes]
    rng.shuffle(sets)
    size = np.array([len(s) for s in sets])
    held = partenum.sketches(common.mix(np.concatenate(sets)), np.repeat(np.arange(len(sets)), size), size)
    second = np.array([rng.random() < 0.4 for _ in sets])
    pick = lambda at: (size[at], [held[i] for i in at])
    want = set()
    for i in range(len(sets)):
        later = np.arange(i + 1, len(sets))
        ok = partenum.pairs_may_link(*pick(np.full(len(later), i)), *pick(later))
        want |= {(i, int(j)) for j in later[ok]}
    assert len(want) > 40
    for other, pairs in ((None, want), (second, {p for p in want if second[p[0]] != second[p[1]]})):
        met = [tuple(sorted((i, int(j)))) for i, close in partenum.near_pairs(size, held, other) for j in close]
        assert len(met) == len(set(met)) and set(met) == pairs
        row, part = partenum.narrow(size, held, other)
        blocks = {}
        for r, b in zip(row.tolist(), part.tolist(), strict=True):
            blocks.setdefault(b, set()).add(r)
        assert all(any({i, j} <= b for b in blocks.values()) for i, j in pairs)


def test_heavy_signatures_give_the_same_cells(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame(list((family(rng, 80, 60, 2) | {500 + i: f"lone {i} " * 9 for i in range(20)}).items()), "doc_id long, text string")
    heavy = partenum.heavy_signatures(docs, share=0.1, sampled=1)
    assert len(heavy) > 0 and (np.diff(heavy) > 0).all()
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(partenum.cells(docs, heavy=heavy)) == rows(partenum.cells(docs)) != set()


def test_shuffles_give_the_same_links(spark):
    """With a limit of no ids nothing is broadcast."""
    rng = random.Random(3)
    docs = spark.createDataFrame(list(family(rng, 60, 50, 3).items()), "doc_id long, text string")
    facts = common.staged(partenum.set_facts(docs), "facts")

    def labels(limit):
        return {tuple(r) for r in partenum.components(partenum.links(docs, facts, limit=limit)).collect()}

    assert labels(0) == labels(10) == labels(10**6) != set()
    gone = docs.select("doc_id", common.row_digest(docs, "text").alias("text_hash")).where("doc_id % 3 = 0")
    kept = lambda limit: sorted(r["doc_id"] for r in common.without(docs, gone, limit=limit).collect())
    assert kept(0) == kept(10**6) == [i for i in range(60) if i % 3]


def test_words_that_meet_under_polynomial_hashes(spark):
    word, other = "a", "b"
    while len(word) < 2048:
        word, other = word + other, other + word
    codes = np.frombuffer((word + " " + other).encode(), np.uint8)
    a, b = common.word_hashes(codes, np.array([0, len(word) + 1]), np.array([len(word), len(codes)]))
    assert a != b
    assert groups(spark, {1: word, 2: other}) == {(1, 1, 1), (2, 1, 2)}
    assert groups(spark, {1: f"{word} x y z w", 2: f"{other} x y z w", 3: f"{other} X Y z w"}) == {(1, 1, 1), (2, 1, 2), (3, 1, 2)}


def test_rows_of_one_id_go_each_for_itself(spark):
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    rows = [(1, base), (5, base + " x"), (5, "quite another text that has nothing to do with it"), (6, base), (6, base), (None, base), (7, None), (8, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "clash", 4) for r in rows], "doc_id long, text string, node string, _h int")
    kept = sorted(((r["doc_id"], r["text"]) for r in partenum.keep_one(docs).collect()), key=str)
    assert kept == sorted([rows[0], rows[2], *rows[5:]], key=str)
    assert partenum.keep_one(docs).columns == docs.columns
    assert partenum.keep_one(docs.limit(0)).count() == 0


def test_ids_with_several_sets(spark):
    base = [f"w{i}" for i in range(40)]
    rows = [(3, " ".join(base)), (2, "one two three four five six"), (2, " ".join(base + ["x"])), (9, "one two three four five six"), (1, "zero")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["component_id"]) for r in partenum.near_groups(docs).collect()}
    assert found == {(1, 1), (2, 2), (3, 2), (9, 2)}


def test_columns_of_the_caller_stay(spark):
    docs = spark.createDataFrame([(1, "a", 10, "h"), (2, "b", 20, "i")], "doc_id long, text string, _h int, _hash string")
    gone = docs.where("doc_id = 2").select("doc_id", common.row_digest(docs, "text").alias("text_hash"))
    assert [tuple(r) for r in common.without(docs, gone).collect()] == [(1, "a", 10, "h")]


def test_ids_beyond_floats_stay_exact(spark):
    big = (1 << 60) + 1
    docs = spark.createDataFrame([(big, "one two three"), (None, "four"), (big + 2, "one two three")], "doc_id long, text string")
    assert {r["doc_id"] for r in partenum.set_facts(docs.coalesce(1)).collect()} == {big, None, big + 2}
    assert {(r["doc_id"], r["component_id"]) for r in partenum.near_groups(docs).collect()} == {(big, big), (big + 2, big), (None, None)}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 7, 24])
def test_window_hashes(n):
    values = np.arange(40, dtype=np.uint64) * np.uint64(7) + np.uint64(3)
    want = [sum(int(values[i + k]) * pow(common.BASE, k, 1 << 64) for k in range(n)) % (1 << 64) for i in range(41 - n)]
    assert common.window_hashes(values, n).tolist() == want


def test_frames_follow_the_size_of_texts(spark):
    docs = spark.createDataFrame([(i, "x" * (100 if i != 5 else 5000)) for i in range(40)], "doc_id long, text string").coalesce(1)
    sizes = common.map_texts(docs, lambda frames: (f.assign(n=len(f))[["doc_id", "n"]] for f in frames), "doc_id long, n long", limit=1000)
    found = {r["doc_id"]: r["n"] for r in sizes.collect()}
    assert len(found) == 40 and max(found.values()) == 2 and found[5] <= 2


def test_texts_longer_than_a_chunk(spark):
    long = " ".join(f"w{i % 977} and" for i in range(60_000))
    assert len(long) > 2 * common.CHUNK_CHARS
    texts = {1: long, 2: long + " end", 3: "short text of five words"}
    assert {(i, c) for i, _, c in groups(spark, texts)} == {(1, 1), (2, 1), (3, 3)}
