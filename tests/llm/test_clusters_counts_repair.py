"""Clustering by bit planes, token counts and repair of conversations against brute force."""

import functools
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from maskwright.llm import bitplanes, repair, tokencount
from maskwright.llm.queries import queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- clustering ------------------------------------------------------------------------------


def brute_clusters(vectors, count, rounds):
    kept = []
    for vec_id, x in vectors:
        if x is not None and len(x) == 64 and all(v is not None and np.isfinite(v) for v in x):
            kept.append((vec_id, [int(np.floor(256 * float(np.float32(v)))) for v in x]))
    hashed = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), x) for i, x in kept if i is not None)
    centroids = [x for _, x in hashed[:count]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        members = defaultdict(list)
        for _, x in kept:
            members[nearest(x)[1]].append(x)
        for k, held in members.items():
            centroids[k] = [sum(column) // len(held) for column in zip(*held, strict=True)]
    done = [(i, *reversed(nearest(x))) for i, x in kept]
    inertia = defaultdict(int)
    for _, k, d in done:
        inertia[k] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia.values()), digest[k]) for i, k, d in done), key=str)


def test_dot_products_are_exact():
    rng = np.random.default_rng(0)
    for planes in (1, 2, 9, 28):
        low, high = -(1 << planes - 1), (1 << planes - 1)
        a, b = (rng.integers(low, high, (7, 64)) for _ in range(2))
        a[0], b[0] = low, low
        assert (bitplanes.values_of(bitplanes.pack(a, planes)) == a).all()
        assert (bitplanes.dot(bitplanes.pack(a, planes), bitplanes.pack(b, planes)) == a @ b.T).all()
        assert (bitplanes.norms(bitplanes.pack(a, planes)) == (a * a).sum(axis=1)).all()


@pytest.mark.parametrize("count,rounds", [(4, 3), (40, 2)])
def test_clusters_equal_brute_force(spark, count, rounds):
    rng = np.random.default_rng(count)
    vectors = [(i, rng.normal(0, 3, 64).astype(np.float32).tolist()) for i in range(30)]
    vectors += [vectors[3], vectors[3], (100, [0.5] * 64), (101, [0.5] * 64), (None, [-0.25] * 64), (None, [9.0] * 64)]
    vectors += [(200, None), (201, []), (202, [1.0] * 63), (203, [None] + [1.0] * 63), (204, [float("nan")] * 64), (205, [float("-inf")] * 64), (206, [1.0] * 65)]
    df = spark.createDataFrame([(i, x, 1, 2) for i, x in vectors], "vec_id long, embedding array<float>, cluster int, planes int")
    assert rows(bitplanes.cluster(df, count, rounds)) == brute_clusters(vectors, count, rounds)


def test_clusters_of_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert bitplanes.cluster(spark.createDataFrame([], schema)).count() == 0
    assert bitplanes.cluster(spark.createDataFrame([(1, None), (2, [1.0])], schema)).count() == 0
    lone = bitplanes.cluster(spark.createDataFrame([(None, [1.0] * 64), (None, [2.0] * 64)], schema)).collect()
    assert [(r["cluster"], r["distance"]) for r in lone] == [(0, 64 * 128**2)] * 2
    with pytest.raises(Exception, match="no distance that fits"):
        bitplanes.cluster(spark.createDataFrame([(1, [1e30] * 64)], schema)).collect()


def test_clusters_of_the_table(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    assert rows(queries()["op11_clusters"](spark, sf)) == brute_clusters([tuple(r) for r in table], 40, 5)


# -- token counts ----------------------------------------------------------------------------

TEXTS = ["", None, "a", "<|endoftext|>", "a<|endoftext|>b <|endoftext|>", "it's  we'll\n\n 'tis", "日本 😀é\x00", " " * 500, "ab" * 20_000, "word, " * 60_000]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(BYTES)
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice("ab 'st\n1.é<|>\t") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    data = [(i if i % 7 else None, t, "x") for i, t in enumerate(texts)] + [((1 << 60) + 1, "big id", "x")]
    found = tokencount.count_tokens(spark.createDataFrame(data, "doc_id long, text string, n_tokens string"), BYTES, limit=20)
    want = []
    for doc_id, text, _ in data:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 20))
    assert rows(found) == sorted(want, key=str)
    assert tokencount.count_tokens(spark.createDataFrame([], "doc_id long, text string"), BYTES).count() == 0


def test_counts_of_pieces_and_forgotten_words(monkeypatch):
    monkeypatch.setattr(tokencount, "PIECE_CHARS", 3)
    monkeypatch.setattr(tokencount, "REMEMBERED", 2)
    known, library = tokencount.Counter(BYTES), Tokenizer.from_file(BYTES)
    for text in ["one  two three\n\n four ", "a b c d e f", "x  y", "   lead", "'s 's  's", "longwordwithoutspace next"]:
        assert known.count(text) == len(library.encode(text, add_special_tokens=False).ids), text
    assert len(known) <= 2


def test_counts_of_the_table(spark, sf):
    library = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = [(r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in docs]
    found = queries()["op12_token_counts"](spark, sf)
    assert rows(found.select("doc_id", "n_tokens")) == sorted(want, key=str)
    assert found.where("over_limit <> (n_tokens > 1024)").count() == 0


# -- conversations ---------------------------------------------------------------------------

WHITE = " \t\n\x0b\x0c\r"


def brute_damage(turns):
    out = []
    for conv, turn, role, text in turns:
        said = lambda v: " " if v is None else str(v)
        dealt = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        role, text = said(role), said(text)
        if dealt == 1:
            text = ""
        elif dealt == 2:
            text = "".join(c for c in text if c not in ".!?")
        elif dealt == 4:
            role = "user"
        out += [(conv, turn, role, text)] * {0: 0, 3: 2}.get(dealt, 1)
    return out


def brute_repair(turns):
    """Everything about one conversation of damaged (turn, role, text) rows."""
    turns = sorted(turns, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in turns:
        body = text.strip(WHITE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        faults.append(fault)
    initials = [r[1][:1] for r in turns]
    grow = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}  # by the last letter

    def add(cost, letter, turn, rest):
        return cost + rest[0], letter + rest[1], turn + rest[2]

    @functools.cache
    def with_inserts(i, last, inserts=2):
        options = [direct(i, last)]
        if inserts:
            for role in ("user", "assistant"):
                if (last, role[0]) in grow:
                    options.append(add(3, "I", ((role, ""),), with_inserts(i, role[0], inserts - 1)))
        return min(options)

    @functools.cache
    def direct(i, last):
        if i == len(turns):
            return (0, "", ()) if last in ("", "a") else (10**9, "", ())
        extra = 3 if faults[i] == "truncated" else 0
        options = [add(4, "D", (), with_inserts(i + 1, last))]
        if faults[i] not in ("blank", "duplicate"):
            if (last, initials[i]) in grow:
                options.append(add(extra, "K", ((turns[i][1], turns[i][2]),), with_inserts(i + 1, grow[last, initials[i]])))
            for role in ("user", "assistant"):
                if (last, role[0]) in grow:
                    options.append(add(3 + extra, "R", ((role, turns[i][2]),), with_inserts(i + 1, role[0])))
        return min(options)

    cost, audit, repaired = with_inserts(0, "")
    numbers = [r[0] for r in turns if r[0] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, digest


def brute(turns):
    held = {r[0]: [] for r in turns}
    for conv, *rest in brute_damage(turns):
        held[conv].append(tuple(rest))
    return sorted(((conv, *brute_repair(v)) for conv, v in held.items()), key=str)


def random_turns(seed, convs, longest):
    rng = random.Random(seed)
    out = []
    for conv in range(convs):
        turns = [None] * rng.randint(0, 2) + list(range(rng.randint(0, longest)))
        for turn in turns:
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "so", "What?\n", " \t", "", None, f"{turn} ok.", f"{turn} and", "é. "])
            out.append((conv if conv else None, turn, role, text))
            if rng.random() < 0.1:
                out.append(out[-1])
    return out


TURNS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("segment", [2048, 4])
def test_repair_equals_brute_force(spark, segment, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    turns = random_turns(segment, 60, 12)
    df = spark.createDataFrame([(*r, "clash", 7) for r in turns], TURNS + ", place string, segment int")
    assert rows(repair.damage_and_repair(df)) == brute(turns)


def test_repair_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SEGMENT", 64)
    monkeypatch.setattr(repair, "BATCH_TURNS", 100)
    turns = [r for r in random_turns(9, 3, 5) if r[0]] + [(77, t, ("user", "assistant")[(t + t // 9) % 2], f"turn {t % 150}" + ".?! "[t % 4]) for t in range(400)]
    assert rows(repair.damage_and_repair(spark.createDataFrame(turns, TURNS))) == brute(turns)


def test_repair_of_nothing(spark):
    assert repair.damage_and_repair(spark.createDataFrame([], TURNS)).count() == 0
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:1".encode()) % 20 == 0)
    found = rows(repair.damage_and_repair(spark.createDataFrame([(dropped, 1, "user", "x")], TURNS)))
    assert found == [(dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_repair_of_the_table(spark, sf):
    turns = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows(queries()["op13_repair"](spark, sf)) == brute(turns)


def test_repaired_turns_keep_the_pattern(spark):
    turns = random_turns(4, 20, 9)
    _, repaired = repair.repair(spark.createDataFrame(turns, TURNS))
    held = defaultdict(str)
    for r in repaired.collect():
        held[r["conv_id"]] += r["role"][0]
    assert held and all(h.lstrip("s") in ("ua" * k for k in range(1, 20)) and h.count("s") <= 1 for h in held.values())
