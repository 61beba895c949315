"""Quality classifier from weak labels.

Overlapping heuristic labellers vote low quality on a document, or don't vote. The counts
of all vote patterns (at most 2 to the number of labellers rows) are gathered by
Spark, and expectation-maximisation over them estimates how often each labeller votes how
for either class, without any true label. The posteriors of a bounded sample of documents
train a linear scorer over hashed runs of character classes and shares of repeated words;
it then scores every document.

Results in special cases: a null text, or one without a word, scores 0 and is rejected;
an empty table gives an empty result; if no document is likely to be low, all that have
words are kept; repeated rows count and are scored like others; a text of any length is looked at
whole, with some 60 bytes of memory a character; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import map_texts, row_digest, staged, without, word_hashes

BUCKETS = 1 << 11
RUN = 4
SAMPLE = 12_000
PRIOR_WORDS = 10
PRIOR_CHARS = 60
THRESHOLD = 0.25
LOWER, UPPER, DIGIT, BLANK, LINE = 1, 2, 3, 4, 5

_held: dict[str, np.ndarray] = {}

#: name of a share of the document, and above which value a labeller votes low; else it has no vote
LABELLERS = (
    ("repeated", 0.12),  # words equal to the word before
    ("same", 0.80),  # words met before in the document, in excess of what its length explains
    ("marked", 0.20),  # words that end in two or more signs
    ("signs", 0.12),  # signs among the characters that are no space
    ("capitals", 0.40),  # capitals among the letters
    ("lone", 0.12),  # words that are a single sign
    ("bare", 0.90),  # words of four or more letters or none, where function words are missing
)


def _classes(codes: np.ndarray) -> np.ndarray:
    """A small number per character: kind of letter, digit, blank, line end, or the sign itself."""
    if "kind" not in _held:
        _held["kind"] = np.zeros(0x110000, np.uint8)
    table = _held["kind"]
    out = table[codes]
    if not out.all():
        for c in np.unique(codes[out == 0]).tolist():
            ch = chr(c)
            kinds = (ch == "\n", LINE), (ch.isspace(), BLANK), (ch.isupper(), UPPER), (ch.isalpha(), LOWER), (ch.isdigit(), DIGIT)
            table[c] = next((k for ok, k in kinds if ok), 6 + c % 90)
        out = table[codes]
    return out


class Batch:
    """Characters, words and shares of some texts."""

    def __init__(self, texts: list[str]) -> None:
        self.n = len(texts)
        whole = "".join(t + "\n" for t in texts)
        lens = np.fromiter(map(len, texts), np.int64, self.n) + 1
        self.codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        self.kind = _classes(self.codes)
        self.bounds = np.concatenate([[0], np.cumsum(lens)])
        self.doc = np.repeat(np.arange(self.n), lens)
        gap = (self.kind == BLANK) | (self.kind == LINE)
        edge = np.flatnonzero(np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8)))
        self.start, self.end = edge[::2], edge[1::2]
        self.owner = self.doc[self.start]
        self.words = np.bincount(self.owner, minlength=self.n)

    def per_doc(self, mask: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.bincount(of[mask], minlength=self.n)

    def shares(self) -> dict[str, np.ndarray]:
        """What the labellers look at, from 0 to 1."""
        word = word_hashes(self.codes, self.start, self.end)
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (self.owner[1:] == self.owner[:-1])
        named = word ^ self.owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        code, distinct = pd.factorize(named)
        first = np.zeros(len(word), bool)
        at = np.empty(len(distinct), np.int64)
        at[code[::-1]] = np.arange(len(code))[::-1]
        first[at] = True
        sign = self.kind > LINE
        last, before = sign[self.end - 1], sign[np.maximum(self.end - 2, self.start)]
        long = self.end - self.start > 1
        letters = (self.kind == LOWER) | (self.kind == UPPER)
        # a few ordinary words are counted in, so that short texts have no extreme shares
        words = self.words + PRIOR_WORDS
        filled = self.per_doc((self.kind != BLANK) & (self.kind != LINE), self.doc) + PRIOR_CHARS
        fresh = self.per_doc(first, self.owner) / np.maximum(self.words, 1)
        return {
            "repeated": self.per_doc(again, self.owner) / words,
            "marked": self.per_doc(last & before & long, self.owner) / words,
            "signs": self.per_doc(sign, self.doc) / filled,
            "capitals": self.per_doc(self.kind == UPPER, self.doc) / (self.per_doc(letters, self.doc) + PRIOR_CHARS),
            "lone": self.per_doc(last & ~long, self.owner) / words,
            # the share of new words falls with the logarithm of the length in ordinary text
            "same": np.clip(1 - fresh * (np.log10(np.maximum(words, 100)) - 1), 0, 1) * (words >= 30),
            "bare": self.per_doc(self._letters(letters) > 3, self.owner) / np.maximum(self.per_doc(self._letters(letters) > 0, self.owner), 1) * (words >= 10),
        }

    def _letters(self, letters: np.ndarray) -> np.ndarray:
        """Letters of each word."""
        seen = np.concatenate([[0], np.cumsum(letters)])
        return seen[self.end] - seen[self.start]

    def votes(self) -> np.ndarray:
        """1 for low, 0 for no vote; a row per text."""
        shares = self.shares()
        return np.stack([(shares[k] > high).astype(np.int8) for k, high in LABELLERS], axis=1)

    def features(self) -> np.ndarray:
        """Shares of hashed runs of character classes, and of repeated words; a row per text."""
        h = np.zeros(len(self.kind), np.uint32)
        for k in range(RUN):
            end = max(len(h) - k, 0)
            h[:end] = h[:end] * np.uint32(0x01000193) + self.kind[k:]
        bucket = (h * np.uint32(0x9E3779B1)) >> np.uint32(21)
        cell = self.doc * BUCKETS + bucket
        counts = np.bincount(cell, minlength=self.n * BUCKETS).reshape(self.n, BUCKETS).astype(np.float32)
        counts /= (np.diff(self.bounds) + PRIOR_CHARS)[:, None]
        shares = self.shares()
        return np.hstack([np.sqrt(counts), np.stack([shares[k] for k, _ in LABELLERS], axis=1).astype(np.float32)])


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), row_digest(docs, text).alias("text_hash"), body.alias("text"))


def vote(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash and votes of every document that has a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = Batch(batch.pop("text").tolist())
            ok = part.words > 0
            if ok.any():
                yield batch[ok].assign(votes=list(part.votes()[ok].astype(np.int32)))

    return map_texts(_texts(docs, text, doc_id), run, "doc_id long, text_hash long, votes array<int>")


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """Share of low documents and P(vote | class) of each labeller, by expectation-maximisation.

    ``patterns`` has a row of votes each, ``counts`` how many documents voted so. The result
    has the axes class (good, low), labeller, vote (0, 1).
    """
    onehot = np.stack([patterns == v for v in (0, 1)], axis=2).astype(float)
    low = np.where(patterns.any(axis=1), 0.9, 0.02)  # to begin with, any vote counts
    for _ in range(rounds):
        weight = np.stack([counts * (1 - low), counts * low])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        table = np.einsum("cp,plv->clv", weight, onehot) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        new = posterior(patterns, prior, table)
        done = np.abs(new - low).max() < 1e-6
        low = new
        if done:
            break
    return float(prior), table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    """P(low | votes) of each row."""
    at = np.arange(patterns.shape[1])
    logs = [np.log(p) + np.log(table[c, at, patterns]).sum(axis=1) for c, p in ((0, 1 - prior), (1, prior))]
    return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))


def fit(rows: np.ndarray | list[np.ndarray], low: np.ndarray, steps: int = 400, rate: float = 0.5, ridge: float = 1e-4) -> np.ndarray:
    """Weights (bias last) of a logistic scorer of P(low), by full gradient steps with momentum.

    Rows that come in a list of parts are taken out of it as they are copied.
    """
    parts = rows if isinstance(rows, list) else [rows]
    x = np.empty((len(low), parts[0].shape[1] + 1), np.float32)
    x[:, -1] = 1
    end = len(x)
    while parts:
        part = parts.pop()
        x[end - len(part) : end, :-1] = part
        end -= len(part)
    del part
    mean, square = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for a in range(0, len(x), 1000):  # x.std() would copy all
        part = x[a : a + 1000].astype(float)
        mean += part.sum(axis=0) / len(x)
        square += np.multiply(part, part, out=part).sum(axis=0) / len(x)
        del part
    scale = np.maximum(np.sqrt(np.maximum(square - mean * mean, 0)), 1e-3).astype(np.float32)
    scale[-1] = 1
    x /= scale
    w, speed = np.zeros(x.shape[1], np.float32), np.zeros(x.shape[1], np.float32)
    # each class weighs the same
    share = low.mean().clip(1e-6, 1 - 1e-6)
    weight = (low * 0.5 / share + (1 - low) * 0.5 / (1 - share)).astype(np.float32)
    rate /= np.sqrt(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ ((p - low) * weight).astype(np.float32) / len(x) + ridge * w
        speed = 0.9 * speed - rate * grad
        w += speed
    return w / scale


def learn(docs: DataFrame, sample: int = SAMPLE, text: str = "text", doc_id: str = "doc_id") -> np.ndarray | None:
    """Weights of the scorer; the labellers' estimate sees all documents, the scorer at most about ``sample``."""
    voted = staged(vote(docs, text, doc_id), "votes")
    seen = voted.groupBy("votes").count().collect()  # at most 2 ** len(LABELLERS) rows
    if not seen:
        return None
    patterns, counts = np.array([r["votes"] for r in seen]), np.array([r["count"] for r in seen], float)
    prior, table = estimate(patterns, counts)
    likely = posterior(patterns, prior, table)
    if (counts * likely).sum() < 0.5:
        return None
    low_of = {tuple(p): float(q) for p, q in zip(patterns.tolist(), likely, strict=True)}
    share = min(1.0, sample / counts.sum())
    bound = int((share - 0.5) * (1 << 64) * 0.999999)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = Batch(batch.pop("text").tolist())
            ok = np.flatnonzero(part.words > 0)
            if len(ok):
                rows, votes = part.features().astype(np.float16), part.votes()
                yield batch.iloc[ok].assign(row=[rows[i].tobytes() for i in ok], low=[low_of[tuple(votes[i].tolist())] for i in ok])

    def teach(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, low = [], []
        for batch in batches:
            low.append(batch["low"].to_numpy(np.float32))
            rows.append(np.frombuffer(b"".join(batch["row"]), np.float16).reshape(len(batch), -1))
            del batch
        if rows:
            yield pd.DataFrame({"weights": [fit(rows, np.concatenate(low)).tobytes()]})

    picked = _texts(docs, text, doc_id)
    if share < 1:
        picked = picked.where(F.xxhash64("doc_id", "text_hash") < bound)
    # at most 2 * sample rows of 4 kB, so one task can hold them; the driver gets the weights alone
    taught = map_texts(picked, run, "doc_id long, text_hash long, row binary, low double").limit(2 * sample)
    ordered = taught.coalesce(1).sortWithinPartitions("doc_id", "text_hash", "row")
    learnt = ordered.mapInPandas(teach, "weights binary").collect()
    return np.frombuffer(learnt[0]["weights"], np.float32) if learnt else None


def score(docs: DataFrame, weights: np.ndarray | None, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, text_hash, score (P(good)) and keep of every document."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            part = Batch(batch.pop("text").tolist())
            good = np.ones(part.n)
            if weights is not None:
                x = part.features() @ weights[:-1] + weights[-1]
                good = 1 / (1 + np.exp(np.clip(x.astype(float), -50, 50)))
            good[part.words == 0] = 0.0
            yield batch.assign(score=good, keep=good >= threshold)

    return map_texts(_texts(docs, text, doc_id), run, "doc_id long, text_hash long, score double, keep boolean")


def classify(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return score(docs, learn(docs), threshold)


def keep_good(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose quality is not rejected, as they are."""
    return without(docs, staged(classify(docs, threshold).where(~F.col("keep")), "rejected"))
