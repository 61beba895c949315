"""Token counts by heap-and-linked-list byte-pair merging.

A word starts as a doubly linked list of byte symbols, with a heap of the ranks of its
adjacent pairs. The pair of lowest rank, of equal ones the leftmost, is popped and merged,
and the pairs this makes with both neighbours are pushed; an entry whose pair is no longer
there is passed over. The word has as many tokens as it had symbols, less the merges. No
token ids are made. A worker remembers the counts of the words it met, so most words are
looked up.

Long texts are cut where white space follows something else, as the tokenizer's pattern never
reaches across such a place; so a worker holds one piece of ``PIECE_CHARS`` characters, and
for its longest word some 60 bytes per byte of it.

Results in special cases: a null text is empty, and an empty one has no bytes and no tokens;
a special token's string in a text counts as one token, as the library has it; rows with the
same id, or none, are counted each for itself; an empty table gives an empty result; other
columns are ignored; texts and words may have any length.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.bpe import byte_letters

#: how the byte-level tokenizer cuts text into words; a fixed value
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: the letters, numbers and white space among the first 256 characters, for the same cut by a faster pattern
LETTERS, NUMBERS, BLANKS = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
LATIN = (
    rf" ?[{LETTERS}]+| ?[{NUMBERS}]+|'(?:[stmd]|re|ve|ll)| ?[^{BLANKS}{LETTERS}{NUMBERS}]+|[{BLANKS}]+(?![^{BLANKS}])|[{BLANKS}]+"
)
PIECE_CHARS = 200_000
REMEMBERED = 400_000
LONG_WORD = 64
COMPACT = 4096

_SEAM = regex.compile(r"\S(?=\s)")


class Counter(dict):
    """Tokens of words by a byte-level ``tokenizer.json``; remembers the words it has met."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["normalizer"] or spec["model"].get("end_of_word_suffix"):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        vocab = spec["model"]["vocab"]
        pairs = [p.split(" ") if isinstance(p, str) else p for p in spec["model"]["merges"]]
        self.width = max(vocab.values()) + 1
        self.leaf = [vocab[c] for c in byte_letters()]
        self.rank = {vocab[a] * self.width + vocab[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        self.words, self.latin = regex.compile(PATTERN), re.compile(LATIN)
        self.before: dict[str, int] = {}
        marks = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.marks = regex.compile("|".join(map(regex.escape, marks))) if marks else None

    def __missing__(self, word: str) -> int:
        count = self.before.get(word)
        if count is None:
            body = word.encode()
            count = len(body) - self.merges(body)
        if len(word) <= LONG_WORD:
            if len(self) >= REMEMBERED:  # what is not asked for again is forgotten
                self.before = dict(self)
                self.clear()
            self[word] = count
        return count

    def merges(self, word: bytes) -> int:
        """How often two neighbouring symbols are merged until no pair has a rank."""
        n = len(word)
        leaf, rank, made, width = self.leaf, self.rank.get, self.made, self.width
        symbol, before, after = [leaf[b] for b in word], range(-1, n - 1), range(1, n + 1)
        if n > COMPACT:
            symbol, before, after = array("q", symbol), array("q", before), array("q", after)
        else:
            before, after = [*before], [*after]
        found = map(rank, (a * width + b for a, b in pairwise(symbol)))
        heap = [r * n + i for i, r in enumerate(found) if r is not None]
        heapify(heap)
        done = 0
        while heap:
            r, i = divmod(heappop(heap), n)
            j, own = after[i], symbol[i]
            if own < 0 or j == n or rank(own * width + symbol[j]) != r:
                continue
            k, h, own = after[j], before[i], made[r]
            symbol[i], symbol[j], after[i] = own, -1, k
            done += 1
            if k < n:
                before[k] = i
                r = rank(own * width + symbol[k])
                if r is not None:
                    heappush(heap, r * n + i)
            if h >= 0:
                r = rank(symbol[h] * width + own)
                if r is not None:
                    heappush(heap, r * n + h)
        return done

    def plain(self, text: str, begin: int, end: int) -> int:
        """Tokens of a stretch of text without special tokens."""
        total = 0
        while begin < end:
            seam = _SEAM.search(text, begin + PIECE_CHARS, end) if end - begin > PIECE_CHARS else None
            stop = seam.end() if seam else end
            piece = text[begin:stop]
            pattern = self.latin if piece.isascii() or max(piece) < "\u0100" else self.words
            total += sum(map(self.__getitem__, pattern.findall(piece)))
            begin = stop
        return total

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        total, begin = 0, 0
        if self.marks:
            for mark in self.marks.finditer(text):
                total += self.plain(text, begin, mark.start()) + 1
                begin = mark.end()
        return total + self.plain(text, begin, len(text))


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """The counter of this Python worker."""
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of every row.

    ``path`` is the ``tokenizer.json`` on every worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            texts = batch.column("text")
            counts = pa.array([known.count(t.as_py()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), counts], ["doc_id", "n_bytes", "n_tokens"])

    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("text"))
    done = rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long")
    return done.withColumn("over_limit", F.col("n_tokens") > limit)
