"""Linear tagging of word sequences: hashed features, batched Viterbi decoding, perceptron updates.

A label is outside, or the begin or inside of an entity type. Words of many sentences lie in
flat arrays; in a step of decoding each sentence of the batch takes one word.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from maskwright.functions.automaton import Words, _mix

BUCKETS = 1 << 16
LONGEST = 100
FORBIDDEN = -1e9
BATCH = 32

_lower = np.zeros(0x110000, np.uint32)
_shape = np.zeros(0x110000, np.uint8)  # 1 capital, 2 other letter, 3 digit, 4 anything else; 0 not looked up yet


def _look_up(codes: np.ndarray) -> None:
    for c in np.unique(codes[_shape[codes] == 0]).tolist():
        ch = chr(c)
        small = ch.lower()
        _lower[c] = ord(small) if len(small) == 1 else c
        _shape[c] = 1 if ch.isupper() else 2 if ch.isalpha() else 3 if ch.isdigit() else 4


class Sentences:
    """Words of texts cut into sentences of at most ``LONGEST`` words, and the features of each word."""

    def __init__(self, texts: list[str]) -> None:
        words = self.words = Words(texts)
        n = len(words.start)
        codes = words.codes
        _look_up(codes)
        # the last sign between a word and the one before it, and whether a sentence ends there
        sign = codes[np.maximum(words.start - 1, 0)].astype(np.int64)
        two = codes[np.maximum(words.start - 2, 0)].astype(np.int64)
        before = np.where(sign == 32, two, sign) * (words.start > words.first[words.owner] if n else True)
        ended = np.isin(before, [10, 33, 46, 63])
        fresh = np.ones(n, bool)
        fresh[1:] = ended[1:] | (words.owner[1:] != words.owner[:-1])
        begin = np.flatnonzero(fresh)
        size = np.diff(np.append(begin, n))
        place = np.arange(n) - np.repeat(begin, size)
        self.begin = np.flatnonzero(place % LONGEST == 0)
        self.size = np.diff(np.append(self.begin, n))
        self.features = self._features(before, np.repeat(np.arange(len(self.begin)), self.size))

    def _features(self, before: np.ndarray, sentence: np.ndarray) -> np.ndarray:
        words = self.words
        n = len(words.start)
        if not n:
            return np.zeros((0, 1), np.int64)
        small, shape = _lower[words.codes].astype(np.uint64), _shape[words.codes].astype(np.uint64)
        size = words.end - words.start
        at = np.cumsum(size) - size
        inside = np.arange(int(size.sum())) - np.repeat(at, size)
        flat = inside + np.repeat(words.start, size)
        word = np.add.reduceat(_mix(inside.astype(np.uint64) << np.uint64(21) | small[flat]), at)
        last = words.end - 1
        head = shape[words.start] * np.uint64(1024)
        form = head + np.bitwise_or.reduceat(np.uint64(1) << shape[flat], at) * np.uint64(8) + np.minimum(size, 7).astype(np.uint64)
        kind = head + np.bitwise_or.reduceat(np.uint64(1) << shape[flat], at)
        end3 = _mix(small[last] + (small[np.maximum(last - 1, words.start)] << np.uint64(21)) + (small[np.maximum(last - 2, words.start)] << np.uint64(42)))
        start3 = _mix(small[words.start] + (small[np.minimum(words.start + 1, last)] << np.uint64(21)) + (small[np.minimum(words.start + 2, last)] << np.uint64(42)))

        def near(values: np.ndarray, by: int) -> np.ndarray:
            out = np.zeros(n, np.uint64)
            here = np.arange(max(0, -by), min(n, n - by))
            same = sentence[here] == sentence[here + by]
            out[here[same]] = values[here[same] + by] + np.uint64(1)
            return out

        sign = before.astype(np.uint64)
        prev, next_ = near(word, -1), near(word, 1)
        kind_before, kind_after = near(kind, -1), near(kind, 1)
        columns = [
            word, form, end3, start3, prev, next_, near(word, -2), near(word, 2), sign * np.uint64(8192) + kind,
            prev ^ kind, next_ ^ kind, kind_before * np.uint64(1 << 20) + kind, (kind_before << np.uint64(40)) + (kind << np.uint64(20)) + kind_after,
            near(sign, 1) * np.uint64(8192) + kind, np.zeros(n, np.uint64),
        ]
        seeds = [np.uint64((k * 0x1000193 + 1) * 0x9E3779B97F4A7C15 % (1 << 64)) for k in range(len(columns))]
        return np.stack([(_mix(c + s) % np.uint64(BUCKETS)).astype(np.int64) for c, s in zip(columns, seeds, strict=True)], axis=1)


@dataclass
class Model:
    """Weights of features by label, and of a label after another (the last row: at the start)."""

    types: tuple[str, ...]
    emit: np.ndarray
    move: np.ndarray

    @classmethod
    def blank(cls, types: tuple[str, ...]) -> Model:
        labels = 1 + 2 * len(types)
        return cls(types, np.zeros((BUCKETS, labels), np.float32), np.zeros((labels + 1, labels), np.float32))


def allowed(labels: int) -> np.ndarray:
    """0, or a forbidding score: the inside of a type (even numbers from 2) follows its begin or inside alone."""
    out = np.zeros((labels + 1, labels), np.float32)
    for inside in range(2, labels, 2):
        out[:, inside] = FORBIDDEN
        out[[inside - 1, inside], inside] = 0
    return out


def viterbi(scores: np.ndarray, move: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The best label of every word; ``begin`` and ``size`` tell the sentences."""
    best = np.zeros(len(scores), np.int64)
    back = np.zeros(scores.shape, np.int8)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    reach = scores[begin] + move[-1]
    ends = np.zeros((len(begin), scores.shape[1]), np.float32)
    ends[size == 1] = reach[size == 1]
    for step in range(1, int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step, side="left"))
        paths = reach[:live, :, None] + move[None, :-1, :]
        at = begin[:live] + step
        back[at] = paths.argmax(axis=1)
        reach = paths.max(axis=1) + scores[at]
        done = size[:live] == step + 1
        ends[:live][done] = reach[done]
    label = ends.argmax(axis=1)
    for step in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
        live = int(np.searchsorted(-size, -step, side="left"))
        at = begin[:live] + step
        best[at] = label[:live]
        label[:live] = back[at, label[:live]]
    return best


def decode(model: Model, features: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    return viterbi(model.emit[features].sum(axis=1), model.move + allowed(model.emit.shape[1]), begin, size)


def labels_of(sentences: Sentences, spans: list[list[tuple[int, int, str]]], types: tuple[str, ...]) -> np.ndarray:
    """The label of every word by the spans (start, end, type) of each text."""
    words = sentences.words
    out = np.zeros(len(words.start), np.int64)
    for k, found in enumerate(spans):
        for start, end, kind in found:
            here = np.flatnonzero((words.owner == k) & (words.start >= words.first[k] + start) & (words.end <= words.first[k] + end)) if kind in types else ()
            if len(here):
                out[here] = 2 + 2 * types.index(kind)
                out[here[0]] -= 1
    # a sentence that begins within a span begins with a begin
    inside = (out[sentences.begin] > 0) & (out[sentences.begin] % 2 == 0)
    out[sentences.begin[inside]] -= 1
    return out


def spans_of(sentences: Sentences, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start, end and number of the type of every entity that the labels tell."""
    words = sentences.words
    first = np.flatnonzero(labels % 2 == 1)
    more = np.concatenate([(labels[1:] > 0) & (labels[1:] % 2 == 0), [False]]) if len(labels) else np.zeros(0, bool)
    last_of = np.flatnonzero((labels > 0) & ~more)
    last = last_of[np.searchsorted(last_of, first)]
    owner = words.owner[first]
    return owner, words.start[first] - words.first[owner], words.end[last] - words.first[owner], labels[first] // 2


def train_pass(model: Model, features: np.ndarray, labels: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[Model, Model]:
    """Weights after one pass over the sentences, in small batches, and their average over the pass."""
    emit, move = model.emit.copy(), model.move.copy()
    late_emit, late_move, count = np.zeros_like(emit, np.float64), np.zeros_like(move, np.float64), 0
    now = Model(model.types, emit, move)
    for a in range(0, len(begin), BATCH):
        b, n = begin[a : a + BATCH], size[a : a + BATCH]
        at = np.repeat(b - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        starts = np.cumsum(n) - n
        told, said = labels[at], decode(now, features[at], starts, n)
        wrong = np.flatnonzero(told != said)
        if len(wrong):
            rows, width = features[at[wrong]], features.shape[1]
            before = lambda x: np.where(np.isin(np.arange(len(x)), starts), -1, np.concatenate([[-1], x[:-1]]))
            for label, sign in ((told, 1.0), (said, -1.0)):
                np.add.at(emit, (rows.ravel(), np.repeat(label[wrong], width)), np.float32(sign))
                np.add.at(late_emit, (rows.ravel(), np.repeat(label[wrong], width)), sign * count)
                np.add.at(move, (before(label), label), np.float32(sign))
                np.add.at(late_move, (before(label), label), sign * count)
        count += 1
    share = max(count, 1)
    return now, Model(model.types, (emit - late_emit / share).astype(np.float32), (move - late_move / share).astype(np.float32))
