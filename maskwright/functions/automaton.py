"""Many terms found in one pass: an Aho-Corasick automaton over words, in flat arrays; a filter for more terms than that.

Terms are sequences of words. A word of a text that stands in no term leads back to the
start, so only runs of known words are walked, all runs of a batch in step with each other: in
each step every run takes one word along its edge, or falls back along failure links until it
can. Edges are one sorted array, searched by halves. A state lists all terms that end there.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import regex

#: a word is a run of letters, digits and the signs that occur inside names; signs at its end do not count
IN_WORD = regex.compile(r"[\p{L}\p{N}_#&.'-]")
ENDINGS = ".'-"
RUN = 256
NOT_IN_WORD, UNKNOWN = 0, 255

_kinds = np.full(0x110000, UNKNOWN, np.uint8)  # 0: not in a word, 1: in a word, 2: in a word, but not at its end


def _kind(codes: np.ndarray) -> np.ndarray:
    kinds = _kinds[codes]
    if (kinds == UNKNOWN).any():
        for c in np.unique(codes[kinds == UNKNOWN]).tolist():
            _kinds[c] = 2 if chr(c) in ENDINGS else 1 if IN_WORD.match(chr(c)) else NOT_IN_WORD
        kinds = _kinds[codes]
    return kinds


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of some texts: where they begin and end in all texts joined by a line end, and their hashes."""

    def __init__(self, texts: list[str]) -> None:
        self.whole = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.cumsum(lens) - lens
        kinds = _kind(self.codes)
        edge = np.flatnonzero(np.diff(np.concatenate([[False], kinds > 0, [False]]).astype(np.int8)))
        start, end = edge[::2].copy(), edge[1::2].copy()
        while True:  # signs at the end are left out, one after the other
            late = (end > start) & (kinds[np.maximum(end - 1, 0)] == 2)
            if not late.any():
                break
            end[late] -= 1
        kept = end > start
        self.start, self.end = start[kept], end[kept]
        self.owner = np.searchsorted(self.first, self.start, side="right") - 1

    def hashes(self) -> np.ndarray:
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, np.uint64)
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        spot = place.astype(np.uint64) << np.uint64(21) | self.codes[place + np.repeat(self.start, size)]
        return np.add.reduceat(_mix(spot * np.uint64(0x9E3779B97F4A7C15)), begin) + _mix(size.astype(np.uint64))

    def whole_hashes(self) -> np.ndarray:
        """A hash of all words of each text that has a word."""
        begin = np.flatnonzero(np.diff(self.owner, prepend=-1))
        if not len(begin):
            return np.zeros(0, np.uint64)
        size = np.diff(np.append(begin, len(self.owner)))
        place = np.arange(len(self.owner)) - np.repeat(begin, size)
        return np.add.reduceat(placed(self.hashes(), place), begin)

    def text(self, first: int, last: int) -> str:
        """Words from one to another as a term is compared: with one space between."""
        return " ".join(self.whole[a:b] for a, b in zip(self.start[first : last + 1].tolist(), self.end[first : last + 1].tolist(), strict=True))


def placed(hashes: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    """Hashes of words at places in a sequence; their sum is a hash of the sequence."""
    return _mix(hashes + np.asarray(place).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class TermFilter:
    """Tells of word sequences whether they may be terms: never wrongly no, seldom wrongly yes.

    ``BITS`` bits a term, up to ``MOST`` in all, of which a term sets ``PROBES``; with more terms more
    sequences pass that are none.
    """

    BITS, MOST, PROBES = 16, 1 << 28, 3

    def __init__(self, held: np.ndarray, lengths: tuple[int, ...]) -> None:
        self.held, self.lengths = held, lengths

    @classmethod
    def places_for(cls, terms: int) -> int:
        return min(cls.MOST, max(64, 1 << (cls.BITS * max(terms, 1) - 1).bit_length()))

    @classmethod
    def spots(cls, hashes: np.ndarray, places: int) -> np.ndarray:
        step = _mix(hashes) | np.uint64(1)
        return np.stack([(hashes + step * np.uint64(k)) & np.uint64(places - 1) for k in range(cls.PROBES)], axis=1)

    def passed(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """First and last word of the sequences that may be terms, by place."""
        hashes, n = words.hashes(), len(words.owner)
        first, last = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        whole = np.zeros(n, np.uint64)
        for size in range(1, min(max(self.lengths, default=0), n) + 1):
            whole = whole[: n - size + 1] + placed(hashes[size - 1 :], size - 1)
            if size in self.lengths:
                at = np.flatnonzero(words.owner[: n - size + 1] == words.owner[size - 1 :])
                for k in range(self.PROBES):  # most are gone after the first
                    spot = self.spots(whole[at], len(self.held) << 6)[:, k]
                    at = at[(self.held[spot >> np.uint64(6)] >> (spot & np.uint64(63)) & np.uint64(1)).astype(bool)]
                first.append(at)
                last.append(at + size - 1)
        begin, end = np.concatenate(first), np.concatenate(last)
        order = np.lexsort((end, begin))
        return begin[order], end[order]


class Automaton:
    """Finds terms; each is given with its label."""

    def __init__(self, terms: Iterable[tuple[str, str]]) -> None:
        told = sorted(set(terms))
        words = Words([t for t, _ in told])
        hashes = words.hashes()
        self.known = np.unique(hashes)
        numbers = (np.searchsorted(self.known, hashes) + 1).tolist()
        cuts = np.searchsorted(words.owner, np.arange(len(told) + 1)).tolist()
        children: list[dict[int, int]] = [{}]
        depth, ends = [0], [[]]
        self.terms: list[tuple[str, str]] = []
        seen = set()
        for k, (_, label) in enumerate(told):
            state = 0
            for w in numbers[cuts[k] : cuts[k + 1]]:
                after = children[state].get(w)
                if after is None:
                    after = children[state][w] = len(children)
                    children.append({})
                    depth.append(depth[state] + 1)
                    ends.append([])
                state = after
            if state and (state, label) not in seen:
                seen.add((state, label))
                ends[state].append(len(self.terms))
                self.terms.append((words.text(cuts[k], cuts[k + 1] - 1), label))
        self.longest = max(depth)
        fail, queue = [0] * len(children), list(children[0].values())
        for state in queue:  # grows while it is walked: by depth
            for w, after in children[state].items():
                back = fail[state]
                while back and w not in children[back]:
                    back = fail[back]
                fail[after] = children[back].get(w, 0)
                ends[after] = ends[after] + ends[fail[after]]
                queue.append(after)
        edges = sorted((s << 32 | w, after) for s, held in enumerate(children) for w, after in held.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.after = np.array([a for _, a in edges], np.int64)
        self.fail = np.array(fail, np.int64)
        counts = np.array([len(e) for e in ends], np.int64)
        self.ends_at = np.concatenate([[0], np.cumsum(counts)])
        self.ends = np.array([t for e in ends for t in e], np.int64)
        self.sizes = np.array([t.count(" ") + 1 for t, _ in self.terms], np.int64)

    def _walk(self, numbers: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The state after each word of runs of known words."""
        states = np.zeros(len(numbers), np.int64)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        now = np.zeros(len(begin), np.int64)
        for step in range(int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -step, side="left"))
            now = now[:live]
            word = numbers[begin[:live] + step]
            todo = np.arange(live)
            while len(todo):
                key = now[todo] << 32 | word[todo]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                hit = self.keys[at] == key
                now[todo[hit]] = self.after[at[hit]]
                todo = todo[~hit]
                top = now[todo] == 0
                now[todo] = self.fail[now[todo]]
                todo = todo[~top]
            states[begin[:live] + step] = now
        return states

    def find(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start, end and term of every occurrence, also of those that overlap; by text and start."""
        none = np.zeros(0, np.int64)
        if not self.terms:
            return none, none, none, none
        words = Words(texts)
        hashes = words.hashes()
        place = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        numbers = np.where(self.known[place] == hashes, place + 1, 0)
        at = np.flatnonzero(numbers)
        fresh = np.ones(len(at), bool)
        fresh[1:] = (np.diff(at) != 1) | (words.owner[at[1:]] != words.owner[at[:-1]])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(at)))
        # long runs are cut; a part begins with the words that a term across the cut may have before it
        parts = np.maximum(1, -(-size // RUN))
        run = np.repeat(np.arange(len(first)), parts)
        number = np.arange(len(run)) - np.repeat(np.cumsum(parts) - parts, parts)
        lead = np.minimum(number * RUN, self.longest - 1)
        begin = first[run] + number * RUN - lead
        until = np.minimum(first[run] + (number + 1) * RUN, first[run] + size[run])
        flat = np.repeat(begin, until - begin) + np.arange(int((until - begin).sum())) - np.repeat(np.cumsum(until - begin) - (until - begin), until - begin)
        spot = np.cumsum(until - begin) - (until - begin)
        states = self._walk(numbers[at[flat]], spot, until - begin)
        own = np.arange(len(flat)) - np.repeat(spot, until - begin) >= np.repeat(lead, until - begin)
        state, last = states[own], at[flat[own]]
        count = self.ends_at[state + 1] - self.ends_at[state]
        last = np.repeat(last, count)
        term = self.ends[np.repeat(self.ends_at[state], count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)]
        begin_word = last - self.sizes[term] + 1
        # words were compared by hash; here the few that are left are compared as they are
        same = np.fromiter((words.text(a, b) == self.terms[t][0] for a, b, t in zip(begin_word.tolist(), last.tolist(), term.tolist(), strict=True)), bool, len(term))
        begin_word, last, term = begin_word[same], last[same], term[same]
        owner = words.owner[begin_word]
        start, end = words.start[begin_word] - words.first[owner], words.end[last] - words.first[owner]
        order = np.lexsort((term, end, start, owner))
        return owner[order], start[order], end[order], term[order]
