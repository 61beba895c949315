"""Byte-pair encoding of whole tables of texts, by batched numpy merge rounds.

Texts of a batch are one flat array of code points. Class changes (letter, number, white
space, other) cut it into words; words are told apart by a 64-bit rolling hash, and only
words not met before are encoded: their symbols lie in one flat array, and in each round the
pair of lowest rank of every word is merged in all words at once; ranks are looked up in hash
tables, and again only for the pairs that a merge has changed. The words met are kept sorted by hash. Texts that a plain cut can't decide (those with
apostrophes) are cut by the tokenizer's own pattern.

``encode_table`` and ``decode_table`` apply this to tables; ids are binary, as little-endian
unsigned 32-bit integers. Results in special cases: null and empty texts have no tokens; strings of special tokens
in a text become those tokens, as the tokenizers library has it; repeated rows are encoded each for
itself; an empty table gives an empty result; other columns are ignored; a text of any length is encoded whole,
in one piece, with some 100 bytes of memory a character.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from maskwright.llm.common import BASE, map_texts, plain_rows, word_hashes

LETTER, NUMBER, SPACE, OTHER, UNKNOWN = 0, 1, 2, 3, 255
CACHE_WORDS = 500_000
TABLE_BITS = 20
ENDS = "'s|'t|'re|'ve|'m|'ll|'d"


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    names = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class Encoder:
    """Encodes and decodes by a byte-level ``tokenizer.json``; one per Python worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        suffix = model.get("end_of_word_suffix") or ""
        self.joined = spec["pre_tokenizer"]["type"] == "ByteLevel"  # a space belongs to the word after it
        self.lower = spec["normalizer"] is not None
        self.pattern = regex.compile(rf"{ENDS}| ?\p{{L}}+| ?\p{{N}}+| ?[^\s\p{{L}}\p{{N}}]+|\s+(?!\S)|\s+")
        letters = byte_letters()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + suffix] for c in letters], np.int64)
        width = max(vocab.values()) + 1
        pairs = [p.split(" ") if isinstance(p, str) else p for p in model["merges"]]
        keys = np.array([vocab[a] * width + vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        self.width, self.keys, self.made = width, keys, made
        self.tables = self._pair_tables()
        # where a merge makes a symbol that also takes part in an earlier merge, occurrences go one by one
        earliest = np.full(width, len(pairs), np.int64)
        for side in (0, 1):
            np.minimum.at(earliest, np.array([vocab[p[side]] for p in pairs], np.int64), np.arange(len(pairs)))
        self.single = earliest[made] <= np.arange(len(pairs))
        place = {c: b for b, c in enumerate(letters)}
        end = len(suffix)
        self.bytes = {i: bytes(place[c] for c in (t[:-end] if end and t.endswith(suffix) else t)) for t, i in vocab.items()}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.piece_at = np.zeros(max(self.bytes) + 2, np.int64)
        lens = np.zeros(max(self.bytes) + 1, np.int64)
        for i, b in self.bytes.items():
            lens[i] = len(b)
        np.cumsum(lens, out=self.piece_at[1:])
        self.piece_bytes = np.frombuffer(b"".join(self.bytes.get(i, b"") for i in range(len(lens))), np.uint8)
        self.classes = np.full(0x110000, UNKNOWN, np.uint8)
        self.forget()

    def _pair_tables(self) -> list[tuple[int, np.ndarray]]:
        """Tables of ranks by some bits of a hash of the pair; where several pairs meet, all but one are in a later table."""
        left, out, bits = np.arange(len(self.keys)), [], TABLE_BITS
        while len(left):
            multiplier = pow(BASE, len(out) + 1, 1 << 64)
            spot = self._spot(self.keys[left], multiplier, bits)
            ranks = np.zeros(1 << bits, np.int32)
            ranks[spot] = left
            out.append((multiplier, ranks))
            left, bits = left[ranks[spot] != left], max(bits - 4, 12)
        return out

    @staticmethod
    def _spot(keys: np.ndarray, multiplier: int, bits: int) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(multiplier)) >> np.uint64(64 - bits)

    def forget(self) -> None:
        self.known, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # word hashes, sorted, and their places in starts
        self.starts, self.pool, self.size = [np.zeros(1, np.int64)], [], 0
        self._flat: tuple[np.ndarray, np.ndarray] | None = None

    # -- words ---------------------------------------------------------------------------

    def _class(self, codes: np.ndarray) -> np.ndarray:
        cls = self.classes[codes]
        if (cls == UNKNOWN).any():
            for c in np.unique(codes[cls == UNKNOWN]).tolist():
                ch = chr(c)
                self.classes[c] = self._kind(ch)
            cls = self.classes[codes]
        return cls

    def _kind(self, ch: str) -> int:
        """The class of a character, asked of the library's own cutter where words end at spaces."""
        if self.joined:
            kinds = (SPACE, r"\s"), (LETTER, r"\p{L}"), (NUMBER, r"\p{N}")
            return next((k for k, p in kinds if regex.match(p, ch)), OTHER)
        pieces = lambda t: len(self.library.pre_tokenizer.pre_tokenize_str(t))
        if not pieces(ch):
            return SPACE
        return LETTER if pieces("a" + ch) == 1 else OTHER if pieces("!" + ch) == 1 else NUMBER

    def _normal(self, text: str) -> str:
        if not self.lower:
            return text
        try:
            text.encode("latin-1")  # composed as it is, and lowered one by one
        except UnicodeEncodeError:
            return self.library.normalizer.normalize_str(text)
        return text.lower()

    def _cuts(self, codes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of words in the flat text; ``bounds`` are where texts begin and end."""
        n = len(codes)
        cls = self._class(codes)
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = cls[1:] != cls[:-1]
        edges = bounds[bounds < n]
        if self.joined:
            last = np.zeros(n, bool)  # last character of a run of white space that is followed by a word
            last[:-1] = (cls[:-1] == SPACE) & (cls[1:] != SPACE)
            inner = edges[edges > 0] - 1
            last[inner] = False
            new[edges] = True
            glue = last & (codes == 32)
            new[1:][glue[:-1]] = False  # the word takes its space along
            new |= last
            starts = np.flatnonzero(new)
            return starts, np.append(starts[1:], n)
        new[edges] = True
        new |= cls == NUMBER
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        words = cls[starts] != SPACE
        return starts[words], ends[words]

    # -- merges --------------------------------------------------------------------------

    def _ranks(self, sym: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at ``at`` (ascending); as many as there are merges where there is none."""
        out = np.full(len(at), len(self.keys))
        if len(at) and at[-1] == len(sym) - 1:
            at = at[:-1]
        inner = np.flatnonzero(owner[at] == owner[at + 1])
        at = at[inner]
        key = sym[at] * self.width + sym[at + 1]
        for multiplier, ranks in self.tables:
            rank = ranks[self._spot(key, multiplier, len(ranks).bit_length() - 1)]
            found = self.keys[rank] == key
            out[inner[found]] = rank[found]
            inner, key = inner[~found], key[~found]
        return out

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all words in a row, and how many each word has."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        sym = self.first[flat]
        ends = np.cumsum(lens)
        sym[ends - 1] = self.last[flat[ends - 1]]
        owner = np.repeat(np.arange(len(words)), lens)
        out_sym, out_owner = [], []
        rank = self._ranks(sym, owner, np.arange(len(sym)))
        while len(sym):
            begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            low = np.minimum.reduceat(rank, begin)
            count = np.diff(np.append(begin, len(sym)))
            best = np.repeat(low, count)
            live = best < len(self.keys)
            if not live.all():
                out_sym.append(sym[~live])
                out_owner.append(owner[~live])
                sym, owner, rank, best = sym[live], owner[live], rank[live], best[live]
                if not len(sym):
                    break
            hit = rank == best
            # of overlapping occurrences (a a a) every other one, from the left
            index = np.arange(len(hit))
            run_start = np.maximum.accumulate(np.where(hit & ~np.concatenate([[False], hit[:-1]]), index, -1))
            hit &= (index - run_start) % 2 == 0
            alone = hit & self.single[best % len(self.keys)]
            if alone.any():
                seen = np.flatnonzero(alone)
                _, leftmost = np.unique(owner[seen], return_index=True)
                hit &= ~alone
                hit[seen[leftmost]] = True
            sym[hit] = self.made[best[hit]]
            keep = ~np.concatenate([[False], hit[:-1]])
            sym, owner, rank, changed = sym[keep], owner[keep], rank[keep], hit[keep]
            changed[:-1] |= changed[1:]  # the pairs of a new symbol with the next and with the one before
            at = np.flatnonzero(changed)
            rank[at] = self._ranks(sym, owner, at)
        sym, owner = np.concatenate(out_sym or [sym]), np.concatenate(out_owner or [owner])
        order = np.argsort(owner, kind="stable")
        return sym[order], np.bincount(owner, minlength=len(words))

    def _learn(self, hashes: np.ndarray, words: list[bytes]) -> None:
        ids, counts = self.merge(words)
        first = sum(map(len, self.starts)) - 1
        order = np.argsort(hashes)
        at = np.searchsorted(self.known, hashes[order])
        self.known, self.slots = np.insert(self.known, at, hashes[order]), np.insert(self.slots, at, first + order)
        self.starts.append(self.size + np.cumsum(counts))
        self.pool.append(ids)
        self.size += len(ids)
        self._flat = None

    def _tables(self) -> tuple[np.ndarray, np.ndarray]:
        if self._flat is None:
            self._flat = np.concatenate(self.starts), np.concatenate(self.pool or [np.zeros(0, np.int64)])
            self.starts, self.pool = [self._flat[0]], [self._flat[1]]
        return self._flat

    # -- texts ---------------------------------------------------------------------------

    def _plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts without special tokens, in a row, and how many each text has."""
        if len(self.known) > CACHE_WORDS:
            self.forget()
        texts = [self._normal(t) for t in texts]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        whole = "".join(texts)
        if not whole:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        bounds = np.concatenate([[0], np.cumsum(lens)])
        starts, ends = self._cuts(codes, bounds)
        odd = np.flatnonzero(codes == 39)
        if len(odd):
            starts, ends = self._by_pattern(texts, bounds, odd, starts, ends)
        hashes = word_hashes(codes, starts, ends)
        code, distinct = pd.factorize(hashes)
        first = np.empty(len(distinct), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]
        at = np.searchsorted(self.known, distinct)
        new = np.append(self.known, np.uint64(0))[at] != distinct
        new |= at == len(self.known)
        if new.any():
            place = first[new]
            self._learn(distinct[new], [whole[a:b].encode() for a, b in zip(starts[place].tolist(), ends[place].tolist(), strict=True)])
            at = np.searchsorted(self.known, distinct)
        begin, pool = self._tables()
        slot = self.slots[at][code]
        from_, count = begin[slot], begin[slot + 1] - begin[slot]
        done = np.concatenate([[0], np.cumsum(count)])
        ids = pool[np.repeat(from_ - done[:-1], count) + np.arange(done[-1])]
        word_at = np.searchsorted(starts, bounds)
        return ids, np.diff(done[word_at])

    def _by_pattern(self, texts, bounds, odd, starts, ends):
        """Cut the texts that hold apostrophes by the pattern itself."""
        which = np.unique(np.searchsorted(bounds, odd, side="right") - 1)
        keep = ~np.isin(np.searchsorted(bounds, starts, side="right") - 1, which)
        s, e = [starts[keep]], [ends[keep]]
        for k in which.tolist():
            if self.joined:
                spans = [m.span() for m in self.pattern.finditer(texts[k])]
            else:
                spans = [p[1] for p in self.library.pre_tokenizer.pre_tokenize_str(texts[k])]
            spans = np.array(spans, np.int64).reshape(-1, 2) + bounds[k]
            s.append(spans[:, 0])
            e.append(spans[:, 1])
        starts, ends = np.concatenate(s), np.concatenate(e)
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        parts: list[str] = []
        marks: list[int] = []  # id of the special token after each part, or -1
        owner: list[int] = []
        for i, t in enumerate(texts):
            t = t or ""
            cut = self.special_cut.split(t) if self.special_cut and "<|" in t else [t]
            for j in range(0, len(cut), 2):
                parts.append(cut[j])
                marks.append(self.special[cut[j + 1]] if j + 1 < len(cut) else -1)
                owner.append(i)
        ids, counts = self._plain(parts)
        if len(parts) > len(texts):
            ends, at = np.cumsum(counts), np.array(marks)
            ids = np.insert(ids, ends[at >= 0], at[at >= 0])
            counts = np.bincount(np.array(owner), weights=counts + (at >= 0), minlength=len(texts)).astype(np.int64)
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a row of ids; a byte sequence that is no UTF-8 is left to the caller."""
        begin, count = self.piece_at[ids], self.piece_at[ids + 1] - self.piece_at[ids]
        done = np.cumsum(count)
        total = int(done[-1]) if len(done) else 0
        return self.piece_bytes[np.repeat(begin - (done - count), count) + np.arange(total)].tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this Python worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def encode_table(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", decoded: bool = False) -> DataFrame:
    """doc_id and ids (binary) of every text; with ``decoded``, also the text that these ids give.

    ``path`` is the ``tokenizer.json`` on every worker.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            ids, counts = enc.encode(batch.pop("text").tolist())
            rows = np.split(ids, np.cumsum(counts)[:-1])
            batch["ids"] = [r.astype("<u4").tobytes() for r in rows]
            if decoded:
                batch["decoded"] = [enc.decode(r).decode("utf-8", "replace") for r in rows]
            yield batch
        enc.forget()  # a worker that goes on to other tasks does not hold the words of this one

    schema = "doc_id long, ids binary" + ", decoded string" * decoded
    return map_texts(plain_rows(docs, text, doc_id), run, schema)


def decode_table(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids, as ``encode_table`` makes them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in batches:
            texts = [enc.decode(np.frombuffer(b or b"", "<u4").astype(np.int64)).decode("utf-8", "replace") for b in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": texts})

    return map_texts(tokens.select("doc_id", "ids"), run, "doc_id long, text string", column="ids")
