"""Language identification by interpolated Kneser-Ney character models.

Texts are lowered, and every run of other characters than letters is one space. Counts of
the longest character sequences are gathered from all training documents by Spark; the
continuation counts of shorter ones follow from them. The models of all languages share
sorted arrays of sequence hashes with one column of log-probabilities per language, so a
position costs one binary search unless its sequence is new to all languages. Models too
large to be collected stay tables of the same order: the probabilities of the sequences that
occur are computed by joins, and each batch of texts is met by those of its own sequences.
Both ways give the same results but for rounding.

The language of least cross-entropy per character wins. A text is rejected if its
cross-entropy lies more than ``margin`` bits above that of all but a thousandth of the
training documents, both of its language and length class and of all.

Results in special cases: a null text, or one without a letter, is ``und`` with score 0
and rejected; rows without a language are predicted but not learnt from; a table that
teaches no language gives ``und`` throughout; repeated rows give repeated results and count
as often as they occur; rows without an id count as not held out; an empty table gives an empty result; a text
of any length is scored whole, in tiles; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import in_chunks, map_texts, row_digest, staged, window_hashes, without

ORDER = 4
MAX_CELLS = 1_500_000
MARGIN = 1.0
QUANTILE = 0.999
TILE = 100_000
BATCH_CHARS = 1_000_000
MIX = np.uint64(0xD6E8FEB86659FD93)
SPACE = 32

_held: dict[str, np.ndarray] = {}


def _lowered(codes: np.ndarray) -> np.ndarray:
    """Each character's lower case if it is a letter, else a space."""
    if "lower" not in _held:
        _held["lower"] = np.zeros(0x110000, np.uint32)
    table = _held["lower"]
    out = table[codes]
    if not out.all():
        for c in np.unique(codes[out == 0]).tolist():
            table[c] = ord(chr(c).lower()[0]) if chr(c).isalpha() else SPACE
        out = table[codes]
    return out


def symbols(texts: list[str | None], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts in a row, each text with ``order - 1`` spaces before and one after; where each begins."""
    pad = " " * (order - 1)
    whole = "".join(f"{pad}{t or ''} " for t in texts)
    lens = np.fromiter((len(t or "") for t in texts), np.int64, len(texts)) + order
    codes = _lowered(np.frombuffer(whole.encode("utf-32-le"), np.uint32))
    begin = np.cumsum(lens) - lens
    gap = codes == SPACE
    keep = np.ones(len(codes), bool)
    keep[1:] = ~(gap[1:] & gap[:-1])
    for k in range(order - 1):
        keep[begin + k] = True
    if order > 1:
        keep[np.minimum(begin + order - 1, len(codes) - 1)] &= ~gap[np.minimum(begin + order - 1, len(codes) - 1)]
    at = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], at[np.append(begin, len(codes))]


def hashes(codes: np.ndarray, n: int) -> np.ndarray:
    """A hash of the ``n`` characters from each position."""
    h = window_hashes(codes.astype(np.uint64) + np.uint64(1), n)
    h ^= h >> np.uint64(32)
    h *= MIX
    return h ^ h >> np.uint64(29)


def _inside(bounds: np.ndarray, order: int) -> np.ndarray:
    """Positions from which ``order`` characters lie within one text."""
    count = np.maximum(np.diff(bounds) - order + 1, 0)
    return np.arange(int(count.sum())) + np.repeat(bounds[:-1] - (np.cumsum(count) - count), count)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def count_sequences(train: DataFrame, order: int = ORDER) -> DataFrame:
    """lang, seq, n over all rows of ``train`` (text, lang); combined per task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        for batch in batches:
            for lang, part in batch.groupby("lang"):
                seqs, n = _sequences(part["text"].tolist(), order)
                kept.append(pd.DataFrame({"lang": lang, "seq": seqs, "n": n}))
            if sum(map(len, kept)) > 300_000:
                kept = [pd.concat(kept).groupby(["lang", "seq"], as_index=False)["n"].sum()]
                if len(kept[0]) > 150_000:
                    yield kept.pop()
        if kept:
            yield pd.concat(kept).groupby(["lang", "seq"], as_index=False)["n"].sum()

    rows = train.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    return map_texts(rows, run, "lang string, seq string, n long").groupBy("lang", "seq").agg(F.sum("n").alias("n"))


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    which, distinct = pd.factorize(h)
    first = np.empty(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    return which, first


def _sequences(texts: list[str | None], order: int) -> tuple[list[str], np.ndarray]:
    """The distinct sequences of all texts and how often each occurs."""
    codes, bounds = symbols(texts, order)
    at = _inside(bounds, order)
    which, first = _distinct(hashes(codes, order)[at])
    rows = codes[at[first][:, None] + np.arange(order)]
    whole = rows.astype("<u4").tobytes().decode("utf-32-le")
    return [whole[i : i + order] for i in range(0, len(whole), order)], np.bincount(which, minlength=len(first))


class Models:
    """Sorted hash arrays and log-probabilities of all languages, built from the counts of the longest sequences."""

    def __init__(self, counts: pd.DataFrame, order: int) -> None:
        self.order = order
        self.langs = sorted(counts["lang"].unique())
        levels: list[dict[str, pd.Series]] = [{}] * (order + 1)
        levels[order] = {x: part.set_index("seq")["n"].astype(float) for x, part in counts.groupby("lang")}
        for n in range(order - 1, 0, -1):  # continuation counts: how many sequences end in this one
            levels[n] = {x: s.groupby(s.index.str[1:]).size().astype(float) for x, s in levels[n + 1].items()}
        alphabet = set().union(*(s.index for s in levels[1].values()))
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.contexts: list[tuple[np.ndarray, np.ndarray]] = []
        below = pd.DataFrame(1 / (len(alphabet) + 1), index=[""], columns=self.langs)
        self.unknown = np.log2(below.to_numpy()[0])
        for n in range(1, order + 1):
            every = pd.Index(sorted(set().union(*(s.index for s in levels[n].values()))))
            prob = pd.DataFrame(index=every, columns=self.langs, dtype=float)
            heads = pd.Index(sorted(set(every.str[:-1])))
            weight = pd.DataFrame(1.0, index=heads, columns=self.langs)
            for x, s in levels[n].items():
                once, twice = (s == 1).sum(), (s == 2).sum()
                discount = once / (once + 2 * twice) if once else 0.5
                by_head = s.groupby(s.index.str[:-1])
                total, rest = by_head.sum(), discount * by_head.size() / by_head.sum()
                weight.loc[rest.index, x] = rest
                own = (s.reindex(every).fillna(0) - discount).clip(lower=0) / total.reindex(every.str[:-1]).fillna(1).to_numpy()
                prob[x] = own + weight[x].reindex(every.str[:-1]).to_numpy() * below[x].reindex(every.str[1:]).to_numpy()
            self.grams.append(self._sorted(every, np.log2(prob.to_numpy())))
            self.contexts.append(self._sorted(heads, np.log2(weight.to_numpy())))
            below = prob

    @staticmethod
    def _sorted(index: pd.Index, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(index[0]) if len(index) else 0
        if n == 0:
            return np.zeros(1, np.uint64), values.astype(np.float32)
        codes = np.frombuffer("".join(index).encode("utf-32-le"), np.uint32)
        h = hashes(codes, n)[::n]
        order = np.argsort(h)
        return h[order], np.ascontiguousarray(values[order], np.float32)

    def log2(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """log2 P(last of the ``order`` characters from each position | those before), per language."""
        out = np.zeros((len(at), len(self.langs)), np.float32)
        open_ = np.arange(len(at))
        for n in range(self.order, 0, -1):
            skip = self.order - n
            h = hashes(codes, n)[at[open_] + skip] if len(open_) else np.zeros(0, np.uint64)
            keys, values = self.grams[n - 1]
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            out[open_[hit]] += values[place[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            keys, values = self.contexts[n - 1]
            h = hashes(codes, n - 1)[at[open_] + skip] if n > 1 else np.zeros(len(open_), np.uint64)
            place = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[place] == h
            out[open_[hit]] += values[place[hit]]
        out[open_] += self.unknown
        return out


class Listed:
    """Log-probabilities of all sequences of one batch of texts."""

    def __init__(self, seqs: list[str], bits: np.ndarray, langs: list[str], order: int) -> None:
        self.order, self.langs = order, langs
        self.keys, self.values = Models._sorted(pd.Index(seqs), bits)

    def log2(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.zeros((0, len(self.langs)), np.float32)
        return self.values[np.searchsorted(self.keys, hashes(codes, self.order)[at])]


def _mixed(lost: Column, total: Callable[[Column], Column], weight: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """The probability for the language of a number, as in ``Models``: 0 of what is not counted, and all of what is below an unknown head."""

    def prob(x: Column) -> Column:
        kept = F.greatest(F.element_at("own", x) - F.get(lost, x), F.lit(0.0)) / total(x)
        return F.coalesce(kept, F.lit(0.0)) + F.coalesce(weight(x), F.lit(1.0)) * F.get("below", x)

    return prob


class Tables:
    """The same models as tables of Spark, of any size; only figures per language are collected."""

    def __init__(self, counts: DataFrame, langs: list[str], order: int) -> None:
        self.order, self.langs = order, langs
        at = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
        self.levels: list[DataFrame] = [counts] * (order + 1)
        self.levels[order] = counts.select(at.alias("x"), "seq", "n")
        for n in range(order - 1, 0, -1):  # continuation counts, as in ``Models``
            shorter = self.levels[n + 1].groupBy("x", F.substring("seq", 2, n).alias("seq")).agg(F.count("*").alias("n"))
            self.levels[n] = staged(shorter, "sequences")
        self.discounts: list[list[float]] = [[]] * (order + 1)
        for n in range(1, order + 1):
            seen = self.levels[n].groupBy("x").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice"))
            found = {r["x"]: r["once"] / (r["once"] + 2 * r["twice"]) if r["once"] else 0.5 for r in seen.collect()}
            self.discounts[n] = [found[x] for x in range(len(langs))]

    def log2(self, seqs: DataFrame) -> DataFrame:
        """seq and bits (one for each language) of distinct sequences of the full length."""
        every = F.sequence(F.lit(0), F.lit(len(self.langs) - 1))
        asked = [seqs] * (self.order + 1)
        for n in range(self.order - 1, 0, -1):
            asked[n] = asked[n + 1].select(F.substring("seq", 2, n).alias("seq")).distinct()
        first = self.levels[1]
        base = 1 / (first.select("seq").distinct().count() + 1)
        whole = {r["x"]: (r["total"], r["size"]) for r in first.groupBy("x").agg(F.sum("n").alias("total"), F.count("*").alias("size")).collect()}
        below = None
        for n in range(1, self.order + 1):
            lost = F.array(*map(F.lit, self.discounts[n]))
            own = self.levels[n].groupBy("seq").agg(F.map_from_entries(F.collect_list(F.struct("x", "n"))).alias("own"))
            rows = asked[n].join(own, "seq", "left")
            if n == 1:  # one head for all
                totals = [float(whole[x][0]) for x in range(len(self.langs))]
                weights = [self.discounts[1][x] * whole[x][1] / whole[x][0] for x in range(len(self.langs))]
                rows = rows.withColumns({"total": F.array(*map(F.lit, totals)), "weight": F.array(*map(F.lit, weights)), "below": F.array_repeat(F.lit(base), len(self.langs))})
                total, weight = lambda x: F.get("total", x), lambda x: F.get("weight", x)
            else:
                heads = self.levels[n].groupBy("x", F.substring("seq", 1, n - 1).alias("head")).agg(F.sum("n").cast("double").alias("total"), F.count("*").alias("size"))
                heads = heads.withColumn("weight", F.get(lost, F.col("x")) * F.col("size") / F.col("total"))
                heads = heads.groupBy("head").agg(
                    *[F.map_from_entries(F.collect_list(F.struct("x", c))).alias(c) for c in ("total", "weight")]
                )
                rows = rows.withColumns({"head": F.substring("seq", 1, n - 1), "tail": F.substring("seq", 2, n - 1)})
                rows = rows.join(heads, "head", "left").join(below.select(F.col("seq").alias("tail"), F.col("prob").alias("below")), "tail")
                total, weight = lambda x: F.element_at("total", x), lambda x: F.element_at("weight", x)
            below = staged(rows.select("seq", F.transform(every, _mixed(lost, total, weight)).alias("prob")), "probabilities")
        return below.select("seq", F.transform("prob", lambda p: F.log2(p).cast("float")).alias("bits"))


def learn(
    docs: DataFrame, order: int = ORDER, most: int = MAX_CELLS, text: str = "text", doc_id: str = "doc_id", lang: str = "lang"
) -> Models | Tables | None:
    """Models of all documents that are not held out.

    They are collected if sequences times languages are ``most`` at most, and else stay
    tables; the order and the probabilities are the same.
    """
    rows = docs.where(~held_out(doc_id)).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = staged(count_sequences(rows, order), "sequences")
    langs = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not langs:
        return None
    if counts.select("seq").distinct().count() * len(langs) > most:
        return Tables(counts, langs, order)
    return Models(counts.toPandas(), order)


def _judged(m: Models | Listed | None, texts: list[str | None]) -> dict[str, list]:
    """lang_pred, score, entropy and letters of texts."""
    best, entropy, sure, letters = [], [], [], []
    for a, b in in_chunks([len(t or "") for t in texts]):
        part = texts[a:b]
        if m is None:
            best += ["und"] * (b - a)
            entropy, sure, letters = entropy + [0.0] * (b - a), sure + [0.0] * (b - a), letters + [0] * (b - a)
            continue
        codes, bounds = symbols(part, m.order)
        at = _inside(bounds, m.order)
        count = np.maximum(np.diff(bounds) - m.order + 1, 0)
        total = np.zeros((len(part), len(m.langs)))
        owner = np.repeat(np.arange(len(part)), count)
        for t in range(0, len(at), TILE):  # a figure per language for each position of a tile
            here, who = at[t : t + TILE], owner[t : t + TILE]
            bits = -m.log2(codes[here[0] : here[-1] + m.order], here - here[0])
            of, begin = np.unique(who, return_index=True)
            total[of] += np.add.reduceat(bits, begin, axis=0, dtype=np.float64)
        mean = total / np.maximum(count, 1)[:, None]
        k = mean.argmin(axis=1)
        least = mean[np.arange(len(part)), k]
        posterior = 1 / np.exp2((least[:, None] - mean) * np.minimum(count, 50)[:, None]).sum(axis=1)
        has = np.diff(bounds) > m.order  # besides the padding and the last space
        best += [m.langs[j] if ok else "und" for j, ok in zip(k, has, strict=True)]
        entropy += np.where(has, least, 0).tolist()
        sure += np.where(has, posterior, 0).tolist()
        letters += np.where(has, count, 0).tolist()
    return {"lang_pred": best, "score": sure, "entropy": entropy, "letters": letters}


SCORED = "doc_id long, text_hash long, lang string, held_out boolean, lang_pred string, score double, entropy double, letters long"


def score(
    docs: DataFrame, models: Models | Tables | None, text: str = "text", doc_id: str = "doc_id", lang: str = "lang"
) -> DataFrame:
    """doc_id, text_hash, lang, held_out, lang_pred, score, entropy (bits a character) and letters (characters scored)."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), row_digest(docs, text).alias("text_hash"), F.col(lang).alias("lang"), held_out(doc_id).alias("held_out"), F.col(text).alias("text")
    )
    if isinstance(models, Tables):
        return _score_by_tables(rows, models)
    shared = docs.sparkSession.sparkContext.broadcast(models)  # at most MAX_CELLS figures of each length

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**_judged(shared.value, batch.pop("text").tolist()))

    return map_texts(rows, run, SCORED)


def _score_by_tables(rows: DataFrame, models: Tables) -> DataFrame:
    """Texts are dealt to batches of bounded size, and each batch gets the probabilities of its distinct sequences."""
    order, langs = models.order, models.langs

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        begin, size = TaskContext.get().partitionId() << 40, 0
        for batch in batches:
            sizes = size + np.cumsum([len(t or "") + 100 for t in batch["text"].tolist()], dtype=np.int64)
            size = int(sizes[-1]) if len(sizes) else size
            yield batch.assign(batch=begin + sizes // BATCH_CHARS)

    dealt = staged(rows.mapInPandas(deal, ", ".join(f"{c} {t}" for c, t in rows.dtypes) + ", batch long"), "dealt")

    def list_sequences(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for number, part in batch.groupby("batch"):
                yield pd.DataFrame({"seq": pd.Series(_sequences(part["text"].tolist(), order)[0], dtype=object)}).assign(batch=number)

    needed = dealt.select("batch", "text").where(F.col("text").isNotNull())
    needed = staged(map_texts(needed, list_sequences, "seq string, batch long").distinct(), "needed")
    known = models.log2(needed.select("seq").distinct())

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = batch.column("bits").flatten().to_numpy().astype(np.float32).reshape(len(batch), -1)
            packed = pa.array([row.tobytes() for row in bits], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("seq"), packed], ["seq", "bits"])

    known = known.mapInArrow(pack, "seq string, bits binary")

    def judge(texts: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        bits = np.frombuffer(b"".join(listed["bits"]), np.float32).reshape(len(listed), len(langs))
        found = _judged(Listed(listed["seq"].tolist(), bits, langs, order), texts["text"].tolist())
        return texts.drop(columns=["text", "batch"]).assign(lang=texts["lang"].astype(object), **found)

    return dealt.groupBy("batch").cogroup(needed.join(known, "seq").groupBy("batch")).applyInPandas(judge, SCORED)


def identify(
    docs: DataFrame, order: int = ORDER, margin: float = MARGIN, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", most: int = MAX_CELLS
) -> DataFrame:
    """doc_id, text_hash, held_out, lang_pred, score, entropy and accepted of every document."""
    models = learn(docs, order, most, text, doc_id, lang)
    scored = staged(score(docs, models, text, doc_id, lang), "languages")
    length = F.least(F.floor(F.log2(F.greatest("letters", F.lit(1)))), F.lit(30)).cast("int")
    scored = scored.withColumn("_class", length)
    taught = scored.where(~F.col("held_out") & (F.col("lang") == F.col("lang_pred")))
    high = F.percentile_approx("entropy", QUANTILE, 10000)
    limits = taught.groupBy("lang_pred", "_class").agg(high.alias("_limit"))
    found = scored.join(F.broadcast(limits), ["lang_pred", "_class"], "left")  # 31 rows a language
    overall = taught.agg(high).first()[0]
    limit = F.greatest(F.col("_limit"), F.lit(overall).cast("double")) + margin
    return found.select(
        "doc_id", "text_hash", "held_out", "lang_pred", "score", "entropy", ((F.col("lang_pred") != "und") & F.coalesce(F.col("entropy") <= limit, F.lit(False))).alias("accepted")
    )


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents whose language is not rejected, as they are."""
    return without(docs, identify(docs).where(~F.col("accepted")))
