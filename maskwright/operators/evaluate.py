"""How good findings are: spans found set against spans that are known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.session import written

WIDTH = 256


def overlap_pairs(left: DataFrame, right: DataFrame, by: str = "doc_id", width: int = WIDTH) -> DataFrame:
    """Every pair of overlapping spans of one document, once, with ``likeness`` (shared length by joint length).

    Both have ``by``, start, end, entity_type; columns of the result are ``by``, left_start, left_end, left_type, and
    so on. Spans are dealt to bins of ``width`` positions and joined by document and bin; a pair that
    shares several bins counts in the one where the later of the two begins.
    """

    def dealt(spans: DataFrame, side: str) -> DataFrame:
        named = spans.where(F.col("end") > F.col("start")).select(
            by, F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), F.col("entity_type").alias(f"{side}_type")
        ).distinct()
        bins = F.sequence(F.floor(F.col(f"{side}_start") / width), F.floor((F.col(f"{side}_end") - 1) / width))
        return named.withColumn("_bin", F.explode(bins))

    pairs = dealt(left, "left").join(dealt(right, "right"), [by, "_bin"])
    late, early = F.greatest("left_start", "right_start"), F.least("left_end", "right_end")
    pairs = pairs.where((late < early) & (F.floor(late / width) == F.col("_bin"))).drop("_bin")
    joint = F.greatest("left_end", "right_end") - F.least("left_start", "right_start")
    return pairs.withColumn("likeness", (early - late) / joint)


def best_matches(pairs: DataFrame, by: str = "doc_id") -> DataFrame:
    """Of ``overlap_pairs``, one-to-one matches: again and again the pairs that are best for both sides.

    The best pair has the greatest likeness, then the earliest spans; so the result is that of taking
    pairs from the best on.
    """
    order = F.struct("likeness", -F.col("left_start"), -F.col("right_start"), -F.col("left_end"), -F.col("right_end"), "left_type", "right_type")
    left, right = [by, "left_start", "left_end", "left_type"], [by, "right_start", "right_end", "right_type"]
    rest, found = written(pairs.withColumn("_order", order), "pairs"), None
    while not rest.isEmpty():
        best_left = rest.groupBy(*left).agg(F.max("_order").alias("_order"))
        best_right = rest.groupBy(*right).agg(F.max("_order").alias("_order"))
        both = written(rest.join(best_left, [*left, "_order"]).join(best_right, [*right, "_order"]).select(rest.columns), "matches")
        found = both if found is None else found.unionByName(both)
        rest = rest.join(both.select(*left), left, "left_anti").join(both.select(*right), right, "left_anti")
        rest = written(rest, "pairs")
    return (rest if found is None else found).drop("_order")


def scores(found: DataFrame, known: DataFrame, by: str = "doc_id", least: float = 0.5) -> DataFrame:
    """entity_type, found, known, right, precision, recall: a finding is right if it matches a known span of its
    type one to one, with a likeness above ``least``."""
    # both are counted and matched, and finding may be costly
    found, known = (written(s.select(by, "start", "end", "entity_type"), n) for s, n in ((found, "found"), (known, "known")))
    pairs = overlap_pairs(found, known, by).where((F.col("left_type") == F.col("right_type")) & (F.col("likeness") > least))
    right = best_matches(pairs, by).groupBy(F.col("left_type").alias("entity_type")).agg(F.count("*").alias("right"))
    count = lambda spans, label: spans.select(by, "start", "end", "entity_type").distinct().groupBy("entity_type").agg(F.count("*").alias(label))
    whole = count(found, "found").join(count(known, "known"), "entity_type", "full").join(right, "entity_type", "left").fillna(0)
    share = lambda of: F.when(F.col(of) > 0, F.col("right") / F.col(of))
    return whole.withColumns({"precision": share("found"), "recall": share("known")})
