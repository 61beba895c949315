"""Numbers that stand for the same text in all documents.

Each distinct text of a type has the place it takes among all of them in order. The texts are dealt
to range partitions and sorted there; a text's number is the number of texts in the partitions
before, by type, and its place in its own. So no task sees all texts, and no two texts share a number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from maskwright.functions.spans import compute, let, name, splice
from maskwright.operators.mask import PIECE
from maskwright.session import lookup_join, written

PARTITION_BITS = 33  # of monotonically_increasing_id


def number_texts(found: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """entity_type, text, number of every distinct (entity_type, text) of ``found``.

    Texts that ``known`` (an earlier result) has keep their numbers, and new ones come after them,
    so what was masked before stays right when documents are added.
    """
    texts = found.select("entity_type", "text").where("text IS NOT NULL").distinct()
    if known is not None:
        texts = texts.join(known.select("entity_type", "text"), ["entity_type", "text"], "left_anti")
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = texts.repartitionByRange(parts, "entity_type", "text").sortWithinPartitions("entity_type", "text")
    placed = written(ordered.withColumn("_at", F.monotonically_increasing_id()), "numbers")
    placed = placed.withColumn("_part", F.shiftright("_at", PARTITION_BITS))
    # at most one row per partition and type
    sizes = placed.groupBy("entity_type", "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy("entity_type").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("entity_type", "_part", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    numbered = placed.join(F.broadcast(bases), ["entity_type", "_part"])
    number = F.col("_base") + F.col("_at") - F.col("_first") + 1
    if known is None:
        return numbered.select("entity_type", "text", number.alias("number"))
    last = known.groupBy("entity_type").agg(F.max("number").alias("_last"))  # one row per type
    fresh = numbered.join(F.broadcast(last), "entity_type", "left")
    fresh = fresh.select("entity_type", "text", (number + F.coalesce("_last", F.lit(0))).alias("number"))
    return known.select("entity_type", "text", "number").unionByName(fresh)


def mask_with_numbers(
    docs: DataFrame, numbers: DataFrame, by: str = "doc_id", text: str = "text", spans: str = "spans", into: str = "masked",
    small: bool | None = None,
) -> DataFrame:
    """Replace every span by ``[TYPE_n]``, n its number in ``numbers``; ``docs`` have resolved spans.

    Only documents with findings are shuffled. A span whose text has no number is refused.
    """
    row = F.xxhash64(F.col(by), F.col(text))
    some = docs.where(F.size(spans) > 0).withColumn("_row", row)
    key = lambda kind, said: F.concat_ws(":", kind, said)
    each = some.select("_row", F.posexplode(spans).alias("_i", "_s")).distinct()
    each = each.select("_row", "_i", key(F.col("_s.entity_type"), F.col("_s.text")).alias("_key"))
    table = numbers.select(key(F.col("entity_type"), F.col("text")).alias("_key"), "number")
    told = lookup_join(each, table, "_key", "left", small=small, salt_by=("_row", "_i"))
    checked = F.when(F.col("number").isNotNull(), F.col("number")).otherwise(F.raise_error(F.lit("a finding has no number")))
    lists = told.groupBy("_row").agg(F.transform(F.sort_array(F.collect_list(F.struct("_i", checked.alias("number")))), lambda s: s["number"]).alias("_numbers"))
    joined = some.join(lists, "_row")
    label = "concat('[', s.entity_type, '_', get(_numbers, i), ']')"
    pieces = f"transform({name(spans)}, (s, i) -> CAST(struct(s.start, s.end, s.entity_type, {label}) AS {PIECE}))"
    masked = compute(joined, {into: let("pieces", pieces, splice(name(text), "pieces"))}).drop("_row", "_numbers")
    others = docs.where(F.coalesce(F.size(spans), F.lit(0)) <= 0)
    return masked.unionByName(others.withColumn(into, F.when(F.col(spans).isNotNull(), F.col(text))))
