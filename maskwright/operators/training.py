"""Rows for tuning an extraction model: chat messages, plain prompts, a stable split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from maskwright.functions.text import fill_template
from maskwright.operators.models import EXTRACTION_PROMPT

# A prompt that shows a text together with its masked form.
MASKING_PROMPT = (
    "Rewrite the text so that it names no person and gives no contact or account data. Put a "
    "numbered label such as EMAIL_1 in place of each.\n\nText: {source_text}\n\nRewritten: {target_text}\n"
)
TEST_SHARE = 0.2
SEED = 42


def entities_of(spans: str = "spans") -> Column:
    """The detected spans in the form a model is to answer: ``{entity, category}``."""
    return F.transform(
        F.col(spans), lambda s: F.struct(s["text"].alias("entity"), s["entity_type"].alias("category"))
    )


def chat_messages(rows: DataFrame, source_text: str = "source_text", entities: str = "entities") -> DataFrame:
    """One ``messages`` column: the user gives the text, the assistant its entities as JSON."""
    message = [
        F.struct(F.lit("user").alias("role"), fill_template(EXTRACTION_PROMPT, F.col(source_text)).alias("content")),
        F.struct(F.lit("assistant").alias("role"), F.to_json(F.col(entities)).alias("content")),
    ]
    return rows.select(F.array(*message).alias("messages"))


def masking_prompt(source_text: Column, target_text: Column) -> Column:
    """The parts of the template around the two texts, so that text is never read as a slot."""
    head, rest = MASKING_PROMPT.split("{source_text}")
    middle, tail = rest.split("{target_text}")
    return F.concat(F.lit(head), source_text, F.lit(middle), target_text, F.lit(tail))


def with_split(rows: DataFrame, key: str, test_share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add ``split``, ``test`` or ``train``, by a hash of the key: the same in every run and partitioning."""
    digest = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")), 256)
    bucket = F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(10_000))
    return rows.withColumn("split", F.when(bucket < int(round(test_share * 10_000)), "test").otherwise("train"))
