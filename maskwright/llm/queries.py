"""The queries of this subpackage, with production parameters and over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers
from maskwright.llm import bitplanes, bpe, chattree, exact, langid, packing, partenum, repair, tokencount, urls, warc, weak, winnow
from maskwright.llm.common import table
from maskwright.session import scratch_path


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    return warc.read_records(spark, path).drop("url")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    done = bpe.encode_table(table(spark, sf_dir, "documents"), path, decoded=True)
    return done.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.classify(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.find_copies(table(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.near_groups(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.compare_with_next(table(spark, sf_dir, "documents"))


def op9_chat_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    nodes, steps, intervals = chattree.build_tree(turns.unionByName(spark.createDataFrame(rows, turns.schema)))
    told = chattree.read_back(nodes, steps)
    seen = chattree.attended(intervals).select(F.col("conv_id").alias("_seen"), "attended_chars")
    return told.join(seen, F.col("conv_id").eqNullSafe(F.col("_seen"))).drop("_seen")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).drop("text_hash")


def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.cluster(table(spark, sf_dir, "embeddings"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.damage_and_repair(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()]
    return {f.__name__: f for f in found}
