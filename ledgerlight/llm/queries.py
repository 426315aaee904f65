"""The registered queries of this subpackage: thin digests over the operators, on whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, line_dedup, merkle, neighbours, packing, quality_rules, sharding, simhash, spelling, substring_dedup, token_counts, topk, warc

VOCABULARY, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_index_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return warc.archive_and_index(table(spark, sf_dir, "pages")).select(*columns)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_dedup.digests(docs, line_dedup.keep_bitmaps(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "source", "place")
    return sharding.interleave(table(spark, sf_dir, "documents")).select(*columns)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digests(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.scores(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_warc_index_merge, op2_substring_dedup, op3_line_dedup, op4_token_counts, op5_sharding, op6_bpe,
        op7_exact_topk, op8_packing, op9_simhash, op10_quality_rules, op11_spelling, op12_merkle_manifest, op13_neighbours,
    )
}
