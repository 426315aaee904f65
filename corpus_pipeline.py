"""A cleaning pipeline over ``documents``: quality rules, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; its result is written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerlight.llm import line_dedup, packing, quality_rules, simhash, substring_dedup
from ledgerlight.llm.common import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in three or more documents stay only in the largest doc_id."""
    return line_dedup.drop_lines(docs, line_dedup.keep_bitmaps(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (0.8 of the five-word shingles) stays, the one with the smallest doc_id.

    Candidates meet at the anchors of SimHash fingerprints and are verified; an exact check finds what anchors can't.
    """
    return simhash.keep_one(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document holds go from the later one."""
    return substring_dedup.drop_passages(docs, substring_dedup.passages(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in training sequences of at most 2048 tokens."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("near-dedup", near_copies), ("substring dedup", passages), ("packing", pack)]

#: Fuzzy passages and near copies have no SQL form. The tests compare near-dedup with exact Jaccard components and substring
#: dedup with planted passages; the pipeline as a whole is checked by counts and columns only.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
