"""The evidence bundle: leaves of the current texts in order, as far as a budget of characters goes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tree import leaves

#: Characters that a bundle holds at most.
BUDGET = 500_000


def _greedy(budget: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = budget
        for frame in frames:
            kept = []
            for sizes in frame["sizes"]:
                # The first leaf that doesn't fit ends its text; the next text goes on with what is left.
                fits = next((i for i, total in enumerate(accumulate(sizes)) if total > left), len(sizes))
                left -= int(sum(sizes[:fits]))
                kept.append(fits)
            yield frame[["source", "doc_id"]].assign(kept=kept)

    return run


def evidence_bundle(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """source, doc_id, document_order and n_chars of the leaves that fit, texts in the order of their sources.

    Trees and sizes are made in parallel. The budget is one for the bundle and what a text takes depends on all
    before, so a row of sizes for each text, and nothing else, meets in one partition.
    """
    sized = leaves(docs).join(docs.select("doc_id", "source"), "doc_id")
    sizes = sized.select("source", "doc_id", F.transform("leaves", lambda x: x["size"].cast("long")).alias("sizes"))
    kept = sizes.repartition(1).sortWithinPartitions("source", "doc_id").mapInPandas(_greedy(budget), "source string, doc_id long, kept int")
    chosen = sized.join(kept.select("doc_id", "kept"), "doc_id").select("source", "doc_id", F.explode(F.slice("leaves", F.lit(1), F.col("kept"))).alias("x"))
    return chosen.select("source", "doc_id", "x.document_order", F.col("x.size").cast("long").alias("n_chars"))
