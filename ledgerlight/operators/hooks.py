"""Scores from a callable of the user's: batched calls over a bounded pool, with retries and a budget of calls.

The callable takes lists of equal length, one for each column, and returns a list of numbers. It is sent to the executors,
so it may open its own connection there. Without one, the Column forms of the search operators do the same work in the JVM.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Scorer = Callable[..., list[float]]


def scored_by(pool: DataFrame, scorer: Scorer, columns: list[str], name: str, batch: int = 32, retries: int = 2, budget: int = 100, wait: float = 0.1) -> DataFrame:
    """Adds ``name``: what the scorer says of the columns, null where it failed or the budget was spent.

    ``pool`` is what a search returns at most, not a table: it becomes one task, so that the budget counts all its calls,
    failed ones among them. A call takes ``batch`` rows at most and is tried again ``retries`` times. Numbers that aren't finite count as failures.
    """

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        left = budget
        for part in parts:
            out: list[float | None] = []
            for at in range(0, len(part), batch):
                rows = [part[c].iloc[at : at + batch].tolist() for c in part.columns]
                found: list[float | None] = [None] * len(rows[0])
                for attempt in range(retries + 1):
                    if not left:
                        break
                    left -= 1
                    try:
                        values = [float(v) for v in scorer(*rows)]
                        if len(values) != len(rows[0]) or not all(abs(v) < float("inf") for v in values):
                            raise ValueError("the scorer returned other than one finite number for each row")
                        found = list(values)
                        break
                    except Exception:  # any failure of the callable is tried again, then left as null
                        if attempt < retries and left:
                            time.sleep(wait * 2**attempt)
                out += found
            yield pd.Series(out, dtype="float64")

    return pool.repartition(1).withColumn(name, score(F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"x{i}") for i, c in enumerate(columns)])))
