"""Streams that are folded to a table: what the batch operators do at once, done as events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.store import new_path


def fold_to_table(folded: DataFrame, label: str) -> DataFrame:
    """Runs a streaming aggregate until its source is exhausted and returns its last state.

    Each batch writes the whole state under its number, so a batch that is repeated after a failure
    replaces its own state and no other.
    """
    spark = folded.sparkSession
    base = new_path(spark, label)
    last: list[int] = []

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/state={number}")
        last.append(number)

    run = folded.writeStream.outputMode("complete").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    run.awaitTermination()
    if not last:
        return spark.createDataFrame([], folded.schema)
    return spark.read.schema(folded.schema).parquet(f"{base}/state={last[-1]}")
