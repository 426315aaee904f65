"""Helpers that every operator of this subpackage shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a Java and RE2 character class body.
SPACE_CLASS = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which the driver and all executors share.

    Only on one machine (tests) a temporary folder takes its place where the setting is missing.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other job uses."""
    return f"{shared_dir(spark)}/ledgerlight/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it again: lineage ends here and survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def batches_of(spark: SparkSession, rows: int | None = None, size: int | None = None) -> Iterator[None]:
    """Arrow batches of at most so many rows and about so many bytes (one row at least), for what is run inside."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        if value is not None:
            spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def planes(rows: np.ndarray) -> bytes:
    """Byte by byte of all rows, which leaves equal bytes side by side for the shuffle's compression."""
    return np.ascontiguousarray(rows.view(np.uint8).reshape(len(rows), rows.itemsize).T).tobytes()


def unplaned(pack: bytes, dtype: np.dtype) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(pack, np.uint8).reshape(dtype.itemsize, -1).T).view(dtype).ravel()


def fresh_name(taken: list[str], base: str) -> str:
    """``base``, with underscores added until no column of ``taken`` has that name (compared without case)."""
    used = {x.lower() for x in taken}
    while base.lower() in used:
        base += "_"
    return base


def text_or_empty(column: str):
    return F.coalesce(F.col(column), F.lit(""))
