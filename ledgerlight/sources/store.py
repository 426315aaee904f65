"""Snapshots, content-addressed objects and JSON exports in the shared folder.

A snapshot is a set of tables below ``state=N``; it counts only once its manifest, written last, names it,
so that a reader never sees a half-written state. There is one writer.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "version long, state long, name string, path string, n long, digest decimal(38,0)"
VERSION = 1


def new_path(spark: SparkSession, label: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names; a temporary one on a single machine alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-shared-")
    return f"{base.rstrip('/')}/ledgerlight/{label}-{uuid.uuid4().hex}"


def _sum(df: DataFrame) -> tuple[int, object]:
    """Row count and an order-free digest of a table."""
    n, total = df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return n, total


def write_snapshot(spark: SparkSession, base: str, state: int, tables: dict[str, DataFrame]) -> None:
    rows = []
    for name, df in tables.items():
        path = f"{base}/state={state}/{name}"
        df.write.mode("overwrite").parquet(path)
        rows.append((VERSION, state, name, path, *_sum(spark.read.parquet(path))))
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("append").parquet(f"{base}/manifest")


def read_snapshot(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the latest complete state; counts and digests must match the manifest."""
    manifest = spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    if manifest.filter(F.col("version") > VERSION).limit(1).count():
        raise ValueError("the snapshot is newer than this code")
    state = manifest.agg(F.max("state")).first()[0]
    out = {}
    for row in manifest.filter(F.col("state") == state).collect():  # one row a table
        df = spark.read.parquet(row.path)
        if _sum(df) != (row.n, row.digest):
            raise ValueError(f"table {row.name} doesn't match its manifest")
        out[row.name] = df
    return out


def write_objects(rows: DataFrame, content: str, base: str) -> DataFrame:
    """Stores each distinct content once under its digest, partitioned by the digest's first two digits."""
    keyed = rows.select(F.sha2(F.col(content), 256).alias("digest"), F.col(content).alias("content")).filter("content IS NOT NULL")
    objects = keyed.dropDuplicates(["digest"]).withColumn("prefix", F.substring("digest", 1, 2))
    objects.write.mode("overwrite").partitionBy("prefix").parquet(base)
    return rows.sparkSession.read.parquet(base)


def damaged_objects(objects: DataFrame) -> DataFrame:
    """Objects whose content doesn't have its digest."""
    return objects.filter(F.sha2("content", 256) != F.col("digest")).select("digest")


def export_json(tables: dict[str, DataFrame], path: str) -> None:
    """All tables as lines of canonical JSON (sorted keys), one folder for each table."""
    for name, df in tables.items():
        df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def import_json(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def files(spark: SparkSession, path: str, pattern: str = "*", limit_bytes: int = 25 * 1024 * 1024) -> DataFrame:
    """path, content and what it is taken for: too large, binary, PDF by its signature, or text that must be valid UTF-8."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    head = F.substring("content", 1, 5)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    kind = (
        F.when(F.col("length") > limit_bytes, "too_large")
        .when(head == F.lit(b"%PDF-"), "application/pdf")
        .when(F.locate("00", F.regexp_replace(F.hex(F.substring("content", 1, 4096)), "(..)", "$1 ")) > 0, "binary")
        .when(text.isNull(), "not_utf8")
        .when(F.lower("path").rlike(r"\.(md|markdown)$"), "text/markdown")
        .otherwise("text/plain")
    )
    return found.select("path", "modificationTime", "length", kind.alias("media_type"), F.when(kind.startswith("text/"), text).alias("text"))
