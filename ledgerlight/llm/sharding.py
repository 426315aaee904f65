"""Proportional stratified interleaving: every shard gets the mixture of the sources.

Rows of a source are ranked in a seeded shuffled order; a row with rank r of n gets the fraction
(2r - 1) / 2n; all rows sorted by fraction are cut into shards whose row counts differ by one at
most (law ``rows``). A stretch of that order holds each source in proportion, so each shard does.

No window spans a source: rows are first dealt to cells of their shuffle hash, which is uniform, and
a rank is the count of the cells before plus the rank inside the cell. The global order is cut into
cells of the fraction in the same way. Only ids, sources and sizes are shuffled, never texts.

Defined cases: null sources form a source of their own; a null text has size 1 and checksum 0; null
doc_ids take part and sort first among equal hashes; repeated rows are dealt one by one; an empty
table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, text_or_empty

#: Rows that a cell is meant to hold, and the bounds of the number of cells.
CELL_ROWS, FEWEST, MOST = 20_000, 64, 1 << 16


def interleave(docs: DataFrame, shards: int = 16, seed: int = 11, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size, text_crc32, law, shard, slot, grown_shard and place, the row's number in the whole order."""
    cells = max(FEWEST, min(MOST, -(-docs.count() // cell_rows)))
    rows = docs.select(
        "doc_id",
        "source",
        (F.octet_length(text_or_empty("text")) + F.lit(1)).cast("long").alias("size"),
        F.crc32(F.encode(text_or_empty("text"), "UTF-8")).alias("text_crc32"),
        F.xxhash64(F.lit(seed), F.col("doc_id")).alias("h"),
    )
    rows = stored(rows.withColumn("cell", F.pmod(F.shiftright("h", 16), F.lit(cells)).cast("int")), "shard-rows")

    counts = rows.groupBy("source", "cell").agg(F.count("*").alias("n"))
    by_source = Window.partitionBy("source")
    before = counts.select(
        F.struct("source", "cell").alias("key"),
        (F.sum("n").over(by_source.orderBy("cell")) - F.col("n")).alias("before"),
        F.sum("n").over(by_source).alias("total"),
    )
    keyed = rows.withColumn("key", F.struct("source", "cell"))
    in_cell = Window.partitionBy("key").orderBy("h", "doc_id", "text_crc32", "size")
    ranked = keyed.join(before, "key").withColumn("rank", F.col("before") + F.row_number().over(in_cell))
    # The cell of the fraction is cut in whole numbers: (2r - 1) * cells div 2n.
    part = F.expr(f"((2 * rank - 1) * {cells}) div (2 * total)").cast("int")
    ranked = ranked.select("doc_id", "source", "size", "text_crc32", "h", ((2 * F.col("rank") - 1) / (2 * F.col("total"))).alias("fraction"), part.alias("part"))
    ranked = stored(ranked, "shard-ranks")

    # One row a cell, MOST at most: small enough for one window and for a broadcast.
    sizes = ranked.groupBy("part").agg(F.count("*").alias("n"))
    sizes = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"), F.sum("n").over(Window.partitionBy(F.lit(1))).alias("rows"))
    in_part = Window.partitionBy("part").orderBy("fraction", "h", "doc_id", "text_crc32", "size", "source")
    placed = ranked.join(F.broadcast(sizes), "part").withColumn("place", F.col("base") + F.row_number().over(in_part) - 1)
    shard = F.expr(f"(place * {shards}) div rows")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = F.expr(f"(shard * rows + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", "source", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        (F.col("place") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "place",
    )
