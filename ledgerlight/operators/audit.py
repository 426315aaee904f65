"""All checks of the record in one pass, and running budgets without a window over a whole group.

A record is a revision with what belongs to it: its bytes as stored, claims, evidence, dependencies, rendered pages and
contradictions. Faults that a record shows alone leave its row as they are found; for what must exist elsewhere the row
sends a wanted or a present mark, and one grouped count finds the wanted ones without a present one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# The names of the faults.
FAULTS = (
    "missing_source_bytes", "source_digest_mismatch", "evidence_quote_mismatch", "invalid_locator", "reviewed_claim_without_evidence", "missing_dependency",
    "rendered_page_missing", "render_conflict", "invalid_contradiction",
)
RECORD = (
    "revision string, digest string, stored string, text string, claims array<struct<claim:string,status:string>>, evidence array<struct<evidence:string,claim:string,start:int,end:int,quote:string>>,"
    " dependencies array<string>, pages array<struct<path:string,digest:string,content:string>>, contradictions array<struct<id:string,left:string,right:string>>"
)



def _fault(name: str, key: Column) -> Column:
    return F.struct(F.lit(name).alias("fault"), key.alias("key"), F.lit(None).cast("string").alias("wants"), F.lit(None).cast("int").alias("mark"))


def _mark(name: str, key: Column, wants: Column, mark: int) -> Column:
    """``mark`` 1: something is there; 0: it is wanted by ``key``."""
    return F.struct(F.lit(name).alias("fault"), key.alias("key"), wants.alias("wants"), F.lit(mark).alias("mark"))


def validate(records: DataFrame) -> DataFrame:
    """fault and key of all that is wrong; ``records`` is read once.

    An empty or missing list has nothing to check, nor has a missing revision bytes. Evidence is resolved in its own record's text. A reviewed claim needs a piece of evidence in any record, an end of a
    contradiction a claim in any record; both are told once for each claim or contradiction.
    """
    list_of = lambda c: F.coalesce(F.col(c), F.filter(F.col(c), lambda x: F.lit(False)))
    none = F.array().cast("array<struct<fault:string,key:string,wants:string,mark:int>>")
    if_ = lambda test, rows: F.when(F.coalesce(test, F.lit(False)), rows).otherwise(none)
    own = F.when(F.col("revision").isNull(), none).when(F.col("stored").isNull(), F.array(_fault("missing_source_bytes", F.col("revision")))).when(T.digest(F.col("stored")) != F.col("digest"), F.array(_fault("source_digest_mismatch", F.col("revision")))).otherwise(none)

    def of_evidence(e: Column) -> Column:
        inside = (e["start"] >= 0) & (e["end"] > e["start"]) & (e["end"] <= F.length("text"))
        wrong = F.when(~F.coalesce(inside, F.lit(False)), F.array(_fault("invalid_locator", e["evidence"]))).when(~T.piece(F.col("text"), e["start"], e["end"]).eqNullSafe(e["quote"]), F.array(_fault("evidence_quote_mismatch", e["evidence"]))).otherwise(none)
        alone = if_(~F.array_contains(F.coalesce("dependencies", F.array().cast("array<string>")), e["claim"]), F.array(_fault("missing_dependency", e["evidence"])))
        return F.concat(wrong, alone, F.array(_mark("reviewed_claim_without_evidence", e["claim"], e["claim"], 1)))

    def of_claim(c: Column) -> Column:
        wanted = if_(c["status"] == "reviewed", F.array(_mark("reviewed_claim_without_evidence", c["claim"], c["claim"], 0)))
        return F.concat(F.array(_mark("invalid_contradiction", c["claim"], c["claim"], 1)), wanted)

    def of_page(p: Column) -> Column:
        return F.when(p["content"].isNull(), F.array(_fault("rendered_page_missing", p["path"]))).when(T.digest(p["content"]) != p["digest"], F.array(_fault("render_conflict", p["path"]))).otherwise(none)

    def of_pair(p: Column) -> Column:
        return F.array(*[_mark("invalid_contradiction", p["id"], p[side], 0) for side in ("left", "right")])

    parts = [F.flatten(F.transform(F.col(c), f)) for c, f in (("evidence", of_evidence), ("claims", of_claim), ("pages", of_page), ("contradictions", of_pair))]
    found = records.select(F.inline(F.concat(own, *[F.coalesce(p, none) for p in parts])))
    # A null end of a contradiction is an end that doesn't exist. A fault of a row's own wants nothing but itself.
    wants = F.when(F.col("mark").isNull(), F.coalesce("key", F.lit(""))).otherwise(F.coalesce("wants", F.lit("")))
    keyed = found.select("fault", "mark", wants.alias("wants"), F.when(F.col("mark") == 1, F.lit(None)).otherwise(F.col("key")).alias("key"))
    counted = keyed.groupBy("fault", "wants", "mark", "key").agg(F.count("*").alias("n"))
    there = F.max(F.coalesce((F.col("mark") == 1) & (F.col("wants") != ""), F.lit(False))).over(Window.partitionBy("fault", "wants"))
    left = counted.withColumn("there", there).filter("mark IS NULL OR (mark = 0 AND NOT there)")
    # What is wanted is told once for each that wants it, a contradiction without both ends once as well.
    once = left.groupBy("fault", "key").agg(F.sum(F.when(F.col("mark").isNull(), F.col("n")).otherwise(0)).alias("own"), F.max("mark").alias("dangling"))
    times = F.greatest(F.col("own"), F.when(F.col("dangling") == 0, 1).otherwise(0))
    return once.select("fault", "key", F.explode(F.sequence(F.lit(1).cast("long"), times)).alias("i")).select("fault", "key")


def running(rows: DataFrame, group: str, order: str, size: str, cell: int) -> DataFrame:
    """Adds used: the sum of ``size`` of the rows of a group up to a row, by ``order`` (whole numbers), equal ones together.

    Rows are added up in cells of the order; only the cells' sums, one for each ``cell`` numbers, meet in a window of the group. A null size is 0, a null group a group of its own.
    """
    sized = rows.withColumn("_cell", F.floor(F.col(order) / cell)).withColumn("_size", F.coalesce(F.col(size), F.lit(0)).cast("long"))
    sums = sized.groupBy(F.col(group).alias("_of"), F.col("_cell").alias("_at")).agg(F.sum("_size").alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_of").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = sums.select("_of", "_at", before.alias("_before"))
    within = F.sum("_size").over(Window.partitionBy(group, "_cell").orderBy(order))
    met = sized.withColumn("_within", within).join(carried, (F.col("_cell") == F.col("_at")) & F.col(group).eqNullSafe(F.col("_of")))
    return met.select(*rows.columns, (F.col("_before") + F.col("_within")).alias("used"))
