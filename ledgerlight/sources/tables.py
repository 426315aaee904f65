"""Readers of the given tables, and the model's tables derived from them.

A source is a value of ``documents.source``; a revision is a distinct text of a source, arrived with its
smallest doc_id; the text that came last, anew or again, is current. Claims are the ``benchmark`` items; evidence is a
document that holds a claim's text. Reviews follow from ``labels``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import digest, text_of


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def revisions(docs: DataFrame) -> DataFrame:
    """source, digest, arrival, copies, is_current: one row for each distinct text of a source. Texts aren't shuffled.

    Older bytes that arrive again become current again. A null source is a source of its own.
    """
    keyed = docs.select("source", digest(text_of("text")).alias("digest"), "doc_id")
    found = keyed.groupBy("source", "digest").agg(F.min("doc_id").alias("arrival"), F.max("doc_id").alias("latest"), F.count("*").alias("copies"))
    last = found.groupBy(F.col("source").alias("of")).agg(F.max("latest").alias("last"))
    joined = found.join(last, F.col("source").eqNullSafe(F.col("of")))
    return joined.select("source", "digest", "arrival", "copies", (F.col("latest") == F.col("last")).alias("is_current"))


def claims(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").alias("claim_id"), F.col("text").alias("claim_text")).filter("length(claim_text) > 0")


#: Words of a claim, from the second on, that anchor it; characters that anchor a claim of one or two words.
ANCHOR_WORDS, ANCHOR_CHARS = 4, 6


def _word_runs(words: Column, n: int) -> Column:
    """Hashes of n words in a row."""
    return F.transform(words, lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, n)]))


def _char_runs(text: Column, n: int) -> Column:
    at = F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1)))
    return F.transform(at, lambda i: F.xxhash64(F.substring(text, i, F.lit(n))))


def anchored(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, claim_id and claim_text of all pairs that share the claim's anchor.

    Words stand between spaces from a claim's second to its last but one, so a document that holds the claim has
    them as words: four of them, or one of claims of three to five words. Shorter claims are anchored by characters.
    """
    words = F.split("claim_text", r"\s+")
    kind = F.when(F.size(words) >= ANCHOR_WORDS + 2, -ANCHOR_WORDS).when(F.size(words) >= 3, -1).otherwise(F.least(F.length("claim_text"), F.lit(ANCHOR_CHARS)))
    ready = known.withColumn("kind", kind).withColumn("w", words)
    # At most 2 + ANCHOR_CHARS values.
    kinds = sorted(r.kind for r in ready.select("kind").distinct().collect())
    out = None
    for k in kinds:
        n = abs(k)
        runs = _word_runs(F.col("w"), n) if k < 0 else _char_runs(F.col("text"), n)
        anchor = F.xxhash64(*[F.get("w", F.lit(i)) for i in range(1, n + 1)]) if k < 0 else F.xxhash64(F.substring("claim_text", 1, n))
        # The words are a column of their own: an expression would be computed for each of them.
        at = docs.withColumn("w", F.split("text", r"\s+")).select("doc_id", F.explode(F.array_distinct(runs)).alias("anchor"))
        met = at.join(ready.filter(F.col("kind") == k).select(anchor.alias("anchor"), "claim_id", "claim_text"), "anchor").select("doc_id", "claim_id", "claim_text")
        out = met if out is None else out.unionByName(met)
    return docs.select("doc_id").join(known, F.lit(False)) if out is None else out


def evidence(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """claim_id, doc_id, source, digest, char_start, char_end: the first place of each claim's text in a document that holds it.

    Documents are joined with claims by anchors, then verified.
    """
    base = docs.select("doc_id", "source", text_of("text").alias("text"))
    hits = anchored(base.select("doc_id", "text"), claims(benchmark)).join(base, "doc_id").withColumn("at", F.instr("text", F.col("claim_text")))
    start = F.col("at") - 1
    return hits.filter("at > 0").select(
        "claim_id", "claim_text", "doc_id", "source", digest(F.col("text")).alias("digest"),
        start.alias("char_start"), (start + F.length("claim_text")).alias("char_end"),
        F.substring("text", F.col("at"), F.length("claim_text")).alias("quote"),
    )


def status() -> Column:
    """The state that quality and toxic lead to: approved ones are reviewed unless retracted, rejected ones retracted."""
    return (
        F.when(F.col("quality").isNull(), "candidate")
        .when((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), "reviewed")
        .otherwise("retracted")
    )


def statuses(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id and the state that its reviews lead to."""
    return docs.select("doc_id").join(labels, "doc_id", "left").select("doc_id", status().alias("status"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """conv_id and the turns of a conversation as blocks ``role: text``, joined by blank lines."""
    block = F.struct("turn", "role", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), text_of("text")).alias("block"))
    turns = conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(block)).alias("turns"))
    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.array_join("turns.block", "\n\n").alias("transcript"), F.col("turns.role").alias("roles"))
