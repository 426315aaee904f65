"""Lexical retrieval: term counts, BM25 with prefix terms, rerank and citation support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import containment, jaccard, tokens

#: Parameters of the ranking, of the pool that is reranked, and of citations.
K1, B = 1.2, 0.75
POOL, BLEND, SUPPORT = 50, 0.25, 0.55


def query_terms(question: str) -> list[str]:
    """The folded words of a question, in order."""
    import re

    return re.findall(r"\w+", question.casefold())


def term_counts(rows: DataFrame, question: str, text: str = "text") -> DataFrame:
    """Adds score: how often the question's distinct words occur. Counted inside the row, so nothing is shuffled."""
    terms = sorted(set(query_terms(question)))
    hits = F.filter(tokens(F.col(text)), lambda t: t.isin(*terms)) if terms else F.array()
    return rows.withColumn("score", F.size(hits).cast("double")).filter("score > 0")


def _starts(prefix: str):
    return lambda t: t.startswith(prefix)


def bm25(rows: DataFrame, question: str, key: str, text: str = "text") -> DataFrame:
    """key and score of the rows that hold a word starting with a word of the question.

    One pass makes the term frequencies and lengths of all rows; the corpus totals are one row.
    """
    terms = query_terms(question)
    words = rows.select(key, tokens(F.coalesce(F.col(text), F.lit(""))).alias("w"))
    counts = [F.size(F.filter("w", _starts(p))).cast("double").alias(f"tf{i}") for i, p in enumerate(terms)]
    freq = words.select(key, F.size("w").cast("double").alias("len"), *counts)
    found = [F.sum((F.col(f"tf{i}") > 0).cast("double")).alias(f"n{i}") for i in range(len(terms))]
    total = freq.agg(F.count("*").cast("double").alias("rows"), F.avg("len").alias("mean"), *found)

    def weight(i: int) -> Column:
        n, tf = F.col(f"n{i}"), F.col(f"tf{i}")
        idf = F.log((F.col("rows") - n + 0.5) / (n + 0.5))
        norm = K1 * (1 - B + B * F.col("len") / F.col("mean"))
        return F.greatest(idf, F.lit(1e-6)) * tf * (K1 + 1) / (tf + norm)

    scored = freq.join(F.broadcast(total))  # one row
    return scored.filter(" + ".join(f"tf{i}" for i in range(len(terms))) + " > 0").select(key, sum((weight(i) for i in range(len(terms))), F.lit(0.0)).alias("score"))


def rerank(rows: DataFrame, question: str, text: str) -> DataFrame:
    """Adds semantic: the shared part of the words of the question and of a text."""
    terms = F.array(*[F.lit(t) for t in sorted(set(query_terms(question)))])
    return rows.withColumn("semantic", jaccard(F.array_distinct(tokens(F.col(text))), terms))


def blend(pool: DataFrame, key: str) -> DataFrame:
    """Adds rank_raw, of the rerank score and the lexical score over the pool's greatest. The pool is a top-k, so one window is small."""
    top = F.max("score").over(Window.partitionBy(F.lit(1)))
    lexical = F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0))
    return pool.withColumn("rank_raw", F.col("semantic") * (1 - BLEND) + lexical * BLEND)


def support(claim: Column, quote: Column) -> Column:
    """How far a quote covers a claim's words."""
    return containment(tokens(claim), F.array_distinct(tokens(quote)))
