"""Search and answer over claims: pool, rerank, citation check, nodes and trace, as one chain of DataFrames.

Claims are rows (key, text, entity, status); evidence is (key, claim_text, quote), any number for each claim.
A pool is the top of a search, so what follows it is small.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, tokens
from . import index as stored_index
from .hooks import Scorer, scored_by
from .search import BLEND, POOL, SUPPORT, query_terms, support

# The states that a search may ask for.
STATES = ("candidate", "reviewed", "disputed", "stale", "superseded", "retracted")
MULTIPLIER = 5


@dataclass(frozen=True)
class Ranking:
    """``semantic`` is off, heuristic, or a scorer of (question, text with entity) lists; a scorer's nulls count as 0."""

    semantic: str | Scorer = "heuristic"
    citation: Scorer | None = None
    blend: float = BLEND
    threshold: float = SUPPORT

    @property
    def off(self) -> bool:
        return self.semantic == "off"

    def name(self) -> str:
        return self.semantic if isinstance(self.semantic, str) else "hook"


def _relevance(pool: DataFrame, question: str, ranking: Ranking) -> DataFrame:
    pool = pool.withColumn("both", F.concat_ws(" ", "text", F.coalesce("entity", F.lit(""))))
    if not isinstance(ranking.semantic, str):
        asked = scored_by(pool.withColumn("question", F.lit(question)), ranking.semantic, ["question", "both"], "semantic")
        return asked.withColumn("semantic", F.coalesce("semantic", F.lit(0.0))).drop("both", "question")
    terms = F.array(*[F.lit(t) for t in sorted(set(query_terms(question)))]).cast("array<string>")
    own = F.array_distinct(tokens(F.col("both")))
    return pool.withColumn("semantic", F.when((F.size(terms) > 0) & (F.size(own) > 0), jaccard(own, terms)).otherwise(F.lit(0.0))).drop("both")


def _cited(found: DataFrame, evidence: DataFrame, ranking: Ranking) -> DataFrame:
    """Adds support (the best of a claim's evidence, rounded) and supported, tested before rounding."""
    own = evidence.join(F.broadcast(found.select("key")), "key", "left_semi")  # a search's results
    if ranking.citation is None:
        rated = own.withColumn("share", support(F.col("claim_text"), F.col("quote")))
    else:
        rated = scored_by(own, ranking.citation, ["claim_text", "quote"], "share").withColumn("share", F.coalesce("share", F.lit(0.0)))
    best = rated.groupBy("key").agg(F.max("share").alias("share"), F.count("*").alias("n_evidence"))
    share = F.coalesce("share", F.lit(0.0))
    return found.join(best, "key", "left").select(*found.columns, F.round(share, 6).alias("support"), (share >= ranking.threshold).alias("supported"), F.coalesce("n_evidence", F.lit(0)).alias("n_evidence"))


def search(
    claims: DataFrame, evidence: DataFrame, question: str, index: stored_index.Index | None, version: int, limit: int = 10,
    states: tuple[str, ...] = ("reviewed",), ranking: Ranking = Ranking(), verify: bool = False,
) -> DataFrame:
    """place, key, text, entity, status, score, and with a ranking semantic_score and rank_score; with ``verify`` support and supported.

    Every row says with which method, backend and pool it was found.
    """
    if not question.strip():
        raise ValueError("a question must not be empty")
    if not states or not set(states) <= set(STATES):
        raise ValueError(f"unknown states: {sorted(set(states) - set(STATES))}")
    size = min(max(limit, limit * MULTIPLIER), POOL)
    allowed = claims.filter(F.col("status").isin(*states)).select("key")
    hits = stored_index.top(claims, "key", ("text", "entity"), question, size, index, version, allowed)
    pool = claims.join(F.broadcast(hits), "key").withColumn("score", F.round("score", 6))  # a pool of POOL rows at most
    if ranking.off:
        order = (F.desc("score"), F.col("key"))
        ranked = pool
    else:
        whole = Window.partitionBy(F.lit(1))
        top = F.max("score").over(whole)
        lexical = F.when(top > 0, F.col("score") / top).otherwise(F.lit(0.0))
        raw = F.col("semantic") * (1 - ranking.blend) + lexical * ranking.blend
        ranked = _relevance(pool, question, ranking).withColumn("raw", raw)
        order = (F.desc("raw"), F.col("key"))
    placed = ranked.withColumn("place", F.row_number().over(Window.orderBy(*order))).filter(F.col("place") <= limit)  # the pool alone
    columns: list[Column | str] = ["place", "key", "text", "entity", "status", "score"]
    if not ranking.off:
        columns += [F.round("semantic", 6).alias("semantic_score"), F.round("raw", 6).alias("rank_score")]
    method = F.lit("lexical" if ranking.off else "lexical+semantic-rerank")
    out = placed.select(*columns, method.alias("method"), "backend", F.lit(ranking.name()).alias("semantic_backend"), F.lit(size).alias("candidate_pool"))
    return _cited(out, evidence, ranking) if verify and not ranking.off else out


def search_nodes(nodes: DataFrame, question: str, index: stored_index.Index | None, version: int, limit: int = 20) -> DataFrame:
    """The nodes (key, document_order, heading, content) that answer best; equal scores by order in the index, by key in the term count."""
    fresh = index is not None and index.version == version
    rows = stored_index.top(nodes, "key", ("heading", "content"), question, limit, index, version, ties=_node_order() if fresh else ())
    return rows.withColumn("score", F.round("score", 6))


#: A node's key is its document's number and its order, in this many digits.
ORDERS = 1_000_000


def _node_order() -> tuple[Column, ...]:
    return F.col("key") % ORDERS, F.col("key")


def ask(
    claims: DataFrame, evidence: DataFrame, question: str, index: stored_index.Index | None, version: int, limit: int = 8,
    states: tuple[str, ...] = ("reviewed",), ranking: Ranking = Ranking(),
) -> DataFrame:
    """One row: answer (numbered statements), citations (number, key, status, support), insufficient and the reason."""
    found = search(claims, evidence, question, index, version, limit, states, ranking, verify=True)
    supported = F.lit(True) if ranking.off else F.col("supported")
    share = F.lit(None).cast("double") if ranking.off else F.col("support")
    cited = found.withColumn("fits", supported).withColumn("number", F.sum(F.col("fits").cast("int")).over(Window.orderBy("place")))  # at most ``limit`` rows
    line = F.when(F.col("fits"), F.struct("number", F.concat("text", F.lit(" ["), F.col("number").cast("string"), F.lit("]")).alias("line")))
    citation = F.when(F.col("fits"), F.struct("number", "key", "status", share.alias("support")))
    none = F.count("*") == 0
    without = F.count_if("fits") == 0
    reason = F.when(none, "No matching claims in the requested review states.").when(without, "Matching claims lacked citation support above the configured threshold.")
    answer = F.array_join(F.sort_array(F.collect_list(line))["line"], " ")
    return cited.agg(
        F.lit(question).alias("question"), F.when(~without, answer).alias("answer"), F.sort_array(F.collect_list(citation)).alias("citations"),
        without.alias("insufficient"), reason.alias("reason"),
    )
