"""Queries over the stored index: build, sync, freshness, claims, nodes, whole searches and answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, retrieve, tree
from ..operators.search import BLEND, POOL, SUPPORT, query_terms
from ..sources.store import new_path
from ..sources.tables import evidence, statuses, table, transcripts
from .evidence import _NEAR, _PREFIXES, _SUPPORT, _TERMS, _TOKENS, QUESTION, _supported
from .registry import ORACLES, query
from .structure import _NODES

QUESTION_WORDS = tuple(query_terms(QUESTION))


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _bm25_sql(rows: str, prefixes: tuple[str, ...]) -> str:
    """key and score by BM25 of rows (key, w), for the words that start with the prefixes."""
    tf = ", ".join(f"len([x FOR x IN w IF starts_with(x, '{p}')])::DOUBLE AS tf{i}" for i, p in enumerate(prefixes))
    n = ", ".join(f"count_if(tf{i} > 0)::DOUBLE AS n{i}" for i in range(len(prefixes)))
    score = " + ".join(f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(prefixes)))
    some = " + ".join(f"tf{i}" for i in range(len(prefixes)))
    return f"bt AS (SELECT key, len(w)::DOUBLE AS dl, {tf} FROM ({rows})), bn AS (SELECT count(*)::DOUBLE AS n, avg(dl) AS mean, {n} FROM bt), bm AS (SELECT key, {score} AS score FROM bt, bn WHERE {some} > 0)"


@query()
def search_index(spark, sf_dir):
    """BM25 over stored postings, of which only the words' own blocks are read; the same as a scan of the texts."""
    docs = _docs(spark, sf_dir)
    built = index.build(docs, "doc_id", ("text",), version=1)
    found = index.top(docs, "doc_id", ("text",), " ".join(_PREFIXES), 10, built, 1)
    return found.select("doc_id", F.round("score", 6).alias("score"))


ORACLES["search_index"] = ORACLES["search_bm25"]

_SESSIONS = (
    "s AS (SELECT conv_id AS key, string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role) AS text FROM conversations"
    " WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY conv_id)"
)
#: Turns that a session had when it was indexed first.
OPENING = 2


def _synced(spark, sf_dir) -> tuple[index.Index, DataFrame]:
    """An index of the openings of all sessions, brought up to date with the sessions that went on and those that are consumed."""
    turns = table(spark, sf_dir, "conversations")
    consumed = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("conv_id")).distinct()
    whole = lambda t: transcripts(t).select("conv_id", F.col("transcript").alias("text"))
    first = index.build(whole(turns.filter(F.col("turn") < OPENING)), "conv_id", ("text",), version=1)
    later = turns.join(turns.filter(F.col("turn") >= OPENING).select("conv_id").distinct(), "conv_id", "left_semi")
    second = index.sync(first, whole(later), version=2)
    third = index.sync(second, consumed.withColumn("text", F.lit(None).cast("string")), version=3)
    return third, whole(turns.join(consumed, "conv_id", "left_anti"))


@query(f"WITH {_SESSIONS}, {_bm25_sql('SELECT key, ' + _TOKENS.format('text') + ' AS w FROM s', QUESTION_WORDS)} SELECT key AS conv_id, round(score, 6) AS score, 'postings' AS backend FROM bm ORDER BY bm.score DESC, key LIMIT 20")
def search_index_synced(spark, sf_dir):
    """Sessions whose later turns, and whose end, came by syncs: the index finds what a whole build would."""
    synced, sessions = _synced(spark, sf_dir)
    compacted = index.opened(spark, index.compact(synced, last=2).path)
    return index.top(sessions, "conv_id", ("text",), QUESTION, 20, compacted, 3).withColumn("score", F.round("score", 6))


@query(
    f"SELECT doc_id, score, 'term-count' AS backend FROM (SELECT doc_id, len([x FOR x IN {_TOKENS.format('text')} IF x IN ({_TERMS})])::DOUBLE AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10"
)
def search_stale_index(spark, sf_dir):
    """The texts have moved on since the index was built: terms are counted, and nothing is built in the search."""
    docs = _docs(spark, sf_dir)
    old = index.build(docs.filter("lang = 'en'"), "doc_id", ("text",), version=1)
    return index.top(docs, "doc_id", ("text",), QUESTION, 10, old, version=2)


@query(f"SELECT count(DISTINCT x) FILTER (starts_with(x, 'th')) > 0 AS found, true AS fewer FROM (SELECT unnest({_TOKENS.format('text')}) AS x FROM documents)")
def search_skips_blocks(spark, sf_dir):
    """Whether a search for the five best texts scored fewer blocks than its words have."""
    docs = _docs(spark, sf_dir)
    found = index.scan(index.build(docs, "doc_id", ("text",), version=1), "th", 5)
    return found.blocks.select((F.col("n_blocks") > 0).alias("found"), (F.col("n_scored") < F.col("n_blocks")).alias("fewer"))


# Claims: a claim in a document, with the document's source as its entity

_CLAIMS = "c AS (SELECT claim_id * 100000000 + ev.doc_id AS key, claim_id, claim_text AS text, ev.source AS entity, status FROM ev JOIN st ON st.doc_id = ev.doc_id)"
_CLAIM_WORDS = f"SELECT key, {_TOKENS.format('text')} || {_TOKENS.format('entity')} AS w FROM c"


def _kept(df: DataFrame, label: str) -> DataFrame:
    """Written once to the shared folder, as a search asks for it several times."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _claims(spark, sf_dir) -> DataFrame:
    docs = _docs(spark, sf_dir)
    rows = evidence(docs, table(spark, sf_dir, "benchmark")).join(statuses(docs, table(spark, sf_dir, "labels")), "doc_id")
    found = rows.select((F.col("claim_id") * 100_000_000 + F.col("doc_id")).alias("key"), "claim_id", F.col("claim_text").alias("text"), F.col("source").alias("entity"), "status")
    return _kept(found, "claims")


@query(f"{_CLAIMS}, {_bm25_sql(_CLAIM_WORDS, QUESTION_WORDS)} SELECT key, claim_id, entity, round(score, 6) AS score FROM bm JOIN c USING (key) WHERE status IN ('candidate', 'reviewed') ORDER BY bm.score DESC, key LIMIT 10", "ev st")
def search_claim_index(spark, sf_dir):
    """Claims by text and entity; the states are a filter on what is found, the ranks are those of all claims."""
    claims = _claims(spark, sf_dir)
    built = index.build(claims, "key", ("text", "entity"), version=1)
    allowed = claims.filter("status IN ('candidate', 'reviewed')").select("key")
    found = index.top(claims, "key", ("text", "entity"), QUESTION, 10, built, 1, allowed)
    return claims.join(F.broadcast(found), "key").select("key", "claim_id", "entity", F.round("score", 6).alias("score"))


_NODE_WORDS = f"SELECT doc_id * {retrieve.ORDERS} + document_order AS key, {_TOKENS.format('heading')} || {_TOKENS.format('content')} AS w FROM o"


def _nodes(spark, sf_dir) -> DataFrame:
    text = F.col("text")
    whole = lambda n, i: F.struct(i.alias("document_order"), n["heading"].alias("heading"), T.piece(text, n["start"], n["end"]).alias("content"))
    rows = tree.node_arrays(_docs(spark, sf_dir)).select("doc_id", F.inline(F.transform("nodes", whole)))
    return rows.select((F.col("doc_id") * retrieve.ORDERS + F.col("document_order")).alias("key"), "heading", "content")


@query(f"{_NODES.rstrip()}, {_bm25_sql(_NODE_WORDS, _PREFIXES)} SELECT key, round(score, 6) AS score, 'postings' AS backend FROM bm ORDER BY bm.score DESC, key % {retrieve.ORDERS}, key LIMIT 20")
def search_node_index(spark, sf_dir):
    """Nodes by heading and content; equal scores by their order in the document."""
    nodes = _nodes(spark, sf_dir)
    built = index.build(nodes, "key", ("heading", "content"), version=1)
    return retrieve.search_nodes(nodes, " ".join(_PREFIXES), built, 1)


@query(
    f"{_NODES} SELECT key, score, 'term-count' AS backend FROM (SELECT key, len([x FOR x IN w IF x IN ({_TERMS})])::DOUBLE AS score FROM ({_NODE_WORDS})) WHERE score > 0 ORDER BY score DESC, key LIMIT 20"
)
def search_nodes_counted(spark, sf_dir):
    """Nodes by counted terms, as without an index; equal scores by id."""
    return retrieve.search_nodes(_nodes(spark, sf_dir), QUESTION, None, 1)


# Whole searches. A claim's quotes are the texts that hold it, or its anchor of words

_HITS = f"h AS (SELECT c.*, round(score, 6) AS score FROM bm JOIN c USING (key) WHERE status IN ('candidate', 'reviewed') ORDER BY bm.score DESC, key LIMIT {POOL})"
_BOTH = _TOKENS.format("text || ' ' || coalesce(entity, '')")
_RANKED = (
    f"q AS (SELECT *, len(list_intersect(list_distinct({_BOTH}), [{_TERMS}])) / len(list_distinct({_BOTH} || [{_TERMS}]))::DOUBLE AS sem FROM h),"
    f" b AS (SELECT *, sem * {1 - BLEND} + CASE WHEN max(score) OVER () > 0 THEN score / max(score) OVER () ELSE 0 END * {BLEND} AS raw FROM q),"
    f" sup AS (SELECT claim_id, max(share) AS share, count(*)::BIGINT AS n_evidence FROM (SELECT claim_id, {_SUPPORT} AS share FROM near) GROUP BY claim_id)"
)


def _quotes(spark, sf_dir, claims: DataFrame) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", T.text_of("text").alias("quote"))
    near = _kept(_supported(spark, sf_dir).select("claim_id", "doc_id"), "near-claims").join(docs, "doc_id")
    return claims.select("key", "claim_id", F.col("text").alias("claim_text")).join(near, "claim_id").select("key", "claim_text", "quote")


@query(
    f"{_NEAR}, {_CLAIMS}, {_bm25_sql(_CLAIM_WORDS, QUESTION_WORDS)}, {_HITS}, {_RANKED}"
    f" SELECT place::INT AS place, key, entity, status, score, round(sem, 6) AS semantic_score, round(raw, 6) AS rank_score, round(share, 6) AS support, share >= {SUPPORT} AS supported, n_evidence,"
    f" 'lexical+semantic-rerank' AS method, 'postings' AS backend, {POOL} AS candidate_pool FROM (SELECT *, row_number() OVER (ORDER BY raw DESC, key) AS place FROM b) JOIN sup USING (claim_id) WHERE place <= 10",
    "ev st",
)
def search_whole(spark, sf_dir):
    """Pool, rerank, blend and citation check of one search, and how it was done."""
    claims = _claims(spark, sf_dir)
    built = index.build(claims, "key", ("text", "entity"), version=1)
    found = retrieve.search(claims, _quotes(spark, sf_dir, claims), QUESTION, built, 1, states=("candidate", "reviewed"), verify=True)
    return found.drop("text", "semantic_backend")


@query(
    f"{_NEAR}, {_CLAIMS}, {_bm25_sql(_CLAIM_WORDS, QUESTION_WORDS)}, {_HITS}, {_RANKED},"
    f" f AS (SELECT text, share >= {SUPPORT} AS fits, row_number() OVER (ORDER BY raw DESC, key) AS place FROM b JOIN sup USING (claim_id) QUALIFY place <= 8),"
    " g AS (SELECT text, row_number() OVER (ORDER BY place) AS n FROM f WHERE fits)"
    " SELECT 'all' AS exit, (SELECT string_agg(text || ' [' || n || ']', ' ' ORDER BY n) FROM g) AS answer, (SELECT count(*) FROM g)::BIGINT AS n_citations, (SELECT count(*) FROM g) = 0 AS insufficient, CASE WHEN (SELECT count(*) FROM g) = 0 THEN 'x' END AS reason"
    " UNION ALL SELECT 'no claim', NULL, 0, true, 'No matching claims in the requested review states.'"
    " UNION ALL SELECT 'no support', NULL, 0, true, 'Matching claims lacked citation support above the configured threshold.'",
    "ev st",
)
def ask_whole(spark, sf_dir):
    """An answer with citations, and both ways to have none: no claim in the states asked for, and none with support."""
    claims = _claims(spark, sf_dir)
    built = index.build(claims, "key", ("text", "entity"), version=1)
    quotes = _quotes(spark, sf_dir, claims)
    states = ("candidate", "reviewed")
    ways = {
        "all": retrieve.ask(claims, quotes, QUESTION, built, 1, states=states),
        "no claim": retrieve.ask(claims, quotes, QUESTION, built, 1, states=("superseded",)),
        "no support": retrieve.ask(claims, quotes, QUESTION, built, 1, states=states, ranking=retrieve.Ranking(threshold=1.1)),
    }
    out = [df.select(F.lit(name).alias("exit"), "answer", F.size("citations").cast("long").alias("n_citations"), "insufficient", "reason") for name, df in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])
