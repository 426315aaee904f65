"""Queries over session memory: the merge of later sessions into what earlier ones left, and memory as text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory
from ..sources.tables import table
from .registry import query

#: Categories that a turn's candidates take in turn, and items of a section that are kept.
TURNS, KEPT = ("stable_fact", "working_rule", "open_question"), 40
_SECTION = "CASE turn % 3 " + " ".join(f"WHEN {i} THEN '{memory.SECTIONS[c]}'" for i, c in enumerate(TURNS)) + " END"
_NORM = "trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'))"
_CANDIDATES = (
    f"c AS (SELECT conv_id, turn, turn * 1000 + line AS number, 'session-' || conv_id AS session, {_SECTION} AS section, text, {_NORM} AS norm, ['low', 'medium', 'high'][(conv_id + turn) % 3 + 1] AS confidence, (conv_id + turn) % 3 + 1 AS rank,"
    " strftime(DATE '2024-01-01' + (conv_id % 300)::INT, '%Y-%m-%d') AS observed_at, CASE WHEN conv_id % 5 = 0 THEN strftime(DATE '2024-01-01' + (conv_id % 300)::INT, '%Y-%m-%d') ELSE '' END AS verified_at,"
    " CASE WHEN conv_id % 5 = 0 THEN 'verified' ELSE 'unverified' END AS verification_status, CASE WHEN conv_id % 3 = 0 THEN strftime(DATE '2024-02-01' + (conv_id % 300)::INT, '%Y-%m-%d') ELSE '' END AS stale_after, 'turns/' || turn AS path"
    " FROM (SELECT conv_id, turn, line, regexp_extract(x, '^\\S+ \\S+') AS text FROM (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM conversations)) WHERE text <> '')"
)


def _candidates(spark, sf_dir) -> DataFrame:
    """The first two words of every line of a session as a candidate; its facts follow from session and turn."""
    lines = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("line", "x"))
    day = lambda first: F.date_format(F.date_add(F.lit(first).cast("date"), (F.col("conv_id") % 300).cast("int")), "yyyy-MM-dd")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), (i + 1).cast("int"))
    every = lambda n, x: F.when(F.col("conv_id") % n == 0, x).otherwise("")
    return lines.select(
        F.struct(F.col("conv_id").alias("session"), (F.col("turn") * 1000 + F.col("line")).alias("number")).alias("at"), F.concat(F.lit("session-"), F.col("conv_id").cast("string")).alias("session"),
        pick(TURNS, F.col("turn") % 3).alias("category"), F.regexp_extract("x", r"^\S+ \S+", 0).alias("text"), pick(memory.CONFIDENCE, (F.col("conv_id") + F.col("turn")) % 3).alias("confidence"),
        day("2024-01-01").alias("observed_at"), F.lit("").alias("source_hint"), every(5, day("2024-01-01")).alias("verified_at"), F.when(F.col("conv_id") % 5 == 0, "verified").otherwise("unverified").alias("verification_status"),
        every(3, day("2024-02-01")).alias("stale_after"), F.array(F.concat(F.lit("turns/"), F.col("turn").cast("string"))).alias("related_paths"), F.array().cast("array<string>").alias("related_tasks"),
    )


_MERGED = (
    f"WITH {_CANDIDATES}, f AS (SELECT norm, arg_min(section, (conv_id, number)) AS s1, arg_min(text, (conv_id, number)) AS t1, min((conv_id, number)) AS born FROM c GROUP BY norm),"
    " o AS (SELECT c.*, s1, t1, born FROM c JOIN f USING (norm) WHERE section = s1 QUALIFY row_number() OVER (PARTITION BY norm, conv_id ORDER BY number) = 1),"
    " i AS (SELECT s1 AS section, norm, any_value(t1) AS text, any_value(born) AS born, count(*)::BIGINT AS n_sources, ['low', 'medium', 'high'][max(rank)] AS confidence, max(observed_at) AS observed_at, max(verified_at) AS verified_at,"
    " CASE WHEN bool_or(verification_status = 'verified') THEN 'verified' ELSE 'unverified' END AS verification_status, max(stale_after) AS stale_after, count(DISTINCT path)::BIGINT AS n_paths, sha256(string_agg(session, '; ' ORDER BY conv_id)) AS hint_digest FROM o GROUP BY norm, s1),"
    " q AS (SELECT norm, arg_min('Resolve: ' || text || ' vs ' || t1, (conv_id, number)) AS text, min((conv_id, number)) AS born FROM c JOIN f USING (norm) WHERE section <> s1 GROUP BY norm),"
    f" a AS (SELECT * FROM i UNION ALL SELECT '{memory.OPEN}', {_NORM}, text, born, 1, 'low', '', '', 'unverified', '', 0, sha256('') FROM q)"
    " SELECT section, 'mem-' || substr(sha1(section || chr(0) || norm), 1, 12) AS id, text, n_sources, confidence, observed_at, verified_at, verification_status, stale_after, n_paths, hint_digest,"
    f" row_number() OVER (PARTITION BY section ORDER BY born, text) <= {KEPT} AS kept FROM a"
)


@query(_MERGED)
def memory_consolidated(spark, sf_dir):
    """What the first half of the sessions left is the base; the others are merged into it: items, observations, open questions and the cap of each section."""
    found = _candidates(spark, sf_dir)
    half = table(spark, sf_dir, "conversations").agg((F.max("conv_id") / 2).alias("half")).first().half or 0
    empty = spark.createDataFrame([], memory.ITEM)
    first = memory.merge(empty, found.filter(F.col("at.session") < half), cap=KEPT)
    base = first.withColumn("place", F.col("at.session") * 1_000_000 + F.col("at.number")).drop("at", "change", "order", "kept")
    merged = memory.merge(base, found.filter(F.col("at.session") >= half), cap=KEPT)
    return merged.select(
        "section", "id", "text", F.size("sources").cast("long").alias("n_sources"), "confidence", "observed_at", "verified_at", "verification_status", "stale_after",
        F.size("related_paths").cast("long").alias("n_paths"), T.digest(F.col("source_hint")).alias("hint_digest"), "kept",
    )


_Q = "'\"' || {} || '\"'"
_FIELDS = (
    "'id: \"mem-' || substr(sha1(section || chr(0) || norm), 1, 12) || '\"'", f"'summary: ' || {_Q.format('text')}", f"'source_hint: ' || {_Q.format('session')}", f"'confidence: ' || {_Q.format('confidence')}",
    f"'observation_sessions: [' || {_Q.format('session')} || ']'", f"'observed_at: ' || {_Q.format('observed_at')}", f"'last_updated_at: ' || {_Q.format('observed_at')}", f"'verified_at: ' || {_Q.format('verified_at')}",
    f"'verification_status: ' || {_Q.format('verification_status')}", f"'stale_after: ' || {_Q.format('stale_after')}", f"'related_paths: [' || {_Q.format('path')} || ']'", "'related_tasks: []'",
)
_BLOCK = "'- ' || text || ' (updated: ' || observed_at || ')' || " + " || ".join(f"chr(10) || '  ' || {f}" for f in _FIELDS)
_SECTIONS_SQL = " || chr(10) || ".join(
    f"'## {s}' || chr(10) || chr(10) || coalesce(string_agg(block, chr(10) ORDER BY number) FILTER (section = '{s}'), '- {memory.NOTHING}') || chr(10)" for s in memory.ORDER
)


@query(
    f"WITH {_CANDIDATES} SELECT conv_id, count(*)::BIGINT AS n_items, sha256('# Project Memory' || chr(10) || chr(10) || 'Proposed consolidated memory (review before promote).' || chr(10) || chr(10) || {_SECTIONS_SQL}) AS digest, true AS same"
    f" FROM (SELECT conv_id, number, section, {_BLOCK} AS block FROM c) GROUP BY conv_id"
)
def memory_roundtrip(spark, sf_dir):
    """Every session's items as a memory text, and whether the items read from it are those that were written."""
    rows = memory.usable(_candidates(spark, sf_dir)).select(
        F.col("at.session").alias("conv_id"), F.col("at.number").alias("place"), "section", "text", F.array("session").alias("sources"), "confidence", "observed_at", F.col("observed_at").alias("last_updated_at"),
        T.short_id(F.col("section"), F.col("norm")).alias("id"), F.col("session").alias("source_hint"), "verified_at", "verification_status", "stale_after", "related_paths", "related_tasks",
    )
    texts = memory.render(rows, ["conv_id"])
    columns = [c for c in rows.columns if c not in ("conv_id", "place")]
    summed = lambda df: df.groupBy("conv_id").agg(F.count("*").alias("n_items"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("sum"))
    back = summed(memory.parse(texts, ["conv_id"])).select("conv_id", F.col("n_items").alias("n_back"), F.col("sum").alias("back"))
    met = summed(rows).join(texts, "conv_id").join(back, "conv_id", "left")
    return met.select("conv_id", "n_items", T.digest(F.col("memory")).alias("digest"), F.coalesce((F.col("n_items") == F.col("n_back")) & (F.col("sum") == F.col("back")), F.lit(False)).alias("same"))
