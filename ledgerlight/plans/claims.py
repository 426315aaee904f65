"""Queries over claims as records: rows, states, supersession, contradictions, proposals, reads, intake and search of claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import index, search
from ..operators.apply import LONGEST, apply, may_follow
from ..operators.detection import PRIVATE_IP
from ..operators.redaction import redacted, residual
from ..sources.store import new_path
from ..sources.tables import evidence, revisions, statuses, table
from .evidence import _PREFIXES, _TERMS, _TOKENS, QUESTION
from .registry import query
from .structure import _MEMORY, _NODES, _memory_items

#: What a review aims at, and the states from which it may be given beyond the table above.
REVIEWS = {"approve": ("reviewed", ("candidate", "disputed")), "reject": ("retracted", ("candidate", "disputed")), "retract": ("retracted", ("reviewed", "disputed"))}


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _ev(spark, sf_dir):
    return evidence(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def _labels(spark, sf_dir):
    return table(spark, sf_dir, "labels")


def _current(spark, sf_dir):
    return revisions(_docs(spark, sf_dir)).select("source", "digest", "is_current")


@query("SELECT claim_id, ev.doc_id, source, lower(source) AS slug, is_current, status FROM ev JOIN cur USING (source, digest) JOIN st ON st.doc_id = ev.doc_id", "rev cur ev st")
def claim_rows(spark, sf_dir):
    """Evidence with its entity, whether its revision is current, and the state of its document."""
    rows = _ev(spark, sf_dir).join(_current(spark, sf_dir), ["source", "digest"]).join(statuses(_docs(spark, sf_dir), _labels(spark, sf_dir)), "doc_id")
    return rows.select("claim_id", "doc_id", "source", T.slugify(F.col("source")).alias("slug"), "is_current", "status")


def folded_states(events: Column) -> Column:
    """(state, refused) after a claim's events in order; an event that may not follow is refused and counted."""
    start = F.struct(F.lit("candidate").alias("state"), F.lit(0).alias("refused"))

    def step(acc: Column, after: Column) -> Column:
        fits = may_follow(acc["state"], after)
        return F.struct(F.when(fits, after).otherwise(acc["state"]).alias("state"), (acc["refused"] + F.when(fits, 0).otherwise(1)).alias("refused"))

    return F.aggregate(events, start, step)


_STATE = (
    "SELECT claim_id, ev.doc_id, is_current, quality, toxic, CASE WHEN quality IS NULL THEN 'candidate' WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 'reviewed' ELSE 'retracted' END AS s,"
    " CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END AS r FROM ev JOIN cur USING (source, digest) LEFT JOIN labels l ON l.doc_id = ev.doc_id"
)


@query(f"SELECT claim_id, doc_id, CASE WHEN NOT is_current AND s <> 'retracted' THEN 'stale' ELSE s END AS state, (r + CASE WHEN NOT is_current AND s = 'retracted' THEN 1 ELSE 0 END)::INT AS n_refused FROM ({_STATE})", "rev cur ev")
def claim_states(spark, sf_dir):
    """The fold of each claim's reviews, and of the change of its source's current revision at the end."""
    rows = _ev(spark, sf_dir).join(_current(spark, sf_dir), ["source", "digest"]).join(_labels(spark, sf_dir), "doc_id", "left")
    events = F.array_compact(F.array(
        F.when(F.col("quality") == 1, "reviewed").when(F.col("quality") == 0, "retracted"), F.when(F.col("toxic") == 1, "retracted"), F.when(~F.col("is_current"), "stale"),
    ))
    return rows.withColumn("f", folded_states(events)).select("claim_id", "doc_id", F.col("f.state").alias("state"), F.col("f.refused").alias("n_refused"))


@query(
    "SELECT action, before, count(*)::BIGINT AS n, bool_and(allowed) AS allowed FROM (SELECT CASE WHEN quality = 1 THEN 'approve' ELSE 'reject' END AS action, 'candidate' AS before, true AS allowed FROM labels"
    " UNION ALL SELECT 'retract', CASE WHEN quality = 1 THEN 'reviewed' ELSE 'retracted' END, quality = 1 FROM labels WHERE toxic = 1) GROUP BY ALL"
)
def review_transitions(spark, sf_dir):
    """Reviews by the state that they meet, and whether they may be given there."""
    labels = _labels(spark, sf_dir)
    first = labels.select(F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("action"), F.lit("candidate").alias("before"))
    then = labels.filter("toxic = 1").select(F.lit("retract").alias("action"), F.when(F.col("quality") == 1, "reviewed").otherwise("retracted").alias("before"))
    allowed = reduce(lambda a, b: a | b, [(F.col("action") == k) & F.col("before").isin(*held) & may_follow(F.col("before"), F.lit(aim)) for k, (aim, held) in REVIEWS.items()])
    return first.union(then).groupBy("action", "before").agg(F.count("*").alias("n"), F.bool_and(allowed).alias("allowed"))


@query(
    f"SELECT claim_id, prior_id, doc_id AS next_id, prior_state, prior_state IN ('reviewed', 'disputed', 'stale') AS allowed FROM (SELECT claim_id, doc_id, lag(doc_id) OVER w AS prior_id, lag(s) OVER w AS prior_state FROM (SELECT x.*, d.source FROM ({_STATE}) x JOIN documents d USING (doc_id))"
    " WINDOW w AS (PARTITION BY claim_id, source ORDER BY doc_id)) WHERE prior_id IS NOT NULL",
    "rev cur ev",
)
def superseded_claims(spark, sf_dir):
    """A claim that a source states again supersedes the one before, unless that is still a candidate or gone."""
    rows = _ev(spark, sf_dir).join(statuses(_docs(spark, sf_dir), _labels(spark, sf_dir)), "doc_id")
    w = Window.partitionBy("claim_id", "source").orderBy("doc_id")
    prior = rows.select("claim_id", F.lag("doc_id").over(w).alias("prior_id"), F.col("doc_id").alias("next_id"), F.lag("status").over(w).alias("prior_state")).filter("prior_id IS NOT NULL")
    return prior.withColumn("allowed", may_follow(F.col("prior_state"), F.lit("superseded")) | (F.col("prior_state") == "stale"))


@query(
    "SELECT DISTINCT least(a, b) AS left_id, greatest(a, b) AS right_id, greatest(a, b) AS disputed_id FROM (SELECT claim_id AS b, lag(claim_id) OVER (PARTITION BY doc_id ORDER BY char_start, claim_id) AS a FROM ev) WHERE a IS NOT NULL",
    "ev",
)
def contradiction_pairs(spark, sf_dir):
    """Neighbouring claims of a document as sorted pairs, each once; only the newer claim is disputed."""
    before = F.lag("claim_id").over(Window.partitionBy("doc_id").orderBy("char_start", "claim_id"))
    pairs = _ev(spark, sf_dir).select(F.col("claim_id").alias("b"), before.alias("a")).filter("a IS NOT NULL")
    left, right = F.least("a", "b"), F.greatest("a", "b")
    return pairs.select(left.alias("left_id"), right.alias("right_id"), right.alias("disputed_id")).distinct()


@query("SELECT DISTINCT source FROM documents d WHERE EXISTS (SELECT 1 FROM ev JOIN cur USING (source, digest) JOIN st ON st.doc_id = ev.doc_id WHERE ev.source = d.source AND is_current AND status = 'reviewed')", "rev cur ev st")
def entities_with_reviewed(spark, sf_dir):
    """Entities that have a reviewed claim in their current revision."""
    held = claim_rows(spark, sf_dir).filter("is_current AND status = 'reviewed'")
    return _docs(spark, sf_dir).select("source").distinct().join(held, "source", "left_semi")


@query("SELECT DISTINCT claim_id, source, digest FROM ev", "ev")
def dependency_edges(spark, sf_dir):
    """The revisions that each claim rests on; an edge that is there already is ignored."""
    return _ev(spark, sf_dir).select("claim_id", "source", "digest").dropDuplicates(["claim_id", "source", "digest"])


@query("SELECT d.doc_id, d.source FROM labels l JOIN documents d USING (doc_id) JOIN cur c ON c.source = d.source AND c.digest = sha256(coalesce(d.text, '')) WHERE NOT is_current", "rev cur")
def stale_inputs(spark, sf_dir):
    """Labelled documents whose text isn't the current one of its source."""
    old = _current(spark, sf_dir).filter("NOT is_current").select("source", "digest")
    docs = _docs(spark, sf_dir).select("doc_id", "source", T.digest(T.text_of("text")).alias("digest"))
    return docs.join(_labels(spark, sf_dir), "doc_id", "left_semi").join(old, ["source", "digest"], "left_semi").select("doc_id", "source")


# Proposals: a run has the texts of DOCS_OF_RUN documents, and a claim of each; faults are planted by rule. A document that isn't
# retracted is current; the claims that exist are those of ``benchmark`` in the documents that hold them.

DOCS_OF_RUN, STATE = 3, 7
_RULES = {
    "closed": "run % 41 = 1", "old_state": "run % 37 = 2", "moved": "doc_id % 53 = 3", "long": "doc_id % 211 = 4", "foreign": "doc_id % 101 = 5", "misquoted": "doc_id % 43 = 6", "twice": "doc_id % 5 = 1",
}
_PROPOSED = (
    "line AS (SELECT doc_id, source, t, coalesce([x FOR x IN ls IF length(x) > 30][1], [x FOR x IN ls IF length(x) > 0][1]) AS claim FROM (SELECT doc_id, source, text AS t, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(text, chr(10))] AS ls FROM documents)),"
    f" held AS (SELECT doc_id, min(claim_id) AS claim_id, min_by(claim_text, claim_id) AS claim_text FROM ev GROUP BY doc_id), d AS (SELECT line.doc_id, source, t, line.doc_id // {DOCS_OF_RUN} AS run, status, CASE WHEN line.doc_id % 2 = 0 THEN coalesce(claim_text, claim) ELSE claim END AS claim, claim_id, CASE WHEN line.doc_id % 2 = 1 THEN claim_id END AS prior FROM line LEFT JOIN held USING (doc_id) JOIN st ON st.doc_id = line.doc_id WHERE claim IS NOT NULL),"
    f" p AS (SELECT *, doc_id * 2 AS number, false AS again FROM d UNION ALL SELECT *, doc_id * 2 + 1, true FROM d WHERE {_RULES['twice']}),"
    f" x AS (SELECT *, CASE WHEN {_RULES['closed']} THEN 0 WHEN {_RULES['old_state']} THEN 1 WHEN bool_or(status = 'retracted' OR {_RULES['moved']}) OVER (PARTITION BY run) THEN 2 END AS run_fault,"
    f" CASE WHEN {_RULES['long']} OR length(claim) > 4000 THEN 4 WHEN {_RULES['foreign']} THEN 5 WHEN {_RULES['misquoted']} THEN 6 END AS own_fault,"
    " (doc_id % 2 = 0 AND claim_id IS NOT NULL) OR again AS double FROM p),"
    " y AS (SELECT *, coalesce(own_fault, CASE WHEN NOT double AND prior IS NOT NULL AND status NOT IN ('reviewed', 'disputed', 'stale') THEN 7 END) AS f FROM x)"
)


def _proposals(spark, sf_dir):
    """The tables of ``apply``, from documents, benchmark and labels."""
    docs, rule = _docs(spark, sf_dir), {k: F.expr(v.replace(" = ", " == ")) for k, v in _RULES.items()}
    # What is asked of the texts is asked before they meet other tables, so that texts are shuffled only where quotes are compared with them.
    path = new_path(spark, "evidence")
    _ev(spark, sf_dir).select("claim_id", "claim_text", "doc_id", "source", "char_start").write.parquet(path)
    ev = spark.read.parquet(path)
    first = F.min_by(F.struct("claim_id", "claim_text", "char_start"), "claim_id")
    held = ev.groupBy("doc_id").agg(first.alias("h"))
    lines = F.transform(F.split("text", "\n"), T.strip)
    own = F.coalesce(F.get(F.filter(lines, lambda x: F.length(x) > 30), F.lit(0)), F.get(F.filter(lines, lambda x: F.length(x) > 0), F.lit(0)))
    now = T.digest(F.col("text"))
    asked = docs.select("doc_id", "source", "text", own.alias("own")).filter("own IS NOT NULL")
    asked = asked.select("doc_id", "source", "own", (F.instr("text", F.col("own")) - 1).alias("own_start"), now.alias("now"), T.digest(F.concat("text", F.lit("old"))).alias("old"))
    even = (F.col("doc_id") % 2 == 0) & F.col("h").isNotNull()
    rows = asked.join(held, "doc_id", "left").select(
        "doc_id", "source", "now", "old", F.floor(F.col("doc_id") / DOCS_OF_RUN).alias("run"), F.when(even, F.col("h.claim_text")).otherwise(F.col("own")).alias("claim"),
        F.when(even, F.col("h.char_start")).otherwise(F.col("own_start")).alias("start"), F.when(F.col("doc_id") % 2 == 1, F.col("h.claim_id")).alias("prior"),
    )
    numbers = F.when(rule["twice"], F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1)).otherwise(F.array(F.col("doc_id") * 2))
    each = rows.withColumn("number", F.explode(numbers))
    key = lambda claim: claim * 100_000_000 + F.col("doc_id")
    # Padding adds to a claim and never cuts it: one cut at a space would be short enough again once that is stripped.
    stated = F.when(rule["long"], F.concat("claim", F.repeat(F.lit("x"), LONGEST + 1))).otherwise(F.col("claim"))
    proposals = each.select(F.col("run").alias("run_id"), "number", F.col("source").alias("entity"), stated.alias("text"), key(F.col("prior")).alias("supersedes"), F.array().cast("array<long>").alias("contradicts"))
    quotes = each.select(F.col("run").alias("run_id"), "number", F.when(rule["foreign"], F.col("doc_id") + DOCS_OF_RUN).otherwise(F.col("doc_id")).alias("revision"), "start", (F.col("start") + F.length("claim")).alias("end"), F.when(rule["misquoted"], F.concat("claim", F.lit("x"))).otherwise(F.col("claim")).alias("quote"))
    state = F.when(rule["old_state"], STATE - 1).otherwise(STATE)
    runs = rows.select("run").distinct().select(F.col("run").alias("run_id"), F.when(rule["closed"], "completed").otherwise("exported").alias("status"), state.alias("state_version"), F.lit(STATE).alias("result_version"))
    current = statuses(docs, _labels(spark, sf_dir)).select(F.col("doc_id").alias("revision"), (F.col("status") != "retracted").alias("is_current"))
    revisions_of = docs.filter("text IS NOT NULL").select(F.col("doc_id").alias("revision"), now.alias("digest"), "text").join(current, "revision")
    inputs = rows.select(F.col("run").alias("run_id"), F.col("doc_id").alias("revision"), F.when(rule["moved"], F.col("old")).otherwise(F.col("now")).alias("digest"))
    known = ev.join(statuses(docs, _labels(spark, sf_dir)), "doc_id").withColumn("claim", key(F.col("claim_id")))
    claims = known.select("claim", F.col("source").alias("entity"), T.digest(F.col("claim_text")).alias("digest"), "status", F.lit(True).alias("is_current"))
    return runs, inputs, proposals, quotes, revisions_of, claims, known.select("claim", F.col("doc_id").alias("revision"))


@query(
    f"{_PROPOSED} SELECT run AS run_id, CASE WHEN max(fault) IS NULL THEN 'applied' ELSE 'refused' END AS outcome, ['run closed', 'stale state', 'stale input', 'entity', 'text', 'revision not in request', 'quote', 'supersession', 'contradiction target'][max(fault) + 1] AS reason, max(spot) AS at_proposal,"
    " CASE WHEN max(fault) IS NULL THEN count_if(NOT double) ELSE 0 END::BIGINT AS n_created, CASE WHEN max(fault) IS NULL THEN count_if(double) ELSE 0 END::BIGINT AS n_reused"
    " FROM (SELECT *, coalesce(run_fault, (first_value(f) OVER w)) AS fault, CASE WHEN run_fault IS NULL THEN first_value(CASE WHEN f IS NOT NULL THEN number END) OVER w END AS spot FROM y WINDOW w AS (PARTITION BY run ORDER BY f IS NULL, number ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY run",
    "ev st",
)
def applied_runs(spark, sf_dir):
    """What became of each run of proposals: applied whole, or refused for the first fault of any of its proposals."""
    return apply(*_proposals(spark, sf_dir), STATE).outcomes


@query(
    f"{_PROPOSED}, bad AS (SELECT DISTINCT run FROM y WHERE coalesce(run_fault, f) IS NOT NULL) SELECT claim_id * 100000000 + doc_id AS claim, status AS before, doc_id * 2 AS at_proposal FROM (SELECT y.*, prior AS held FROM y) WHERE prior IS NOT NULL AND NOT double AND run NOT IN (SELECT run FROM bad)",
    "ev st",
)
def superseded_by_apply(spark, sf_dir):
    """Claims that a new claim of their entity took the place of, with the state that they had."""
    tables = _proposals(spark, sf_dir)
    found = apply(*tables, STATE)
    before = tables[5].select("claim", F.col("status").alias("before"))
    return found.superseded.join(found.created.select(F.col("claim").alias("next_claim"), F.col("number").alias("at_proposal")), "next_claim").join(before, "claim").select("claim", "before", "at_proposal")


@query("SELECT (SELECT count(*) FROM rev)::BIGINT AS n_ingested, (SELECT count(*) FROM labels WHERE quality IS NOT NULL)::BIGINT AS n_reviews, ((SELECT count(*) FROM rev) + (SELECT count(*) FROM labels WHERE quality IS NOT NULL))::BIGINT AS version", "rev")
def state_version(spark, sf_dir):
    """The version that all canonical changes lead to: arrivals of new texts and reviews."""
    n = revisions(_docs(spark, sf_dir)).agg(F.count("*").alias("n_ingested"))
    r = _labels(spark, sf_dir).filter("quality IS NOT NULL").agg(F.count("*").alias("n_reviews"))
    return n.join(F.broadcast(r)).withColumn("version", F.col("n_ingested") + F.col("n_reviews"))  # one row each


@query("SELECT c.source, c.arrival, c.digest, c.is_current, length(text)::BIGINT AS n_chars FROM cur c JOIN documents d ON d.doc_id = c.arrival WHERE c.source = 'src1'", "rev cur")
def source_history(spark, sf_dir):
    """The revisions of one source: its key reaches the scan."""
    docs = _docs(spark, sf_dir).filter("source = 'src1'")
    sizes = docs.select(F.col("doc_id").alias("arrival"), F.length("text").cast("long").alias("n_chars"))
    return revisions(docs).join(sizes, "arrival").select("source", "arrival", "digest", "is_current", "n_chars")


@query(f"{_NODES} SELECT doc_id, count_if(parent_order IS NULL)::BIGINT AS n_roots, count_if(parent_order = 0)::BIGINT AS n_below_root FROM o GROUP BY doc_id")
def tree_children(spark, sf_dir):
    """Nodes without a parent and those below the root, by one null-safe test each."""
    from ..operators import tree

    n = tree.nodes(_docs(spark, sf_dir))
    below = lambda x: F.count_if(F.col("parent_order").eqNullSafe(x))
    return n.groupBy("doc_id").agg(below(F.lit(None).cast("int")).alias("n_roots"), below(F.lit(0)).alias("n_below_root"))


# Retrieval of claims; the stored index is in retrieval.py


@query(f"SELECT term, doc_id, count(*)::INT AS tf FROM (SELECT doc_id, unnest({_TOKENS.format('text')}) AS term FROM documents) GROUP BY ALL")
def postings(spark, sf_dir):
    return index.postings(_docs(spark, sf_dir), "doc_id", "text")


_POOLED = (
    f"p AS (SELECT claim_id, min(doc_id) AS doc_id, any_value(claim_text) AS claim_text, len([x FOR x IN {_TOKENS.format('any_value(claim_text)')} IF x IN ({_TERMS})])::DOUBLE AS score"
    " FROM ev JOIN st USING (doc_id) WHERE status = 'reviewed' GROUP BY claim_id)"
)


@query(
    f"{_POOLED}, q AS (SELECT *, len(list_intersect(list_distinct({_TOKENS.format('claim_text')}), [{_TERMS}])) / len(list_distinct({_TOKENS.format('claim_text')} || [{_TERMS}]))::DOUBLE AS sem FROM p WHERE score > 0 ORDER BY score DESC, claim_id LIMIT {search.POOL}),"
    f" b AS (SELECT *, sem * {1 - search.BLEND} + score / (max(score) OVER ()) * {search.BLEND} AS raw FROM q) SELECT claim_id, doc_id, round(raw, 6) AS rank_score, row_number() OVER (ORDER BY raw DESC, claim_id)::INT AS place FROM b ORDER BY raw DESC, claim_id LIMIT 10",
    "ev st",
)
def search_claims(spark, sf_dir):
    """Reviewed claims alone: pool by term count, rerank and blend, then the ten best with the evidence that comes first."""
    held = _ev(spark, sf_dir).join(statuses(_docs(spark, sf_dir), _labels(spark, sf_dir)).filter("status = 'reviewed'"), "doc_id")
    rows = held.groupBy("claim_id").agg(F.min("doc_id").alias("doc_id"), F.first("claim_text").alias("claim_text"))
    pool = search.term_counts(rows, QUESTION, "claim_text").orderBy(F.desc("score"), "claim_id").limit(search.POOL)
    best = search.blend(search.rerank(pool, QUESTION, "claim_text"), "claim_id")
    place = F.row_number().over(Window.orderBy(F.desc("rank_raw"), "claim_id"))  # the pool alone
    return best.withColumn("place", place).filter(F.col("place") <= 10).select("claim_id", "doc_id", F.round("rank_raw", 6).alias("rank_score"), "place")


# Intake, notes and local data


@query(
    "SELECT conv_id, n_bytes FROM (SELECT conv_id, sum(strlen(coalesce(text, '')))::BIGINT AS n_bytes FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY conv_id ORDER BY conv_id DESC LIMIT 20) WHERE n_bytes <= 2000"
)
def session_intake(spark, sf_dir):
    """The newest twenty sessions that aren't consumed, and of these the ones that aren't too large: the cap comes first."""
    done = _labels(spark, sf_dir).filter("quality = 1").select(F.col("doc_id").alias("conv_id"))
    left = table(spark, sf_dir, "conversations").join(done, "conv_id", "left_anti")
    sized = left.groupBy("conv_id").agg(F.sum(F.octet_length(T.text_of("text"))).alias("n_bytes"))
    return sized.orderBy(F.desc("conv_id")).limit(20).filter("n_bytes <= 2000")


@query(
    "SELECT doc_id, title, sha256('---' || chr(10) || 'source: ' || source || chr(10) || '---' || chr(10) || '# ' || title || chr(10) || chr(10) || coalesce(text, '')) AS note_digest"
    " FROM (SELECT *, trim(regexp_replace(source || '_' || lang || '-note', '[_-]+', ' ', 'g')) AS title FROM documents)"
)
def summary_notes(spark, sf_dir):
    """A note for each document: front matter, title and body."""
    title = F.trim(F.regexp_replace(F.concat("source", F.lit("_"), "lang", F.lit("-note")), "[_-]+", " "))
    note = F.concat(F.lit("---\nsource: "), "source", F.lit("\n---\n# "), "title", F.lit("\n\n"), T.text_of("text"))
    return _docs(spark, sf_dir).withColumn("title", title).select("doc_id", "title", T.digest(note).alias("note_digest"))


@query(
    "SELECT page_id, path, (regexp_matches(path, '^/(en|de)(/|$)') AND NOT regexp_matches(path, '(^|/)\\.\\.(/|$)')) AS contained FROM (SELECT page_id, regexp_replace('/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1), '/+', '/', 'g') AS path FROM pages)"
)
def contained_paths(spark, sf_dir):
    """Whether a page's path lies below one of the allowed roots and never climbs."""
    path = F.regexp_replace(F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)), "/+", "/")
    inside = F.col("path").rlike("^/(en|de)(/|$)") & ~F.col("path").rlike(r"(^|/)\.\.(/|$)")
    return table(spark, sf_dir, "pages").select("page_id", path.alias("path")).withColumn("contained", inside)


@query("SELECT lang, count_if(quality = 1)::BIGINT AS n_ok, count_if(quality = 0)::BIGINT AS n_failed, count_if(quality = 1 AND toxic = 0)::BIGINT AS n_cleaned FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def batch_outcomes(spark, sf_dir):
    rows = _docs(spark, sf_dir).join(_labels(spark, sf_dir), "doc_id")
    n = lambda test, name: F.count_if(F.expr(test)).alias(name)
    return rows.groupBy("lang").agg(n("quality = 1", "n_ok"), n("quality = 0", "n_failed"), n("quality = 1 AND toxic = 0", "n_cleaned"))


@query(f"WITH {_MEMORY} SELECT section, count(DISTINCT body)::BIGINT AS n FROM m GROUP BY section")
def items_per_section(spark, sf_dir):
    return _memory_items(spark, sf_dir).groupBy("section").agg(F.countDistinct("body").alias("n"))


@query(f"WITH {_MEMORY} SELECT section, body, min(conv_id * 1000 + turn)::BIGINT AS first_place FROM m GROUP BY section, body")
def changelog_union(spark, sf_dir):
    """Entries of all sessions once each, at the place where they were first seen."""
    return _memory_items(spark, sf_dir).groupBy("section", "body").agg(F.min(F.col("conv_id") * 1000 + F.col("turn")).alias("first_place"))


@query("SELECT user_id, count_if(date_diff('day', ts::DATE, latest::DATE) > 2)::BIGINT AS n_pruned, count_if(date_diff('day', ts::DATE, latest::DATE) <= 2)::BIGINT AS n_kept FROM events, (SELECT max(ts) AS latest FROM events) GROUP BY user_id")
def retention_prune(spark, sf_dir):
    """Records older than the days they are kept for."""
    events = table(spark, sf_dir, "events")
    latest = events.agg(F.max("ts").alias("latest"))  # one row
    old = F.datediff(F.to_date("latest"), F.to_date("ts")) > 2
    return events.join(F.broadcast(latest)).groupBy("user_id").agg(F.count_if(old).alias("n_pruned"), F.count_if(~old).alias("n_kept"))


@query("SELECT page_id, regexp_replace(regexp_extract(html, '<title>([^<]*)', 1), '[^A-Za-z0-9._-]+', '-', 'g') AS folder FROM pages")
def folder_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_extract("html", "<title>([^<]*)", 1), "[^A-Za-z0-9._-]+", "-").alias("folder"))


@query("SELECT conv_id, turn, length(t)::BIGINT AS n_chars, sha256(t) AS digest FROM (SELECT conv_id, turn, regexp_replace(coalesce(text, ''), '\\x1b\\[[0-?]*[ -/]*[@-~]', '', 'g') AS t FROM conversations)")
def plain_turns(spark, sf_dir):
    """Turns without terminal control sequences."""
    t = F.regexp_replace(T.text_of("text"), r"\x1b\[[0-?]*[ -/]*[@-~]", "")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length(t).cast("long").alias("n_chars"), T.digest(t).alias("digest"))


#: Terms that stand for a machine's own names here; they are parameters and never read from the host.
LOCAL_TERMS = ("copyright", "license", "/srv/home")


@query(
    "SELECT doc_id, label, string_agg(line, ',' ORDER BY line) AS lines FROM (SELECT DISTINCT doc_id, label, line FROM (SELECT doc_id, unnest(ls) AS x, unnest(generate_series(1, len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),"
    + " (VALUES ('home path', '/srv/home'), ('user or host name', 'copyright'), ('user or host name', 'license')) v(label, term) WHERE contains(lower(x), term)"
    + f" UNION SELECT doc_id, 'private IP', line FROM (SELECT doc_id, unnest(ls) AS x, unnest(generate_series(1, len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE len([y FOR y IN regexp_extract_all(x, '{PRIVATE_IP}') IF NOT starts_with(y, '127.')]) > 0) GROUP BY ALL"
)
def local_findings(spark, sf_dir):
    """Lines that hold given terms or private addresses, looked at inside the row."""
    names = [t for t in LOCAL_TERMS if "/" not in t and "\\" not in t]
    paths = [t for t in LOCAL_TERMS if t not in names]
    holds = lambda x, terms: T.any_of([F.contains(F.lower(x), F.lit(t)) for t in terms])
    private = lambda x: F.exists(F.regexp_extract_all(x, F.lit(f"({PRIVATE_IP})"), F.lit(1)), lambda ip: ~ip.startswith("127."))
    of = lambda label, test: F.struct(F.lit(label).alias("label"), F.array_join(F.filter(F.transform("ls", lambda x, i: F.when(test(x), i + 1)), lambda n: n.isNotNull()), ",").alias("lines"))
    found = F.array(of("home path", lambda x: holds(x, paths)), of("user or host name", lambda x: holds(x, names)), of("private IP", private))
    docs = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n").alias("ls"))
    return docs.select("doc_id", F.inline(F.filter(found, lambda f: f["lines"] != "")))


@query()
def agent_texts(spark, sf_dir):
    """Texts for a reader outside: masked, cut to 4000 characters, and refused where anything is left."""
    masked = _docs(spark, sf_dir).select("doc_id", F.substring(redacted(F.col("text")), 1, 4000).alias("cleaned"))
    return masked.withColumn("refused", residual(F.col("cleaned")) != "").select("doc_id", F.when(~F.col("refused"), F.col("cleaned")).alias("cleaned"), "refused")
