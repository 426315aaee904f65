"""Queries over aliases, duplicates, caps, validation, lint and evaluation, and the stream form of the job log."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import jobs
from ..operators import transcripts as transcript_files
from ..sources.tables import claims, evidence, revisions, statuses, table
from ..streaming.folds import fold_to_table
from .registry import query
from .structure import _MEMORY, _memory_items


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query("SELECT lang AS alias, count(DISTINCT source)::BIGINT AS n_entities, count(DISTINCT source) > 1 AS ambiguous, min(source) AS first_entity FROM documents GROUP BY lang")
def alias_ambiguity(spark, sf_dir):
    """An alias that names several entities can't be resolved by itself."""
    n = F.countDistinct("source")
    return _docs(spark, sf_dir).groupBy(F.col("lang").alias("alias")).agg(n.alias("n_entities"), (n > 1).alias("ambiguous"), F.min("source").alias("first_entity"))


@query(
    "SELECT DISTINCT key, source, kind FROM (SELECT 'src0' AS key, source, 'id' AS kind FROM documents WHERE source = 'src0' UNION ALL SELECT 'en', source, 'alias' FROM documents WHERE lang = 'en')"
)
def entity_lookup(spark, sf_dir):
    """A lookup by id or alias as a union of equalities, so that each can use its own plan."""
    docs = _docs(spark, sf_dir)
    by_id = docs.filter("source = 'src0'").select(F.lit("src0").alias("key"), "source", F.lit("id").alias("kind"))
    by_alias = docs.filter("lang = 'en'").select(F.lit("en").alias("key"), "source", F.lit("alias").alias("kind"))
    return by_id.union(by_alias).distinct()


@query(
    "SELECT lang, digest, kept, n_reused, sources FROM (SELECT lang, sha256(coalesce(text, '')) AS digest, min(doc_id) AS kept, count(*)::BIGINT - 1 AS n_reused, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources"
    " FROM documents GROUP BY 1, 2) WHERE n_reused > 0"
)
def duplicate_claims(spark, sf_dir):
    """Texts of a language that come again: the first stays, and the set of sources they depend on."""
    keyed = _docs(spark, sf_dir).select("lang", T.digest(T.text_of("text")).alias("digest"), "doc_id", "source")
    g = keyed.groupBy("lang", "digest").agg(F.min("doc_id").alias("kept"), (F.count("*") - 1).alias("n_reused"), F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"))
    return g.filter("n_reused > 0")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)::INT AS n, n <= 3 AS kept FROM conversations")
def section_cap(spark, sf_dir):
    """The first three turns of a conversation are kept, the others logged as capped: the cap is the feature."""
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", n.alias("n"), (n <= 3).alias("kept"))


@query("SELECT conv_id, turn, printf('T%04d', row_number() OVER (PARTITION BY conv_id ORDER BY turn, role)) AS item_id FROM conversations")
def stable_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.format_string("T%04d", n).alias("item_id"))


@query(
    f"WITH {_MEMORY}, k AS (SELECT m.*, turn * 2 < n AS early FROM m JOIN (SELECT conv_id, max(turn) + 1 AS n FROM conversations GROUP BY conv_id) USING (conv_id)), a AS (SELECT DISTINCT section, body FROM k WHERE early), b AS (SELECT DISTINCT section, body FROM k WHERE NOT early)"
    " SELECT section, count_if(kind = 'added')::BIGINT AS n_added, count_if(kind = 'removed')::BIGINT AS n_removed FROM (SELECT 'added' AS kind, section FROM (SELECT * FROM b EXCEPT SELECT * FROM a)"
    " UNION ALL SELECT 'removed', section FROM (SELECT * FROM a EXCEPT SELECT * FROM b)) GROUP BY section"
)
def memory_diff(spark, sf_dir):
    """What the memory of the later halves of all conversations adds to that of the earlier halves, and what it lacks."""
    n = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("n"))
    items = _memory_items(spark, sf_dir).join(n, "conv_id").select("section", "body", (F.col("turn") * 2 < F.col("n")).alias("early"))
    # One row an entry says in which of the two memories it is.
    held = items.groupBy("section", "body").agg(F.bool_or("early").alias("before"), F.bool_or(~F.col("early")).alias("after")).filter("before <> after")
    return held.groupBy("section").agg(F.count_if("after").alias("n_added"), F.count_if("before").alias("n_removed"))


@query(
    "SELECT coalesce(o.source, n.source) AS source, coalesce(n.digest, o.digest) AS digest, CASE WHEN o.source IS NULL THEN 'insert' WHEN n.source IS NULL THEN 'keep' ELSE 'update' END AS action"
    " FROM (SELECT source, arg_max(digest, latest) AS digest FROM cur WHERE NOT is_current GROUP BY source) o FULL JOIN (SELECT source, digest FROM cur WHERE is_current) n USING (source)",
    "rev cur",
)
def render_state_upsert(spark, sf_dir):
    """The pages of all sources: those of the revision before, upserted with those of the current one by a full join."""
    r = revisions(_docs(spark, sf_dir))
    old = r.filter("NOT is_current").groupBy("source").agg(F.max_by("digest", "arrival").alias("old"))
    new = r.filter("is_current").select("source", F.col("digest").alias("new"))
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "keep").otherwise("update")
    return old.join(new, "source", "full").select("source", F.coalesce("new", "old").alias("digest"), action.alias("action"))


@query(
    "SELECT doc_id, label, string_agg(line, ',' ORDER BY line) AS lines FROM (SELECT DISTINCT doc_id, CASE WHEN regexp_matches(x, '(?i)\\blicen[sc]e') THEN 'license' WHEN contains(x, '@') THEN 'address' WHEN contains(x, 'token = ') THEN 'token' END AS label, line"
    " FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(generate_series(1, len(string_split(text, chr(10))))) AS line FROM documents)) WHERE label IS NOT NULL GROUP BY ALL"
)
def finding_lines(spark, sf_dir):
    """Label and sorted line numbers of what a line-wise detector finds in each document."""
    label = lambda x: F.when(x.rlike(r"(?i)\blicen[sc]e"), "license").when(F.contains(x, F.lit("@")), "address").when(F.contains(x, F.lit("token = ")), "token")
    found = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct(label(x).alias("label"), (i + 1).alias("line"))), lambda f: f["label"].isNotNull())
    rows = _docs(spark, sf_dir).select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.*")
    g = rows.groupBy("doc_id", "label").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    return g.select("doc_id", "label", F.array_join(F.transform("lines", lambda x: x.cast("string")), ",").alias("lines"))


@query("SELECT event_id, regexp_extract('reply: ' || props || ' end', '\\{.*\\}') AS body, (regexp_extract('reply: ' || props || ' end', '\\{.*\\}')::JSON ->> 'k')::BIGINT AS k FROM events")
def first_json(spark, sf_dir):
    """The first object of a reply, from its first to its last brace."""
    body = F.regexp_extract(F.concat(F.lit("reply: "), "props", F.lit(" end")), r"(?s)\{.*\}", 0)
    return table(spark, sf_dir, "events").select("event_id", body.alias("body"), F.get_json_object(body, "$.k").cast("long").alias("k"))


@query(
    "SELECT conv_id, turn, errors FROM (SELECT conv_id, turn, array_to_string([x FOR x IN [CASE WHEN role NOT IN ('user', 'assistant') THEN 'unknown role' END, CASE WHEN length(coalesce(text, '')) < 20 THEN 'short text' END,"
    " CASE WHEN turn > 5 THEN 'late turn' END] IF x IS NOT NULL], '; ') AS errors FROM conversations) WHERE errors <> ''"
)
def session_errors(spark, sf_dir):
    """All that is wrong with a turn, as one list."""
    tests = F.array(
        F.when(~F.col("role").isin("user", "assistant"), "unknown role"), F.when(F.length(T.text_of("text")) < 20, "short text"), F.when(F.col("turn") > 5, "late turn")
    )
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_compact(tests), "; ").alias("errors")).filter("errors <> ''")


_FIXTURES = {"en": (("the", "and"), ("der ",)), "de": (("der", "und"), (" the ",)), "fr": (("la", "de"), (" the ",)), "es": (("la", "de"), (" der ",))}


@query(
    "SELECT lang, count(*)::BIGINT AS n, count_if("
    + " OR ".join(f"(lang = '{k}' AND {' AND '.join(f'''contains(text, '{x}')''' for x in must)} AND {' AND '.join(f'''NOT contains(text, '{x}')''' for x in must_not)})" for k, (must, must_not) in _FIXTURES.items())
    + ")::BIGINT AS n_passed FROM documents GROUP BY lang"
)
def eval_fixtures(spark, sf_dir):
    """Texts that hold all that their language's fixture demands and nothing that it forbids."""
    has = lambda x: F.contains(F.col("text"), F.lit(x))
    cases = [reduce(lambda a, b: a & b, [F.col("lang") == k, *map(has, must), *(~has(x) for x in must_not)]) for k, (must, must_not) in _FIXTURES.items()]
    return _docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(T.any_of(cases)).alias("n_passed"))


_LINT = (
    "SELECT page_id, unnest([x FOR x IN [CASE WHEN regexp_extract(html, '<html lang=\"([^\"]*)', 1) NOT IN ('en', 'de') THEN 'warning:language' END, CASE WHEN length(regexp_extract(html, '<title>([^<]*)', 1)) > 50 THEN 'warning:long title' END,"
    " CASE WHEN NOT contains(html, '<h1') THEN 'error:no heading' END, CASE WHEN contains(html, 'class=\"ad\"') THEN 'info:advertisement' END] IF x IS NOT NULL]) AS finding FROM pages"
)


def _lint(spark, sf_dir):
    html = F.col("html")
    tests = F.array(
        F.when(~F.regexp_extract(html, '<html lang="([^"]*)', 1).isin("en", "de"), "warning:language"),
        F.when(F.length(F.regexp_extract(html, "<title>([^<]*)", 1)) > 50, "warning:long title"),
        F.when(~F.contains(html, F.lit("<h1")), "error:no heading"),
        F.when(F.contains(html, F.lit('class="ad"')), "info:advertisement"),
    )
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.array_compact(tests)).alias("finding"))


@query(_LINT)
def metadata_lint(spark, sf_dir):
    return _lint(spark, sf_dir)


@query(f"SELECT string_split(finding, ':')[1] AS severity, count(*)::BIGINT AS n FROM ({_LINT}) GROUP BY 1")
def lint_counts(spark, sf_dir):
    return _lint(spark, sf_dir).groupBy(F.split("finding", ":")[0].alias("severity")).agg(F.count("*").alias("n"))


@query(
    "SELECT round(avg((substr(body, char_start + 1, char_end - char_start) = claim_text)::INT), 6) AS locator_validity, round(avg((length(claim_text) BETWEEN 1 AND 4000)::INT), 6) AS claim_length,"
    " round(avg((status <> 'retracted')::INT), 6) AS not_retracted FROM ev JOIN st USING (doc_id)",
    "st ev",
)
def evaluation_ratios(spark, sf_dir):
    """Shares of the evidence that passes each gate."""
    docs = _docs(spark, sf_dir)
    rows = evidence(docs, table(spark, sf_dir, "benchmark")).join(statuses(docs, table(spark, sf_dir, "labels")), "doc_id")
    share = lambda test: F.round(F.avg(test.cast("int")), 6)
    return rows.agg(
        share(F.col("quote") == F.col("claim_text")).alias("locator_validity"), share(F.length("claim_text").between(1, 4000)).alias("claim_length"), share(F.col("status") != "retracted").alias("not_retracted")
    )


@query(
    "SELECT claim_id, count(ev.doc_id)::BIGINT AS n_evidence, coalesce(count(DISTINCT ev.source), 0)::BIGINT AS n_sources FROM (SELECT item_id AS claim_id FROM benchmark WHERE text <> '') b LEFT JOIN ev USING (claim_id) GROUP BY claim_id",
    "ev",
)
def claim_counts(spark, sf_dir):
    """The scalar subquery of a claim list as one grouped join."""
    e = evidence(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark")).groupBy("claim_id").agg(F.count("*").alias("n"), F.countDistinct("source").alias("s"))
    joined = claims(table(spark, sf_dir, "benchmark")).select("claim_id").join(e, "claim_id", "left")
    return joined.select("claim_id", F.coalesce("n", F.lit(0)).alias("n_evidence"), F.coalesce("s", F.lit(0)).alias("n_sources"))


@query("SELECT page_id, to_base64(encode(url)) AS encoded, sha256(url) AS digest, substr(sha256(url), 1, 2) || '/' || sha256(url) AS object_path FROM pages WHERE url IS NOT NULL")
def object_paths(spark, sf_dir):
    """The content address of an object, and its bytes as text for an export."""
    d = T.digest(F.col("url"))
    return table(spark, sf_dir, "pages").filter("url IS NOT NULL").select("page_id", T.base64(F.col("url")).alias("encoded"), d.alias("digest"), F.concat_ws("/", F.substring(d, 1, 2), d).alias("object_path"))


@query(
    "SELECT doc_id, '{\"chars\":' || n_chars || ',\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS payload FROM documents WHERE NOT contains(text, 'License')"
)
def decision_payload(spark, sf_dir):
    """The evidence of each item that waits for a decision, as canonical JSON."""
    docs = _docs(spark, sf_dir).filter(~F.contains("text", F.lit("License")))
    return docs.select("doc_id", F.to_json(F.struct(F.col("n_chars").alias("chars"), "lang", "source")).alias("payload"))


@query("SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS last_event, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def stream_job_states(spark, sf_dir):
    """The job log read as a stream until it is exhausted: an addition, equal to the batch fold."""
    schema = table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)
    folded = events.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), F.max_by("event_type", "event_id").alias("status"))
    return fold_to_table(folded, "job-states")


# Jobs: an event of a user's log is an event of one of the user's jobs, by the number in its record

_EVENTS_OF_JOBS = {"signup": "create", "view": "create", "click": "running", "purchase": "completed", "error": "cancel"}


def _job_events(rows):
    """(at, kind, key, event) of logged events; one kind isn't allowed."""
    kinds = F.array(*[F.lit(k) for k in (*jobs.KINDS[:4], "shell")])
    names = F.create_map(*[F.lit(x) for pair in _EVENTS_OF_JOBS.items() for x in pair])
    number = F.get_json_object("props", "$.k").cast("long") % 7
    return rows.select(F.col("event_id").alias("at"), F.element_at(kinds, (F.col("user_id") % 5 + 1).cast("int")).alias("kind"), F.concat_ws("/", F.col("user_id").cast("string"), number.cast("string")).alias("key"), names[F.col("event_type")].alias("event"))


_JOB_NAMES = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _EVENTS_OF_JOBS.items()) + " END"
_SAME = "p := a.p, e := a.e, status := {}, created := {}, updated := {}, n := a.n + 1, rep := a.rep + {}, ref := a.ref + {}"
_STEP = (
    f"CASE WHEN a.status = '' AND x.e = 'create' THEN struct_pack({_SAME.format(chr(39) + 'queued' + chr(39), 'x.p', 'x.p', 0, 0)}) WHEN a.status = '' THEN struct_pack({_SAME.format('a.status', 'a.created', 'a.updated', 0, 1)})"
    f" WHEN x.e = 'create' OR (a.status IN ('completed', 'cancelled') AND (x.e = a.status OR x.e = 'cancel' AND a.status = 'cancelled')) THEN struct_pack({_SAME.format('a.status', 'a.created', 'a.updated', 1, 0)})"
    f" WHEN a.status IN ('completed', 'cancelled') OR x.e = 'cancel' AND a.status = 'running' THEN struct_pack({_SAME.format('a.status', 'a.created', 'a.updated', 0, 1)})"
    f" ELSE struct_pack({_SAME.format('CASE WHEN x.e = ' + chr(39) + 'cancel' + chr(39) + ' THEN ' + chr(39) + 'cancelled' + chr(39) + ' ELSE x.e END', 'a.created', 'x.p', 0, 0)}) END"
)
_EMPTY_JOB = "struct_pack(p := {0}, e := {1}, status := '', created := 0::BIGINT, updated := 0::BIGINT, n := 0::BIGINT, rep := 0::BIGINT, ref := 0::BIGINT)"
_JOBS_SQL = (
    f"SELECT kind, key, j.status AS status, j.created AS created_at, j.updated AS updated_at, j.n AS n_events, j.rep AS n_repeats, j.ref AS n_refused FROM (SELECT kind, key, list_reduce(list_prepend({_EMPTY_JOB.format('0::BIGINT', chr(39) + chr(39))}, list({_EMPTY_JOB.format('born', 'event')} ORDER BY born)), lambda a, x: {_STEP}) AS j"
    f" FROM (SELECT event_id AS born, ['ingest_file', 'ingest_url', 'compile', 'render', 'shell'][user_id % 5 + 1] AS kind, user_id || '/' || ((props::JSON ->> 'k')::BIGINT % 7) AS key, {_JOB_NAMES} AS event FROM events) WHERE kind <> 'shell' GROUP BY kind, key) WHERE j.status <> ''"
)


@query(_JOBS_SQL)
def jobs_folded(spark, sf_dir):
    """Jobs by kind and key: repeats of a create, ends that stay, cancels refused while a job runs."""
    return jobs.folded(_job_events(table(spark, sf_dir, "events")))


@query(_JOBS_SQL)
def jobs_streamed(spark, sf_dir):
    """The same from a stream of the log, with a state for each job."""
    schema = table(spark, sf_dir, "events").schema
    return jobs.streamed(_job_events(spark.readStream.schema(schema).option("pathGlobFilter", "events*.parquet").parquet(sf_dir)))


_LEAST_AGE = 14
_BOTH = "bool_or(role = 'user') AND bool_or(role = 'assistant')"
_ANY = "bool_or(role IN ('user', 'assistant') AND text IS NOT NULL)"


@query(
    f"SELECT conv_id, kind, CASE WHEN age < {_LEAST_AGE} OR tracked THEN 'keep' ELSE 'decide' END AS action, CASE WHEN age < {_LEAST_AGE} THEN 'younger than {_LEAST_AGE} days' WHEN tracked THEN 'tracked' ELSE 'untracked transcript (' || kind || '), ' || age || 'd old' END AS why"
    f" FROM (SELECT conv_id, conv_id % 40 AS age, conv_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS tracked, CASE conv_id % 5 WHEN 0 THEN CASE WHEN {_BOTH} THEN 'dialogue-markers' WHEN conv_id % 2 = 0 THEN 'filename-only-review-required' END"
    f" WHEN 3 THEN 'session-metadata' WHEN 4 THEN CASE WHEN conv_id % 2 = 0 THEN 'filename-only-review-required' END ELSE CASE WHEN {_ANY} THEN 'message-record' WHEN conv_id % 2 = 0 AND conv_id % 5 = 1 THEN 'filename-only-review-required' END END AS kind FROM conversations GROUP BY conv_id) WHERE kind IS NOT NULL"
)
def transcript_routes(spark, sf_dir):
    """Every session as a file of one of five forms: plain, lines of JSON, a wrapper of messages, metadata, or text without marks; its kind, and what to do with it."""
    turns = table(spark, sf_dir, "conversations")
    record = F.struct("turn", F.to_json(F.struct("role", F.col("text").alias("content"))).alias("r"), F.concat("role", F.lit(": "), T.text_of("text")).alias("line"), T.text_of("text").alias("text"))
    sessions = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(record)).alias("t"))
    form = F.col("conv_id") % 5
    text = (
        F.when(form == 0, F.array_join("t.line", "\n\n")).when(form == 1, F.concat(F.lit("no json\n"), F.array_join("t.r", "\n"))).when(form == 2, F.concat(F.lit('{"messages": ['), F.array_join("t.r", ","), F.lit("]}")))
        .when(form == 3, F.lit('[{"type": "other"}, {"type": "session_meta", "payload": {"id": 1}}]')).otherwise(F.array_join("t.text", " "))
    )
    end = F.when(form == 1, ".jsonl").when(form.isin(2, 3), ".json").otherwise(".txt")
    name = F.concat(F.lit("logs/"), F.when(F.col("conv_id") % 2 == 0, "rollout-").otherwise("notes-"), F.col("conv_id").cast("string"), end)
    consumed = table(spark, sf_dir, "labels").filter("quality = 1").select(F.col("doc_id").alias("conv_id"), F.lit(True).alias("tracked")).distinct()
    files = sessions.select("conv_id", name.alias("name"), text.alias("text"), (F.col("conv_id") % 40).alias("age_days")).join(consumed, "conv_id", "left")
    return transcript_files.routed(files, _LEAST_AGE).select("conv_id", "kind", "action", "why")
