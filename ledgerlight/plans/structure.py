"""Queries over document trees, transcripts, memory, pages and event logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import tree
from ..operators.audit import running
from ..operators.bundle import evidence_bundle
from ..operators.markdown import with_flat
from ..operators.stems import stemmed_counts
from ..sources.tables import revisions, statuses, table, transcripts
from .evidence import _TOKENS
from .registry import query

_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_HEADS = rf"""
WITH l AS (
  SELECT doc_id, i, line, {_STRIP.format('line')} AS title, coalesce(lead(line) OVER w, '') AS after, sum(length(line) + 1) OVER w - length(line) - 1 AS pos
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM documents)
  WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), k AS (
  SELECT *, CASE WHEN regexp_matches({_STRIP.format('after')}, '^=+$') THEN 1 WHEN regexp_matches({_STRIP.format('after')}, '^-+$') THEN 2 END AS under,
    regexp_replace(title, '[^\p{{L}}]', '', 'g') AS letters FROM l WHERE length(title) BETWEEN 1 AND 80
), h AS (
  SELECT doc_id, pos::INT AS char_start, (pos + CASE WHEN under IS NULL THEN length(rtrim(line)) ELSE length(line) + 1 + length(rtrim(after)) END)::INT AS char_end, coalesce(under, 1)::INT AS level, title
  FROM k WHERE under IS NOT NULL OR (length(title) >= 4 AND letters <> '' AND NOT regexp_matches(letters, '[^\p{{Lu}}]'))
)"""


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"{_HEADS} SELECT * FROM h")
def plain_headings(spark, sf_dir):
    lines = _docs(spark, sf_dir).select("doc_id", tree.text_lines(T.text_of("text")).alias("lines"))
    found = lines.select("doc_id", F.explode(tree.plain_headings(F.col("lines"))).alias("h"))
    return found.select("doc_id", F.col("h.start").alias("char_start"), F.col("h.end").alias("char_end"), "h.level", "h.title")


_NODES = rf"""{_HEADS}, n AS (
  SELECT *, row_number() OVER w AS number, lead(char_start) OVER w AS following FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY char_start)
), d AS (SELECT doc_id, text FROM documents WHERE text <> ''
), r AS (
  SELECT doc_id, 0 AS number, 0 AS level, 0 AS body, text AS region FROM d WHERE doc_id NOT IN (SELECT doc_id FROM h)
  UNION ALL SELECT doc_id, number, level, char_end, substr(text, char_end + 1, coalesce(following, length(text)) - char_end) FROM n JOIN d USING (doc_id)
), s AS (
  SELECT 0 AS kind, doc_id, 0 AS rank, 'Document' AS heading, 0 AS depth, NULL AS parent_order, 0 AS a, length(text) AS b FROM d
  UNION ALL SELECT 1, doc_id, number, title, level, coalesce((SELECT max(m.number) FROM n m WHERE m.doc_id = n.doc_id AND m.number < n.number AND m.level < n.level), 0), char_start,
    coalesce((SELECT min(m.char_start) FROM n m WHERE m.doc_id = n.doc_id AND m.number > n.number AND m.level <= n.level), length(text)) FROM n JOIN d USING (doc_id)
  UNION ALL SELECT 2, doc_id, number, c[:72] || CASE WHEN length(c) > 72 THEN '…' ELSE '' END, level + 1, number, body + length(region) - length(ltrim(region, E' \n\t')), body + length(region) - length(ltrim(region, E' \n\t')) + length(trim(region, E' \n\t'))
    FROM (SELECT *, regexp_replace(trim(region, E' \n\t'), '\s+', ' ', 'g') AS c FROM r) WHERE c <> ''
), o AS (
  SELECT s.*, row_number() OVER (PARTITION BY doc_id ORDER BY kind, rank) - 1 AS document_order, text, substr(text, a + 1, b - a) AS content FROM s JOIN d USING (doc_id)
)
"""
_LINE = "(length(substr(text, 1, {0})) - length(replace(substr(text, 1, {0}), chr(10), '')) + 1)::INT"


@query(
    f"{_NODES} SELECT doc_id, document_order::INT AS document_order, heading, depth::INT AS depth, parent_order::INT AS parent_order, a::INT AS char_start, b::INT AS char_end,"
    f" {_LINE.format('a')} AS line_start, {_LINE.format('greatest(a, b - 1)')} AS line_end, sha256(content) AS content_digest,"
    f" greatest(1, len({_TOKENS.format('content')}))::INT AS token_estimate FROM o"
)
def tree_nodes(spark, sf_dir):
    return tree.nodes(_docs(spark, sf_dir)).drop("node_id")


@query(f"{_NODES} SELECT doc_id, document_order::INT AS document_order, heading FROM o WHERE NOT EXISTS (SELECT 1 FROM o c WHERE c.doc_id = o.doc_id AND c.parent_order = o.document_order)")
def tree_leaves(spark, sf_dir):
    return tree.leaf_rows(_docs(spark, sf_dir)).select("doc_id", "document_order", "heading")


@query(
    f"{_NODES.rstrip()}, rev AS (SELECT source, text, min(doc_id) AS arrival, max(doc_id) AS latest FROM documents GROUP BY 1, 2), cur AS (SELECT arrival FROM rev QUALIFY latest = max(latest) OVER (PARTITION BY source))"
    f" SELECT doc_id, document_order::INT AS document_order, score::BIGINT AS score FROM (SELECT doc_id, document_order, len([x FOR x IN {_TOKENS.format('heading')} || {_TOKENS.format('content')}"
    " IF x IN ('the', 'and')]) AS score FROM o WHERE doc_id IN (SELECT arrival FROM cur)) WHERE score > 0 ORDER BY score DESC, doc_id, document_order LIMIT 20"
)
def search_nodes(spark, sf_dir):
    """The twenty nodes of current texts that hold the question's words most often."""
    docs = _docs(spark, sf_dir)
    current = revisions(docs).filter("is_current").select(F.col("arrival").alias("doc_id"))
    rows = tree.node_arrays(docs.join(current, "doc_id", "left_semi"))
    words = lambda n: F.concat(T.tokens(n["heading"]), T.tokens(T.piece(F.col("text"), n["start"], n["end"])))
    score = lambda n, i: F.struct(i.alias("document_order"), F.size(F.filter(words(n), lambda x: x.isin("the", "and"))).cast("long").alias("score"))
    return rows.select("doc_id", F.inline(F.transform("nodes", score))).filter("score > 0").orderBy(F.desc("score"), "doc_id", "document_order").limit(20)


@query(
    "SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(coalesce(role, '') || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, role)) AS digest FROM conversations GROUP BY conv_id"
)
def transcript_text(spark, sf_dir):
    t = transcripts(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", "n_turns", T.digest(F.col("transcript")).alias("digest"))


@query(
    "SELECT conv_id, CASE WHEN bool_or(role IN ('user', 'human')) AND bool_or(role IN ('assistant', 'claude', 'codex', 'gemini', 'cursor')) THEN 'dialogue-markers'"
    " WHEN bool_or(regexp_matches(text, '(?m)^\\s*[>❯]\\s+\\S')) AND bool_or(regexp_matches(text, '(?m)^\\s*●\\s+\\S')) THEN 'terminal-dialogue' ELSE 'none' END AS reason FROM conversations GROUP BY conv_id"
)
def transcript_class(spark, sf_dir):
    """The first rule that holds for a transcript; role marks stand at the start of a line."""
    text = F.col("transcript")
    mark = lambda names: text.rlike(rf"(?im)^\s*(?:#{{1,6}}\s+|\*\*)?(?:{names})(?:\*\*)?\s*(?::|$|\[|\()")
    spoken = mark("user|human") & mark("assistant|claude|codex|gemini|cursor")
    terminal = text.rlike(r"(?m)^\s*[>❯]\s+\S") & text.rlike(r"(?m)^\s*●\s+\S")
    reason = F.when(spoken, "dialogue-markers").when(terminal, "terminal-dialogue").otherwise("none")
    return transcripts(table(spark, sf_dir, "conversations")).select("conv_id", reason.alias("reason"))


_ITEMS = (
    "i AS (SELECT doc_id, lang AS kind, CASE WHEN contains(text, 'License') THEN 'keep' ELSE 'decide' END AS action FROM documents),"
    " m AS (SELECT i.doc_id, kind, CASE WHEN action = 'keep' THEN 'keep' WHEN l.doc_id IS NULL THEN 'hold' WHEN (i.doc_id * 37) % 100 < 30 THEN 'hold'"
    " WHEN quality = 1 THEN 'ingest_summary' ELSE 'discard' END AS action FROM i LEFT JOIN labels l USING (doc_id))"
)


def _decided(spark, sf_dir):
    """Plan items joined with their answers: no answer or little confidence holds the item."""
    docs = _docs(spark, sf_dir)
    kept = F.coalesce(F.contains(F.col("text"), F.lit("License")), F.lit(False))
    items = docs.select("doc_id", F.col("lang").alias("kind"), F.when(kept, "keep").otherwise("decide").alias("action"))
    answers = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "ingest_summary").otherwise("discard").alias("choice"), ((F.col("doc_id") * 37) % 100).alias("confidence"))
    held = F.col("choice").isNull() | (F.col("confidence") < 30)
    action = F.when(F.col("action") == "keep", "keep").when(held, "hold").otherwise(F.col("choice"))
    return items.join(answers, "doc_id", "left").select("doc_id", "kind", action.alias("action"))


@query(f"WITH {_ITEMS} SELECT doc_id, kind, action FROM m")
def decision_merge(spark, sf_dir):
    return _decided(spark, sf_dir)


@query(f"WITH {_ITEMS} SELECT kind || ':' || action AS item, count(*)::BIGINT AS n FROM m GROUP BY 1")
def plan_summary(spark, sf_dir):
    return _decided(spark, sf_dir).groupBy(F.concat_ws(":", "kind", "action").alias("item")).agg(F.count("*").alias("n"))


_NORM = "trim(regexp_replace(lower(line), '[^a-z0-9]+', ' ', 'g'))"
_MEMORY = (
    f"m AS (SELECT role AS section, {_NORM} AS body, line, conv_id, turn FROM (SELECT role, conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations) WHERE {_NORM} <> '')"
)


def _memory_items(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.col("role").alias("section"), "conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    return turns.withColumn("body", T.normalize(F.col("line"))).filter("body <> ''")


@query(
    f"WITH {_MEMORY} SELECT 'mem-' || substr(sha1(section || chr(0) || body), 1, 12) AS memory_id, section, count(*)::BIGINT AS n_observations, min(conv_id) AS first_seen, max(conv_id) AS last_seen,"
    " max(CASE WHEN turn = 0 THEN 3 WHEN turn < 3 THEN 2 ELSE 1 END)::INT AS confidence_rank FROM m GROUP BY section, body"
)
def memory_merge(spark, sf_dir):
    """Observations of the same section and normalised text become one item with the highest confidence."""
    rank = F.when(F.col("turn") == 0, 3).when(F.col("turn") < 3, 2).otherwise(1)
    g = _memory_items(spark, sf_dir).groupBy("section", "body").agg(
        F.count("*").alias("n_observations"), F.min("conv_id").alias("first_seen"), F.max("conv_id").alias("last_seen"), F.max(rank).alias("confidence_rank")
    )
    return g.select(T.short_id(F.col("section"), F.col("body")).alias("memory_id"), "section", "n_observations", "first_seen", "last_seen", "confidence_rank")


@query(f"WITH {_MEMORY} SELECT body, count(DISTINCT section)::BIGINT AS n_sections, min(section) AS first_section FROM m GROUP BY body HAVING count(DISTINCT section) > 1")
def memory_conflicts(spark, sf_dir):
    """The same text in several sections, one row a text instead of pairs."""
    g = _memory_items(spark, sf_dir).groupBy("body").agg(F.countDistinct("section").alias("n_sections"), F.min("section").alias("first_section"))
    return g.filter("n_sections > 1")


@query(
    "SELECT user_id, last_seen::DATE AS observed, date_diff('day', last_seen::DATE, latest::DATE)::INT AS age_days, age_days > 3 AS stale FROM (SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id),"
    " (SELECT max(ts) AS latest FROM events)"
)
def memory_stale(spark, sf_dir):
    """Users whose last event is more than three days before the latest of all."""
    events = table(spark, sf_dir, "events")
    last = events.groupBy("user_id").agg(F.max("ts").alias("last_seen"))
    latest = events.agg(F.max("ts").alias("latest"))  # one row
    age = F.datediff(F.to_date("latest"), F.to_date("last_seen"))
    return last.join(F.broadcast(latest)).select("user_id", F.to_date("last_seen").alias("observed"), age.alias("age_days"), (age > 3).alias("stale"))


_STATES = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}
_ALLOWED = {("signup", "view"), ("view", "view"), ("view", "click"), ("click", "view"), ("click", "click"), ("click", "purchase"), ("purchase", "view"), ("view", "error"), ("click", "error"), ("error", "view")}
_PAIRS = ", ".join(f"'{a}>{b}'" for a, b in sorted(_ALLOWED))


@query(
    f"SELECT before || '>' || event_type AS step, count(*)::BIGINT AS n, min(event_id) AS first_event FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before"
    f" FROM events) WHERE before IS NOT NULL AND before || '>' || event_type NOT IN ({_PAIRS}) GROUP BY 1"
)
def transition_violations(spark, sf_dir):
    """Steps of a user's log that the table of allowed transitions lacks."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select("event_id", F.concat_ws(">", F.lag("event_type").over(w), "event_type").alias("step"), F.lag("event_type").over(w).alias("before"))
    wrong = steps.filter(F.col("before").isNotNull() & ~F.col("step").isin(*[f"{a}>{b}" for a, b in sorted(_ALLOWED)]))
    return wrong.groupBy("step").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("SELECT user_id, count(*)::BIGINT AS n, max(event_id) AS last_event, arg_max(event_type, event_id) AS status FROM events GROUP BY user_id")
def job_states(spark, sf_dir):
    """The fold of an append-only log: the last event of each key is its state."""
    last = F.max_by("event_type", "event_id")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"), last.alias("status"))


@query("SELECT event_id, (props::JSON ->> 'k')::BIGINT AS k FROM events WHERE json_valid(props)")
def json_records(spark, sf_dir):
    """Records of a JSON column; lines that don't parse are left out."""
    k = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    return table(spark, sf_dir, "events").select("event_id", k.alias("r")).filter("r IS NOT NULL").select("event_id", "r.k")


@query("SELECT event_id, 'k: ' || (props::JSON ->> 'k') AS flat FROM events")
def flat_records(spark, sf_dir):
    """Records as lines of path and value."""
    return with_flat(table(spark, sf_dir, "events"), "props", "flat").select("event_id", "flat")


_HREFS = "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1))) AS target FROM pages"
_PATH = "'/' || regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1)"


@query(f"SELECT target, count(*)::BIGINT AS n_inbound FROM ({_HREFS}) WHERE target NOT IN (SELECT {_PATH} FROM pages) GROUP BY target")
def missing_targets(spark, sf_dir):
    """Link targets that no page has, with their inbound links."""
    return _links(spark, sf_dir).join(_paths(spark, sf_dir), F.col("target") == F.col("path"), "left_anti").groupBy("target").agg(F.count("*").alias("n_inbound"))


def _links(spark, sf_dir):
    hrefs = F.array_distinct(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(hrefs).alias("target"))


def _paths(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("/"), F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)).alias("path"))


@query(
    f"SELECT p.page_id, CASE WHEN n_out IS NULL THEN 'isolated' ELSE 'orphan' END AS class FROM (SELECT page_id, {_PATH} AS path FROM pages) p LEFT JOIN (SELECT page_id, count(*) AS n_out FROM ({_HREFS}) GROUP BY page_id) o"
    f" USING (page_id) WHERE path NOT IN (SELECT target FROM ({_HREFS}))"
)
def link_orphans(spark, sf_dir):
    """Pages that no link reaches; isolated ones have no links either."""
    links = _links(spark, sf_dir)
    alone = _paths(spark, sf_dir).join(links.select(F.col("target").alias("path")).distinct(), "path", "left_anti")
    out = links.select("page_id", F.lit(1).alias("n_out")).distinct()
    return alone.join(out, "page_id", "left").select("page_id", F.when(F.col("n_out").isNull(), "isolated").otherwise("orphan").alias("class"))


_TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"
_SLUG = f"regexp_replace(regexp_replace(replace(lower({_TITLE}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(
    f"SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY slug ORDER BY page_id) = 1 THEN slug ELSE slug || '-' || page_id END AS slug FROM (SELECT page_id, CASE WHEN {_SLUG} = '' THEN 'entity' ELSE {_SLUG} END AS slug FROM pages)"
)
def page_slugs(spark, sf_dir):
    """Slugs of the page titles; all but the first page of a slug get their id as a suffix."""
    slugs = table(spark, sf_dir, "pages").select("page_id", T.slugify(F.regexp_extract("html", "<title>([^<]*)", 1)).alias("slug"))
    first = slugs.groupBy("slug").agg(F.min("page_id").alias("first"))
    return slugs.join(first, "slug").select("page_id", F.when(F.col("page_id") == F.col("first"), F.col("slug")).otherwise(F.concat_ws("-", "slug", F.col("page_id").cast("string"))).alias("slug"))


@query(
    "SELECT page_id, host, CASE WHEN regexp_matches(path, '(?i)(^|/)(\\.env|id_rsa|[^/]*\\.(pem|key|pfx|p12)|credentials\\.json|secrets?\\.json)$') THEN 'sensitive' WHEN regexp_matches(path, '[а-яА-Я]') THEN 'sensitive'"
    " WHEN contains(url, '?') OR contains(url, '#') THEN 'review' ELSE 'ingest' END AS plan FROM (SELECT page_id, url, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages WHERE url IS NOT NULL)"
)
def ingest_plan(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").filter("url IS NOT NULL")
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    secret = path.rlike(r"(?i)(^|/)(\.env|id_rsa|[^/]*\.(pem|key|pfx|p12)|credentials\.json|secrets?\.json)$") | path.rlike("[а-яА-Я]")
    plan = F.when(secret, "sensitive").when(F.contains("url", F.lit("?")) | F.contains("url", F.lit("#")), "review").otherwise("ingest")
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), plan.alias("plan"))


@query(
    "SELECT host, page_id, used, used <= 20000 AS allowed FROM (SELECT host, page_id, sum(size) OVER (PARTITION BY host ORDER BY page_id)::BIGINT AS used FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, strlen(html) AS size FROM pages))"
)
def export_budget(spark, sf_dir):
    """A running budget of bytes over the pages of each host, carried from cell to cell of page numbers."""
    sized = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.octet_length("html").cast("long").alias("size"))
    return running(sized, "host", "page_id", "size", 1 << 16).select("host", "page_id", "used", (F.col("used") <= 20000).alias("allowed"))


@query(
    "SELECT page_id, length(t)::BIGINT AS n_chars, sha256(t) AS digest FROM (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '(?m)^#.*$', '', 'g'), '\\[\\[([^\\]]*)\\]\\]', '\\1', 'g')) AS t FROM pages)"
)
def legacy_cleanup(spark, sf_dir):
    """Comments, headings and double brackets go from a page's body."""
    html = F.regexp_replace("html", r"(?s)<!--.*?-->", "")
    t = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?md)^#.*$", ""), r"\[\[([^\]]*)\]\]", "$1"))
    return table(spark, sf_dir, "pages").select("page_id", F.length(t).cast("long").alias("n_chars"), T.digest(t).alias("digest"))


@query("SELECT s.status, d.lang, count(*)::BIGINT AS n, round(avg(d.n_chars), 6) AS mean_chars FROM st s JOIN documents d USING (doc_id) GROUP BY ALL", "st")
def status_by_language(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    s = statuses(docs, table(spark, sf_dir, "labels")).join(docs.select("doc_id", "lang", "n_chars"), "doc_id")
    return s.groupBy("status", "lang").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("SELECT c_custkey, c_name, c_mktsegment, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey ORDER BY ALL")
def dump_ordered(spark, sf_dir):
    """A table joined with its lookups and ordered by every column, as a dump."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    out = joined.select("c_custkey", "c_name", "c_mktsegment", "n_name", "r_name")
    return out.orderBy(*out.columns)


@query()
def evidence_bundle_budget(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    current = revisions(docs).filter("is_current").select(F.col("arrival").alias("doc_id"))
    return evidence_bundle(docs.join(current, "doc_id", "left_semi"))


@query()
def porter_search(spark, sf_dir):
    return stemmed_counts(_docs(spark, sf_dir), "standing onely reds", 10)


_PAGE_NODES = _NODES.replace("FROM documents", "FROM (SELECT page_id AS doc_id, html AS text FROM pages)")


@query(
    f"{_PAGE_NODES} SELECT doc_id AS page_id, document_order::INT AS document_order, heading, depth::INT AS depth, parent_order::INT AS parent_order, a::INT AS char_start, b::INT AS char_end,"
    f" {_LINE.format('a')} AS line_start, {_LINE.format('greatest(a, b - 1)')} AS line_end FROM o"
)
def page_nodes(spark, sf_dir):
    """Pages are ingested as plain text: their tags are words like any other."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))
    found = tree.nodes(pages).withColumnRenamed("doc_id", "page_id")
    return found.select("page_id", "document_order", "heading", "depth", "parent_order", "char_start", "char_end", "line_start", "line_end")


_NOTE = "'# ' || source || ' ' || lang || chr(10) || chr(10) || text || chr(10) || '## Origin ##' || chr(10) || 'doc ' || doc_id || chr(10) || '```' || chr(10) || '# code' || chr(10) || '```' || chr(10) || '#####' || chr(10) || chr(10) || '  late title  ' || chr(10) || '####### seven' || chr(10) || '# End'"


@query(
    "SELECT doc_id, number::INT AS number, level, title, length(regexp_extract(m, '^[^\\n]*'))::INT AS first_line, parent FROM (SELECT *, coalesce((SELECT max(q.number) FROM h q WHERE q.doc_id = h.doc_id AND q.number < h.number AND q.level < h.level), 0)::INT AS parent FROM h)"
    .replace("SELECT doc_id, number", f"WITH n AS (SELECT doc_id, regexp_extract_all({_NOTE}, '(?m)^#{{1,6}}\\s+.+?\\s*$') AS ms FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, m, i AS number, length(regexp_extract(m, '^#+'))::INT AS level, trim(regexp_extract(m, '^#+\\s+((.|\\n)*)', 1), E' \\n\\t\\r') AS title FROM (SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS i FROM n)) SELECT doc_id, number", 1)
)
def markdown_outline(spark, sf_dir):
    """The headings of a Markdown note made of each document, with their parents; lines in a fence count, as in a plain search."""
    note = F.concat(
        F.lit("# "), "source", F.lit(" "), "lang", F.lit("\n\n"), "text", F.lit("\n## Origin ##\ndoc "), F.col("doc_id").cast("string"), F.lit("\n```\n# code\n```\n#####\n\n  late title  \n####### seven\n# End"),
    )
    notes = _docs(spark, sf_dir).filter("text IS NOT NULL").select("doc_id", note.alias("text"))
    first = lambda h: F.length(F.substring_index(T.piece(F.col("text"), h["start"], h["end"]), "\n", 1))
    row = lambda h: F.struct(*[h[c].alias(c) for c in ("number", "level", "title")], first(h).alias("first_line"), h["parent"].alias("parent"))
    return tree.with_sections(notes, markdown=True).select("doc_id", F.inline(F.transform("heads", row)))
