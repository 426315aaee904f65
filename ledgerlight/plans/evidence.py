"""Queries over sources, revisions, claims, evidence and their audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search
from ..sources.tables import anchored, claims, evidence, revisions, statuses, table
from .registry import query


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query("SELECT source, digest, arrival, copies, is_current FROM cur", "rev cur")
def revisions_current(spark, sf_dir):
    return revisions(_docs(spark, sf_dir))


@query("SELECT source, sum(copies)::BIGINT AS n_documents, count(*)::BIGINT AS n_revisions, sum(copies - 1)::BIGINT AS n_reused FROM rev GROUP BY source", "rev")
def revision_dedupe(spark, sf_dir):
    r = revisions(_docs(spark, sf_dir))
    return r.groupBy("source").agg(F.sum("copies").alias("n_documents"), F.count("*").alias("n_revisions"), F.sum(F.col("copies") - 1).alias("n_reused"))


@query(
    "SELECT s.source, c.arrival AS current_doc_id, c.digest, length(d.text)::BIGINT AS n_chars FROM (SELECT DISTINCT source FROM documents) s"
    " LEFT JOIN (SELECT * FROM cur WHERE is_current) c USING (source) LEFT JOIN documents d ON d.doc_id = c.arrival",
    "rev cur",
)
def sources_with_current(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    current = revisions(docs).filter("is_current").select("source", F.col("arrival").alias("current_doc_id"), "digest")
    sizes = docs.select(F.col("doc_id").alias("current_doc_id"), F.length("text").cast("long").alias("n_chars"))
    return docs.select("source").distinct().join(current, "source", "left").join(sizes, "current_doc_id", "left").select("source", "current_doc_id", "digest", "n_chars")


@query("SELECT source, arrival, digest, lag(digest) OVER (PARTITION BY source ORDER BY arrival) AS supersedes FROM rev", "rev")
def revision_lineage(spark, sf_dir):
    r = revisions(_docs(spark, sf_dir))
    return r.select("source", "arrival", "digest", F.lag("digest").over(Window.partitionBy("source").orderBy("arrival")).alias("supersedes"))


@query(
    "SELECT arrival, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', (('0x' || substr(h, 17, 1))::INT % 4) + 1, 1)"
    f" || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS revision_id FROM (SELECT arrival, sha1(from_hex('{T.NAMESPACE}') || encode(source || chr(10) || digest)) AS h FROM rev)",
    "rev",
)
def revision_ids(spark, sf_dir):
    r = revisions(_docs(spark, sf_dir))
    return r.select("arrival", T.uuid5(F.concat("source", F.lit("\n"), "digest")).alias("revision_id"))


@query(
    "SELECT doc_id, CASE WHEN length(t) = 0 THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END END::BIGINT AS n_lines,"
    " strlen(t)::BIGINT AS n_bytes, length(t)::BIGINT AS n_chars, CASE WHEN starts_with(t, '%PDF-') THEN 'application/pdf'"
    " WHEN contains(substr(t, 1, 4096), chr(0)) THEN 'refused' ELSE 'text/plain' END AS media_type FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
)
def doc_lines(spark, sf_dir):
    t = T.text_of("text")
    lines = F.when(F.length(t) == 0, 0).otherwise(T.newlines(t) + F.when(t.endswith("\n"), 0).otherwise(1))
    media = F.when(t.startswith("%PDF-"), "application/pdf").when(F.contains(F.substring(t, 1, 4096), F.lit("\0")), "refused").otherwise("text/plain")
    return _docs(spark, sf_dir).select("doc_id", lines.cast("long").alias("n_lines"), F.octet_length(t).cast("long").alias("n_bytes"), F.length(t).cast("long").alias("n_chars"), media.alias("media_type"))


@query("SELECT claim_id, doc_id, source, char_start::INT AS char_start, char_end::INT AS char_end, digest FROM ev", "ev")
def claim_evidence(spark, sf_dir):
    return _evidence(spark, sf_dir).select("claim_id", "doc_id", "source", "char_start", "char_end", "digest")


@query(
    "SELECT claim_id, doc_id, substr(body, char_start + 1, char_end - char_start) = claim_text AS valid,"
    " (length(substr(body, 1, char_start)) - length(replace(substr(body, 1, char_start), chr(10), '')) + 1)::INT AS line_start,"
    " (length(substr(body, 1, greatest(char_start, char_end - 1))) - length(replace(substr(body, 1, greatest(char_start, char_end - 1)), chr(10), '')) + 1)::INT AS line_end FROM ev",
    "ev",
)
def locator_roundtrip(spark, sf_dir):
    docs = _docs(spark, sf_dir).select("doc_id", T.text_of("text").alias("body"))
    df = _evidence(spark, sf_dir).join(docs, "doc_id")
    start, end, body = F.col("char_start"), F.col("char_end"), F.col("body")
    valid = T.piece(body, start, end) == F.col("quote")
    return df.select("claim_id", "doc_id", valid.alias("valid"), T.line_at(body, start).alias("line_start"), T.line_at(body, F.greatest(start, end - 1)).alias("line_end"))


@query("SELECT source, digest, ev.claim_id, ev.doc_id FROM ev JOIN (SELECT * FROM cur WHERE NOT is_current) c USING (source, digest)", "rev cur ev")
def stale_claims(spark, sf_dir):
    old = revisions(_docs(spark, sf_dir)).filter("NOT is_current").select("source", "digest")
    return _evidence(spark, sf_dir).join(old, ["source", "digest"], "left_semi").select("source", "digest", "claim_id", "doc_id")


@query("SELECT status, count(*)::BIGINT AS n FROM st GROUP BY status", "st")
def status_counts(spark, sf_dir):
    s = statuses(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))
    return s.groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, status FROM st", "st")
def claim_status(spark, sf_dir):
    return statuses(_docs(spark, sf_dir), table(spark, sf_dir, "labels"))


@query(
    "SELECT count(*)::BIGINT AS n_reviewed, count(e.doc_id)::BIGINT AS n_supported, CASE WHEN count(*) > 0 THEN round(count(e.doc_id) / count(*)::DOUBLE, 6) END AS coverage"
    " FROM st LEFT JOIN (SELECT DISTINCT doc_id FROM ev) e USING (doc_id) WHERE status = 'reviewed'",
    "st ev",
)
def citation_coverage(spark, sf_dir):
    reviewed = statuses(_docs(spark, sf_dir), table(spark, sf_dir, "labels")).filter("status = 'reviewed'")
    held = _evidence(spark, sf_dir).select("doc_id").distinct().withColumn("held", F.lit(1))
    n, k = F.count("*"), F.count("held")
    return reviewed.join(held, "doc_id", "left").agg(n.alias("n_reviewed"), k.alias("n_supported"), F.round(F.try_divide(k.cast("double"), n.cast("double")), 6).alias("coverage"))


@query("SELECT doc_id FROM st WHERE status = 'reviewed' AND NOT EXISTS (SELECT 1 FROM ev WHERE ev.doc_id = st.doc_id)", "st ev")
def claims_without_evidence(spark, sf_dir):
    reviewed = statuses(_docs(spark, sf_dir), table(spark, sf_dir, "labels")).filter("status = 'reviewed'")
    return reviewed.join(_evidence(spark, sf_dir), "doc_id", "left_anti").select("doc_id")


@query("SELECT claim_id, doc_id FROM ev WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = ev.doc_id AND l.quality = 1)", "ev")
def missing_dependencies(spark, sf_dir):
    edges = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return _evidence(spark, sf_dir).join(edges, "doc_id", "left_anti").select("claim_id", "doc_id")


@query(
    "SELECT least(a, b) AS left_id, greatest(a, b) AS right_id FROM (SELECT min(doc_id) FILTER (quality = 1) AS a, min(doc_id) FILTER (quality = 0) AS b"
    " FROM documents JOIN labels USING (doc_id) GROUP BY lang, floor(n_chars / 50)) WHERE a IS NOT NULL AND b IS NOT NULL"
)
def contradictions(spark, sf_dir):
    """One sorted pair of an accepted and a refused document of like language and length; groups never meet as pairs."""
    rows = _docs(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id")
    of = lambda q: F.min(F.when(F.col("quality") == q, F.col("doc_id")))
    pairs = rows.groupBy("lang", F.floor(F.col("n_chars") / 50)).agg(of(1).alias("a"), of(0).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    return pairs.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"))


@query(
    "SELECT item_id AS left_id, doc_id AS right_id, CASE WHEN b.item_id IS NULL THEN 'left' ELSE 'right' END AS missing"
    " FROM benchmark b FULL JOIN (SELECT doc_id FROM labels WHERE quality = 0) l ON b.item_id = l.doc_id WHERE item_id IS NULL OR doc_id IS NULL"
)
def invalid_contradictions(spark, sf_dir):
    left = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("left_id"))
    right = table(spark, sf_dir, "labels").filter("quality = 0").select(F.col("doc_id").alias("right_id"))
    both = left.join(right, F.col("left_id") == F.col("right_id"), "full").filter("left_id IS NULL OR right_id IS NULL")
    return both.withColumn("missing", F.when(F.col("left_id").isNull(), "left").otherwise("right"))


@query("SELECT DISTINCT claim_id, source, is_current FROM ev JOIN cur USING (source, digest)", "rev cur ev")
def backlinks(spark, sf_dir):
    r = revisions(_docs(spark, sf_dir)).select("source", "digest", "is_current")
    return _evidence(spark, sf_dir).join(r, ["source", "digest"]).select("claim_id", "source", "is_current").distinct()


LINE = "line <> '' AND NOT regexp_matches(line, '^(---|#|```|>)')"


@query(
    "SELECT doc_id, claim_text, (position(claim_text IN t) - 1)::INT AS char_start, (position(claim_text IN t) - 1 + length(claim_text))::INT AS char_end FROM ("
    "SELECT doc_id, t, coalesce([x FOR x IN ls IF length(x) > 30 AND NOT regexp_matches(x, '^(---|#|```|>)')][1], [x FOR x IN ls IF length(x) > 20 AND NOT starts_with(x, '#')][1]) AS claim_text"
    " FROM (SELECT doc_id, text AS t, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(text, chr(10))] AS ls FROM documents JOIN cur c ON c.arrival = doc_id)) WHERE claim_text IS NOT NULL",
    "rev cur",
)
def auto_claims(spark, sf_dir):
    """A representative line of every revision, with its locator."""
    docs = _docs(spark, sf_dir)
    rows = docs.join(revisions(docs).select(F.col("arrival").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    lines = F.transform(F.split("text", "\n"), T.strip)
    first = F.get(F.filter(lines, lambda x: (F.length(x) > 30) & ~x.rlike("^(---|#|```|>)")), F.lit(0))
    second = F.get(F.filter(lines, lambda x: (F.length(x) > 20) & ~x.startswith("#")), F.lit(0))
    found = rows.withColumn("claim_text", F.coalesce(first, second)).filter("claim_text IS NOT NULL")
    start = F.instr("text", F.col("claim_text")) - 1
    return found.select("doc_id", "claim_text", start.alias("char_start"), (start + F.length("claim_text")).alias("char_end"))


@query(
    "SELECT name, n FROM (SELECT 'documents' AS name, count(*)::BIGINT AS n FROM documents UNION ALL SELECT 'benchmark', count(*) FROM benchmark UNION ALL SELECT 'labels', count(*) FROM labels"
    " UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations UNION ALL SELECT 'events', count(*) FROM events"
    " UNION ALL SELECT 'revisions', count(*) FROM rev UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents)",
    "rev",
)
def stats(spark, sf_dir):
    names = ("documents", "benchmark", "labels", "pages", "conversations", "events")
    frames = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in names]
    docs = _docs(spark, sf_dir)
    frames.append(revisions(docs).agg(F.count("*").alias("n")).select(F.lit("revisions").alias("name"), "n"))
    frames.append(docs.agg(F.countDistinct("source").alias("n")).select(F.lit("sources").alias("name"), "n"))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


@query(
    "SELECT 'quote mismatch' AS problem, count_if(substr(body, char_start + 1, char_end - char_start) <> claim_text)::BIGINT AS n FROM ev"
    " UNION ALL SELECT 'claim length', count_if(length(trim(text)) NOT BETWEEN 1 AND 4000)::BIGINT FROM benchmark"
    " UNION ALL SELECT 'size mismatch', count_if(length(text) <> n_chars)::BIGINT FROM documents"
    " UNION ALL SELECT 'dangling label', count(*)::BIGINT FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)",
    "ev",
)
def validate_counts(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    count = lambda name, df, bad: df.agg(F.count_if(bad).alias("n")).select(F.lit(name).alias("problem"), "n")
    quotes = _evidence(spark, sf_dir)
    length = F.length(F.trim(F.col("text")))
    out = count("quote mismatch", quotes, F.col("quote") != F.col("claim_text"))
    out = out.unionByName(count("claim length", table(spark, sf_dir, "benchmark"), ~length.between(1, 4000)))
    out = out.unionByName(count("size mismatch", docs, F.length("text") != F.col("n_chars")))
    return out.unionByName(count("dangling label", table(spark, sf_dir, "labels").join(docs, "doc_id", "left_anti"), F.lit(True)))


@query(
    "SELECT source, arrival, digest, total FROM (SELECT *, count(*) OVER ()::BIGINT AS total FROM rev) ORDER BY source, arrival LIMIT 25 OFFSET 50",
    "rev",
)
def revisions_page(spark, sf_dir):
    """The third page of 25 revisions with the total: the limit is the feature."""
    r = revisions(_docs(spark, sf_dir)).select("source", "arrival", "digest")
    total = r.agg(F.count("*").alias("total"))
    return r.orderBy("source", "arrival").offset(50).limit(25).join(F.broadcast(total))  # one row


QUESTION = "the stand of that and und die"
_TOKENS = r"regexp_extract_all(replace(lower(coalesce({}, '')), 'ß', 'ss'), '[\p{{L}}\p{{N}}_]+')"
_TERMS = ", ".join(f"'{t}'" for t in sorted(set(search.query_terms(QUESTION))))


@query(
    f"SELECT doc_id, score FROM (SELECT doc_id, len([x FOR x IN {_TOKENS.format('text')} IF x IN ({_TERMS})])::DOUBLE AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 10"
)
def search_terms(spark, sf_dir):
    hits = search.term_counts(_docs(spark, sf_dir).select("doc_id", "text"), QUESTION)
    return hits.select("doc_id", "score").orderBy(F.desc("score"), "doc_id").limit(10)


_PREFIXES = ("stan", "erst", "zu")
_TF = ", ".join(f"len([x FOR x IN w IF starts_with(x, '{p}')])::DOUBLE AS tf{i}" for i, p in enumerate(_PREFIXES))
_SCORE = " + ".join(
    f"greatest(ln((n - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / mean))" for i in range(len(_PREFIXES))
)


@query(
    f"SELECT doc_id, round(score, 6) AS score FROM (SELECT doc_id, {_SCORE} AS score FROM (SELECT doc_id, len(w)::DOUBLE AS dl, {_TF} FROM (SELECT doc_id, {_TOKENS.format('text')} AS w FROM documents)),"
    f" (SELECT count(*)::DOUBLE AS n, avg(len(w)) AS mean, {', '.join(f'''count_if(len([x FOR x IN w IF starts_with(x, '{p}')]) > 0)::DOUBLE AS n{i}''' for i, p in enumerate(_PREFIXES))}"
    f" FROM (SELECT {_TOKENS.format('text')} AS w FROM documents)) WHERE tf0 + tf1 + tf2 > 0) ORDER BY score DESC, doc_id LIMIT 10"
)
def search_bm25(spark, sf_dir):
    scored = search.bm25(_docs(spark, sf_dir), " ".join(_PREFIXES), "doc_id")
    return scored.orderBy(F.desc("score"), "doc_id").limit(10).select("doc_id", F.round("score", 6).alias("score"))


_SEM = f"len(list_intersect(w, [{_TERMS}])) / len(list_distinct(w || [{_TERMS}]))::DOUBLE"


@query(f"SELECT item_id, round({_SEM}, 6) AS semantic FROM (SELECT item_id, list_distinct({_TOKENS.format('text')}) AS w FROM benchmark)")
def rerank_jaccard(spark, sf_dir):
    rows = search.rerank(table(spark, sf_dir, "benchmark").select("item_id", T.text_of("text").alias("text")), QUESTION, "text")
    return rows.select("item_id", F.round("semantic", 6).alias("semantic"))


_POOL = (
    f"p AS (SELECT item_id, text, score, {_SEM} AS semantic FROM (SELECT item_id, text, len([x FOR x IN {_TOKENS.format('text')} IF x IN ({_TERMS})])::DOUBLE AS score,"
    f" list_distinct({_TOKENS.format('text')}) AS w FROM benchmark) WHERE score > 0 ORDER BY score DESC, item_id LIMIT {search.POOL}),"
    f" b AS (SELECT *, semantic * {1 - search.BLEND} + score / (max(score) OVER ()) * {search.BLEND} AS rank_raw FROM p)"
)


def _blended(spark, sf_dir) -> DataFrame:
    hits = search.term_counts(table(spark, sf_dir, "benchmark").select("item_id", "text"), QUESTION)
    pool = hits.orderBy(F.desc("score"), "item_id").limit(search.POOL)
    return search.blend(search.rerank(pool, QUESTION, "text"), "item_id")


@query(f"WITH {_POOL} SELECT item_id, round(semantic, 6) AS semantic_score, round(rank_raw, 6) AS rank_score FROM b ORDER BY rank_raw DESC, item_id LIMIT 10")
def blend_topk(spark, sf_dir):
    """Sorted on the unrounded value, rounded afterwards."""
    best = _blended(spark, sf_dir).orderBy(F.desc("rank_raw"), "item_id").limit(10)
    return best.select("item_id", F.round("semantic", 6).alias("semantic_score"), F.round("rank_raw", 6).alias("rank_score"))


_NEAR = (
    "cw AS (SELECT item_id AS claim_id, text AS claim_text, string_split_regex(text, '\\s+') AS w FROM benchmark WHERE text <> ''), dw AS (SELECT doc_id, text AS body, string_split_regex(coalesce(text, ''), '\\s+') AS w FROM documents),"
    " near AS (SELECT claim_id, claim_text, doc_id, body FROM (SELECT DISTINCT doc_id, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c, w[i + 3] AS d FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM dw)) g"
    " JOIN cw ON len(cw.w) >= 6 AND g.a = cw.w[2] AND g.b = cw.w[3] AND g.c = cw.w[4] AND g.d = cw.w[5] JOIN dw USING (doc_id) UNION SELECT claim_id, claim_text, doc_id, body FROM ev)"
)
_SUPPORT = f"len(list_intersect(list_distinct({_TOKENS.format('claim_text')}), {_TOKENS.format('body')})) / len(list_distinct({_TOKENS.format('claim_text')}))::DOUBLE"


def _supported(spark, sf_dir) -> DataFrame:
    """How far the whole text of each document that holds a claim, or shares its anchor of words, covers the claim's words."""
    docs = _docs(spark, sf_dir).select("doc_id", T.text_of("text").alias("text"))
    known = claims(table(spark, sf_dir, "benchmark"))
    near = anchored(docs, known).join(docs, "doc_id")
    whole = F.size(F.split("claim_text", r"\s+")) >= 6
    met = near.filter(whole | F.contains("text", F.col("claim_text"))).dropDuplicates(["claim_id", "doc_id"])
    return met.select("claim_id", "doc_id", search.support(F.col("claim_text"), F.col("text")).alias("raw"))


@query(f"{_NEAR} SELECT claim_id, doc_id, round(raw, 6) AS support, raw >= {search.SUPPORT} AS supported FROM (SELECT claim_id, doc_id, {_SUPPORT} AS raw FROM near)", "ev")
def citation_support(spark, sf_dir):
    return _supported(spark, sf_dir).select("claim_id", "doc_id", F.round("raw", 6).alias("support"), (F.col("raw") >= search.SUPPORT).alias("supported"))


@query(
    f"{_NEAR} SELECT claim_id, round(max(raw), 6) AS support, max(raw) >= {search.SUPPORT} AS supported, arg_max(doc_id, (raw, -doc_id)) AS best_doc, count(*)::BIGINT AS n_documents"
    f" FROM (SELECT claim_id, doc_id, {_SUPPORT} AS raw FROM near) GROUP BY claim_id",
    "ev",
)
def claim_support(spark, sf_dir):
    """A claim's support is its best document's, the smallest of equal ones."""
    g = _supported(spark, sf_dir).groupBy("claim_id").agg(F.max("raw").alias("raw"), F.max_by("doc_id", F.struct("raw", -F.col("doc_id"))).alias("best_doc"), F.count("*").alias("n_documents"))
    return g.select("claim_id", F.round("raw", 6).alias("support"), (F.col("raw") >= search.SUPPORT).alias("supported"), "best_doc", "n_documents")


@query(
    f"WITH {_POOL}, t AS (SELECT item_id, text, row_number() OVER (ORDER BY rank_raw DESC, item_id) AS n FROM b QUALIFY n <= 5)"
    " SELECT count(*) = 0 AS insufficient, count(*)::BIGINT AS n_statements, coalesce(string_agg(text || ' [' || n || ']', ' ' ORDER BY n), '') AS answer FROM t"
)
def ask_answer(spark, sf_dir):
    """The five best statements, numbered; an empty answer where nothing is found."""
    best = _blended(spark, sf_dir).orderBy(F.desc("rank_raw"), "item_id").limit(5)
    numbered = best.withColumn("n", F.row_number().over(Window.orderBy(F.desc("rank_raw"), "item_id")))  # five rows
    line = F.struct("n", F.concat("text", F.lit(" ["), F.col("n").cast("string"), F.lit("]")).alias("line"))
    return numbered.agg((F.count("*") == 0).alias("insufficient"), F.count("*").alias("n_statements"), F.array_join(F.sort_array(F.collect_list(line))["line"], " ").alias("answer"))


@query(
    "SELECT claim_id, 'claims/' || claim_id || '.md' AS path, count(*)::BIGINT AS n_sources, sha256('# Claim ' || claim_id || chr(10) || chr(10) || claim_text || chr(10) || chr(10)"
    " || string_agg('- ' || source || '#' || doc_id || ' [' || char_start || ',' || char_end || ')', chr(10) ORDER BY doc_id)) AS page_digest FROM ev GROUP BY claim_id, claim_text",
    "ev",
)
def rendered_pages(spark, sf_dir):
    """A Markdown page for each claim with evidence; its digest tells whether a page has changed."""
    e = _evidence(spark, sf_dir)
    bullet = F.concat(F.lit("- "), "source", F.lit("#"), F.col("doc_id").cast("string"), F.lit(" ["), F.col("char_start").cast("string"), F.lit(","), F.col("char_end").cast("string"), F.lit(")"))
    g = e.groupBy("claim_id", "claim_text").agg(F.count("*").alias("n_sources"), F.sort_array(F.collect_list(F.struct("doc_id", bullet.alias("line")))).alias("lines"))
    page = F.concat(F.lit("# Claim "), F.col("claim_id").cast("string"), F.lit("\n\n"), "claim_text", F.lit("\n\n"), F.array_join("lines.line", "\n"))
    return g.select("claim_id", F.concat(F.lit("claims/"), F.col("claim_id").cast("string"), F.lit(".md")).alias("path"), "n_sources", T.digest(page).alias("page_digest"))
