"""Queries of the whole record's checks and of the export policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import audit, policy
from ..sources.tables import status, table
from .registry import query

#: Records are documents; faults are planted by rule of their number.
_RULES = {"lost": 97, "altered": 89, "shifted": 83, "far": 79, "unbound": 73, "unrendered": 71, "edited": 67, "opposed": 11, "unheld": 41}


def _planted(name: str) -> str:
    return f"doc_id % {_RULES[name]} = {list(_RULES).index(name) + 1}"


_LINE = "coalesce([x FOR x IN string_split(text, chr(10)) IF length(x) > 30][1], '')"


@query(
    f"x AS (SELECT d.doc_id, text, status, {_LINE} AS line FROM documents d JOIN st ON st.doc_id = d.doc_id WHERE text IS NOT NULL), e AS (SELECT * FROM x WHERE line <> '' AND NOT ({_planted('unheld')}))"
    f" SELECT 'missing_source_bytes' AS fault, 'r' || doc_id AS key FROM x WHERE {_planted('lost')} UNION ALL SELECT 'source_digest_mismatch', 'r' || doc_id FROM x WHERE {_planted('altered')} AND NOT ({_planted('lost')})"
    f" UNION ALL SELECT 'invalid_locator', 'e' || doc_id FROM e WHERE {_planted('far')} UNION ALL SELECT 'evidence_quote_mismatch', 'e' || doc_id FROM e WHERE {_planted('shifted')} AND NOT ({_planted('far')})"
    f" UNION ALL SELECT 'missing_dependency', 'e' || doc_id FROM e WHERE {_planted('unbound')}"
    f" UNION ALL SELECT 'reviewed_claim_without_evidence', 'c' || doc_id FROM x WHERE status = 'reviewed' AND doc_id NOT IN (SELECT doc_id FROM e)"
    f" UNION ALL SELECT 'rendered_page_missing', 'p' || doc_id FROM x WHERE {_planted('unrendered')} UNION ALL SELECT 'render_conflict', 'p' || doc_id FROM x WHERE {_planted('edited')} AND NOT ({_planted('unrendered')})"
    f" UNION ALL SELECT 'invalid_contradiction', 'o' || doc_id FROM x WHERE {_planted('opposed')} AND doc_id + 7 NOT IN (SELECT doc_id FROM x)",
    "st",
)
def validate_record(spark, sf_dir):
    """All nine checks over the record that documents and labels make, with faults planted by rule."""
    # Labels send their claims as records of their own, so texts aren't shuffled to meet them.
    rows = table(spark, sf_dir, "documents").filter("text IS NOT NULL")
    rule = {k: F.expr(_planted(k).replace(" = ", " == ")) for k in _RULES}
    name = lambda prefix, x=F.col("doc_id"): F.concat(F.lit(prefix), x.cast("string"))
    line = F.coalesce(F.get(F.filter(F.split("text", "\n"), lambda x: F.length(x) > 30), F.lit(0)), F.lit(""))
    text, lined = F.col("text"), rows.withColumn("line", line)
    start = F.instr("text", F.col("line")) - 1
    quote = F.struct(
        name("e").alias("evidence"), name("c").alias("claim"), F.when(rule["far"], F.length("text")).otherwise(start).cast("int").alias("start"), F.when(rule["far"], F.length("text") + 5).otherwise(start + F.length("line")).cast("int").alias("end"),
        F.when(rule["shifted"], F.concat("line", F.lit("?"))).otherwise(F.col("line")).alias("quote"),
    )
    held = (F.col("line") != "") & ~rule["unheld"]
    page = F.concat(F.lit("# "), F.col("line"))
    records = lined.select(
        name("r").alias("revision"), T.digest(text).alias("digest"), F.when(~rule["lost"], F.when(rule["altered"], F.concat(text, F.lit("x"))).otherwise(text)).alias("stored"), "text",
        F.array(F.struct(name("c").alias("claim"), F.lit("candidate").alias("status"))).alias("claims"), F.when(held, F.array(quote)).alias("evidence"), F.when(~rule["unbound"], F.array(name("c"))).alias("dependencies"),
        F.array(F.struct(name("p").alias("path"), T.digest(page).alias("digest"), F.when(~rule["unrendered"], F.when(rule["edited"], F.concat(page, F.lit("!"))).otherwise(page)).alias("content"))).alias("pages"),
        F.when(rule["opposed"], F.array(F.struct(name("o").alias("id"), name("c").alias("left"), name("c", F.col("doc_id") + 7).alias("right")))).alias("contradictions"),
    )
    judged = table(spark, sf_dir, "labels").select(F.array(F.struct(name("c").alias("claim"), status().alias("status"))).alias("claims"))
    return audit.validate(records.unionByName(judged, allowMissingColumns=True))


_POLICY = policy.Policy(denied=("**/*secret*", "de/*1", "**/en/?"), allowed=("**/*[0-9]", "**/*.html"), max_files=40, max_total_bytes=60_000)
_PARTS_SQL = " OR ".join(f"contains(lower(normal), '{p}')" for p in policy.PARTS)
_NAME = "string_split(normal, '/')[-1]"


@query(
    "WITH f AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_replace(url, '^[a-z]+://[^/]+/', '') AS path, strlen(html)::BIGINT AS size FROM pages WHERE url IS NOT NULL),"
    " n AS (SELECT *, array_to_string([x FOR x IN string_split(trim(path), '/') IF x <> '' AND x <> '.'], '/') AS normal FROM f),"
    " r AS (SELECT *, CASE WHEN normal = '' THEN 'empty' WHEN trim(path)[1] IN ('/', '~') THEN 'absolute' WHEN list_contains(string_split(trim(path), '/'), '..') THEN 'traversal' WHEN regexp_matches(trim(path), '[*?\\[\\]]') THEN 'glob'"
    f" WHEN count(*) OVER (PARTITION BY host, normal) > 1 THEN 'duplicate' WHEN regexp_matches(normal, '(^.*/.*secret.*$)|(^.*secret.*$)|(^de/.*1$)|(^(.*/)?en/.$)') OR regexp_matches({_NAME}, '^.*secret.*$') THEN 'denied'"
    f" WHEN {_NAME} IN ('.netrc', 'kubeconfig', 'credentials', 'secrets') OR {_PARTS_SQL} THEN 'credential name' WHEN NOT regexp_matches(normal, '([0-9]|\\.html)$') THEN 'not allowed' END AS rule FROM n),"
    " s AS (SELECT *, sum(CASE WHEN rule IS NULL THEN 1 ELSE 0 END) OVER w AS place, coalesce(sum(CASE WHEN rule IS NULL THEN size END) OVER w, 0) AS used FROM r WINDOW w AS (PARTITION BY host ORDER BY page_id))"
    f" SELECT page_id, host, normal, coalesce(rule, CASE WHEN place > {_POLICY.max_files} THEN 'too many files' WHEN used > {_POLICY.max_total_bytes} THEN 'over budget' END) AS verdict, place::BIGINT AS place, used::BIGINT AS used FROM s"
)
def export_policy(spark, sf_dir):
    """The verdict on every page's path as a file of its host: rules first, then the budget over what is left."""
    pages = table(spark, sf_dir, "pages").filter("url IS NOT NULL")
    files = pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_replace("url", "^[a-z]+://[^/]+/", "").alias("path"), F.octet_length("html").cast("long").alias("size"))
    return policy.judged(files, _POLICY, "host", "page_id").select("page_id", "host", "normal", "verdict", "place", "used")
