"""Queries over credentials and personal data in documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import entropy, text_of
from ..operators import detection as D
from ..operators.redaction import redact, redacted
from ..sources.tables import table
from .registry import query


def _sql(pattern: str) -> str:
    return pattern.replace("'", "''")


_REAL = lambda p, group=0: f"len([x FOR x IN regexp_extract_all(text, '{_sql(p)}', {group}) IF NOT regexp_matches(trim(x), '{_sql(D.PLACEHOLDER)}')])"
_LABELS = [*((k, _REAL(p)) for k, p in D.TOKENS.items()), ("Suspicious assignment", _REAL(D.ASSIGNMENT, 1))]


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS label, {n}::INT AS n FROM documents WHERE {n} > 0" for k, n in _LABELS))
def token_findings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.explode(D.findings(F.col("text"))).alias("f"))
    return docs.select("doc_id", "f.label", "f.n")


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{_sql(D.EMAIL)}'))::INT AS n FROM documents WHERE contains(text, '@') AND n > 0")
def email_findings(spark, sf_dir):
    hits = F.size(F.regexp_extract_all("text", F.lit(f"({D.EMAIL})"), 1))
    return table(spark, sf_dir, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", hits.alias("n")).filter("n > 0")


@query(
    f"SELECT doc_id, line::INT AS line, ip FROM (SELECT doc_id, line, unnest(regexp_extract_all(x, '{D.PRIVATE_IP}')) AS ip FROM (SELECT doc_id, unnest(ls) AS x, unnest(generate_series(1, len(ls))) AS line"
    " FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))) WHERE NOT starts_with(ip, '127.')"
)
def private_ip_findings(spark, sf_dir):
    """Every private address, with its line."""
    ips = lambda x: F.filter(F.regexp_extract_all(x, F.lit(f"({D.PRIVATE_IP})"), F.lit(1)), lambda ip: ~ip.startswith("127."))
    found = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(ips(x), lambda ip: F.struct((i + 1).alias("line"), ip.alias("ip")))))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("f")).select("doc_id", "f.line", "f.ip")


_HIST = "list_sum([-p * log2(p) FOR p IN [(length(t) - length(replace(t, c, ''))) / length(t)::DOUBLE FOR c IN list_distinct(string_split(t, ''))]])"
_PARTS = "[p FOR p IN string_split_regex(lower(regexp_replace(k, '([a-z0-9])([A-Z])', '\\1_\\2', 'g')), '[_.-]+') IF p <> '']"
_JOINED = "ps || [ps[i] || coalesce(ps[i + 1], '') FOR i IN range(1, len(ps) + 1)]"
_LIST = lambda words: ", ".join(f"'{x}'" for x in words)
_NAMES = lambda words: f"len([x FOR x IN {_JOINED} IF regexp_matches(x, '({'|'.join(words)})$')]) > 0"
_STRENGTH = (
    f"CASE WHEN starts_with(k, '--') OR len(ps) = 0 OR ps[-1] IN ({_LIST(D.OTHER_SUFFIXES)}) OR list_contains(ps, 'public') THEN NULL WHEN {_NAMES(D.STRONG_WORDS)} THEN 'strong'"
    f" WHEN {_NAMES(D.SECRET_WORDS)} THEN 'weak' WHEN list_has_any(ps, [{_LIST(D.KEY_KINDS)}]) THEN NULL WHEN list_contains(ps, 'key') THEN 'weak' END"
)
_HAS = lambda p: f"regexp_matches(v, '{_sql(p)}')"
_LIKE = (
    f"CASE WHEN length(v) < CASE WHEN strength = 'strong' THEN 6 ELSE 8 END OR {_HAS(D.EXPRESSION)} OR {_HAS(D.COLOUR)} OR {_HAS(D.ADDRESS)} THEN false"
    f" WHEN contains(v, '/') THEN length(v) >= 20 AND {_HAS('[a-z]')} AND {_HAS('[A-Z]')} AND {_HAS('[0-9]')} AND {_HIST.replace('(t', '(v')} >= 3.5"
    f" WHEN {_HAS(D.DOTTED)} OR {_HAS(D.VERSION)} OR {_HAS(D.HYPHENED)} OR contains(v, ' ') THEN false WHEN strength = 'strong' THEN true WHEN {_HAS(D.WORD)} OR {_HAS(D.CONSTANT)} THEN false"
    f" ELSE ({_HAS(chr(92) + 'p{L}')} AND ({_HAS('[0-9]')} OR {_HAS('[!@#$%^&*=?~]')})) OR ({_HAS('[a-z]')} AND {_HAS('[A-Z]')} AND length(v) >= 12) END"
)
_OTHER = lambda v: f"regexp_matches(trim({v}), '{_sql(D.VARIABLE)}') OR regexp_matches({v}, '{_sql(D.PLACEHOLDER)}')"
# This engine's patterns can't look behind: what may not stand before a name is matched instead.
_BEFORE = lambda p: p.replace("(?i)", "(?i)(?:^|[^A-Za-z0-9_.-])", 1)
_PAIRS = lambda p, of, text: f"SELECT {of}, unnest(regexp_extract_all({text}, '{_sql(p)}', 1)) AS k, trim(unnest(regexp_extract_all({text}, '{_sql(p)}', 2))) AS v"


@query(
    f"""SELECT doc_id, key, strength, count(*)::INT AS n FROM (SELECT doc_id, k AS key, v, {_STRENGTH} AS strength FROM (
  SELECT *, {_PARTS} AS ps FROM ({_PAIRS(_BEFORE(D.QUOTED), 'doc_id', 'text')} FROM documents))) WHERE strength IS NOT NULL AND NOT ({_OTHER('v')}) AND {_LIKE} GROUP BY ALL"""
)
def quoted_secret_findings(spark, sf_dir):
    """Quoted assignments under a key that names a secret, with a value like a credential."""
    text, pattern = F.col("text"), F.lit(D.NAME_EDGE + D.QUOTED)
    pairs = F.arrays_zip(F.regexp_extract_all(text, pattern, 1).alias("k"), F.regexp_extract_all(text, pattern, 2).alias("v"))
    # The end of the pattern is quick to look for and spares most texts the search for the whole of it.
    docs = table(spark, sf_dir, "documents").filter(text.rlike(r"[:=][ \t]*[\"']"))
    found = docs.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", F.col("p.k").alias("key"), F.col("p.v").alias("value"))
    found = found.withColumn("strength", D.key_strength(F.col("key"))).filter("strength IS NOT NULL")
    real = found.filter(~D.stands_for_another(F.col("value")) & D.credential_like(F.col("value"), F.col("strength") == "strong"))
    return real.groupBy("doc_id", "key", "strength").agg(F.count("*").cast("int").alias("n"))


_LINES = "SELECT doc_id, unnest(ls) AS x, unnest(generate_series(1, len(ls))) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"
_SHOWN = "regexp_extract(y, '^[^:]+://[^:@/]+:([^@/]+)@', 1)"
_SHAPES = " UNION ALL ".join(
    f"SELECT doc_id, line, '{k}' AS label FROM l WHERE len([y FOR y IN regexp_extract_all(x, '{_sql(p)}', {g}) IF NOT regexp_matches(trim(y), '{_sql(D.PLACEHOLDER)}')"
    f" AND NOT ({_SHOWN} <> '' AND (lower({_SHOWN}) IN ({_LIST(D.STOCK_PASSWORDS)}) OR {_OTHER(_SHOWN)}))]) > 0"
    for k, p, g in [*((k, p, 0) for k, p in D.TOKENS.items()), ("Suspicious assignment", D.ASSIGNMENT, 1)]
)


@query(
    f"""WITH l AS ({_LINES}), a AS ({_PAIRS(_BEFORE(D.QUOTED), 'doc_id, line', 'x')} FROM l UNION ALL {_PAIRS(D.UNQUOTED, 'doc_id, line', 'x')} FROM l), f AS (
  {_SHAPES} UNION ALL SELECT doc_id, line, 'secret assignment' FROM (SELECT *, {_STRENGTH} AS strength FROM (SELECT *, {_PARTS} AS ps FROM a)) WHERE strength IS NOT NULL AND NOT ({_OTHER('v')}) AND {_LIKE}
  UNION ALL SELECT doc_id, line, 'connection-string password' FROM (SELECT doc_id, line, unnest(regexp_extract_all(x, '{_sql(D.FIELD)}', 1)) AS v FROM l) WHERE NOT ({_OTHER('v')}) AND lower(v) NOT IN ({_LIST(D.STOCK_PASSWORDS)}))
SELECT doc_id, label, string_agg(line, ',' ORDER BY line) AS lines FROM (SELECT DISTINCT doc_id, label, line FROM f) GROUP BY doc_id, label"""
)
def secret_findings(spark, sf_dir):
    """Lines of each kind of secret of every text; texts are looked at line by line, and rows stay where they are."""
    quick = F.col("text").rlike(r"(?i)[:=]|A[KS]IA|gh[pousr]_|github_pat_|xox|sk-|AIza|eyJ|PRIVATE KEY")
    found = table(spark, sf_dir, "documents").filter(quick).select("doc_id", D.secret_findings(F.col("text")).alias("f")).filter(F.size("f") > 0)
    labels = F.array_sort(F.array_distinct(F.col("f.label")))
    lines = F.transform(labels, lambda k: F.struct(k.alias("label"), F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter("f", lambda x: x["label"] == k), lambda x: x["line"]))), ",").alias("lines")))
    return found.select("doc_id", F.inline(lines))


_SECRET_FILE = _sql(D.SECRET_FILE)


@query(
    f"SELECT page_id, name, CASE WHEN regexp_matches(name, '{_SECRET_FILE}') THEN 'secret file' WHEN regexp_matches(name, '{_sql(D.CODE_FILE)}') THEN 'source code' ELSE 'text' END AS kind"
    " FROM (SELECT page_id, regexp_replace(url, '^[a-z]+://[^/]*|[?#].*$', '', 'g') AS name FROM pages)"
)
def file_kinds(spark, sf_dir):
    """Names of secret files and of source code, by the path of every page."""
    name = F.regexp_replace("url", "^[a-z]+://[^/]*|[?#].*$", "")
    kind = F.when(F.col("name").rlike(D.SECRET_FILE), "secret file").when(F.col("name").rlike(D.CODE_FILE), "source code").otherwise("text")
    return table(spark, sf_dir, "pages").select("page_id", name.alias("name")).select("page_id", "name", kind.alias("kind"))


@query(
    f"SELECT doc_id, token, round({_HIST.replace('(t', '(token').replace(', c', ', c')}, 6) AS bits FROM (SELECT doc_id, unnest([regexp_replace(x, '^=+|=+$', '', 'g') FOR x IN regexp_extract_all(text, '{D.CANDIDATE}')]) AS token FROM documents)"
    f" WHERE length(token) >= 32 AND regexp_matches(token, '[a-z]') AND regexp_matches(token, '[A-Z]') AND regexp_matches(token, '[0-9]') AND {_HIST.replace('(t', '(token')} >= {D.LOWEST_ENTROPY}"
)
def high_entropy_tokens(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(D.random_tokens(F.col("text"))).alias("token"))
    return found.select("doc_id", "token", F.round(entropy(F.col("token")), 6).alias("bits"))


@query(
    "SELECT doc_id, round(-sum(n / total * log2(n / total)), 6) AS bits FROM (SELECT doc_id, n::DOUBLE AS n, sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS total FROM ("
    "SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE text <> '') GROUP BY ALL)) GROUP BY doc_id"
)
def character_entropy(spark, sf_dir):
    """Bits a character of every document; its characters are counted before they are shuffled, some dozens for each document."""
    docs = table(spark, sf_dir, "documents").filter("text <> ''")
    counts = docs.select("doc_id", F.explode(F.split("text", "")).alias("c")).groupBy("doc_id", "c").agg(F.count("*").cast("double").alias("n"))
    # The sum of n log2 n and the total give the entropy without a second pass.
    of_doc = counts.groupBy("doc_id").agg(F.sum("n").alias("total"), F.sum(F.col("n") * F.log2("n")).alias("weighted"))
    return of_doc.select("doc_id", F.round(F.log2("total") - F.col("weighted") / F.col("total"), 6).alias("bits"))


@query()
def redact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redacted(F.col("text")).alias("redacted"))


@query()
def residual_checks(spark, sf_dir):
    return redact(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "residual")


@query("SELECT doc_id, count(*)::BIGINT AS n_license_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '(?i)\\b(licensed|license|copyright)\\b') GROUP BY doc_id")
def license_lines(spark, sf_dir):
    lines = F.filter(F.split(text_of("text"), "\n"), lambda x: x.rlike(r"(?i)\b(licensed|license|copyright)\b"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(lines).cast("long").alias("n_license_lines")).filter("n_license_lines > 0")
