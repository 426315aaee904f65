"""DuckDB SQL for the queries that SQL can express."""

from .quality_rules import RULES, STOP_WORDS

_OP1 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages
), k AS (
  SELECT html, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY html
)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN keeper > page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN keeper > page_id THEN keeper END AS refers_to
FROM p LEFT JOIN k USING (html)
"""

_OP3 = r"""
WITH l AS (
  SELECT doc_id, line, place, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS place
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))
), k AS (
  SELECT key, max(doc_id) AS keeper FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), m AS (
  SELECT l.*, coalesce(doc_id <> keeper, false) AS gone FROM l LEFT JOIN k USING (key)
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_OP7 = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q
  FROM (SELECT DISTINCT vec_id, embedding FROM embeddings)
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum([x[1] * x[2] FOR x IN list_zip(a.q, b.q)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 10
"""

_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TESTS = " AND ".join(
    f"100 * {r.top} {sign} {bound} * {r.bottom}" for r in RULES for sign, bound in ((">=", r.low), ("<=", r.high)) if bound is not None
)
_OP10 = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place
  FROM (SELECT doc_id, [x FOR x IN regexp_split_to_array(t, '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM d)
), g AS (
  SELECT doc_id, place, word, lead(word) OVER p AS second, lead(word, 2) OVER p AS third FROM w WINDOW p AS (PARTITION BY doc_id ORDER BY place)
), r AS (
  SELECT doc_id, place FROM (
    SELECT doc_id, place, count(*) OVER (PARTITION BY doc_id, word, second, third) AS n FROM g WHERE third IS NOT NULL) WHERE n > 1
), c AS (
  SELECT doc_id, count(DISTINCT place + step)::BIGINT AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS s(step) GROUP BY doc_id
), k AS (
  SELECT doc_id, count(*)::BIGINT AS n_words, sum(length(word))::BIGINT AS word_chars, count_if(lower(word) IN ({_STOP}))::BIGINT AS n_stop_words
  FROM w GROUP BY doc_id
), l AS (
  SELECT doc_id, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclaim
  FROM d
), a AS (
  SELECT l.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, len(ls)::BIGINT AS n_lines, coalesce(n_stop_words, 0) AS n_stop_words, n_exclaim
  FROM l LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a
)
SELECT *, NOT base_failed AND {_TESTS} AS kept FROM b
"""

#: CRC-32 (reflected, polynomial 0xEDB88320): the table for a byte, and a checksum of a list of bytes.
_CRC_TABLE = "crc AS (SELECT [list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) FOR x IN range(256)] AS t)"


def _crc(data: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {data}), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"


def _field(value: str) -> str:
    return f"coalesce(strlen({value}) || ':' || {value}, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_field(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _tree(name: str, base: str, key: str) -> str:
    """Nodes (key, level, place, node) above ``base``, and runs of eight with the level above them."""
    return f"""{name} AS (
  SELECT {key}, 0 AS level, place, node FROM {base}
  UNION ALL
  SELECT {key}, level + 1, place // 8, sha256(string_agg(node, '' ORDER BY place))
  FROM (SELECT *, count(*) OVER (PARTITION BY {key}) AS n FROM {name}) WHERE n > 1 GROUP BY {key}, level, place // 8
), {name}_run AS (
  SELECT {key}, level, place // 8 AS up, list(node ORDER BY place) AS run FROM {name}
  WHERE level < (SELECT max(level) FROM {name} o WHERE o.{key} = {name}.{key}) GROUP BY {key}, level, place // 8
)"""


def _folds(name: str, base: str, tree: str, key: str) -> str:
    """Steps up from ``base`` (key, id, place, node, proof) through the runs of ``tree``."""
    others = "list_concat(run[:place % 8], run[place % 8 + 2:])"
    own = "list_concat(run[:place % 8], [node], run[place % 8 + 2:])"
    return f"""{name} AS (
  SELECT {key}, id, 0 AS level, place, node, proof FROM {base}
  UNION ALL
  SELECT {key}, id, level + 1, place // 8, sha256(array_to_string({own}, '')), proof || array_to_string({others}, '')
  FROM {name} JOIN {tree}_run USING ({key}, level) WHERE up = place // 8
), {name}_end AS (SELECT id, arg_max(node, level) AS node, arg_max(proof, level) AS proof, arg_max({key}, level) AS {key} FROM {name} GROUP BY id)"""


_OP12 = f"""
WITH RECURSIVE {_CRC_TABLE}, d AS (
  SELECT doc_id, coalesce('+' || lang, '') AS part, {_leaf('text')} AS node,
    CASE WHEN {_crc("[ascii(c) FOR c IN string_split(doc_id::VARCHAR, '')]")} % 3 = 0
      THEN {_leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS altered
  FROM documents, crc
), l AS (
  SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id, node) - 1 AS place FROM d
), {_tree('t', 'l', 'part')}, s AS (
  SELECT 0 AS whole, part, row_number() OVER (ORDER BY part) - 1 AS place, node AS subroot, node
  FROM (SELECT part, arg_max(node, level) AS node FROM t GROUP BY part)
), {_tree('u', 's', 'whole')}, root AS (SELECT arg_max(node, level) AS root FROM u),
f AS (SELECT part, doc_id AS id, place, coalesce(altered, node) AS node, '' AS proof FROM l), {_folds('g', 'f', 't', 'part')},
h AS (SELECT 0 AS whole, g.id, s.place, g.node, g.proof FROM g_end g JOIN s USING (part)), {_folds('k', 'h', 'u', 'whole')}
SELECT l.doc_id, l.node AS leaf, s.subroot, root, sha256(k.proof) AS proof_sha256, k.node AS folded_root, k.node = root AS verified
FROM l JOIN s USING (part) JOIN k_end k ON k.id = l.doc_id, root
"""

#: The bytes of a run: letters from U+00C0 to U+00FF are two in UTF-8, 195 and the letter less 64.
_RUN_BYTES = "flatten([CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [195, ord(c) - 64] END FOR c IN string_split(doc_id || ':' || run, '')])"
_OP11 = f"""
WITH RECURSIVE {_CRC_TABLE}, r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL
), c AS (
  SELECT run, n, {_crc(_RUN_BYTES)} AS h FROM r, crc
), v AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM c)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, place, left(word, place - 1) AS head, substr(word, place + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS place FROM v)
), less AS (
  SELECT DISTINCT word, n, head || tail AS rest FROM cut
), pairs AS (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b USING (place, head, tail) WHERE a.word <> b.word
  UNION ALL SELECT l.word, v.word, v.n FROM less l JOIN v ON v.word = rest
  UNION ALL SELECT v.word, l.word, l.n FROM less l JOIN v ON v.word = rest
), best AS (
  SELECT word, count(*)::BIGINT AS n_near, max(m) AS m FROM pairs GROUP BY word
), formed AS (
  SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 5 * v.n THEN m END AS form_n,
    CASE WHEN m >= 5 * v.n THEN (SELECT min(other) FROM pairs p WHERE p.word = v.word AND p.m = best.m) END AS form
  FROM v LEFT JOIN best USING (word)
), chain AS (
  SELECT word, word AS root, 0 AS steps FROM formed
  UNION ALL SELECT c.word, f.form, steps + 1 FROM chain c JOIN formed f ON f.word = c.root WHERE f.form IS NOT NULL
)
SELECT word, form, arg_max(root, steps) AS root, any_value(n) AS n, any_value(n_near) AS n_near, any_value(form_n) AS form_n
FROM formed JOIN chain USING (word) GROUP BY word, form
"""

ORACLES: dict[str, str] = {"op1_warc_index_merge": _OP1, "op3_line_dedup": _OP3, "op7_exact_topk": _OP7, "op10_quality_rules": _OP10, "op11_spelling": _OP11, "op12_merkle_manifest": _OP12}
