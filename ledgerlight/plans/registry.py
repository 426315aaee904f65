"""Queries and their equivalents in SQL, collected by name."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Common table expressions that the SQL texts share.
PARTS = {
    "rev": "rev AS (SELECT source, sha256(coalesce(text, '')) AS digest, min(doc_id) AS arrival, max(doc_id) AS latest, count(*)::BIGINT AS copies FROM documents GROUP BY 1, 2)",
    "cur": "cur AS (SELECT r.*, latest = (max(latest) OVER (PARTITION BY source)) AS is_current FROM rev r)",
    "st": "st AS (SELECT d.doc_id, CASE WHEN quality IS NULL THEN 'candidate' WHEN quality = 1 AND coalesce(toxic, 0) = 0 THEN 'reviewed'"
    " ELSE 'retracted' END AS status FROM documents d LEFT JOIN labels l USING (doc_id))",
    "ev": "ev AS (SELECT item_id AS claim_id, b.text AS claim_text, doc_id, source, sha256(d.text) AS digest, position(b.text IN d.text) - 1 AS char_start,"
    " position(b.text IN d.text) - 1 + length(b.text) AS char_end, d.text AS body FROM documents d JOIN benchmark b ON contains(d.text, b.text) AND b.text <> '')",
}


def query(sql: str | None = None, parts: str = ""):
    """Registers a query under its function's name; ``parts`` names the expressions that its SQL needs."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            head = ", ".join(PARTS[p] for p in parts.split())
            # A text that goes on with expressions of its own begins with the name of the first one.
            more = ", " if re.match(r"\w+ AS \(", sql) else " "
            ORACLES[f.__name__] = f"WITH {head}{more}{sql}" if head else sql
        return f

    return add
