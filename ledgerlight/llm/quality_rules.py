"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of characters other than U+0020 and U+0009 to U+000D. A row of ``RULES`` bounds a
ratio of two counts; ratios are compared as products of integers, so that no rounding enters.

Defined cases: a null text counts as an empty one; an empty text has no words and fails the base
rule; rows that repeat are judged one by one; an empty table gives an empty table; further columns
of the input are ignored by ``scores`` and kept untouched by ``keep_good``, whatever their names.
Windows of three words are compared by their chained XXH64 value inside one text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, fresh_name, text_or_empty


@dataclass(frozen=True)
class Rule:
    """``low`` % <= 100 * top / bottom <= ``high`` %; a side that is None does not bound."""

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None


# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "on", "are", "as", "with", "by", "from", "at", "this", "be", "or",
    "der", "die", "das", "und", "ist", "nicht", "ein", "zu", "den", "von", "mit", "für", "auf", "des", "sich", "dem", "im",
    "le", "la", "les", "et", "est", "une", "un", "dans", "que", "qui", "pour", "du", "pas", "sur", "au", "par", "ce",
    "el", "los", "y", "en", "es", "una", "por", "con", "se", "las", "del", "no", "su", "de", "al", "lo",
)

#: The method's own thresholds, in percent. ``letters`` are the characters of words, ``marks`` the listed symbols and exclamation marks.
RULES = (
    Rule("mean word length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols per word", "n_symbols", "n_words", high=10),
    Rule("exclamation marks per word", "n_exclaim", "n_words", high=30),
    Rule("stop words per word", "n_stop_words", "n_words", low=4),
    Rule("repeated lines per line", "n_dup_lines", "n_lines", high=50),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = "#*$%&|<>"


def _add_counts(df: DataFrame, text: Column, n: dict[str, str]) -> DataFrame:
    """Adds the counts under the names in ``n``; each step is a projection, so that nothing is computed twice."""
    words, hashes, order, hits = (F.col(n[k]) for k in ("words", "hashes", "order", "hits"))
    df = df.withColumns({
        n["words"]: F.array_remove(F.split(text, f"[{SPACE_CLASS}]+"), ""),
        n["lines"]: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]")),
        n["word_chars"]: F.length(F.regexp_replace(text, f"[{SPACE_CLASS}]+", "")).cast("long"),
        n["n_symbols"]: (F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))).cast("long"),
        n["n_exclaim"]: (F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit("")))).cast("long"),
    })
    window = F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    df = df.withColumns({
        n["n_words"]: F.size(words).cast("long"),
        n["n_lines"]: F.size(n["lines"]).cast("long"),
        n["n_dup_lines"]: (F.size(n["lines"]) - F.size(F.array_distinct(n["lines"]))).cast("long"),
        n["n_stop_words"]: F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        n["hashes"]: F.slice(window, 1, F.greatest(F.size(words) - 2, F.lit(0))),
    })
    # Only a text with a window that repeats pays for the sort of (hash, place).
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    df = df.withColumn(n["order"], F.when(repeats, F.sort_array(pairs)))
    alike = F.filter(order, lambda x, i: (x["h"] == F.get(order, i - 1)["h"]) | (x["h"] == F.get(order, i + 1)["h"]))
    df = df.withColumn(n["hits"], F.sort_array(F.transform(alike, lambda x: x["i"])))
    covered = F.transform(hits, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(hits, i + 1) - p, F.lit(3))))
    return df.withColumn(n["n_repeat_words"], F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long"))


def _names(taken: list[str]) -> dict[str, str]:
    keys = ("words", "lines", "hashes", "order", "hits", "n_lines", "n_stop_words", "n_exclaim", *BASE)
    return {k: fresh_name(taken, f"_quality_{k}") for k in keys}


def base_failed(n: dict[str, str]) -> Column:
    return (F.col(n["n_words"]) < 50) | (100 * F.col(n["n_repeat_words"]) > 50 * F.col(n["n_words"]))


def passes(rules, n: dict[str, str]) -> Column:
    """The threshold table as one boolean expression."""
    tests = [F.lit(True)]
    for r in rules:
        top, bottom = F.col(n[r.top]), F.col(n[r.bottom])
        tests += [100 * top >= r.low * bottom] if r.low is not None else []
        tests += [100 * top <= r.high * bottom] if r.high is not None else []
    return reduce(lambda a, b: a & b, tests)


def scores(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the counts, ``base_failed`` and ``kept`` of every row."""
    n = _names(["doc_id", "text"])
    df = _add_counts(docs.select("doc_id", "text"), text_or_empty("text"), n)
    failed = base_failed(n)
    counts = [F.col(n[k]).alias(k) for k in (*BASE, "n_lines", "n_stop_words", "n_exclaim")]
    return df.select("doc_id", *counts, failed.alias("base_failed"), (~failed & passes(rules, n)).alias("kept"))


def keep_good(docs: DataFrame, rules=RULES) -> DataFrame:
    """The rows of ``docs`` that the base rule and the table keep, with the columns of ``docs``."""
    n = _names(docs.columns)
    df = _add_counts(docs, text_or_empty("text"), n)
    # A filter would move below the projections it reads and repeat their expressions there, nested ones many times
    # over. So the verdict makes one row or none: what is taken out of an expression stays where it is.
    verdict = fresh_name(docs.columns, "_quality_verdict")
    one = F.when(~base_failed(n) & passes(rules, n), F.array(F.lit(1)))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return df.select(*columns, F.explode(one).alias(verdict)).select(*columns)
