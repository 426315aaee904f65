"""Search on word stems: a suffix-stripping stemmer over distinct words, as a pandas function."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import query_terms

# The endings of the published algorithm (Porter, 1980), by step, with what takes their place.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"),
    ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for each letter; y is a vowel after a consonant."""
    out = ""
    for i, ch in enumerate(word):
        out += "v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def _swap(word: str, endings, least: int) -> str:
    for end, new in sorted(endings, key=lambda x: -len(x[0])):
        if word.endswith(end):
            stem = word[: -len(end)]
            return stem + new if _measure(stem) > least else word
    return word


def stem(word: str) -> str:
    """The stem of a lower-case word; words of other alphabets and of two letters stay."""
    w = "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1] if w.endswith("s") and not w.endswith("ss") else w
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (m := re.fullmatch("(.*)(ed|ing)", w)) and "v" in _shape(m[1]):
        w = m[1]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _short(w):
            w += "e"
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2, 0), STEP3, 0)
    if w.endswith(("sion", "tion")):
        w = w[:-3] if _measure(w[:-3]) > 1 else w
    else:
        w = _swap(w, [(e, "") for e in STEP4], 1)
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def stemmed_counts(docs: DataFrame, question: str, limit: int) -> DataFrame:
    """doc_id and score of the ``limit`` texts with most words that share a stem with the question's."""
    wanted = sorted({stem(t) for t in query_terms(question)})

    @F.pandas_udf("long")
    def hits(words: pd.Series) -> pd.Series:
        known: dict[str, bool] = {}
        for w in {w for ws in words for w in ws}:
            known[w] = stem(w) in wanted
        return words.map(lambda ws: sum(known[w] for w in ws))

    scored = docs.select("doc_id", hits(tokens(F.coalesce("text", F.lit("")))).alias("score")).filter("score > 0")
    return scored.orderBy(F.desc("score"), "doc_id").limit(limit)
