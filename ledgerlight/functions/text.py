"""Text kernel: Column expressions for folding, tokens, digests, identities and locators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: One pattern for words everywhere: letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"
#: The namespace of name-based ids (RFC 4122, URLs).
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def casefold(x: Column) -> Column:
    return F.replace(F.lower(x), F.lit("ß"), F.lit("ss"))


def tokens(x: Column) -> Column:
    """The folded words of a text, in order."""
    return F.regexp_extract_all(casefold(x), F.lit(f"({TOKEN})"), 1)


def strip(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def collapse(x: Column) -> Column:
    return strip(F.regexp_replace(x, r"(?U)\s+", " "))


def normalize(x: Column) -> Column:
    """Lower case, every run of other characters than a-z and 0-9 one space."""
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def slugify(x: Column, fallback: str = "entity") -> Column:
    """Words joined by hyphens. Compatibility forms are left as they are: see the README."""
    slug = F.regexp_replace(F.regexp_replace(casefold(x), r"[^\p{L}\p{N}]+", "-"), "^-+|-+$", "")
    return F.when(slug == "", F.lit(fallback)).otherwise(slug)


def digest(x: Column) -> Column:
    return F.sha2(F.encode(x, "UTF-8"), 256)


def base64(x: Column) -> Column:
    """A text's bytes as one line; Spark breaks what it encodes after 76 characters."""
    return F.replace(F.base64(F.encode(x, "UTF-8")), F.lit("\r\n"), F.lit(""))


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """The name-based id of version 5, so that a repeated task makes the same id again."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1))
    parts = (F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return F.concat_ws("-", *parts)


def short_id(section: Column, body: Column, prefix: str = "mem-") -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha1(F.encode(F.concat(section, F.lit("\0"), body), "UTF-8")), 1, 12))


def newlines(x: Column) -> Column:
    return F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))


def line_at(text: Column, offset: Column) -> Column:
    """The number, from 1, of the line that holds a code point."""
    return newlines(F.substring(text, F.lit(1), offset)) + 1


def piece(text: Column, start: Column, end: Column) -> Column:
    """Code points from start to end, half-open from 0."""
    return F.substring(text, start + 1, end - start)


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    """Shared words over all words of two texts; 0 where there are none."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """The share of a's words that b has; 0 where a has none."""
    own = F.array_distinct(a)
    return F.when(F.size(own) > 0, F.size(F.array_intersect(own, b)) / F.size(own)).otherwise(F.lit(0.0))


def entropy(x: Column) -> Column:
    """Bits a character of a text of any length, from the run lengths of its sorted characters; null for an empty one."""
    chars = F.array_sort(F.split(x, ""))
    # Where a run ends, the number of characters up to there; arrays of one bind what is used more than once.
    ends = lambda cs: F.filter(F.transform(cs, lambda c, i: F.when(F.get(cs, i + 1).isNull() | (F.get(cs, i + 1) != c), i + 1)), lambda e: e.isNotNull())
    sizes = lambda es: F.zip_with(es, F.concat(F.array(F.lit(0)), F.slice(es, F.lit(1), F.size(es) - 1)), lambda e, before: (e - before).cast("double"))
    n = F.length(x).cast("double")
    bits = lambda ss: F.aggregate(ss, F.lit(0.0), lambda a, k: a - (k / n) * F.log2(k / n))
    bind = lambda value, use: F.get(F.transform(F.array(value), use), F.lit(0))
    return F.when(n > 0, bind(bind(bind(chars, ends), sizes), bits))


def any_of(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)
