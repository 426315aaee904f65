"""Which paths may be exported: globs as patterns, denied before allowed, names that look like credentials, and budgets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of
from .audit import running

# Names and parts of names that look like credentials.
NAMES = (".netrc", "kubeconfig", "credentials", "secrets")
PARTS = ("secret", "credential", "credentials", "passwd", "password", "token", "apikey", "api_key", "auth", "private_key")
VERDICTS = ("empty", "absolute", "traversal", "glob", "duplicate", "denied", "credential name", "not allowed", "too many files", "over budget")


@dataclass(frozen=True)
class Policy:
    denied: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ("**/*",)
    max_files: int = 0
    max_total_bytes: int = 0


def pattern_of(glob: str) -> str:
    """A glob as a pattern for whole strings: a star takes any characters, separators among them."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        # A closing bracket right after the opening one, or after its negation, stands for itself.
        inside = i + 1 + (glob[i + 1 : i + 2] == "!")
        end = glob.find("]", inside + 1) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inner = glob[i + 1 : end]
            negative = inner.startswith("!")
            out += f"[{'^' * negative}{''.join(c if c.isalnum() or c == '-' else chr(92) + c for c in inner[negative:])}]"
            i = end
        else:
            out += c if c.isalnum() or c in "_/" else f"\\{c}"
        i += 1
    return rf"(?s)^(?:{out})\z"


def matches(path: Column, globs: tuple[str, ...]) -> Column:
    """Whether a path, or its last part, fits a glob; one that begins with ``**/`` also fits without that."""
    name = F.element_at(F.split(path, "/"), -1)
    tests = [x for g in globs for x in (path.rlike(pattern_of(g)), name.rlike(pattern_of(g)), *([path.rlike(pattern_of(g[3:]))] if g.startswith("**/") else []))]
    return any_of(tests) if tests else F.lit(False)


def like_credentials(path: Column) -> Column:
    low = F.lower(path)
    return F.element_at(F.split(low, "/"), -1).isin(*NAMES) | any_of([F.contains(low, F.lit(p)) for p in PARTS])


def normalized(path: Column) -> Column:
    """A path without outer blanks, empty parts and single dots; null is empty."""
    raw = F.trim(F.coalesce(path, F.lit("")))
    parts = F.filter(F.split(raw, "/"), lambda x: (x != "") & (x != "."))
    return F.array_join(parts, "/")


def judged(files: DataFrame, policy: Policy, group: str, order: str, cell: int = 1 << 16) -> DataFrame:
    """Adds normal, verdict (the first rule against a file, or null), used and place: bytes and files that its group's accepted files take up to it.

    Rules look at one path, duplicates at the paths of a group; counts and bytes run over the files that no other rule is against, in ``order`` (whole
    numbers). ``files`` has path and size. The sums are carried from cell to cell, so no window holds a group.
    """
    raw = F.trim(F.coalesce("path", F.lit("")))
    normal = normalized(F.col("path"))
    same = files.groupBy(F.col(group).alias("_of"), normal.alias("_normal")).agg(F.count("*").alias("_copies"))
    met = files.withColumn("normal", normal).join(same, F.col(group).eqNullSafe(F.col("_of")) & (F.col("normal") == F.col("_normal")))
    rule = (
        F.when(F.col("normal") == "", "empty").when(raw.startswith("/") | raw.startswith("~"), "absolute").when(F.array_contains(F.split(raw, "/"), ".."), "traversal").when(raw.rlike(r"[*?\[\]]"), "glob")
        .when(F.col("_copies") > 1, "duplicate").when(matches(F.col("normal"), policy.denied), "denied").when(like_credentials(F.col("normal")), "credential name")
        .when(~matches(F.col("normal"), policy.allowed) if policy.allowed else F.lit(False), "not allowed")
    )
    ruled = met.withColumn("_rule", rule).drop("_of", "_normal", "_copies")
    counted = ruled.withColumn("_bytes", F.when(F.col("_rule").isNull(), F.col("size"))).withColumn("_one", F.when(F.col("_rule").isNull(), 1).otherwise(0))
    placed = running(counted, group, order, "_one", cell).withColumnRenamed("used", "place")
    summed = running(placed, group, order, "_bytes", cell)
    over = F.when((F.lit(policy.max_files) > 0) & (F.col("place") > policy.max_files), "too many files").when((F.lit(policy.max_total_bytes) > 0) & (F.col("used") > policy.max_total_bytes), "over budget")
    return summed.withColumn("verdict", F.coalesce("_rule", over)).drop("_rule", "_bytes", "_one")
