"""Markdown and JSON pieces whose grammar nests: links, frontmatter, code fences, flattened records.

Each is a small function of one text, run over Arrow batches.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a link's target may span, and parentheses that it may nest.
LONGEST_TARGET, DEEPEST = 8192, 32
FENCE = re.compile(r"[ \t]*(`{3,}|~{3,})")
SECRET_KEY = re.compile(r"(?i)(?:key|token|secret|pass(?:w(?:or)?d)?|pwd|credential|auth)")


def outside_fences(text: str) -> str:
    """The text with fenced blocks blanked, line by line; a fence closes with its own mark, at least as long, alone on its line."""
    out, mark = [], ""
    for line in text.splitlines(keepends=True):
        m = FENCE.match(line)
        if m and not mark:
            mark = m[1]
        elif m and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not line[m.end() :].strip():
            mark = ""
        elif not mark:
            out.append(line)
            continue
        out.append("\n")
    return "".join(out)


def _target(text: str, at: int) -> tuple[str, int] | None:
    """The target that starts at ``at``, inside angle brackets or with balanced parentheses, and where it ends."""
    stop = min(len(text), at + LONGEST_TARGET)
    if text[at : at + 1] == "<":
        end = text.find(">", at, stop)
        return None if end < 0 or "\n" in text[at:end] else (text[at + 1 : end], end + 1)
    depth, out = 0, []
    while at < stop and depth <= DEEPEST:
        c = text[at]
        if c == "\\" and at + 1 < stop:
            out.append(text[at + 1])
            at += 2
            continue
        if c.isspace() or c == ")" and not depth:
            return "".join(out), at
        depth += (c == "(") - (c == ")")
        out.append(c)
        at += 1
    return None


def links(text: str) -> list[str]:
    """The targets of inline links in order; escaped brackets, fenced blocks and images' marks aside."""
    text, found = outside_fences(text), []
    opened = 0
    for m in re.finditer(r"\\.|\]\(|[\[\]]", text, re.S):
        if m[0] == "[":
            opened += 1
            continue
        was, opened = opened, max(0, opened - (m[0] in ("]", "](")))
        if m[0] != "](" or not was:
            continue
        start = m.end() + len(re.match(r"[ \t]*", text[m.end() : m.end() + 64])[0])
        hit = _target(text, start)
        if hit and re.match(r"\s*(?:\"[^\"]*\"|'[^']*'|\([^()]*\))?\s*\)", text[hit[1] : hit[1] + LONGEST_TARGET]):
            found.append(hit[0])
    return found


def resolve(target: str, page: str) -> tuple[str, str]:
    """(kind, path): ``skipped`` for addresses and anchors, ``escaped`` for paths above the root, else ``local``."""
    parts = urlsplit(target)
    if parts.scheme or parts.netloc or not parts.path:
        return "skipped", ""
    base = "" if parts.path.startswith("/") else posixpath.dirname(page)
    path = posixpath.normpath(posixpath.join(base, unquote(parts.path).lstrip("/")))
    return ("escaped", "") if path == ".." or path.startswith("../") else ("local", path)


def frontmatter(text: str) -> dict[str, str]:
    """The plain ``key: value`` lines between two lines of three hyphens at the start of a text."""
    m = re.match(r"---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\Z)", text, re.S)
    pairs = (line.split(":", 1) for line in m[1].split("\n") if ":" in line and not line.startswith((" ", "#", "-"))) if m else ()
    return {k.strip(): v.strip().strip("\"'") for k, v in pairs}


def flatten(value: str) -> str | None:
    """A JSON value as lines ``path: value``, values under keys that name a secret masked whole; null where it doesn't parse."""
    try:
        tree = json.loads(value)
    except ValueError:
        return None
    out, work = [], [("", tree)]
    while work:
        path, node = work.pop()
        if path and SECRET_KEY.search(path.rpartition(".")[2]) and node not in (None, ""):
            out.append(f"{path}: [REDACTED:value]")
        elif isinstance(node, dict):
            work += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(node.items())]
        elif isinstance(node, list):
            work += [(path, v) for v in reversed(node)]
        else:
            out.append(f"{path}: {node}" if path else str(node))
    return "\n".join(out)


def _mapped(f: Callable[[str], object], kind: str):
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def with_flat(rows: DataFrame, column: str, name: str) -> DataFrame:
    return rows.withColumn(name, _mapped(flatten, "string")(F.col(column)))


def link_table(pages: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """path, target, kind and resolved path of every link."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(p, t, *resolve(t, p)) for p, body in zip(frame[path], frame[text]) if body and p for t in links(body)]
            yield pd.DataFrame(rows, columns=["path", "target", "kind", "resolved"])

    return pages.select(path, text).mapInPandas(run, "path string, target string, kind string, resolved string")


def with_frontmatter(pages: DataFrame, text: str = "text", name: str = "meta") -> DataFrame:
    return pages.withColumn(name, _mapped(frontmatter, "map<string,string>")(F.col(text)))
