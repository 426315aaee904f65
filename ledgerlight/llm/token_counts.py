"""Token counts of sections by offset-mapped attribution.

A whole document is encoded once with a byte-level vocabulary, whose tokens' lengths add up to the
text, so the running sum of lengths gives every token its span of characters. The spans and the
sections of the document, both sorted, are interval-joined by binary search; no section is encoded on
its own, so its tokens are those of the whole text. A token that crosses a border is allocated by an
explicit rule: ``start`` gives it to the section of its first character, ``most`` to the section that
holds most of its characters (the earlier one on ties), ``share`` splits it by characters.

Spans are half-open, in code points; a token that holds only a part of a character's bytes spans that
character, and tokens that start inside one are allocated with it.

Defined cases: a null or empty text has the one empty section of its one empty line, with no tokens;
sections that are null, empty, unsorted or beyond the text get what overlaps them; characters outside
all sections belong to none; repeated rows are counted one by one; an empty table gives an empty
table; further columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

RULES = ("start", "most", "share")
COUNTS = "doc_id long, section int, start_char long, end_char long, n_tokens double, n_crossing long, doc_tokens long"


@lru_cache(maxsize=2)
def vocabulary(path: str, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    """The encoding of a rank file, and the number of bytes of each token; one for each Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, f)}
    sizes = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        sizes[rank] = len(token)
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


def character_spans(text: str, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first character, end) of consecutive tokens of ``sizes`` bytes."""
    ends = np.cumsum(sizes)
    if text.isascii():
        return ends - sizes, ends
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    at = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    return at[ends - sizes] - 1, at[ends - 1]


def line_sections(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The lines of a text, each with the line feed that ends it."""
    if text.isascii():
        cuts = np.flatnonzero(np.frombuffer(text.encode(), np.uint8) == 10) + 1
    else:
        cuts = np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32) == 10) + 1
    ends = np.append(cuts, len(text))
    return np.concatenate([[0], cuts]), ends


def allocate(start: np.ndarray, end: np.ndarray, sec_start: np.ndarray, sec_end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and crossing tokens of each section; sections are sorted and don't overlap."""
    n, m = len(sec_start), len(start)
    counts, crossing = np.zeros(n), np.zeros(n, np.int64)
    if not n or not m:
        return counts, crossing
    first = np.searchsorted(sec_end, start, side="right")  # the first section that ends after the token starts
    last = np.searchsorted(sec_start, end, side="left") - 1  # the last one that starts before the token ends
    inside = (first == last) & (sec_start[np.minimum(first, n - 1)] <= start) & (end <= sec_end[np.minimum(first, n - 1)])
    np.add.at(counts, first[inside], 1.0)
    for t in np.flatnonzero(~inside & (last >= first)).tolist():
        at = np.arange(first[t], last[t] + 1)
        part = np.minimum(end[t], sec_end[at]) - np.maximum(start[t], sec_start[at])
        at, part = at[part > 0], part[part > 0]
        crossing[at] += 1
        if not len(at):
            continue
        if rule == "share":
            counts[at] += part / (end[t] - start[t])
        elif rule == "most":
            counts[at[part.argmax()]] += 1
        elif sec_start[at[0]] <= start[t]:
            counts[at[0]] += 1
    return counts, crossing


def count_tokens(docs: DataFrame, path: str, pattern: str, rule: str = "most", sections: str | None = None) -> DataFrame:
    """One row for each section of each row, in the order of the sections.

    ``sections`` names a column of arrays of structs (start_char, end_char); without it they are the lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, sizes = vocabulary(path, pattern)
        for whole in batches:
            for first in range(0, len(whole), 500):
                batch = whole.slice(first, 500)
                owners, numbers, starts, ends, counts, crossings, totals = [], [], [], [], [], [], []
                for i, doc in enumerate(batch.column(0).to_pylist()):
                    text = batch.column(1)[i].as_py()
                    if sections is None:
                        a, b = line_sections(text)
                    else:
                        given = [(s["start_char"], s["end_char"]) for s in batch.column(2)[i].as_py() or [] if s and None not in s.values()]
                        a, b = np.array(sorted(given), np.int64).reshape(-1, 2).T
                    ids = np.array(encoding.encode_ordinary(text), np.int64)
                    n, x = allocate(*character_spans(text, sizes[ids]), a, b, rule) if len(ids) else (np.zeros(len(a)), np.zeros(len(a), np.int64))
                    owners += [doc] * len(a)
                    totals += [len(ids)] * len(a)
                    for out, new in ((numbers, np.arange(len(a))), (starts, a), (ends, b), (counts, n), (crossings, x)):
                        out.append(new)
                if owners:
                    columns = [np.concatenate(x) for x in (numbers, starts, ends, counts, crossings)]
                    yield pa.record_batch([
                        pa.array(owners, pa.int64()), pa.array(columns[0].astype(np.int32)), *(pa.array(x) for x in columns[1:]), pa.array(totals, pa.int64()),
                    ], ["doc_id", "section", "start_char", "end_char", "n_tokens", "n_crossing", "doc_tokens"])

    columns = [F.col("doc_id").cast("long"), text_or_empty("text"), *([F.col(sections)] if sections else [])]
    return docs.select(*columns).mapInArrow(run, COUNTS)
