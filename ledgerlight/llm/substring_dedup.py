"""Fuzzy repeated passages by collinear chaining of shared k-mer seeds.

Seeds are the minimizers of the k-mers of a text's words (A-Z in lower case): of ``window`` k-mers in a
row the one of least hash, so seeds follow each other without leaving out a word. Seeds are joined as
stars, not as pairs: every occurrence is matched with the first occurrence of the seed in the smallest
doc_id that has it, in the whole table. Occurrences travel in packs, one for each batch and range of
hashes; where a batch holds a seed very often, only its first occurrence goes to the seed's range, and
the others meet the first one by a join that splits hot keys.

A seed's star alone would lose a passage that two documents share where smaller documents hold its parts.
So where neighbouring seeds of a document don't lead to one stretch of one other document, units of them
are joined as stars too: of 4 and 8 seeds in a row, and of as many as span 44 and 50 words. The partner is
then the smallest document that shares the whole unit. As seeds leave out no word, documents with a unit of
50 words in common share these words, so a passage of 62 equal words or more is always found, whatever
other documents hold. Shorter or fuzzy ones can be missed where a smaller document holds most of their seeds.

The matches of two documents are chained in order of place: a chain gains a seed's words and pays for
the words it jumps in either text; the best chain so far that ends before a match comes from a Fenwick
tree over the places in the other text. Chains are aligned on the words themselves, between the seeds
and beyond both ends, and cut where the share of equal words falls. A passage has at least
``min_words`` words with a share of at least ``similarity``.

Results go from the later document to the earlier one: doc_id > other_id always. They follow from the
rows alone, not from how these are partitioned.

Defined cases: null and empty texts and texts of fewer than k words have no passages; very long texts are
taken whole; null doc_ids take no part; rows that share a doc_id count as one document; texts that tie for a
seed are told apart by doc_id, then place; an empty table gives an empty table; further columns are ignored
by ``passages`` and kept by ``drop_passages``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, planes, stored, text_or_empty, unplaned


@dataclass(frozen=True)
class Settings:
    k: int = 5
    window: int = 5
    min_words: int = 50
    similarity: float = 0.8
    #: Words that a chain may jump in either text.
    max_gap: int = 40
    gap_cost: float = 0.05

    @property
    def reach(self) -> int:
        """Words beyond a chain's ends in which a passage may go on without a seed."""
        return self.min_words

    @property
    def least_span(self) -> int:
        """Words that the seeds of a passage span at least: two seeds, as errors may leave few stretches of k words."""
        return self.k + 1


#: Units: seeds in a row, and of how many units in a row the one of least hash is taken; and words that seeds in a row span.
UNITS, SPANS = ((4, 3), (8, 4)), (44, 50)
#: Rows of whole documents that are chained at once, and occurrences of a seed in a batch from which it counts as hot.
DOC_ROWS, HOT = 500_000, 256

PACKS = "bucket int, kind int, pack binary"
#: Kinds of packs and of rows: seeds in their range; matches; occurrences of hot seeds; the first occurrences of hot seeds.
OWN, MATCH, HOT_PLACE, HOT_FIRST = range(4)
SEED = np.dtype([("seed", "<u8"), ("doc", "<i8"), ("at", "<i4")])
MATCHES = "kind int, seed long, doc long, pos int, rep long, rep_pos int"
FOUND = "kind int, doc long, rep long, lo int, hi int, rep_lo int, rep_hi int, seeds binary, unit long, places long"
CHAINS = "doc long, rep long, lo int, hi int, rep_lo int, rep_hi int, seeds binary"
PASSAGES = "doc_id long, other_id long, start_word int, end_word int, other_start int, other_end int, matched int, aligned int"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Bytes of texts that are taken at once, bytes whose words are hashed at once, and requests for words in a batch.
SLICE, BLOCK, REQUESTS = 1 << 20, 1 << 18, 2000
SPACE = np.isin(np.arange(256), (0x20, *range(0x09, 0x0E)))
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
BASE = np.uint64(0xD6E8FEB86659FD93)


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column without nulls, and where each text begins and the last one ends."""
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), at


def slices_of(at: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the texts that are taken at once: those that begin in one slice of the bytes."""
    return _cut_by(at[:-1] // SLICE)


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(size, BASE), np.full(size, pow(int(BASE), -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_codes(text: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, hash) of the words of texts that lie one after the other, in lower case.

    A word's hash is a polynomial of its bytes modulo 2^64, taken from running sums, and then mixed with its length.
    """
    word = np.zeros(len(text) + 2, bool)
    np.logical_not(SPACE[text], out=word[1:-1])
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    inner = np.unique(begins[(begins > 0) & (begins < len(text))])
    inner = inner[word[inner] & word[inner + 1]]  # a word that ends with its text, where the next text begins with one
    if len(inner):
        starts, ends = (np.insert(x, np.searchsorted(x, inner), inner) for x in (starts, ends))
    codes = np.empty(len(starts), np.uint64)
    at = np.searchsorted(starts, np.arange(0, len(text) + BLOCK, BLOCK)).tolist()
    for a, b in zip(at, at[1:]):
        if a == b:
            continue
        low = int(starts[a])
        part = LOWER[text[low : int(ends[b - 1])]].astype(np.uint64) + np.uint64(1)
        up, down = _powers(max(2 * BLOCK, 1 << len(part).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[a:b] - low, ends[a:b] - low
        h = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            h = (h ^ h >> np.uint64(33)) * np.uint64(factor)
        codes[a:b] = h ^ h >> np.uint64(33)
    return starts, codes


def minimizers(codes: np.ndarray, first: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, hash) of the minimizers of the k-mers of texts, whose words begin at ``first``; its last value is the end."""
    of = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(codes) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ codes[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    place = np.flatnonzero(of[:n] == of[k - 1 :]) if n else np.empty(0, np.int64)
    h, of = h[place], of[place]
    n = len(h)
    at, best, rows = np.arange(n), h.copy(), np.arange(n)
    for j in range(1, min(window, n)):
        less = (h[j:] < best[: n - j]) & (of[j:] == of[: n - j])
        best[: n - j][less] = h[j:][less]
        at[: n - j][less] = rows[j:][less]
    # A text of few k-mers is one window.
    whole = np.r_[of[window - 1 :] == of[: max(0, n - window + 1)], np.zeros(min(n, window - 1), bool)]
    at = at[whole | np.r_[True, of[1:] != of[:-1]][:n]]
    at = at[np.r_[True, at[1:] != at[:-1]][: len(at)]]
    seeds, of, place = h[at], of[at], place[at]
    place = place - first[of]
    again = np.zeros(len(first) - 1, bool)
    for d in range(1, min(window + 1, len(seeds))):
        same = (seeds[d:] == seeds[:-d]) & (of[d:] == of[:-d]) & (place[d:] - place[:-d] <= window)
        again[of[d:][same]] = True
    for text in np.flatnonzero(again).tolist():
        a, b = np.searchsorted(of, (text, text + 1)).tolist()
        seeds[a:b] = _numbered(place[a:b], seeds[a:b], window)
    return of, place, seeds


def _numbered(at: np.ndarray, seeds: np.ndarray, window: int) -> np.ndarray:
    """Gives the seeds of a stretch of repeated words their number in it, so that two such stretches match place by place."""
    order = np.lexsort((at, seeds))
    s, p = seeds[order], at[order]
    again = (s[1:] == s[:-1]) & (np.diff(p) <= window)
    if not again.any():
        return seeds
    begins = np.r_[True, ~again]
    number = np.arange(len(s)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
    out = seeds.copy()
    out[order] = s + number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return out


def _cut_by(key: np.ndarray) -> list[tuple[int, int]]:
    """(from, to) of the stretches of equal values."""
    if not len(key):
        return []
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True]).tolist()
    return list(zip(cuts, cuts[1:]))


def _batch_seeds(o: Settings, buckets: int):
    def packs(rows: np.ndarray, bucket: np.ndarray, kind: int) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = _cut_by(bucket)
        return pa.record_batch([
            pa.array([int(bucket[a]) for a, _ in cuts], pa.int32()), pa.array([kind] * len(cuts), pa.int32()), pa.array([planes(rows[a:b]) for a, b in cuts], pa.binary()),
        ], ["bucket", "kind", "pack"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, (data, at) = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            found = []
            for a, b in slices_of(at):
                begins = at[a : b + 1] - at[a]
                starts, codes = word_codes(data[at[a] : at[b]], begins[:-1])
                of, place, seeds = minimizers(codes, np.searchsorted(starts, begins), o.k, o.window)
                found.append((docs[a + of], place, seeds))
            rows = np.empty(sum(len(seeds) for _, _, seeds in found), SEED)
            if not len(rows):
                continue
            doc, place, seeds = (np.concatenate(c) for c in zip(*found))
            rows["seed"], rows["at"], rows["doc"] = seeds, place << 1, doc
            rows = rows[np.argsort(rows["seed"], kind="stable")]
            cuts = np.flatnonzero(np.r_[True, rows["seed"][1:] != rows["seed"][:-1], True])
            hot = np.flatnonzero(np.diff(cuts) > HOT)
            if len(hot):
                stays = np.ones(len(rows), bool)
                for a, b in zip(cuts[hot].tolist(), cuts[hot + 1].tolist()):
                    first = a + int(np.lexsort((rows["at"][a:b], rows["doc"][a:b]))[0])
                    stays[a:b] = False
                    stays[first] = True
                    rows["at"][first] |= 1
                others, rows = rows[~stays], rows[stays]
                yield packs(others, (others["doc"] % buckets).astype(np.int32), HOT_PLACE)
            yield packs(rows, ((rows["seed"] >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32), OWN)

    return run


def _rows(kind: int, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    """A batch of MATCHES rows with nulls in the other columns."""
    types = {"seed": np.int64, "doc": np.int64, "pos": np.int32, "rep": np.int64, "rep_pos": np.int32}
    arrays = [pa.array(np.ascontiguousarray(columns[c]).astype(t)) if c in columns else pa.nulls(n, pa.from_numpy_dtype(t)) for c, t in types.items()]
    return pa.record_batch([pa.array(np.full(n, kind, np.int32)), *arrays], ["kind", *types])


def stars(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Matches of all occurrences of a range of seeds that come in several documents, or are hot, with the first one."""
    rows = rows[np.argsort(rows["seed"], kind="stable")]
    same = rows["seed"][1:] == rows["seed"][:-1]
    near = np.r_[False, same] | np.r_[same, False] | ((rows["at"] & 1) > 0)
    rows = rows[near]
    if not len(rows):
        return
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["seed"]))]
    first = np.r_[True, rows["seed"][1:] != rows["seed"][:-1]]
    run = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    last = np.r_[heads[1:], len(rows)] - 1
    hot = np.logical_or.reduceat((rows["at"] & 1) > 0, heads)
    # A hot seed may have its only other document among the occurrences that don't come here.
    shared = (rows["doc"][heads] != rows["doc"][last]) | hot
    keep = np.flatnonzero(shared[run])
    if len(keep):
        head = heads[run[keep]]
        yield _rows(MATCH, len(keep), doc=rows["doc"][keep], pos=rows["at"][keep] >> 1, rep=rows["doc"][head], rep_pos=rows["at"][head] >> 1)
    head = heads[hot]
    if len(head):
        yield _rows(HOT_FIRST, len(head), seed=rows["seed"][head].view(np.int64), rep=rows["doc"][head], rep_pos=rows["at"][head] >> 1)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packs come sorted by range; a range is matched at once."""
    now, held = None, []
    for batch in batches:
        for bucket, kind, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            rows = unplaned(pack.as_py(), SEED)
            if kind == HOT_PLACE:
                yield _rows(HOT_PLACE, len(rows), seed=rows["seed"].copy().view(np.int64), doc=rows["doc"], pos=rows["at"] >> 1)
                continue
            if bucket != now:
                if held:
                    yield from stars(np.concatenate(held))
                now, held = bucket, []
            held.append(rows)
    if held:
        yield from stars(np.concatenate(held))


def mixed_at(rep: np.ndarray, way: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Whether the seeds from each first to each last one don't all lead to one stretch of one document."""
    changes = np.r_[0, np.cumsum((rep[1:] != rep[:-1]) | (way[1:] != way[:-1]))]
    return changes[last] != changes[first]


def units_of(doc: np.ndarray, pos: np.ndarray, rep: np.ndarray, rep_pos: np.ndarray, o: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, document, places) of the units of shared seeds, which come sorted by document and place.

    The first occurrence stands for its seed. Places are four of the unit's seeds in one number: the first
    in the upper bits, then three distances of ten bits.
    """
    again = np.r_[False, (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1])]
    doc, pos, rep, rep_pos = doc[~again], pos[~again].astype(np.int64), rep[~again], rep_pos[~again].astype(np.int64)
    seed = (rep.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (rep_pos.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seed ^= seed >> np.uint64(31)
    run = np.cumsum(np.r_[True, (doc[1:] != doc[:-1]) | (np.diff(pos) > o.max_gap + o.k)])
    way = rep_pos - pos
    found = []

    def take(at: np.ndarray, length: np.ndarray | int, h: np.ndarray) -> None:
        places = pos[at] << 30
        for i in (1, 2, 3):
            places |= (pos[at + (length - 1) * i // 3] - pos[at]) << (30 - 10 * i)
        found.append((h.view(np.int64), doc[at], places))

    for length, window in UNITS:
        n = len(doc) - length + 1
        if n <= 0:
            continue
        h = np.full(n, length, np.uint64)
        for j in range(length):
            h = (h ^ seed[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        use = (run[:n] == run[length - 1 :]) & mixed_at(rep, way, np.arange(n), np.arange(n) + length - 1)
        rank = np.r_[np.where(use, h >> np.uint64(1), np.uint64(2**64 - 1)), np.full(window - 1, 2**64 - 1, np.uint64)]
        at = np.unique(np.lib.stride_tricks.sliding_window_view(rank, window).argmin(axis=1) + np.arange(n))
        at = at[at < n]
        at = at[use[at]]
        take(at, length, h[at])
    step = np.r_[np.uint64(0), np.where(run[1:] == run[:-1], np.diff(pos), 0).astype(np.uint64)]
    for span in SPANS:
        # The first seed after which as many words are spanned: places grow within a run, and runs lie apart.
        far = run * (1 << 32) + pos
        last = np.searchsorted(far, far + (span - o.k))
        ok = np.flatnonzero(last < len(pos))
        ok = ok[run[last[ok]] == run[ok]]
        # Without a gap between seeds, equal seeds mean equal words.
        close = np.r_[0, np.cumsum(step > o.k)]
        ok = ok[(close[last[ok] + 1] == close[ok + 1]) & mixed_at(rep, way, ok, last[ok])]
        if not len(ok):
            continue
        length = last[ok] - ok + 1
        h = np.full(len(ok), span, np.uint64)
        for j in range(int(length.max())):
            more = j < length
            at = np.minimum(ok + j, len(seed) - 1)
            gap = np.where(j > 0, step[at], np.uint64(0))
            new = (h ^ seed[at] ^ (gap << np.uint64(7))) * np.uint64(0x9E3779B97F4A7C15)
            new ^= new >> np.uint64(29)
            h = np.where(more, new, h)
        take(ok, length, h)
    return tuple(np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64),) * 3


def places_of(packed: np.ndarray) -> np.ndarray:
    """All the places in the numbers that ``units_of`` makes."""
    first = packed >> 30
    return np.concatenate([first, *(first + ((packed >> shift) & 1023) for shift in (20, 10, 0))])


def chain(x: np.ndarray, y: np.ndarray, o: Settings) -> list[np.ndarray]:
    """Index arrays of the chains of matches (x, y), which come sorted by x, then y; best chain first."""
    n = len(x)
    if n == 1 or ((x[1:] > x[:-1]) & (y[1:] > y[:-1])).all():
        # All in order: the chain through all of them is best, as jumps cost the same however they are cut.
        return _cut(x, y, np.arange(n), o)
    place = np.unique(y, return_inverse=True)[1] + 1
    size = int(place.max())
    score, before = [float(o.k)] * n, [-1] * n
    tree_best, tree_at = [-np.inf] * (size + 1), [-1] * (size + 1)
    xs, ys, places = x.tolist(), y.tolist(), place.tolist()
    i = 0
    while i < n:
        j = i
        while j < n and xs[j] == xs[i]:  # matches at one place can't follow each other
            p, best, at = places[j] - 1, -np.inf, -1
            while p > 0:
                if tree_best[p] > best:
                    best, at = tree_best[p], tree_at[p]
                p &= p - 1
            gain = best - o.gap_cost * (xs[j] + ys[j])
            if at >= 0 and gain > 0:
                score[j] += gain
                before[j] = at
            j += 1
        for m in range(i, j):
            value, p = score[m] + o.gap_cost * (xs[m] + ys[m]), places[m]
            while p <= size:
                if value > tree_best[p]:
                    tree_best[p], tree_at[p] = value, m
                p += p & -p
        i = j
    used, out = np.zeros(n, bool), []
    for end in np.argsort(-np.array(score), kind="stable").tolist():
        links, at = [], end
        while at >= 0 and not used[at]:
            links.append(at)
            used[at] = True
            at = before[at]
        if links:
            out += _cut(x, y, np.array(links[::-1]), o)
    return out


def _cut(x: np.ndarray, y: np.ndarray, at: np.ndarray, o: Settings) -> list[np.ndarray]:
    a, b = x[at], y[at]
    far = np.flatnonzero((a[1:] - a[:-1] > o.max_gap + o.k) | (b[1:] - b[:-1] > o.max_gap + o.k)) + 1
    return np.split(at, far) if len(far) else [at]


def chain_rows(x: np.ndarray, y: np.ndarray, o: Settings) -> Iterator[tuple]:
    """(lo, hi, other lo, other hi, seeds) of the chains of sorted matches that span enough words."""
    for at in chain(x, y, o):
        a, b = x[at], y[at]
        if a[-1] + o.k - a[0] >= o.least_span and b[-1] + o.k - b[0] >= o.least_span:
            yield int(a[0]), int(a[-1]) + o.k, int(b[0]), int(b[-1]) + o.k, np.stack([a, b], axis=1).astype("<i4").tobytes()


def _doc_chains(o: Settings):
    """Chains of the seeds of each document, and the units that are joined further."""
    names = [x.split()[0] for x in FOUND.split(", ")]
    types = [pa.int32(), pa.int64(), pa.int64(), *[pa.int32()] * 4, pa.binary(), pa.int64(), pa.int64()]

    def found(doc: np.ndarray, pos: np.ndarray, rep: np.ndarray, rep_pos: np.ndarray) -> Iterator[pa.RecordBatch]:
        unit, of, places = units_of(doc, pos, rep, rep_pos, o)
        if len(unit):
            n = len(unit)
            yield pa.record_batch([pa.array(np.ones(n, np.int32)), pa.array(of), *(pa.nulls(n, t) for t in types[2:8]), pa.array(unit), pa.array(places)], names)
        apart = rep != doc
        doc, pos, rep, rep_pos = doc[apart], pos[apart], rep[apart], rep_pos[apart]
        order = np.lexsort((rep_pos, pos, rep, doc))
        doc, pos, rep, rep_pos = doc[order], pos[order], rep[order], rep_pos[order]
        starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (rep[1:] != rep[:-1])]) if len(doc) else np.empty(0, np.int64)
        ends = np.r_[starts[1:], len(doc)]
        # A single seed makes no chain.
        several = ends - starts > 1
        out = [(0, int(doc[a]), int(rep[a]), *c, None, None) for a, b in zip(starts[several].tolist(), ends[several].tolist()) for c in chain_rows(pos[a:b], rep_pos[a:b], o)]
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by document and place."""
        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)))
            if sum(len(c[0]) for c in held) >= DOC_ROWS:
                columns = tuple(np.concatenate(c) for c in zip(*held))
                cut = int(np.searchsorted(columns[0], columns[0][-1]))  # the last document goes on
                if cut:
                    yield from found(*(c[:cut] for c in columns))
                held = [tuple(c[cut:] for c in columns)]
        if held and len(held[0][0]):
            yield from found(*(np.concatenate(c) for c in zip(*held)))

    return run


def _unit_chains(o: Settings):
    def pair(x: np.ndarray, y: np.ndarray) -> Iterator[tuple]:
        x, y = places_of(x), places_of(y)
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        fresh = np.r_[True, (np.diff(x) != 0) | (np.diff(y) != 0)]  # units find the same matches
        return chain_rows(x[fresh], y[fresh], o)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by document, other document, place and other place."""
        held: tuple[np.ndarray, ...] | None = None
        types = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.binary()]

        def rows(parts: list[tuple[int, int]], columns) -> Iterator[pa.RecordBatch]:
            doc, rep, x, y = columns
            out = [(int(doc[a]), int(rep[a]), *c) for a, b in parts for c in pair(x[a:b], y[a:b])]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in CHAINS.split(", ")])

        for batch in batches:
            columns = tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            if held is not None:
                columns = tuple(np.concatenate(c) for c in zip(held, columns))
            if not len(columns[0]):
                continue
            cuts = np.r_[0, np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0)) + 1].tolist()
            yield from rows(list(zip(cuts[:-1], cuts[1:])), columns)
            held = tuple(c[cuts[-1] :] for c in columns)
        if held is not None:
            yield from rows([(0, len(held[0]))], held)

    return run


def _spans(o: Settings):
    """Cuts the words of each request out of its text, as codes of 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "rep", "kind", "lo", "rep_lo", "side", "first", "words", "seeds"]
        for batch in batches:
            data, at = texts_of(batch.column(0))
            texts = [data[a:b] for a, b in zip(at.tolist(), at[1:].tolist())]
            # The parts of a document's requests mostly come one after the other: their text is taken once.
            new = np.array([n == 0 or not np.array_equal(t, texts[n - 1]) for n, t in enumerate(texts)], bool)
            group, rows = np.cumsum(new) - 1, np.r_[np.flatnonzero(new), len(texts)]
            cuts = np.r_[0, np.cumsum(np.diff(at)[new])]
            ends = np.r_[0, np.cumsum(pc.list_value_length(batch.column(1)).to_numpy(zero_copy_only=False))]
            asked = pa.RecordBatch.from_struct_array(batch.column(1).flatten())
            for i, j in slices_of(cuts):
                begins = cuts[i : j + 1] - cuts[i]
                starts, codes = word_codes(np.concatenate([texts[t] for t in rows[i:j].tolist()]), begins[:-1])
                codes, words = codes.astype("<u4"), np.searchsorted(starts, begins)
                stop = int(ends[rows[j]])
                for low in range(int(ends[rows[i]]), stop, REQUESTS):
                    r = asked.slice(low, min(REQUESTS, stop - low))
                    of = group[np.searchsorted(ends, np.arange(low, low + len(r)), side="right") - 1] - i
                    a = np.maximum(0, r.column("from_word").to_numpy() - o.reach)
                    b = np.maximum(a, np.minimum(words[of + 1] - words[of], r.column("to_word").to_numpy() + o.reach))
                    cut = [codes[p:q].tobytes() for p, q in zip((words[of] + a).tolist(), (words[of] + b).tolist())]
                    made = {"first": pa.array(a.astype(np.int32)), "words": pa.array(cut, pa.binary())}
                    yield pa.record_batch([made[c] if c in made else r.column(c) for c in names], names)

    return run


def common_length(a: list, b: list) -> int:
    """The length of the longest common subsequence, by bits of whole numbers."""
    masks: dict = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


FARTHER = sorted(((i, j) for i in range(7) for j in range(7) if i or j), key=lambda x: (max(x), abs(x[0] - x[1])))


def extend(a: list, b: list) -> list[tuple[int, int, int, int]]:
    """Aligns outwards from the ends of a chain: runs (words of a, words of b, matched, aligned) until errors prevail."""
    i = j = 0
    runs: list[tuple[int, int, int, int]] = []
    while i < len(a) and j < len(b):
        n = 0
        while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
            n += 1
        if n:
            runs.append((n, n, n, n))
            i, j = i + n, j + n
            continue
        # The smallest change after which two words agree again, or the texts end.
        for di, dj in ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3)):
            p, q = a[i + di : i + di + 2], b[j + dj : j + dj + 2]
            if p and len(p) == 2 and p == q:
                runs.append((di, dj, 0, max(di, dj)))
                i, j = i + di, j + dj
                break
        else:
            # Errors stand close: single words that agree after as many words in both, or two words farther away.
            for di, dj in FARTHER:
                p, q = a[i + di : i + di + 2], b[j + dj : j + dj + 2]
                if p and q and p[0] == q[0] and (di == dj or (len(p) == 2 and p == q)):
                    runs.append((di, dj, 0, max(di, dj)))
                    i, j = i + di, j + dj
                    break
            else:
                break
    return runs


def longest(runs: list, first: int, last: int, x: int, y: int, o: Settings) -> list[tuple[int, int, int, int, int, int]]:
    """The longest segments of the runs from first to last that are similar enough, begin and end with equal words and are long enough."""
    sums = np.zeros((len(runs) + 1, 4), np.int64)
    np.cumsum(np.array(runs, np.int64).reshape(-1, 4), axis=0, out=sums[1:])
    found, parts = [], [(first, last)]
    while parts:
        first, last = parts.pop()
        if (sums[last] - sums[first])[:2].max(initial=0) < o.min_words:
            continue
        whole = [i for i in range(first, last) if runs[i][2] == runs[i][3] > 0]
        if not whole:
            continue
        begins, ends = np.array(whole), np.array(whole) + 1
        d = sums[ends][None, :, :] - sums[begins][:, None, :]
        length = np.maximum(d[..., 0], d[..., 1])
        good = (d[..., 2] >= o.similarity * d[..., 3]) & (length >= o.min_words)
        if good.any():
            i, j = np.unravel_index(int(np.where(good, length, 0).argmax()), length.shape)
            p, q = int(begins[i]), int(ends[j])
            found.append((x + int(sums[p][0]), x + int(sums[q][0]), y + int(sums[p][1]), y + int(sums[q][1]), *map(int, sums[q][2:] - sums[p][2:])))
            parts += [(first, p), (q, last)]
    return found


def joined(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The runs with neighbours of equal words as one: no passage begins or ends between them."""
    out: list[tuple[int, int, int, int]] = []
    for r in runs:
        if out and r[0] == r[1] == r[2] == r[3] and out[-1][0] == out[-1][1] == out[-1][2] == out[-1][3]:
            n = out[-1][0] + r[0]
            out[-1] = (n, n, n, n)
        else:
            out.append(r)
    return out


def align(a: np.ndarray, b: np.ndarray, a_first: int, b_first: int, seeds: np.ndarray, o: Settings) -> list[tuple[int, int, int, int, int, int]]:
    """(start, end, other start, other end, matched, aligned) of the passages of a chain."""
    xs, ys = seeds[:, 0] - a_first, seeds[:, 1] - b_first
    a_words, b_words, a, b = a, b, a.tolist(), b.tolist()
    x0, y0, px, py = int(xs[0]), int(ys[0]), int(xs[-1]), int(ys[-1])
    runs = extend(a[:x0][::-1], b[:y0][::-1])[::-1]
    start, other = x0 - sum(r[0] for r in runs), y0 - sum(r[1] for r in runs)

    def step(i: int) -> None:
        """From one seed to the next: the words of the seed as far as they don't overlap, then the gap."""
        dx, dy = int(xs[i + 1] - xs[i]), int(ys[i + 1] - ys[i])
        inside = min(o.k, dx, dy)
        runs.append((inside, inside, inside, inside))
        if dx > inside or dy > inside:
            p, q = a[xs[i] + inside : xs[i + 1]], b[ys[i] + inside : ys[i + 1]]
            equal = len(p) if p == q else common_length(p, q)
            runs.append((len(p), len(q), equal, max(len(p), len(q))))

    way = xs - ys
    turns = [0, *(np.flatnonzero(way[1:] != way[:-1]) + 1).tolist(), len(xs)]
    for first, end in zip(turns, turns[1:]):
        if first:
            step(first - 1)
        # Seeds that keep their distance: all at once where all the words between them are equal.
        n = int(xs[end - 1] - xs[first])
        if n and np.array_equal(a_words[xs[first] : xs[end - 1]], b_words[ys[first] : ys[end - 1]]):
            runs.append((n, n, n, n))
        else:
            for i in range(first, end - 1):
                step(i)
    runs.append((o.k, o.k, o.k, o.k))
    runs = joined(runs + extend(a[px + o.k :], b[py + o.k :]))
    # Segments of greatest score, where a match counts 1 and an error as much as the similarity allows for.
    loss = o.similarity / (1 - o.similarity)
    out, ranges = [], []
    x, y, total, best = start, other, 0.0, 0.0
    segment, kept, begin, stop = (x, y, 0, 0), None, 0, 0
    for n, (dx, dy, matched, aligned) in enumerate([*runs, (0, 0, 0, 10**9)]):
        total += matched - loss * (aligned - matched)
        segment = (segment[0], segment[1], segment[2] + matched, segment[3] + aligned)
        x, y = x + dx, y + dy
        if total > best:
            best, kept, stop = total, (segment[0], x, segment[1], y, segment[2], segment[3]), n + 1
        elif total < 0 or best - total > loss * o.max_gap:
            if kept and max(kept[1] - kept[0], kept[3] - kept[2]) >= o.min_words:
                out.append(kept)
                ranges.append((begin, stop))
            total, best, kept, segment, begin = 0.0, 0.0, None, (x, y, 0, 0), n + 1
    # The segment of greatest score may be a part of a passage that is long enough only with all its errors.
    edges = [0, *(e for r in ranges for e in r), len(runs)]
    for first, last in zip(edges[::2], edges[1::2]):
        if max(sum(r[0] for r in runs[first:last]), sum(r[1] for r in runs[first:last])) >= o.min_words:
            out += longest(runs, first, last, start, other, o)
    return [(s + a_first, e + a_first, p + b_first, q + b_first, m, n) for s, e, p, q, m, n in out]


def apart(found: list[tuple]) -> list[tuple]:
    """The passages of two documents without those that lie inside another one on both sides."""
    kept: list[tuple] = []
    for p in sorted(set(found), key=lambda p: (p[0], -p[1], p[2], -p[3], p[4:])):
        if not any(p[1] <= q[1] and q[2] <= p[2] and p[3] <= q[3] for q in kept[-8:]):
            kept.append(p)
    return kept


def _aligned(o: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by pair of documents, chain and side."""
        names = ["doc_id", "other_id", "start_word", "end_word", "other_start", "other_end", "matched", "aligned"]
        types = [pa.int64()] * 2 + [pa.int32()] * 6
        held, found = None, []
        now: tuple | None = None
        for batch in batches:
            out: list = []
            for row in zip(*(batch.column(i).to_pylist() for i in range(9))):
                if row[:2] != now:
                    out += [(*now, *p) for p in apart(found)] if found else []
                    now, found = row[:2], []
                if row[5] == 0:
                    held = row
                elif held is not None and held[:5] == row[:5]:
                    a, b = (np.frombuffer(r[7], "<u4") for r in (held, row))
                    seeds = np.frombuffer(held[8], "<i4").reshape(-1, 2)
                    # Rows that share a doc_id may differ in length: their chains can lie beyond this text.
                    if seeds[-1, 0] + o.k <= held[6] + len(a) and seeds[-1, 1] + o.k <= row[6] + len(b):
                        found += align(a, b, held[6], row[6], seeds, o)
                    held = None
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if found:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*[(*now, *p) for p in apart(found)]), types)], names)

    return run


def _matches(texts: DataFrame, o: Settings) -> DataFrame:
    """doc, pos, rep and rep_pos of every occurrence of a seed that several documents have, also of the first one."""
    spark = texts.sparkSession
    buckets = max(256, int(spark.conf.get("spark.sql.shuffle.partitions")))
    packs = texts.mapInArrow(_batch_seeds(o, buckets), PACKS)
    rows = stored(packs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_stars, MATCHES), "passage-matches")
    of = lambda kind: rows.filter(F.col("kind") == kind)
    firsts = of(HOT_FIRST).select("seed", "rep", "rep_pos")
    hot = of(HOT_PLACE).select("seed", "doc", "pos").join(firsts, "seed")
    columns = ("doc", "pos", "rep", "rep_pos")
    return of(MATCH).select(*columns).union(hot.select(*columns))


def passages(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, other_id, the passage's words in both (half-open), the words matched and the words aligned."""
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    by_doc = _matches(texts, settings).repartition("doc").sortWithinPartitions("doc", "pos")
    found = stored(by_doc.mapInArrow(_doc_chains(settings), FOUND), "passage-chains")
    units = found.filter("kind = 1").select("unit", "doc", "places")
    first = units.groupBy("unit").agg(F.min(F.struct("doc", "places")).alias("first"), F.max("doc").alias("last")).filter("first.doc < last")
    met = units.join(first, "unit").filter("doc <> first.doc").select("doc", F.col("first.doc").alias("rep"), "places", F.col("first.places").alias("rep_places"))
    pairs = met.distinct().repartition("doc", "rep").sortWithinPartitions("doc", "rep", "places", "rep_places")
    columns = [x.split()[0] for x in CHAINS.split(", ")]
    chains = found.filter("kind = 0").select("kind", *columns).union(pairs.mapInArrow(_unit_chains(settings), CHAINS).select(F.lit(1), *columns))
    # Each chain asks both its documents for words; requests of a document travel as arrays, in 16 parts or more on a large
    # cluster, so that the requests for a passage's first document stay small as the documents that ask for it grow in number.
    parts = max(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 16)
    side = lambda n, of, a, b, seeds: F.struct(
        F.col(of).alias("of"), "doc", "rep", "kind", "lo", "rep_lo", F.lit(n).alias("side"), F.col(a).alias("from_word"), F.col(b).alias("to_word"), seeds.alias("seeds"),
    )
    both = F.array(side(0, "doc", "lo", "hi", F.col("seeds")), side(1, "rep", "rep_lo", "rep_hi", F.lit(None).cast("binary")))
    asked = chains.select(F.explode(both).alias("r"))
    part = F.pmod(F.xxhash64("r.doc", "r.rep", "r.lo"), F.lit(parts))
    asked = asked.groupBy(F.col("r.of").alias("doc_id"), part.alias("part")).agg(F.collect_list("r").alias("asked"))
    spans = texts.join(asked, "doc_id").select("text", "asked").mapInArrow(
        _spans(settings), "doc long, rep long, kind int, lo int, rep_lo int, side int, first int, words binary, seeds binary"
    )
    keys = ("doc", "rep", "kind", "lo", "rep_lo")
    return spans.repartition("doc", "rep").sortWithinPartitions(*keys, "side").mapInArrow(_aligned(settings), PASSAGES)


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the given stretches of words, each up to the next word that stays."""
    starts = [m.start() for m in WORD.finditer(text)]
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= len(starts):
            continue
        begin = max(at, starts[a])
        out.append(text[at:begin])
        at = max(at, starts[b] if b < len(starts) else len(text))
    return b"".join([*out, text[at:]])


def drop_passages(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the passages that an earlier document holds; texts without one stay as they are."""
    id_, cuts = fresh_name(docs.columns, "_passage_doc"), fresh_name(docs.columns, "_passage_cuts")
    spans = found.groupBy(F.col("doc_id").alias(id_)).agg(F.collect_set(F.struct("start_word", "end_word")).alias(cuts))
    df = docs.join(spans, docs["doc_id"].cast("long") == F.col(id_), "left").drop(id_)
    names = docs.columns
    text_at, cuts_at = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = []
            for text, spans_ in zip(batch.column(text_at), batch.column(cuts_at).to_pylist()):
                t = text.as_py()
                new.append(without_words(t.encode(), [(s["start_word"], s["end_word"]) for s in spans_]).decode() if spans_ and t else t)
            yield pa.record_batch([pa.array(new, pa.string()) if i == text_at else batch.column(i) for i in range(len(names))], names)

    out = df.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
