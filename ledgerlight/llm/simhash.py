"""SimHash near-dedup by anchor-point covering.

Fingerprints are cut into blocks, and several blocks together make a word: one of three, and as the rows grow two of five, three
of six or four of seven. Of four differing bits the best word has one at most. In each word the anchors are those of a
covering code: a perfect Hamming code on fifteen bits (every string is within one bit of an anchor) beside free bits. A
fingerprint is at home at the anchor nearest to it and is replicated to every anchor within the covering radius plus the word's
threshold of one bit; so whichever of two near fingerprints is taken, the other one visits its home, though their homes may differ.
Per anchor, homes are compared with visitors on the whole fingerprint.

Equal fingerprints are one class before anything is replicated, and a class travels as its smallest
doc_id. Replicas are packed for each of ``cells`` ranges of anchors; the load of the cells is measured
first, and the homes of a hot cell are dealt to several tasks, each of which gets all its visitors.
What an anchor finds leaves its task as a spanning forest, never as all pairs.

Defined cases: a null or empty text, or one without words, has the fingerprint zero, linked like any
other; a null doc_id gets a fingerprint, takes no part in linking and has a null component; rows that
share a doc_id are linked through it; an empty table gives an empty table; further columns are
ignored by ``fingerprints`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, fresh_name, planes, stored, text_or_empty, unplaned
from .components import components

#: Homes that a cell is meant to hold, and those that one task compares at most; further ones go to further tasks.
CELL_ROWS, CELL_HOMES = 40_000, 200_000
#: Rows whose replicas are packed at once, the replicas of them, and comparisons held at once.
PACK_ROWS, PACK_REPLICAS = 10_000, 460_000
CHUNK = 1 << 21
#: Comparisons of near-dedup's candidates held at once, pairs of them held before they are reduced, and pairs verified at once.
COMPARED, PAIRS_HELD, VERIFIED = 1 << 18, 1 << 18, 1000
#: Bytes of near-dedup's texts and packs that a worker gets at once, and replicas of shingles that it packs at once (44 bytes each, four copies).
AT_ONCE, REPLICAS_AT_ONCE = 8 << 20, 1 << 17
SHIFTS = np.arange(64, dtype=np.uint64)


@dataclass(frozen=True)
class Covering:
    """The fingerprint is cut into ``blocks``; every ``together`` of them make a word that anchors cover. ``both``: the second one too."""

    threshold: int
    blocks: int
    together: int = 1
    both: bool = False

    @property
    def within(self) -> int:
        """Bits in which the best word of two near fingerprints differs at most, if the bits that differ are spread evenly."""
        each, more = divmod(self.threshold, self.blocks)
        return self.together * each + max(0, self.together - (self.blocks - more))

    def words(self) -> list[list[tuple[int, int]]]:
        """The (first bit, number of bits) of the blocks of each word."""
        cuts = [64 * i // self.blocks for i in range(self.blocks + 1)]
        return [list(x) for x in combinations([(a, b - a) for a, b in zip(cuts, cuts[1:])], self.together)]

    @property
    def rows_at_once(self) -> int:
        """Rows that have ``PACK_REPLICAS`` visits on average, ``PACK_ROWS`` at most."""
        steps = [_steps(sum(size for _, size in parts), 1 + self.within) for parts in self.words()]
        return max(1, min(PACK_ROWS, 16 * PACK_REPLICAS // (sum(len(x) for by in steps for x in by) * (1 + self.both))))


def covering_for(rows: int) -> Covering:
    """Of words for links of four bits, those whose anchors keep the comparisons of a row few: 2^17, 2^21, 2^28 or 2^32 of them."""
    return Covering(4, 3) if rows < 1 << 19 else Covering(4, 5, 2) if rows < 1 << 24 else Covering(4, 6, 3) if rows < 1 << 29 else Covering(4, 7, 4)


# Column i of the parity checks of the [15, 11] Hamming code is the number i + 1.
def _syndrome(values: np.ndarray) -> np.ndarray:
    out = np.zeros(len(values), np.uint64)
    for i in range(15):
        out ^= np.where((values >> np.uint64(i)) & np.uint64(1), np.uint64(i + 1), np.uint64(0))
    return out.astype(np.int64)


@lru_cache(maxsize=8)
def _steps(bits: int, radius: int) -> tuple[np.ndarray, ...]:
    """For each syndrome, the changes of at most ``radius`` bits of a block that lead to an anchor."""
    found: list[list[int]] = [[] for _ in range(16)]
    for size in range(radius + 1):
        for places in combinations(range(bits), size):
            syndrome = 0
            for p in places:
                syndrome ^= p + 1 if p < 15 else 0
            found[syndrome].append(sum(1 << p for p in places))
    return tuple(np.array(x, np.uint64) for x in found)


def homes(block: np.ndarray) -> np.ndarray:
    """The anchor nearest to each value of a block."""
    syndrome = _syndrome(block)
    return block ^ np.where(syndrome > 0, np.uint64(1) << np.maximum(syndrome - 1, 0).astype(np.uint64), np.uint64(0))


def visits(block: np.ndarray, bits: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of the value, anchor) for every anchor within ``radius`` of a value."""
    syndrome, steps = _syndrome(block), _steps(bits, radius)
    index, anchors = [], []
    for s in range(16):
        of = np.flatnonzero(syndrome == s)
        if len(of) and len(steps[s]):
            index.append(np.repeat(of, len(steps[s])))
            anchors.append((block[of][:, None] ^ steps[s][None, :]).ravel())
    return np.concatenate([*index, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([*anchors, np.empty(0, np.uint64)]).astype(np.uint64)


def bits_of(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    ones = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.uint64(1) << SHIFTS)[2 * ones > len(hashes)].sum(dtype=np.uint64))


def shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle, A-Z in lower case; one of all words where there are fewer."""
    tokens = text.lower().split()
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 42)] if tokens else [], np.uint64)
    joined, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *ends[:-1].tolist()]
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())], np.uint64)


def _second(hashes: np.ndarray) -> np.ndarray:
    """Another hash of the same shingles, mixed from the first one."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """doc_id, f1 and f2: two independent fingerprints of 64 bits of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first, second = [], []
            for text in batch.column(1):
                h = shingle_hashes(text.as_py(), words)
                first.append(bits_of(h))
                second.append(bits_of(_second(h)))
            yield pa.record_batch([batch.column(0), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (first, second))], ["doc_id", "f1", "f2"])

    return docs.select(F.col("doc_id").cast("long"), F.encode(text_or_empty("text"), "UTF-8")).mapInArrow(run, "doc_id long, f1 long, f2 long")


REPLICA = np.dtype([("anchor", "<u8"), ("f1", "<u8"), ("f2", "<u8"), ("node", "<i8")])
HOME, VISITOR = 0, 1


def _anchored(covering: Covering, f1: np.ndarray, kind: int, f2: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index, anchor with its word's number in the top bits) for all homes or all visits."""
    for number, (prints, parts) in enumerate(product((f1, f2) if covering.both else (f1,), covering.words())):
        word, bits = np.zeros(len(prints), np.uint64), 0
        for first, size in parts:
            word |= ((prints >> np.uint64(first)) & np.uint64((1 << size) - 1)) << np.uint64(bits)
            bits += size
        index, anchor = (np.arange(len(prints)), homes(word)) if kind == HOME else visits(word, bits, 1 + covering.within)
        yield index, anchor | np.uint64(number << 48)


def _cell(anchor: np.ndarray, cells: int) -> np.ndarray:
    return ((anchor * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % cells


def _columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    node, f1, f2 = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
    return node, f1.view(np.uint64), f2.view(np.uint64)


def _loads(covering: Covering, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            _, f1, f2 = _columns(batch)
            for _, anchor in _anchored(covering, f1, HOME, f2):
                total += np.bincount(_cell(anchor, cells), minlength=cells)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["cell", "homes"])

    return run


def _replicas(covering: Covering, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = covering.rows_at_once
        for whole in batches:
            for start in range(0, len(whole), at_once):
                batch = whole.slice(start, at_once)
                node, f1, f2 = _columns(batch)
                for kind in (HOME, VISITOR):
                    out: list[tuple[int, int, bytes]] = []
                    for index, anchor in _anchored(covering, f1, kind, f2):
                        rows = np.empty(len(index), REPLICA)
                        rows["anchor"], rows["f1"], rows["f2"], rows["node"] = anchor, f1[index], f2[index], node[index]
                        cell = _cell(anchor, cells)
                        order = np.argsort(cell, kind="stable")
                        rows, cell = rows[order], cell[order]
                        cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True]) if len(cell) else np.zeros(1, np.int64)
                        out += [(int(cell[a]), kind, rows[a:b].tobytes()) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                    if out:
                        cell_, kinds, packs = zip(*out)
                        yield pa.record_batch([pa.array(cell_, pa.int32()), pa.array(kinds, pa.int32()), pa.array(packs, pa.binary())], ["cell", "kind", "pack"])

    return run


class Forest:
    """Spanning links of what has been joined so far, over nodes that are known by their ids."""

    def __init__(self, nodes: np.ndarray):
        self.nodes = np.unique(nodes)
        self.parent = np.arange(len(self.nodes))

    def _roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[at]
            if (up == at).all():
                return at
            at = self.parent[up]

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = np.searchsorted(self.nodes, a), np.searchsorted(self.nodes, b)
        while True:
            a, b = self._roots(a), self._roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        root = self._roots(np.arange(len(self.nodes)))
        below = np.flatnonzero(root != np.arange(len(self.nodes)))
        return self.nodes[below], self.nodes[root[below]]


def near(home: np.ndarray, visitor: np.ndarray, threshold: int, threshold_both: int | None, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Nodes (of a home, of a visitor at the same anchor) whose fingerprints are near, and bits apart. ``home`` is sorted by anchor."""
    lo, hi = np.searchsorted(home["anchor"], visitor["anchor"]), np.searchsorted(home["anchor"], visitor["anchor"], side="right")
    visitor, lo, sizes = visitor[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(visitor):
        # At least one visitor at a time: it meets no more than the homes of one anchor.
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + chunk)))
        n = sizes[at:stop]
        v = np.repeat(np.arange(at, stop), n)
        h = np.repeat(lo[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        apart = np.bitwise_count(home["f1"][h] ^ visitor["f1"][v]).astype(np.int16)
        close = np.flatnonzero((apart <= threshold) & (home["node"][h] != visitor["node"][v]))
        apart = apart[close]
        if threshold_both is not None and len(close):
            apart = apart + np.bitwise_count(home["f2"][h[close]] ^ visitor["f2"][v[close]])
            close, apart = close[apart <= threshold_both], apart[apart <= threshold_both]
        if len(close):
            yield home["node"][h[close]], visitor["node"][v[close]], apart
        at = stop


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(homes, visitors) of each key; rows come sorted by key and kind: the homes of a key, then its visitors."""
    key, packs, home = None, [], None
    for batch in batches:
        visitors: list[bytes] = []
        for now, kind, pack in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            if now != key:
                if visitors:
                    yield home, np.frombuffer(b"".join(visitors), REPLICA)
                key, packs, home, visitors = now, [], None, []
            if kind == HOME:
                packs.append(pack.as_py())
            elif packs or home is not None:
                if home is None:
                    home, packs = np.frombuffer(b"".join(packs), REPLICA), []
                    home = home[np.argsort(home["anchor"], kind="stable")]
                visitors.append(pack.as_py())
        if visitors:
            yield home, np.frombuffer(b"".join(visitors), REPLICA)


def _compare(threshold: int, threshold_both: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[np.ndarray, np.ndarray]] = []

        def forest() -> Forest:
            out = Forest(np.concatenate([x for ab in found for x in ab]))
            for a, b in found:
                out.join(a, b)
            return out

        for home, visitors in _meetings(batches):
            found += [(a, b) for a, b, _ in near(home, visitors, threshold, threshold_both)]
            if sum(len(a) for a, _ in found) > CHUNK:
                found = [forest().links()]
        if found:
            yield pa.record_batch([pa.array(x) for x in forest().links()], ["a", "b"])

    return run


def _met(classes: DataFrame, covering: Covering, rows: int) -> DataFrame:
    """The packs of each cell as ``_meetings`` reads them, the homes of a hot cell dealt to several tasks; ``classes`` has node, f1, f2."""
    cells = max(256, -(-rows * len(covering.words()) * (1 + covering.both) // CELL_ROWS))
    nodes = classes.select("node", "f1", "f2")
    # A row for each cell; the cells grow with the rows, so this is a table like any other.
    loads = nodes.mapInArrow(_loads(covering, cells), "cell int, homes long").groupBy("cell").agg(F.sum("homes").alias("homes"))
    loads = loads.select("cell", F.ceil(F.col("homes") / CELL_HOMES).cast("int").alias("tasks"))
    packs = nodes.mapInArrow(_replicas(covering, cells), "cell int, kind int, pack binary").join(loads, "cell")
    one = F.array(F.pmod(F.xxhash64("pack"), F.col("tasks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("tasks") - 1)
    dealt = packs.withColumn("task", F.explode(F.when(F.col("kind") == HOME, one).otherwise(every)))
    keyed = dealt.select((F.col("cell").cast("long") * (1 << 20) + F.col("task")).alias("key"), "kind", "pack")
    return keyed.repartition("key").sortWithinPartitions("key", "kind")


def _upward(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def near_links(classes: DataFrame, covering: Covering | None = None, threshold_both: int | None = None, rows: int | None = None) -> DataFrame:
    """Links (a > b) between nodes whose fingerprints are near; ``classes`` has node, f1, f2, all distinct."""
    rows = classes.count() if rows is None else rows
    covering = covering or covering_for(rows)
    return _upward(_met(classes, covering, rows).mapInArrow(_compare(covering.threshold, threshold_both), "a long, b long"))


def near_components(docs: DataFrame, words: int = 4, covering: Covering | None = None, threshold_both: int | None = None) -> DataFrame:
    """doc_id, f1 and component_id of every row; with ``threshold_both``, f2 must be near as well."""
    prints = stored(fingerprints(docs, words), "fingerprints")
    pair = ["f1", "f2"] if threshold_both is not None else ["f1"]
    known = prints.filter("doc_id IS NOT NULL")
    classes = known.groupBy(*pair).agg(F.min("doc_id").alias("node"))
    classes = stored(classes if threshold_both is not None else classes.withColumn("f2", F.lit(0).cast("long")), "classes")
    # Rows that share a doc_id join the classes they are in.
    shared = known.select("doc_id", *pair).join(classes, pair).filter("doc_id <> node").select("doc_id", "node", *pair)
    repeated = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    own = shared.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    found = components(near_links(classes, covering, threshold_both).union(own))
    roots = classes.join(found, "node", "left").select(*pair, F.coalesce("component", "node").alias("component_id"))
    return prints.join(roots, pair, "left").select("doc_id", "f1", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, the fingerprint in hexadecimal and component_id, for links of at most four bits."""
    hex16 = F.lpad(F.lower(F.hex("f1")), 16, "0")
    return near_components(docs).select("doc_id", hex16.alias("fingerprint"), "component_id")


# Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, verified on the sets.
#
# Candidates come by the anchors of two SimHash fingerprints of each set: homes meet visitors, and of what a node meets its
# nearest, its smallest and its smallest likely one are verified. What the groups so found leave open, an exact check closes, as no anchors see
# every pair at 0.8: prefix filtering between different groups, which loses none. With the shingles of every set in one order,
# two such sets share one among the first n - ceil(0.8 n) + 1 of the larger and n - ceil(8/9 n) + 1 of the smaller set. Any
# order will do: by hash, but shingles that a large share of all texts hold come last, so that none gathers them.

COPY_WORDS = 5
#: Bits of 128 that candidates may differ in: at a similarity of 0.8 the mean is 19 and the standard deviation 4, so five of them more. Sets of
#: fewer than ``SMALL_SET`` shingles are never told apart by bits.
COPY_BITS, SMALL_SET = 40, 32
#: Bits that copies at 0.8 differ in on average: what differs in no more is likely one.
LIKELY_BITS = 19
#: Replicas that a cell is meant to hold, and the share of texts from which a shingle is frequent: at most ``FREQUENT``
#: times the mean size of a set are.
COPY_CELL, FREQUENT = 50_000, 256
#: Bits of the filter that keeps texts without candidates from being shuffled (1 MB; when full it only lets all pass).
FILTER_BITS = 1 << 23
COPY = np.dtype([("anchor", "<u4"), ("size", "<u4"), ("f1", "<u8"), ("f2", "<u8"), ("node", "<i8"), ("place", "<u4"), ("label", "<i8")])


def copy_covering(rows: int) -> Covering:
    """Words of both fingerprints that tolerate a bit: small ones find most pairs at 0.8, larger ones keep comparisons few as rows grow."""
    return Covering(4, 4, both=True) if rows < 1 << 19 else Covering(4, 3, both=True) if rows < 1 << 26 else Covering(4, 5, 2, both=True)


def home_prefix(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n + (-8 * n // 9) + 1, 0)


def visit_prefix(n: np.ndarray) -> np.ndarray:
    return np.where(n > 0, n + (-4 * n // 5) + 1, 0)


def are_copies(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of hashes have a Jaccard similarity of 0.8 or more."""
    if 5 * min(len(a), len(b)) < 4 * max(len(a), len(b)):
        return False
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 5 * shared >= 4 * (len(a) + len(b) - shared)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct shingles, as hashes of 40 bits."""
    return np.unique(shingle_hashes(text, COPY_WORDS) >> np.uint64(24))


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A hash of the words of each text, and the shingles that many texts of the batch hold with their number there."""
    names = ["doc_id", "key", "token", "n"]
    for batch in batches:
        texts = [t.as_py() for t in batch.column(1)]
        keys = [xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 42) for t in texts]
        n = len(texts)
        yield pa.record_batch([batch.column(0), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names)
        # Copies count once: each distinct text of the batch.
        sets = [shingle_set(t) for t in dict(zip(keys, texts)).values()]
        tokens, counts = np.unique(np.concatenate([*sets, np.empty(0, np.uint64)]), return_counts=True)
        often = counts >= max(2, n // (2 * FREQUENT))
        k = int(often.sum())
        yield pa.record_batch([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array(tokens[often].astype(np.int64)), pa.array(counts[often])], names)


def _prefixes(frequent: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f1, f2, sizes, packs = [], [], [], []
            for text in batch.column(1):
                h = shingle_set(text.as_py())
                f1.append(bits_of(_second(h)))
                f2.append(bits_of(_second(_second(h))))
                sizes.append(len(h))
                if len(frequent) and len(h):
                    late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
                    h = np.concatenate([h[~late], h[late]])
                packs.append(h[: int(visit_prefix(np.int64(len(h))))].astype("<u8").tobytes())
            prints = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (f1, f2))
            yield pa.record_batch([batch.column(0), *prints, pa.array(sizes, pa.int32()), pa.array(packs, pa.binary())], ["node", "f1", "f2", "size", "tokens"])

    return run


def _first(*by: np.ndarray) -> np.ndarray:
    """Of the rows with an equal last key, the first by the others (as in lexsort)."""
    order = np.lexsort(by)
    return order[np.r_[True, np.diff(by[-1][order]) != 0]]


def _copy_meetings(most: int | None):
    """Of what meets at the anchors of a task, the nearest, the smallest and the smallest likely one of each node: a, b and bits apart."""

    def some(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
        less = apart > LIKELY_BITS
        return np.unique(np.concatenate([_first(*by) for x, y in ((a, b), (b, a)) for by in ((y, apart, x), (y, x), (y, less, x))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        new = 0

        def fold() -> None:
            """The nearest and the smallest of those that are left are those of all."""
            columns = tuple(np.concatenate(c) for c in zip(*held))
            at = some(*columns)
            held[:] = [tuple(c[at] for c in columns)]

        def leave() -> pa.RecordBatch:
            a, b, apart = held.pop()
            return pa.record_batch([pa.array(a), pa.array(b), pa.array(apart.astype(np.int32))], ["a", "b", "apart"])

        for home, visitors in _meetings(batches):
            for found in near(home, visitors, 64, 128 if most is None else most, COMPARED):
                held.append(found)
                new += len(found[0])
                if new > PAIRS_HELD:
                    fold()
                    new = 0
                    if len(held[0][0]) > PAIRS_HELD:
                        yield leave()
        if held:
            fold()
            yield leave()

    return run


def copy_candidates(nodes: DataFrame, most: int | None = COPY_BITS) -> DataFrame:
    """Distinct pairs (a > b) of ``nodes`` (node, f1, f2) that meet at an anchor, differ in ``most`` of 128 bits at most and are to be verified."""
    # Equal fingerprints stand for one another at the anchors; each of their nodes is verified against the smallest.
    prints = stored(nodes.groupBy("f1", "f2").agg(F.min("node").alias("node")), "copy-prints")
    rows = prints.count()
    met = _met(prints, copy_covering(rows), rows).mapInArrow(_copy_meetings(most), "a long, b long, apart int")
    # A node meets others in many tasks: of all of them the same three are left, so that a group brings no more pairs than thrice its size.
    ends = met.union(met.select("b", "a", "apart")).groupBy("a").agg(
        F.min(F.struct("apart", "b"))["b"].alias("nearest"), F.min("b").alias("smallest"), F.min(F.when(F.col("apart") <= LIKELY_BITS, F.col("b"))).alias("likely")
    )
    met = ends.select("a", F.explode(F.array_distinct(F.array("nearest", "smallest", F.coalesce("likely", "smallest")))).alias("b"))
    equal = nodes.join(prints.select("f1", "f2", F.col("node").alias("b")), ["f1", "f2"]).filter("node <> b").select(F.col("node").alias("a"), "b")
    return _upward(met.union(equal)).distinct()


def _stretches(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(start, stop) of stretches of rows whose sizes add up to ``most`` at most, or of a row that is larger."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, stop
        at = stop


def _copy_replicas(cells: int):
    """The first shingles of each text, packed by cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start, stop in _stretches(visit_prefix(whole.column(3).to_numpy().astype(np.int64)), REPLICAS_AT_ONCE):
                batch = whole.slice(start, stop - start)
                node, f1, f2, size = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
                lengths = visit_prefix(size.astype(np.int64))
                index = np.repeat(np.arange(len(node)), lengths)
                if not len(index):
                    continue
                # Hashes that come first are small ones: they are mixed before they choose a cell.
                token = _second(np.frombuffer(b"".join(x.as_py() for x in batch.column(4)), "<u8"))
                rows = np.empty(len(index), COPY)
                rows["anchor"], rows["size"], rows["node"] = token & np.uint64(0xFFFFFFFF), size[index], node[index]
                rows["f1"], rows["f2"] = f1.view(np.uint64)[index], f2.view(np.uint64)[index]
                rows["place"] = np.arange(len(index)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                rows["label"] = batch.column(5).to_numpy(zero_copy_only=False)[index]
                cell = (token >> np.uint64(33)).astype(np.int64) % cells
                order = np.argsort(cell, kind="stable")
                rows, cell = rows[order], cell[order]
                cuts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1], True])
                packs = [planes(rows[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
                yield pa.record_batch([pa.array(cell[cuts[:-1]].astype(np.int32)), pa.array(packs, pa.binary())], ["cell", "pack"])

    return run


def near_sets(rows: np.ndarray, most: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row of the smaller set, row of the larger set) of the candidates with the same shingle and different labels, of any bits apart where ``most`` is None."""
    home = np.flatnonzero(rows["place"] < home_prefix(rows["size"].astype(np.int64)))
    home = home[np.argsort(rows["anchor"][home], kind="stable")]
    anchors = rows["anchor"][home]
    lo, hi = np.searchsorted(anchors, rows["anchor"]), np.searchsorted(anchors, rows["anchor"], side="right")
    met = np.flatnonzero(hi > lo)
    lo, sizes = lo[met], (hi - lo)[met]
    ends = np.cumsum(sizes)
    at = 0
    while at < len(met):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + COMPARED)))
        n = sizes[at:stop]
        v = np.repeat(met[at:stop], n)
        h = home[np.repeat(lo[at:stop] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        small, large = rows["size"][h].astype(np.int64), rows["size"][v].astype(np.int64)
        keep = (small <= large) & (5 * small >= 4 * large) & (rows["node"][h] != rows["node"][v])
        # At the first shingle that both hold, what is left of either set must suffice for 8/9 of their mean size.
        keep &= 9 * np.minimum(small - rows["place"][h], large - rows["place"][v]) >= 4 * (small + large)
        keep &= rows["label"][h] != rows["label"][v]
        h, v = h[keep], v[keep]
        apart = (np.bitwise_count(rows["f1"][h] ^ rows["f1"][v]) + np.bitwise_count(rows["f2"][h] ^ rows["f2"][v])).astype(np.int64)
        close = np.full(len(apart), True) if most is None else (apart <= most) | (rows["size"][h] < SMALL_SET)
        if close.any():
            yield h[close], v[close]
        at = stop


def _copy_pairs(most: int | None):
    """All candidate pairs of each cell that join different groups."""

    def pairs(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
        rows = np.concatenate([unplaned(p, COPY) for p in packs])
        held: list[tuple[np.ndarray, np.ndarray]] = []
        new = 0

        def fold() -> None:
            a, b = (np.concatenate(c) for c in zip(*held))
            more, less = np.maximum(a, b), np.minimum(a, b)
            o = np.lexsort((less, more))
            o = o[np.r_[True, (np.diff(more[o]) != 0) | (np.diff(less[o]) != 0)]]
            held[:] = [(more[o], less[o])]

        def leave() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x) for x in held.pop()], ["a", "b"])

        for h, v in near_sets(rows, most):
            held.append((rows["node"][h], rows["node"][v]))
            new += len(h)
            if new > PAIRS_HELD:
                fold()
                new = 0
                if len(held[0][0]) > PAIRS_HELD:
                    yield leave()
        if held:
            fold()
            yield leave()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell."""
        key, packs = None, []
        for batch in batches:
            for now, pack in zip(batch.column(0).to_pylist(), batch.column(1)):
                if now != key:
                    if packs:
                        yield from pairs(packs)
                    key, packs = now, []
                packs.append(pack.as_py())
        if packs:
            yield from pairs(packs)

    return run


def _candidates(nodes: DataFrame, replicas: int, most: int | None) -> DataFrame:
    """Distinct candidate pairs (a > b) of different labels among ``nodes`` (node, f1, f2, size, tokens, label)."""
    cells = max(512, min(1 << 20, -(-replicas // COPY_CELL)))
    packs = nodes.mapInArrow(_copy_replicas(cells), "cell int, pack binary")
    return packs.repartition("cell").sortWithinPartitions("cell").mapInArrow(_copy_pairs(most), "a long, b long").distinct()


def _filter_of(ids: DataFrame) -> np.ndarray:
    """Bits at which the hashes of the ids stand, put together by the executors."""
    at = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1  # buckets and positions count from 1
    found = ids.groupBy(F.bitmap_bucket_number(at).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 8 + 4096, np.uint8)
    for r in found:
        first = (r.part - 1) * 4096
        bits[first : first + len(r.bits)] |= np.frombuffer(r.bits, np.uint8)
    return bits


def _sets_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """node and shingles (hashes of 40 bits, byte by byte) of the texts with these ids, and of few others."""
    bits = _filter_of(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8) & 1) > 0))
            for start in range(0, len(batch), 1000):
                part = batch.slice(start, 1000)
                packs = [np.ascontiguousarray(shingle_set(t.as_py()).view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes() for t in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(packs, pa.binary())], ["node", "hashes"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    return texts.select("doc_id", "text", at.alias("at")).mapInArrow(run, "node long, hashes binary")


def _unpacked(pack: bytes) -> np.ndarray:
    five = np.frombuffer(pack, np.uint8).reshape(5, -1)
    return sum(five[i].astype(np.uint64) << np.uint64(8 * i) for i in range(5))


def _ends(pairs: DataFrame) -> DataFrame:
    """The distinct ids of both ends of the pairs; each end is reduced before it is shuffled."""
    return stored(pairs.select(F.col("a").alias("id")).distinct().union(pairs.select(F.col("b").alias("id")).distinct()).distinct(), "copy-ends")


def _verified(pairs: DataFrame, ends: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets are similar; ``ends`` are their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [are_copies(_unpacked(x.as_py()), _unpacked(y.as_py())) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(same, pa.bool_()))

    sets = _sets_of(texts, ends)
    # The sets are looked up in a table of them: sorting would hold the set of ``a`` for each of its pairs, far more than their compressed size lets expect.
    of = lambda end: sets.select(F.col("node").alias(end), F.col("hashes").alias(f"{end}_set")).hint("shuffle_hash")
    same = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "a_set", "b_set").mapInArrow(run, "a long, b long").distinct()
    with batches_of(texts.sparkSession, rows=VERIFIED):  # a pair brings both its sets
        return stored(same, "copy-links")


def _keys(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The texts of the rows with a doc_id, and of each of these rows the hash of its words, among frequent shingles."""
    texts = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    return texts, stored(texts.mapInArrow(_word_keys, "doc_id long, key long, token long, n long"), "copy-keys")


def copy_components(texts: DataFrame, keyed: DataFrame, most: int | None = COPY_BITS, whole: bool = True) -> DataFrame:
    """doc_id and component_id of the rows with a doc_id that are linked to a smaller one.

    Each text is first verified against three at most of those that it meets at the anchors; then all pairs
    that this has not joined are checked exactly, so a large group of copies never meets as pairs and no link is lost.
    """
    keys = keyed.filter("doc_id IS NOT NULL").select("doc_id", "key")
    classes = stored(keys.groupBy("key").agg(F.min("doc_id").alias("node")), "copy-classes")
    often = keyed.filter("token IS NOT NULL").groupBy("token").agg(F.sum("n").alias("n"))
    least = max(16, classes.count() // FREQUENT)
    frequent = np.array(sorted(r.token for r in often.filter(F.col("n") >= least).select("token").collect()), np.uint64)
    all_ = texts.mapInArrow(_prefixes(frequent), "node long, f1 long, f2 long, size int, tokens binary")
    # The text of each class; a doc_id whose rows differ may bring sets that stand for no class, which links them as its rows are.
    nodes = stored(all_.join(classes.select("node").distinct(), "node", "left_semi"), "copy-nodes")
    first = stored(copy_candidates(nodes.select("node", "f1", "f2"), most), "copy-candidates")
    links = _verified(first, _ends(first), texts)
    if whole:
        groups = nodes.join(components(links), "node", "left").withColumn("label", F.coalesce("component", "node"))
        replicas = nodes.agg(F.sum(F.floor(F.col("size") / 5) + 1)).first()[0] or 0
        open_ = _candidates(groups.select("node", "f1", "f2", "size", "tokens", "label"), replicas, most)
        rest = stored(open_.join(first, ["a", "b"], "left_anti"), "copy-rest")
        links = links.union(_verified(rest, _ends(rest), texts))
    # Rows that share a doc_id join the classes they are in.
    own = keys.join(classes, "key").filter("doc_id <> node").select("doc_id", "node")
    repeated = keys.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    shared = own.join(repeated, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    roots = classes.join(components(links.union(shared)), "node", "left").select("key", F.coalesce("component", "node").alias("component_id"))
    return keys.join(roots, "key").filter("component_id < doc_id").select("doc_id", "component_id")


def keep_one(docs: DataFrame, most: int | None = COPY_BITS, whole: bool = True) -> DataFrame:
    """``docs`` with one row of each group of near copies: a row with the smallest doc_id. Rows without doc_id stay.

    Candidates whose fingerprints differ in more than ``most`` of 128 bits aren't verified; None verifies all of them.
    Without ``whole`` the exact check is left out, and only what the anchors find is linked (for measuring it).
    """
    with batches_of(docs.sparkSession, size=AT_ONCE):
        texts, keyed = _keys(docs)
        gone = stored(copy_components(texts, keyed, most, whole).select("doc_id").distinct(), "near-copies")
    ids = keyed.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n"))
    repeated = stored(ids.filter("n > 1").select("doc_id"), "repeated-ids")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = docs.join(gone, "doc_id", "left_anti")
    # Rows that repeat a doc_id with the same text are copies too; the others needn't be shuffled.
    name = fresh_name(docs.columns, "_near_row")
    several = rest.join(repeated, "doc_id", "left_semi").withColumn(name, F.xxhash64(text_or_empty("text"))).dropDuplicates(["doc_id", name])
    return rest.join(repeated, "doc_id", "left_anti").select(*columns).union(several.select(*columns))
