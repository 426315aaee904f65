"""Spelling variants: words one edit apart, found by range searches in k-d trees over letter counts.

Words are counted inside tasks before they are shuffled. A word's letters are counted in 32 groups (a to z, and the accented
letters in six), each count as two coordinates, "at least one" and "at least two", in 64 bits. One edit takes away
one letter at most and adds one at most, so the vectors of near words lie within one step down and one step up of each
other. All words of one length make a tree; its upper splits are one letter a level, chosen by how evenly they halve the length's words (counted
over all of them), and lead to cells. A word has one home cell, and visits every cell whose side of each split it can reach: one step down and
one up among the words of its own length, one step up among those longer by one letter. Inside a cell the tree goes on
to small leaves with the box of the vectors below each node; a visitor leaves a branch when its box is out of reach, and what remains is
verified letter by letter. Homes of a large cell are dealt to several tasks, and visitors come in packs, so a task holds
a bounded part of a cell. Folding and clipping counts only bring vectors nearer, so no near pair is lost.

Defined cases: a null or empty text has no words; a null doc_id is hashed as an empty one; repeated rows count anew; very long texts are
searched run by run, and very long words (64 letters or more) share one tree in which lengths may differ; ties of forms go to the
smaller word in code-point order; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

RUN = r"[a-zÀ-ÿ]"
#: Groups of letters, and accented ones among them.
GROUPS, ACCENTED = 32, 6
#: Words of this length or more share one tree.
LONG = 64
#: Words that a cell should have; homes of a cell for one task; words of a leaf.
CELL, TASK_HOMES, LEAF = 4096, 16384, 16
#: Words that are counted before they are passed on, dealt at once, in a pack at most, and searched at once.
HELD_COUNTS, DEALT, PACKED, SEARCHED = 300_000, 1 << 16, 4096, 1 << 14
LONG_TEXT = 1 << 20
HOME, EQUAL, SHORTER = 0, 1, 2
#: Pairs verified at once.
PAIRS = 1 << 19

CELLS = "bucket int, path long, role int, size int, words string, counts binary"
NEAR = "word string, n_near long, best_n long, best string"


def _counted(every: int, least_length: int):
    pattern = re.compile(f"{RUN}{{{least_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def passed() -> pa.RecordBatch:
            out = pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                lowered = (text.as_buffer().to_pybytes() if text.is_valid else b"").lower().decode()  # bytes lower A to Z only
                runs = pattern.findall(lowered) if len(lowered) <= LONG_TEXT else (m[0] for m in pattern.finditer(lowered))
                head = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs).items():
                    crc = zlib.crc32(word.encode(), head)
                    if crc % every == 0:
                        at = crc % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least_length:
                            continue
                    held[word] = held.get(word, 0) + n
                if len(held) >= HELD_COUNTS:
                    yield passed()
        if held:
            yield passed()

    return run


def vocabulary(docs: DataFrame, every: int = 199, least_length: int = 6, least: int = 5) -> DataFrame:
    """word and n of all words; one run in ``every`` (by its document's number and itself) loses a letter first."""
    words = docs.select("doc_id", "text").mapInArrow(_counted(every, least_length), "word string, n long")
    return words.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def letter_counts(words: list[str]) -> np.ndarray:
    """How often each group of letters is in each word."""
    out = np.zeros((len(words), GROUPS), np.int64)
    at = 0
    while at < len(words):
        end, chars = at, 0
        while end < len(words) and (end == at or chars + len(words[end]) <= LONG_TEXT):
            chars += len(words[end])
            end += 1
        code = np.frombuffer("".join(words[at:end]).encode("latin-1"), np.uint8).astype(np.int64)
        group = np.where(code < 0x80, code - ord("a"), GROUPS - ACCENTED + (code - 0xC0) % ACCENTED)
        row = np.repeat(np.arange(end - at), [len(w) for w in words[at:end]])
        out[at:end] = np.bincount(row * GROUPS + group, minlength=(end - at) * GROUPS).reshape(-1, GROUPS)
        at = end
    return out


def vectors(counts: np.ndarray) -> np.ndarray:
    """Counts clipped at two, a bit for each step."""
    step = np.arange(GROUPS, dtype=np.uint64) * np.uint64(2)
    one = (counts >= 1).astype(np.uint64) << step
    two = (counts >= 2).astype(np.uint64) << (step + np.uint64(1))
    return np.bitwise_or.reduce(one | two, axis=1)


def _bucket(words: list[str]) -> np.ndarray:
    return np.minimum([len(w) for w in words], LONG)


def _steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many words of each length take each step; step -1 counts the words."""
    sums = np.zeros((LONG + 1, 2 * GROUPS + 1), np.int64)
    for batch in batches:
        words = batch.column(0).to_pylist()
        counts = letter_counts(words)
        both = np.stack([counts >= 1, counts >= 2], axis=2).reshape(len(words), -1)
        np.add.at(sums, _bucket(words), np.hstack([both, np.ones((len(words), 1), bool)]).astype(np.int64))
    bucket, step = np.nonzero(sums)
    step_of = np.where(step == 2 * GROUPS, -1, step)
    yield pa.record_batch([pa.array(bucket, pa.int32()), pa.array(step_of, pa.int32()), pa.array(sums[bucket, step])], ["bucket", "step", "n"])


def upper_splits(words: DataFrame, cell: int = CELL) -> dict[int, list[tuple[int, int]]]:
    """For each length the (group, least count) of its upper splits: as many as its words need, evenest first, one a group.

    What is collected has at most LONG + 1 lengths of 2 * GROUPS + 1 numbers.
    """
    rows = words.select("word").mapInArrow(_steps, "bucket int, step int, n long").groupBy("bucket", "step").agg(F.sum("n").alias("n")).collect()
    taken = {(r.bucket, r.step): r.n for r in rows}
    out = {}
    for bucket in {b for b, _ in taken}:
        total = taken[bucket, -1]
        depth = max(0, int(np.ceil(np.log2(total / cell))))
        shares = {(s // 2, s % 2 + 1): taken.get((bucket, s), 0) / total for s in range(2 * GROUPS)}
        chosen: list[tuple[int, int]] = []
        for group, least in sorted(shares, key=lambda k: (abs(shares[k] - 0.5), k)):
            if len(chosen) < depth and 0 < shares[group, least] < 1 and group not in {g for g, _ in chosen}:
                chosen.append((group, least))
        out[bucket] = chosen
    return out


def reached(counts: np.ndarray, splits: list[tuple[int, int]], down: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, path) of the cells within one step up and, if ``down``, one step down; and each row's own path."""
    n = len(counts)
    rows, own = np.arange(n), np.zeros(n, np.int64)
    for i, (group, least) in enumerate(splits):
        own |= (counts[:, group] >= least).astype(np.int64) << i
    ups, downs = [(rows, own)], [(rows, own)]
    for i, (group, least) in enumerate(splits):
        may = np.flatnonzero(counts[:, group] == least - 1)
        ups.append((may, own[may] | 1 << i))
        may = np.flatnonzero(counts[:, group] == least)
        downs.append((may, own[may] & ~np.int64(1 << i)))
    found = list(ups)
    if down:
        for i, (group, least) in enumerate(splits):
            lower = counts[:, group] == least
            found.append(downs[i + 1])
            for who, path in ups[1:]:
                both = lower[who]
                found.append((who[both], path[both] & ~np.int64(1 << i)))
    return np.concatenate([r for r, _ in found]), np.concatenate([p for _, p in found]), own


def _dealt(splits: dict[int, list[tuple[int, int]]]):
    """Packs of words for their home cells and for those that they visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[str] = []
        ns: list[int] = []

        def packs(bucket: int, role: int, who: np.ndarray, path: np.ndarray, own: np.ndarray) -> Iterator[pa.RecordBatch]:
            order = np.argsort(path, kind="stable")
            cuts = np.flatnonzero(np.diff(path[order])) + 1
            parts = [x[i : i + PACKED] for x in np.split(order, cuts) for i in range(0, len(x), PACKED)]
            if parts:
                yield pa.record_batch([
                    pa.array([bucket] * len(parts), pa.int32()), pa.array([int(path[p[0]]) for p in parts], pa.int64()), pa.array([role] * len(parts), pa.int32()),
                    pa.array([len(p) for p in parts], pa.int32()), pa.array(["\n".join(words[own[who[x]]] for x in p) for p in parts]),
                    pa.array([np.array([ns[own[who[x]]] for x in p], "<i8").tobytes() for p in parts], pa.binary()),
                ], ["bucket", "path", "role", "size", "words", "counts"])

        def dealt() -> Iterator[pa.RecordBatch]:
            counts, bucket = letter_counts(words), _bucket(words)
            for b in np.unique(bucket).tolist():
                own = np.flatnonzero(bucket == b)
                who, path, home = reached(counts[own], splits[b], True)
                yield from packs(b, HOME, np.arange(len(own)), home, own)
                yield from packs(b, EQUAL, who, path, own)
                if b < LONG and b + 1 in splits:
                    who, path, _ = reached(counts[own], splits[b + 1], False)
                    yield from packs(b + 1, SHORTER, who, path, own)

        for batch in batches:
            words += batch.column(0).to_pylist()
            ns += batch.column(1).to_pylist()
            if len(words) >= DEALT:
                yield from dealt()
                words.clear()
                ns.clear()
        if words:
            yield from dealt()

    return run


class Tree:
    """A k-d tree over letter vectors: nodes as (all bits, any bits, rows or None, children)."""

    def __init__(self, homes: np.ndarray):
        self.homes = homes
        self.bits = np.unpackbits(homes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        self.root = self._node(np.arange(len(homes)))

    def _node(self, rows: np.ndarray) -> tuple:
        own = self.homes[rows]
        box = np.bitwise_and.reduce(own), np.bitwise_or.reduce(own)
        if len(rows) > LEAF:
            ones = self.bits[rows].sum(axis=0, dtype=np.int64)
            bit = int(np.argmin(np.abs(2 * ones - len(rows))))
            if 0 < ones[bit] < len(rows):
                side = self.bits[rows, bit] == 1
                return *box, None, (self._node(rows[~side]), self._node(rows[side]))
        return *box, rows, ()

    def near(self, visitors: np.ndarray, down: int) -> tuple[np.ndarray, np.ndarray]:
        """(visitor, home) pairs at most ``down`` steps down and one step up apart."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        todo = [(self.root, np.arange(len(visitors)))]
        while todo:
            (every, some, rows, children), who = todo.pop()
            v = visitors[who]
            who = who[(np.bitwise_count(v & ~some) <= down) & (np.bitwise_count(~v & every) <= 1)]
            if not len(who):
                continue
            if rows is None:
                todo += [(child, who) for child in children]
                continue
            v, h = visitors[who][:, None], self.homes[rows][None, :]
            a, b = np.nonzero((np.bitwise_count(v & ~h) <= down) & (np.bitwise_count(~v & h) <= 1))
            found.append((who[a], rows[b]))
        return (np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])) if found else (np.empty(0, np.int64),) * 2


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced letter makes a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    p = 0
    while p < min(len(a), len(b)) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) >= len(b)) :] == b[p + (len(b) >= len(a)) :]


def _verified(visitors: list[str], homes: list[str], v: np.ndarray, h: np.ndarray, bucket: int, role: int) -> np.ndarray:
    if bucket == LONG:
        return np.array([one_edit(visitors[x], homes[y]) for x, y in zip(v.tolist(), h.tolist())], bool)
    a = np.array([w.encode("latin-1") for w in visitors]).view(np.uint8).reshape(len(visitors), -1)
    b = np.array([w.encode("latin-1") for w in homes]).view(np.uint8).reshape(len(homes), -1)
    fine = []
    for at in range(0, len(v), PAIRS):
        x, y = a[v[at : at + PAIRS]], b[h[at : at + PAIRS]]
        if role == EQUAL:
            fine.append((x != y).sum(axis=1) == 1)
        else:
            # Equal letters from the left, and from the right, together make the shorter word.
            left = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
            right = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            fine.append(left + right >= x.shape[1])
    return np.concatenate(fine) if fine else np.empty(0, bool)


def _best(owners: list[str], others: list[str], owner: np.ndarray, other: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """How many near words each owner has here, and the most frequent of them."""
    rank = np.empty(len(others), np.int64)
    rank[sorted(range(len(others)), key=others.__getitem__)] = np.arange(len(others))
    order = np.lexsort((rank[other], -n[other], owner))
    owner, other = owner[order], other[order]
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]]) if len(owner) else np.empty(0, np.int64)
    sizes = np.diff(np.r_[first, len(owner)])
    return pa.record_batch([
        pa.array([owners[i] for i in owner[first]], pa.string()), pa.array(sizes, pa.int64()),
        pa.array(n[other[first]], pa.int64()), pa.array([others[i] for i in other[first]], pa.string()),
    ], ["word", "n_near", "best_n", "best"])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, path, task, role, words, counts), sorted: the homes of a cell, then those that visit it."""
    now, homes, home_n, tree = None, [], np.empty(0, np.int64), None
    kind, visitors, visitor_n = None, [], []

    def search() -> Iterator[pa.RecordBatch]:
        nonlocal tree
        if homes and visitors:
            if tree is None:
                tree = Tree(vectors(letter_counts(homes)))
            n = np.concatenate(visitor_n)
            v, h = tree.near(vectors(letter_counts(visitors)), 0 if kind == SHORTER else 1)
            fine = _verified(visitors, homes, v, h, now[0], kind)
            v, h = v[fine], h[fine]
            yield _best(visitors, homes, v, h, home_n)
            if kind == SHORTER:
                yield _best(homes, visitors, h, v, n)
        visitors.clear()
        visitor_n.clear()

    for batch in batches:
        for row in batch.to_pylist():
            key = (row["bucket"], row["path"], row["task"])
            words, counts = row["words"].split("\n"), np.frombuffer(row["counts"], "<i8")
            if key != now or row["role"] != kind or len(visitors) >= SEARCHED:
                yield from search()
            if key != now:
                now, homes, home_n, tree = key, [], np.empty(0, np.int64), None
            kind = row["role"]
            if kind == HOME:
                homes += words
                home_n = np.concatenate([home_n, counts])
            else:
                visitors += words
                visitor_n.append(counts)
    yield from search()


def near_words(words: DataFrame, cell: int = CELL, task_homes: int = TASK_HOMES) -> DataFrame:
    """word, n_near, best_n and best (the most frequent near word) of the words that have one. ``words`` holds word and n."""
    splits = upper_splits(words, cell)
    packs = stored(words.select("word", "n").mapInArrow(_dealt(splits), CELLS), "spelling-cells")
    sizes = packs.filter(F.col("role") == HOME).groupBy("bucket", "path").agg(F.sum("size").alias("homes"))
    tasks = sizes.select("bucket", "path", F.ceil(F.col("homes") / task_homes).cast("int").alias("tasks"))
    met = packs.join(tasks, ["bucket", "path"])
    # A pack of homes goes to one task of its cell, a pack of visitors to all.
    mine = F.array(F.pmod(F.xxhash64("words"), F.col("tasks")).cast("int"))
    all_of = F.sequence(F.lit(0), F.col("tasks") - 1)
    sent = met.withColumn("task", F.explode(F.when(F.col("role") == HOME, mine).otherwise(all_of)))
    sent = sent.select("bucket", "path", "task", "role", "words", "counts").repartition("bucket", "path", "task").sortWithinPartitions("bucket", "path", "task", "role")
    found = sent.mapInArrow(_searched, NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("least"), "best"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", (-F.col("b.least")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """word and root: the last of the forms that follow each other from a word. A form is more frequent than its word, so there is no circle."""
    now = stored(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "spelling-roots")
    while not now.filter("moved").isEmpty():
        ahead = now.select(F.col("word").alias("at"), F.col("root").alias("next"))
        now = stored(now.join(ahead, F.col("root") == F.col("at"), "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
    return now.select("word", "root")


def variants(docs: DataFrame, times: int = 5) -> DataFrame:
    """word, form, root, n, n_near and form_n. A word's form is its most frequent near word, if that has at least ``times`` its count."""
    words = stored(vocabulary(docs), "spelling-words")
    joined = words.join(near_words(words), "word", "left")
    has = F.col("best_n") >= times * F.col("n")
    formed = stored(joined.select("word", F.when(has, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best_n")).alias("form_n")), "spelling-forms")
    linked = roots(formed.filter("form IS NOT NULL"))
    return formed.join(linked, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
