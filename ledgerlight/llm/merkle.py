"""Merkle manifest of a table: every row a leaf, with a witness that shows it belongs to the root.

Rows are hashed by Spark, put in order inside their group (``lang``) and numbered without a window over a group:
each range of rows counts its own, and a table of counts, one row for each range and group, says what lies before it. Aligned
stretches of 8^4 leaves are appended one by one to a `Frontier`: a leaf's partial witness hangs on the open subtree
that holds it, and each run that completes extends the witnesses below its members by their siblings. The roots of
stretches are further appends to a frontier of the next level, and so on, until a group has one node, its subroot. The subroots,
in order of their groups, are appended once more. What the appends above add to a stretch's witness goes back down, a row for each
stretch, so rows never carry their witnesses through a shuffle.

Defined cases: a null is hashed as ``-``, and a null group is a group of its own, the first; leaves with a null doc_id come
first and are never altered; rows that repeat a doc_id follow each other by their digests, and equal rows are counted together before they
are shuffled, each with a place and a witness of its own; empty texts are values of length 0; a very long text or row is hashed
by Spark inside its row and isn't moved; an empty table gives an empty manifest; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

FAN, HEIGHT = 8, 4
#: Leaves of an aligned stretch.
STRETCH = FAN**HEIGHT
PACK = "part string, number long, total long, ids array<long>, copies array<long>, nodes array<string>, altered array<string>, node string"
STEPS = "array<struct<place:int,run:string>>"

#: A step up: the place of a subtree in its run, and the digests of the whole run.
Step = tuple[int, str]


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


class Frontier:
    """A tree that grows by appended nodes; its open runs hold the subtrees that still wait for siblings."""

    def __init__(self) -> None:
        self.open: list[list[tuple[str, int, int]]] = [[]]
        self.witnesses: list[list[Step]] = []

    def append(self, node: str) -> None:
        self.witnesses.append([])
        self._put(0, (node, len(self.witnesses) - 1, len(self.witnesses)))

    def _put(self, level: int, subtree: tuple[str, int, int]) -> None:
        if level == len(self.open):
            self.open.append([])
        self.open[level].append(subtree)
        if len(self.open[level]) == FAN:
            self._complete(level)

    def _complete(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        nodes = "".join(node for node, _, _ in run)
        for place, (_, first, end) in enumerate(run):
            for leaf in range(first, end):
                self.witnesses[leaf].append((place, nodes))
        self._put(level + 1, (digest(nodes), run[0][1], run[-1][2]))

    def close(self, height: int) -> str:
        """Completes what is open below ``height`` and returns the one node there."""
        for level in range(height):
            if level < len(self.open) and self.open[level]:
                self._complete(level)
        return self.open[height][0][0]


def height_of(count: int, total: int) -> int:
    """Levels above ``count`` leaves that are a stretch of a tree with ``total``; only a whole tree is lower than a stretch."""
    if total > STRETCH:
        return HEIGHT
    height = 0
    while FAN**height < count:
        height += 1
    return height


def folded(node: str, steps: list[Step]) -> str:
    """The node above ``node`` after all steps."""
    for place, run in steps:
        node = digest(run[: place * 64] + node + run[place * 64 + 64 :])
    return node


def siblings(steps: list[Step]) -> str:
    return "".join(run[: place * 64] + run[place * 64 + 64 :] for place, run in steps)


def _field(value: Column) -> Column:
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def _leaf(text: Column) -> Column:
    fields = (F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text)
    return F.sha2(F.concat(*[_field(f) for f in fields]).cast("binary"), 256)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaves(docs: DataFrame, every: int = 3) -> DataFrame:
    """doc_id, part (the group), node (a row's digest) and altered: the digest after lower-casing, for one row in ``every``."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % every == 0
    altered = F.when(chosen, _leaf(F.translate("text", UPPER, LOWER)))
    return docs.select(F.col("lang").alias("part"), F.col("doc_id").cast("long").alias("id"), _leaf(F.col("text")).alias("node"), altered.alias("altered"))


def _count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds this range's number and how many copies of its group come before a row in it. Rows are sorted by group."""
    from pyspark import TaskContext

    number, now, before = TaskContext.get().partitionId(), object(), 0
    for batch in batches:
        at = []
        for part, copies in zip(batch["part"].to_pylist(), batch["copies"].to_pylist()):
            if part != now:
                now, before = part, 0
            at.append(before)
            before += copies
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), number, np.int32)), pa.array(at, pa.int64())], [*batch.schema.names, "range", "local"])


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows (part, copies, ...) with start, the copies before them in their group, and total, those of the group."""
    ranged = rows.repartitionByRange("part", *order).sortWithinPartitions("part", *order)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", `range` int, `local` long"
    placed = stored(ranged.mapInArrow(_count_on, schema), "merkle-rows")
    counts = placed.groupBy(F.col("part").alias("of"), F.col("range").alias("r")).agg(F.sum("copies").alias("n"))
    whole = Window.partitionBy("of")
    before = F.coalesce(F.sum("n").over(whole.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("of", "r", before.alias("before"), F.sum("n").over(whole).alias("total"))
    met = placed.join(offsets, (F.col("range") == F.col("r")) & F.col("part").eqNullSafe(F.col("of")))
    return met.select(*rows.columns, (F.col("before") + F.col("local")).alias("start"), "total")


def _pack(table: pa.Table) -> pa.Table:
    """A stretch as one row: appends its leaves, and keeps the node above them."""
    table = table.sort_by("start")
    copies, nodes = table["copies"].to_pylist(), table["node"].to_pylist()
    tree = Frontier()
    for node, n in zip(nodes, copies):
        for _ in range(n):
            tree.append(node)
    part, number, total = (table[c][0].as_py() for c in ("part", "number", "total"))
    node = tree.close(height_of(len(tree.witnesses), total))
    row = {"part": part, "number": number, "total": total, "ids": table["id"].to_pylist(), "copies": copies, "nodes": nodes, "altered": table["altered"].to_pylist(), "node": node}
    types = {"part": pa.string(), "number": pa.int64(), "total": pa.int64(), "ids": pa.list_(pa.int64()), "copies": pa.list_(pa.int64()), "nodes": pa.list_(pa.string()), "altered": pa.list_(pa.string()), "node": pa.string()}
    return pa.table({k: pa.array([row[k]], t) for k, t in types.items()})


def stretches(rows: DataFrame) -> DataFrame:
    """Packs of at most STRETCH leaves each, from rows (part, id, node, altered, copies, start, total)."""
    first, last = F.floor(F.col("start") / STRETCH), F.floor((F.col("start") + F.col("copies") - 1) / STRETCH)
    spread = rows.withColumn("number", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("number") * STRETCH)
    end = F.least(F.col("start") + F.col("copies"), (F.col("number") + 1) * STRETCH)
    cut = spread.select("part", "number", "total", "id", "node", "altered", begin.alias("start"), (end - begin).alias("copies"))
    return stored(cut.groupBy("part", "number").applyInArrow(_pack, PACK), "merkle-stretches")


def _grown(row: dict) -> tuple[list[str], list[list[Step]], list[Step]]:
    """A pack's nodes, copies counted, their steps up to its own node, and the steps above that."""
    tree, nodes = Frontier(), []
    for node, n in zip(row["nodes"], row["copies"]):
        for _ in range(n):
            nodes.append(node)
            tree.append(node)
    tree.close(height_of(len(nodes), row["total"]))
    return nodes, tree.witnesses, [(s["place"], s["run"]) for s in row["above"] or []]


def _handed_down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The steps above each node of a pack."""
    for batch in batches:
        for row in batch.to_pylist():
            nodes, within, above = _grown(row)
            base = row["number"] * STRETCH
            steps = [[{"place": p, "run": r} for p, r in [*own, *above]] for own in within]
            count = len(nodes)
            yield pa.record_batch([
                pa.array([row["part"]] * count, pa.string()), pa.array(range(base, base + count), pa.int64()),
                pa.array(steps, pa.list_(pa.struct([("place", pa.int32()), ("run", pa.string())]))),
                pa.array([row["subroot"]] * count, pa.string()), pa.array([row["root"]] * count, pa.string()),
            ], ["part", "number", "above", "subroot", "root"])


def _proofs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The manifest's rows of a pack of leaves."""
    for batch in batches:
        for row in batch.to_pylist():
            nodes, within, above = _grown(row)
            ids = [i for i, n in zip(row["ids"], row["copies"]) for _ in range(n)]
            altered = [a for a, n in zip(row["altered"], row["copies"]) for _ in range(n)]
            tail, root = siblings(above), row["root"]
            whole = folded(row["node"], above)
            out = []
            for node, other, steps in zip(nodes, altered, within):
                # Leaves that weren't altered are folded too: a fold is what verifies.
                up = folded(other or node, steps)
                out.append((digest(siblings(steps) + tail), whole if up == row["node"] else folded(up, above)))
            count = len(ids)
            yield pa.record_batch([
                pa.array(ids, pa.int64()), pa.array(nodes), pa.array([row["subroot"]] * count), pa.array([root] * count),
                pa.array([p for p, _ in out]), pa.array([f for _, f in out]), pa.array([f == root for _, f in out]),
            ], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


MANIFEST = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
HANDED = f"part string, number long, above {STEPS}, subroot string, root string"


def _levels(rows: DataFrame) -> list[DataFrame]:
    """Packs of each level, from the leaves up, until every group is one pack."""
    found = [stretches(rows)]
    while (found[-1].agg(F.max("total")).first()[0] or 0) > STRETCH:
        below = found[-1]
        total = F.ceil(F.col("total") / STRETCH)
        nodes = below.select("part", F.lit(None).cast("long").alias("id"), "node", F.lit(None).cast("string").alias("altered"), F.lit(1).cast("long").alias("copies"), F.col("number").alias("start"), total.alias("total"))
        found.append(stretches(nodes))
    return found


def _below(levels: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest packs with what is above them; ``above`` has it by (part, number) for the packs of the last level."""
    for i in range(len(levels) - 1, -1, -1):
        known = above.withColumnsRenamed({"part": "of", "number": "at"})
        met = levels[i].join(known, (F.col("number") == F.col("at")) & F.col("part").eqNullSafe(F.col("of"))).drop("of", "at")
        if i == 0:
            return met
        above = stored(met.mapInArrow(_handed_down, HANDED), "merkle-above")
    raise ValueError("no level")


def manifest(docs: DataFrame, every: int = 3) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row; one row in ``every`` is altered before it is folded."""
    rows = leaves(docs, every).groupBy("part", "id", "node", "altered").agg(F.count("*").alias("copies"))
    levels = _levels(numbered(rows, ["id", "node"]))
    # Every group is one node now: its subroot. All groups together are one tree more.
    tops = levels[-1].select("part", F.col("node").alias("subroot"))
    listed = tops.select(F.lit("").alias("part"), F.col("part").alias("name"), F.col("subroot").alias("node"), F.lit(1).cast("long").alias("copies"))
    placed = stored(numbered(listed, ["name"]), "merkle-groups")
    nothing = F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("altered")
    over = _levels(placed.select("part", *nothing, "node", "copies", "start", "total"))
    root = over[-1].select("part", F.lit(0).cast("long").alias("number"), F.lit(None).cast(STEPS).alias("above"), F.lit(None).cast("string").alias("subroot"), F.col("node").alias("root"))
    handed = _below(over, root).mapInArrow(_handed_down, HANDED).select(F.col("number").alias("start"), "above", "root")
    by_group = stored(placed.join(handed, "start").select(F.col("name").alias("part"), F.lit(0).cast("long").alias("number"), "above", F.col("node").alias("subroot"), "root"), "merkle-tops")
    return _below(levels, by_group).mapInArrow(_proofs, MANIFEST)
