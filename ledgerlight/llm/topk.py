"""Exact top-k search by inner product over norm buckets.

Vectors become whole numbers, floor(scale * x). Candidates are range-partitioned by length and packed
into buckets of nearly equal length, longest first; queries are packed into blocks. A first round
searches each query in one of the longest buckets, which gives it a score to beat; the second round
joins query blocks with all buckets that could still reach it (length pruning of whole buckets) and
derives a cosine threshold for each query and bucket: the score to beat over the query's length and the
bucket's greatest length. A low threshold leaves length pruning inside the bucket; a high one adds
coordinate pruning: along the query's largest coordinates a candidate's best possible cosine, from
that coordinate and the length that remains, must reach the threshold. What is left is verified by
exact products. Pruning has a slack for rounding, so no result is lost.

Defined cases: vectors that are null or hold null or non-finite components take no part; components
that a shorter vector lacks count as zero; a query's own row is every row with its vec_id; rows that
repeat a vec_id with the same vector count once; ties go to the smaller vec_id; scores beyond 64 bits are
clipped; an empty table or one without queries gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

BUCKET_ROWS, QUERY_ROWS = 4096, 1024
#: Buckets of a part of the table, and those that one task searches.
PART_BUCKETS, GROUP_BUCKETS = 4, 8
#: Coordinates checked, and the cosine from which checking them pays.
FOCUS, HIGH_COSINE = 3, 0.5
SLACK = 1e-9
EXACT = 2.0**53
PACK = "part int, number int, n int, dim int, longest double, ids binary, vectors binary"
RESULT = "query_id long, vec_id long, score long"


def integer_vectors(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v (array of long) and its length, for the vectors that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    v = F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    valid = vectors.filter(fine & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long"), v.alias("v"))
    return valid.distinct().withColumn("length", length)


def _pack(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def packed(table: pa.Table) -> pa.RecordBatch:
            nonlocal number
            ids = table["vec_id"].to_numpy()
            lists = table["v"].combine_chunks()
            sizes = np.diff(lists.offsets.to_numpy())
            dim = int(sizes.max(initial=0))
            out = np.zeros((len(ids), dim), np.int64)
            out[np.arange(dim)[None, :] < sizes[:, None]] = lists.flatten().to_numpy()
            number += 1
            longest = float(table["length"].to_numpy().max())
            return pa.record_batch([
                pa.array([part], pa.int32()), pa.array([number - 1], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([dim], pa.int32()), pa.array([longest]),
                pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([out.astype("<i8").tobytes()], pa.binary()),
            ], ["part", "number", "n", "dim", "longest", "ids", "vectors"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= rows:
                table = pa.Table.from_batches(held)
                while len(table) >= rows:
                    yield packed(table.slice(0, rows))
                    table = table.slice(rows)
                held = table.combine_chunks().to_batches() if len(table) else []
        if sum(map(len, held)):
            yield packed(pa.Table.from_batches(held))

    return run


class Block:
    """Vectors in memory, with lengths and directions."""

    def __init__(self, n: int, dim: int, ids: bytes, vectors: bytes):
        self.ids = np.frombuffer(ids, "<i8")
        self.v = np.frombuffer(vectors, "<i8").reshape(n, dim)
        self.f = self.v.astype(np.float64)
        self.length = np.sqrt((self.f * self.f).sum(axis=1))
        self.top = float(np.abs(self.f).max(initial=0))

    def directions(self) -> np.ndarray:
        """Directions by coordinate, one row each."""
        return np.ascontiguousarray((self.f / np.where(self.length > 0, self.length, 1)[:, None]).T)


class Best:
    """The k best of each query of a block so far."""

    def __init__(self, queries: Block, k: int, floor: np.ndarray | None = None):
        self.queries, self.k = queries, k
        self.ids: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries.ids)
        self.scores: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries.ids)
        self.floor = np.full(len(queries.ids), -np.inf) if floor is None else floor.copy()

    def add(self, q: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[q], self.scores[q] = ids[order], scores[order]
        if len(order) == self.k:
            self.floor[q] = max(self.floor[q], float(scores[order[-1]]))

    def batch(self) -> pa.RecordBatch:
        owners = np.repeat(self.queries.ids, [len(x) for x in self.ids])
        return pa.record_batch([pa.array(owners), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.scores))], ["query_id", "vec_id", "score"])


def _products(queries: Block, q: int, bucket: Block, rows: np.ndarray) -> np.ndarray:
    dim = min(queries.v.shape[1], bucket.v.shape[1])
    if queries.top * bucket.top * max(dim, 1) < EXACT:
        return (bucket.f[rows, :dim] @ queries.f[q, :dim]).astype(np.int64)
    exact = bucket.v[rows, :dim].astype(object) @ queries.v[q, :dim].astype(object)
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in exact], np.int64)


def search(queries: Block, bucket: Block, best: Best) -> None:
    """Adds the bucket's candidates that can be among the best of a query. The bucket is sorted, longest first."""
    if not len(bucket.ids):
        return
    along, dim = bucket.directions(), min(queries.v.shape[1], bucket.v.shape[1])
    exact = queries.top * bucket.top * max(dim, 1) < EXACT
    for q in range(len(queries.ids)):
        beat, length = best.floor[q], queries.length[q]
        slack = SLACK * (1 + abs(beat))
        rows = np.arange(len(bucket.ids))
        if exact and beat > -np.inf and length > 0:
            cosine = (beat - slack) / (length * bucket.length[0]) if bucket.length[0] > 0 else 2.0 * (beat > 0)
            if cosine > 1 + SLACK:
                continue
            if beat > 0:
                # Length pruning: |q| |c| must reach the score to beat.
                rows = rows[: np.searchsorted(-bucket.length, -(beat - slack) / length * (1 - SLACK), side="right")]
            if cosine > HIGH_COSINE / 4:
                unit = queries.f[q, :dim] / length
                for f in np.argsort(-np.abs(unit))[:FOCUS]:
                    c = along[f, rows]
                    most = unit[f] * c + np.sqrt(max(0.0, 1 - unit[f] ** 2)) * np.sqrt(np.maximum(0, 1 - c * c))
                    rows = rows[most >= (beat - slack) / (length * np.maximum(bucket.length[rows], 1e-300)) - SLACK]
        rows = rows[bucket.ids[rows] != queries.ids[q]]
        if not len(rows):
            continue
        scores = _products(queries, q, bucket, rows)
        hit = scores >= beat
        if hit.any():
            best.add(q, bucket.ids[rows[hit]], scores[hit])


def _block(batch: pa.RecordBatch, i: int, at: int) -> Block:
    return Block(batch.column(at)[i].as_py(), batch.column(at + 1)[i].as_py(), batch.column(at + 2)[i].as_py(), batch.column(at + 3)[i].as_py())


def _search_rows(k: int):
    """Rows: group, query block number, its columns and floors, then a bucket's columns.

    Neighbouring rows of one query block share its best results; where a block comes back later, it only
    starts anew from its floors, and the results are merged afterwards.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, best = None, None
        for batch in batches:
            for i in range(len(batch)):
                key = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if key != now:
                    if best is not None:
                        yield best.batch()
                    queries = _block(batch, i, 2)
                    floors = batch.column(6)[i].as_py()
                    now, best = key, Best(queries, k, None if floors is None else np.frombuffer(floors, "<f8"))
                search(best.queries, _block(batch, i, 7), best)
        if best is not None:
            yield best.batch()

    return run


def _with_floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns a block's (query_id, floor) pairs into its floors, and the length that a bucket must have at least."""
    for batch in batches:
        floors, least = [], []
        for i in range(len(batch)):
            block = _block(batch, i, 1)
            known = {x["query_id"]: x["floor"] for x in batch.column(5)[i].as_py() or []}
            values = np.array([known.get(q, -np.inf) for q in block.ids.tolist()], np.float64)
            with np.errstate(divide="ignore", invalid="ignore"):
                need = np.where(values > 0, values / block.length, 0.0)
            floors.append(values.astype("<f8").tobytes())
            least.append(float(np.nan_to_num(need, posinf=0.0).min(initial=np.inf)) * (1 - 1e-6))
        yield pa.record_batch([*(batch.column(i) for i in range(5)), pa.array(floors, pa.binary()), pa.array(least)], ["block", "q_n", "q_dim", "q_ids", "q_vectors", "floors", "least"])


QUERY_BLOCK = "block int, q_n int, q_dim int, q_ids binary, q_vectors binary"


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id and score of the k best candidates of each row whose vec_id is divisible by ``every``."""
    rows = stored(integer_vectors(vectors, scale), "vectors")
    total = max(1, rows.count())
    ranged = rows.repartitionByRange(max(1, -(-total // (PART_BUCKETS * BUCKET_ROWS))), F.desc("length"), "vec_id").sortWithinPartitions(F.desc("length"), "vec_id")
    buckets = stored(ranged.mapInArrow(_pack(BUCKET_ROWS), PACK), "buckets")
    chosen = rows.filter(F.col("vec_id") % every == 0)
    dealt = chosen.repartition(max(1, -(-total // (every * QUERY_ROWS))), "vec_id")
    blocks = dealt.mapInArrow(_pack(QUERY_ROWS), PACK)
    numbered = blocks.select((F.col("part") * 1000 + F.col("number")).alias("block"), F.col("n").alias("q_n"), F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    queries = stored(numbered, "query-blocks")

    columns = [F.col(c) for c in ("n", "dim", "ids", "vectors")]
    # Parts follow the lengths, so neighbouring ones make a group; no bucket needs a number of its own.
    placed = buckets.withColumn("group", F.floor(F.col("part") * PART_BUCKETS / GROUP_BUCKETS).cast("int"))
    extent = buckets.agg(F.min(F.struct("part", "number")).alias("first"), F.max("part").alias("last")).first()
    if extent.first is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    longest = buckets.filter((F.col("part") == extent.first.part) & (F.col("number") == extent.first.number))

    q = ["q_n", "q_dim", "q_ids", "q_vectors"]
    # One bucket of at most BUCKET_ROWS vectors: small enough to be broadcast to the query blocks.
    first = queries.withColumns({"floors": F.lit(None).cast("binary"), "part": F.lit(extent.first.part)})
    start = first.join(F.broadcast(longest), "part").select(F.lit(0).alias("group"), "block", *q, "floors", *columns)
    found = start.repartition("block").mapInArrow(_search_rows(k), RESULT)
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    floors = ranked.filter(F.col("r") == k).select("query_id", F.col("score").cast("double").alias("floor"))

    ids = rows.filter(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"))
    owner = queries.mapInArrow(_owners, "query_id long, block int").join(floors.join(ids, "query_id", "left_semi"), "query_id")
    by_block = owner.groupBy("block").agg(F.collect_list(F.struct("query_id", "floor")).alias("known"))
    primed = queries.join(by_block, "block", "left").select("block", *q, "known")
    primed = stored(primed.mapInArrow(_with_floors, QUERY_BLOCK + ", floors binary, least double"), "primed-queries")

    groups = extent.last * PART_BUCKETS // GROUP_BUCKETS + 1
    spread = primed.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    # A query block meets the buckets of a group one after the other; they aren't shuffled or sorted as pairs.
    cells = spread.join(placed, "group").filter(F.col("longest") >= F.col("least"))
    results = cells.select("group", "block", *q, "floors", *columns).mapInArrow(_search_rows(k), RESULT)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return results.distinct().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, ids in zip(batch.column(0).to_pylist(), batch.column(3)):
            own = np.frombuffer(ids.as_py(), "<i8")
            yield pa.record_batch([pa.array(own), pa.array(np.full(len(own), block, np.int32))], ["query_id", "block"])
