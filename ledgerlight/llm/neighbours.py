"""Approximate nearest neighbours by inner product, over partitions learned from a neighbour graph.

Rows with equal vectors are one class. A bounded sample of the classes gives a graph of nearest neighbours, which is cut into parts of
nearly equal size with few links between them; a softmax classifier learns in which parts the neighbours of a vector lie.
Every row goes to its most probable part. A query goes to the most probable parts until they
hold a share of the probability that, on sample rows kept out of the training, finds RECALL of the neighbours.
Parts that are still large are partitioned again, each by a graph and a classifier of its own, so sample, model and part stay
bounded at every size of the table. In the parts that a query reaches, all rows are ranked by their inner products in
double precision. Vectors get one more component, which makes all of them equally long and leaves the order of inner
products as it is, so lengths may differ.

A model travels to the rows of its part as a row of the same sorted stream, and so do a part's rows to its queries: tasks hold a
model and a batch, or a bounded chunk of a part and a batch of queries.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without a vec_id; components
that a shorter vector lacks count as zero; of different vectors of one vec_id the smallest counts; equal vectors are found
together, and of them the smallest ids; ties go to the smaller vec_id; queries with equal vectors are searched once; very long
vectors are held whole, a batch of rows at a time; an empty table or one without queries gives an empty table; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows that a model is fitted on, at most (by hash, so a few more or less), and the parts it makes.
SAMPLE, PARTS = 8192, 32
#: Parts of more rows are partitioned again, to this depth at most.
PART_ROWS, DEPTH = 4096, 6
#: Neighbours of a row in the graph, and how far a part may exceed its share.
LINKS, SLACK = 16, 0.1
#: Neighbours that routing should find, measured on one sample row in HELD_OUT.
RECALL, HELD_OUT = 0.97, 5
#: Passes of the refinement and of the training.
REFINED, EPOCHS = 12, 30
#: Rows of a part that one task ranks, and queries that it ranks at once.
CHUNK, BATCH = 16384, 512
MODEL, ITEM, QUERY = 0, 1, 2


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id, its vector v and the vector's hash h, of the rows that take part."""
    x = F.col("embedding")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf"))) & F.exists(x, lambda e: e != 0)
    single = vectors.filter(fine & F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(x).alias("v"))
    return single.withColumn("h", F.xxhash64("v"))


def classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """class (the smallest vec_id), h, v, ids (the k + 1 smallest) and asks (whether a query is among them) of each distinct vector."""
    place = F.row_number().over(Window.partitionBy("h", "v").orderBy("vec_id"))
    few = rows.withColumn("place", place).filter(F.col("place") <= k + 1).groupBy("h", "v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asking = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("h").alias("qh"), F.col("v").alias("qv")).agg(F.lit(True).alias("asks"))
    met = few.join(asking, (F.col("h") == F.col("qh")) & (F.col("v") == F.col("qv")), "left")
    return met.select(F.col("ids")[0].alias("class"), "h", "v", "ids", F.coalesce("asks", F.lit(False)).alias("asks"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of doubles, shorter ones filled with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), dim))
    out[np.arange(dim)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def candidates_of(x: np.ndarray, longest: float) -> np.ndarray:
    """Vectors over the longest length, with the component that makes them unit vectors."""
    x = x / longest
    return np.hstack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))[:, None]])


def queries_of(x: np.ndarray) -> np.ndarray:
    return np.hstack([x / np.sqrt((x * x).sum(axis=1))[:, None], np.zeros((len(x), 1))])


def neighbour_graph(queries: np.ndarray, candidates: np.ndarray, links: int) -> np.ndarray:
    """The numbers of the nearest candidates of each query, its own number left out."""
    links = min(links, len(candidates) - 1)
    out = np.empty((len(queries), links), np.int64)
    for at in range(0, len(queries), BATCH):
        s = queries[at : at + BATCH] @ candidates.T
        s[np.arange(len(s)), at + np.arange(len(s))] = -np.inf
        out[at : at + BATCH] = np.argpartition(-s, links - 1, axis=1)[:, :links]
    return out


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int) -> np.ndarray:
    """A part for each node: halves along the widest directions first, then nodes move to where most neighbours are and room is."""
    n = len(x)
    label = np.zeros(n, np.int64)
    for level in range(int(math.log2(parts))):
        for part in range(1 << level):
            own = np.flatnonzero(label == part)
            if len(own) < 2:
                continue
            centred = x[own] - x[own].mean(axis=0)
            along = centred @ np.linalg.eigh(centred.T @ centred)[1][:, -1]
            label[own[np.argsort(along, kind="stable")[len(own) // 2 :]]] |= 1 << level
    room = math.ceil(n / parts * (1 + SLACK))
    size = np.bincount(label, minlength=parts)
    who, other = np.repeat(np.arange(n), graph.shape[1]), graph.ravel()
    for turn in range(REFINED):
        held = np.bincount(who * parts + label[other], minlength=n * parts) + np.bincount(other * parts + label[who], minlength=n * parts)
        held = held.reshape(n, parts)
        best = held.argmax(axis=1)
        gain = held[np.arange(n), best] - held[np.arange(n), label]
        # Half of the nodes a turn, so that neighbours don't change places for ever.
        moving = np.flatnonzero((gain > 0) & ((np.arange(n) + turn) % 2 == 0))
        for i in moving[np.argsort(-gain[moving], kind="stable")].tolist():
            if size[best[i]] < room:
                size[label[i]] -= 1
                size[best[i]] += 1
                label[i] = best[i]
    return label


class Router:
    """A softmax classifier over standardised vectors, and the share of probability that a query visits."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, share: float):
        self.mean, self.scale, self.weights, self.share = mean, scale, weights, share

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))]) @ self.weights
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def home(self, candidates: np.ndarray) -> np.ndarray:
        return self.probabilities(candidates).argmax(axis=1)

    def before(self, queries: np.ndarray) -> np.ndarray:
        """For each query and part, the probability of all parts that come first."""
        p = self.probabilities(queries)
        order = np.argsort(-p, axis=1, kind="stable")
        ranked = np.take_along_axis(p, order, axis=1)
        out = np.empty_like(p)
        np.put_along_axis(out, order, np.cumsum(ranked, axis=1) - ranked, axis=1)
        return out

    def to_bytes(self) -> bytes:
        return np.concatenate([[len(self.mean), self.weights.shape[1], self.share], self.mean, self.scale, self.weights.ravel()]).astype("<f8").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> Router:
        x = np.frombuffer(data, "<f8")
        dim, parts = int(x[0]), int(x[1])
        return cls(x[3 : 3 + dim], x[3 + dim : 3 + 2 * dim], x[3 + 2 * dim :].reshape(dim + 1, parts), float(x[2]))


def trained(x: np.ndarray, targets: np.ndarray) -> Router:
    """Softmax regression by Adam on shuffled batches, always in the same order."""
    scale = x.std(axis=0)
    router = Router(x.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), np.zeros((x.shape[1] + 1, targets.shape[1])), 1.0)
    z = np.hstack([(x - router.mean) / router.scale, np.ones((len(x), 1))])
    first, second, step = np.zeros_like(router.weights), np.zeros_like(router.weights), 0
    rng = np.random.default_rng(1)
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            rows, step = order[at : at + BATCH], step + 1
            a = z[rows] @ router.weights
            p = np.exp(a - a.max(axis=1, keepdims=True))
            slope = z[rows].T @ (p / p.sum(axis=1, keepdims=True) - targets[rows]) / len(rows) + 1e-4 * router.weights
            first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope * slope
            router.weights = router.weights - 0.05 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return router


def fitted(x: np.ndarray, longest: float, parts: int = PARTS) -> Router:
    """The router of a sample: graph, parts, classifier, and the share measured on rows that the classifier hasn't seen."""
    candidates, queries = candidates_of(x, longest), queries_of(x)
    n = len(x)
    if n <= 2 * parts:
        return Router(np.zeros(x.shape[1] + 1), np.ones(x.shape[1] + 1), np.zeros((x.shape[1] + 2, parts)), 1.0)
    graph = neighbour_graph(queries, candidates, LINKS)
    label = balanced_parts(candidates, graph, parts)
    who = np.repeat(np.arange(n), graph.shape[1] + 1)
    near = np.hstack([np.arange(n)[:, None], graph]).ravel()
    targets = np.bincount(who * parts + label[near], minlength=n * parts).reshape(n, parts) / (graph.shape[1] + 1)
    held = np.arange(n) % HELD_OUT == 0
    router = trained(queries[~held], targets[~held])
    home = router.home(candidates)
    needed = np.take_along_axis(router.before(queries[held]), home[graph[held]], axis=1)
    # A part is visited when what comes before it is less than the share.
    router.share = min(1.0, float(np.quantile(needed, RECALL)) + 1e-6)
    return router


def _fit(dim: int, longest: float, parts: int):
    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("class")
        model = fitted(matrix(table["v"], dim), longest, parts).to_bytes()
        return pa.table({"part": pa.array([table["part"][0].as_py()]), "model": pa.array([model], pa.binary())})

    return fit


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else [], kind))


def _runs(batch: pa.RecordBatch, *names: str) -> Iterator[pa.RecordBatch]:
    """The batch cut where one of these columns changes."""
    cuts = np.zeros(max(0, len(batch) - 1), bool)
    for name in names:
        codes = batch[name].dictionary_encode().indices.to_numpy(zero_copy_only=False)
        cuts |= np.diff(codes) != 0
    ends = [*(np.flatnonzero(cuts) + 1).tolist(), len(batch)]
    for start, end in zip([0, *ends], ends):
        if end > start:
            yield batch.slice(start, end - start)


def _routed(dim: int, longest: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (part, salt, kind, class, ids, v, model), sorted: the model of a part, then its candidates and queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = None
        for batch in batches:
            for rows in _runs(batch, "part", "salt", "kind"):
                part, kind = rows["part"][0].as_py(), rows["kind"][0].as_py()
                if kind == MODEL:
                    router = Router.from_bytes(rows["model"][0].as_py())
                    continue
                x = matrix(rows["v"], dim)
                if kind == ITEM:
                    who, to = np.arange(len(x)), router.home(candidates_of(x, longest))
                else:
                    who, to = np.nonzero(router.before(queries_of(x)) < router.share)
                moved = rows.take(pa.array(who))
                yield pa.RecordBatch.from_arrays([pa.array([f"{part}.{t}" for t in to.tolist()], pa.string()), moved["kind"], moved["class"], moved["ids"], moved["v"]], ["part", "kind", "class", "ids", "v"])

    return run


def exact_scores(query: np.ndarray, rows: np.ndarray) -> list[float]:
    """Inner products whose sums are rounded once, so equal vectors have equal scores wherever they are computed."""
    return [math.fsum(p) for p in (rows * query).tolist()]


def _ranked(dim: int, k: int):
    """Rows (part, salt, kind, class, ids, v), sorted: the candidates of a chunk, then its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, x, ids = None, [], None, []
        for batch in batches:
            for rows in _runs(batch, "part", "salt", "kind"):
                key, kind = (rows["part"][0].as_py(), rows["salt"][0].as_py()), rows["kind"][0].as_py()
                if key != now:
                    now, held, x, ids = key, [], None, []
                if kind == ITEM:
                    held.append(matrix(rows["v"], dim))
                    ids += rows["ids"].to_pylist()
                    continue
                if not held:
                    continue
                if x is None:
                    x = np.concatenate(held)
                    held = [x]
                q = matrix(rows["v"], dim)
                for at in range(0, len(q), BATCH):
                    yield _best(q[at : at + BATCH], rows["class"].to_numpy()[at : at + BATCH], x, ids, k)

    def _best(q: np.ndarray, owners: np.ndarray, x: np.ndarray, ids: list[list[int]], k: int) -> pa.RecordBatch:
        s = q @ x.T
        most = min(k + 1, len(x))
        bound = np.partition(s, len(x) - most, axis=1)[:, len(x) - most]
        # Products may differ in their last bits; what is as good as the last one is summed exactly.
        bound = bound - 1e-9 * (1 + np.abs(bound))
        near, scores = [], []
        for i in range(len(q)):
            found = np.flatnonzero(s[i] >= bound[i])
            exact = exact_scores(q[i], x[found])
            pairs = sorted((-e, j) for e, c in zip(exact, found.tolist()) for j in ids[c])[: k + 1]
            near.append(np.array([j for _, j in pairs], np.int64))
            scores.append(np.array([-e for e, _ in pairs]))
        return pa.record_batch([pa.array(owners), _lists(near, pa.int64()), _lists(scores, pa.float64())], ["class", "near", "scores"])

    return run


def _dealt(rows: DataFrame, sizes: DataFrame, size_of: int, model: DataFrame | None) -> DataFrame:
    """Rows of each part in tasks of at most ``size_of`` candidates, sorted by kind; what comes before them goes to all tasks of a part."""
    tasks = sizes.select("part", F.ceil(F.col("size") / size_of).cast("int").alias("tasks"))
    own = F.pmod(F.xxhash64("class"), F.col("tasks")).cast("int")
    every = F.sequence(F.lit(0), F.col("tasks") - 1)
    met = rows.join(tasks, "part")
    if model is None:
        sent = met.withColumn("salt", F.explode(F.when(F.col("kind") == ITEM, F.array(own)).otherwise(every))).drop("tasks")
    else:
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in rows.schema if f.name not in ("part", "kind")}
        models = model.join(tasks, "part").select("part", F.lit(MODEL).alias("kind"), *[v.alias(c) for c, v in nothing.items()], "model", F.explode(every).alias("salt"))
        sent = met.withColumn("salt", own).withColumn("model", F.lit(None).cast("binary")).drop("tasks").unionByName(models)
    return sent.repartition("part", "salt").sortWithinPartitions("part", "salt", "kind")


def partitioned(found: DataFrame, dim: int, longest: float, part_rows: int, parts: int, sample: int) -> DataFrame:
    """part, kind, class, ids and v: every class in its part, and every query in all parts that it visits."""
    items = found.select(F.lit("").alias("part"), F.lit(ITEM).alias("kind"), "class", "ids", "v")
    asks = found.filter("asks").select(F.lit("").alias("part"), F.lit(QUERY).alias("kind"), "class", F.array().cast("array<long>").alias("ids"), "v")
    rows, done = items.unionByName(asks), None
    schema = "part string, kind int, class long, ids array<long>, v " + found.schema["v"].dataType.simpleString()
    for depth in range(DEPTH):
        # The whole table is always partitioned, its parts only where they are large.
        sizes = rows.filter(F.col("kind") == ITEM).groupBy("part").agg(F.count("*").alias("size"))
        large = stored(sizes.filter(F.col("size") > (part_rows if depth else 0)), "parts")
        if large.isEmpty():
            break
        drawn = rows.filter(F.col("kind") == ITEM).join(large, "part").filter(F.pmod(F.xxhash64(F.lit(depth), "class"), "size") < sample)
        models = stored(drawn.select("part", "class", "v").groupBy("part").applyInArrow(_fit(dim, longest, parts), "part string, model binary"), "routers")
        small = rows.join(large, "part", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = stored(_dealt(rows, large, CHUNK, models).mapInArrow(_routed(dim, longest), schema), "routed")
    return rows if done is None else done.unionByName(rows)


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, part_rows: int = PART_ROWS, parts: int = PARTS, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each row whose vec_id is divisible by ``every``."""
    rows = valid(vectors)
    found = stored(classes(rows, k, every), "vector-classes")
    norm: Column = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double")))
    extent = found.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("longest")).first()
    placed = partitioned(found, extent.dim or 1, extent.longest or 1.0, part_rows, parts, sample)
    sizes = placed.filter(F.col("kind") == ITEM).groupBy("part").agg(F.count("*").alias("size"))
    ranked = _dealt(placed, sizes, CHUNK, None).mapInArrow(_ranked(extent.dim or 1, k), "class long, near array<long>, scores array<double>")
    pairs = F.arrays_zip((F.transform("scores", lambda s: -s)).alias("less"), F.col("near").alias("vec_id"))
    best = ranked.select("class", pairs.alias("pairs")).groupBy("class").agg(F.slice(F.array_sort(F.flatten(F.collect_list("pairs"))), 1, k + 1).alias("pairs"))
    answers = found.filter("asks").select("class", "h", "v").join(best, "class").select(F.col("h").alias("qh"), F.col("v").alias("qv"), "pairs")
    queries = rows.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id")
    others = F.slice(F.filter("pairs", lambda p: p["vec_id"] != F.col("query_id")), 1, k)
    out = queries.join(answers, (F.col("h") == F.col("qh")) & (F.col("v") == F.col("qv"))).select("query_id", F.posexplode(others).alias("at", "p"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("p.vec_id").alias("vec_id"), (-F.col("p.less")).alias("score"))
