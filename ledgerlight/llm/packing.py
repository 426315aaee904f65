"""Cost-balanced packing of token sequences.

The cost of a piece of n tokens is ``linear * n + quadratic * n * n``, the estimate of its attention. A
document longer than a sequence is cut into whole sequences and a rest; rests go in descending order
to the sequence of lowest cost that still has room, and a rest that fits nowhere is cut at those
with the most room. A task packs stretches of about ``stretch`` tokens, each into the least
number of sequences, so that only one sequence's worth of padding falls to a stretch. Nothing is
shuffled, and no group can grow: the stretches follow the partitions of the input.

Defined cases: a null or empty text is the closing id alone; texts longer than a stretch are packed
with the stretch they end in; of equal lengths the earlier row goes first; repeated rows and rows with a
null doc_id are packed one by one; an empty table gives no pieces;
further columns are ignored. Sequence ids hold the partition in their high bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .bpe import encoder
from .common import text_or_empty

CLOSING = (1).to_bytes(4, "little")
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, cost double"


def balance(sizes: np.ndarray, room: int, linear: float, quadratic: float) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """(row, start, length, sequence, offset) of every piece, and the number of sequences."""
    total = int(sizes.sum())
    count = -(-total // room)
    out, whole = [], 0
    for row in np.flatnonzero(sizes >= room).tolist():
        for k in range(sizes[row] // room):
            out.append((row, k * room, room, whole, 0))
            whole += 1
    rest = sizes % room
    left, cost = np.full(count - whole, room), np.zeros(count - whole)
    # Rests come in descending order, so a sequence without room for one may have it for a later one: it waits by its room.
    ready = [(0.0, at) for at in range(count - whole)]
    waiting: list[tuple[int, int]] = []

    def put(row: int, start: int, n: int, at: int) -> None:
        out.append((row, start, n, whole + at, room - int(left[at])))
        left[at] -= n
        cost[at] += linear * n + quadratic * n * n

    for row in np.argsort(-rest, kind="stable").tolist():
        n = int(rest[row])
        start = int(sizes[row]) - n
        while waiting and -waiting[0][0] >= n > 0:
            at = heappop(waiting)[1]
            heappush(ready, (float(cost[at]), at))
        while n:
            while ready and left[ready[0][1]] < n:
                at = heappop(ready)[1]
                if left[at]:
                    heappush(waiting, (-int(left[at]), at))
            # A rest that fits nowhere is cut at the sequence with the most room.
            at = heappop(ready)[1] if ready else heappop(waiting)[1]
            part = min(n, int(left[at]))
            put(row, start, part, at)
            start, n = start + part, n - part
            if left[at]:
                heappush(ready, (float(cost[at]), at))
            while waiting and -waiting[0][0] >= n > 0:
                other = heappop(waiting)[1]
                heappush(ready, (float(cost[other]), other))
    return out, count


def pack(docs: DataFrame, path: str, room: int = 2048, linear: float = 1.0, quadratic: float = 1.0 / 2048, stretch: int = 1 << 20) -> DataFrame:
    """One row for each piece of a document, with its place in a sequence of at most ``room`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, by_library=True)
        base = TaskContext.get().partitionId() << 36
        rows: list[tuple[int | None, bytes]] = []
        held = 0

        def packed() -> pa.RecordBatch:
            nonlocal base, rows, held
            sizes = np.array([len(ids) // 4 for _, ids in rows])
            pieces, count = balance(sizes, room, linear, quadratic)
            row, start, length, sequence, offset = np.array(pieces, np.int64).T
            views = [memoryview(ids) for _, ids in rows]
            sums = [zlib.crc32(views[r][4 * s : 4 * (s + n)]) for r, s, n, _, _ in pieces]
            batch = pa.record_batch([
                pa.array([rows[r][0] for r in row.tolist()], pa.int64()), pa.array(start), pa.array(length), pa.array(sums, pa.int64()),
                pa.array(sizes[row]), pa.array(sequence + base), pa.array(offset), pa.array(linear * length + quadratic * length * length),
            ], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "cost"])
            base, rows, held = base + count, [], 0
            return batch

        for batch in batches:
            texts = bpe.encode_all(text.as_py() for text in batch.column(1))
            for doc, text_ids in zip(batch.column(0).to_pylist(), texts):
                ids = text_ids.astype("<u4").tobytes() + CLOSING
                rows.append((doc, ids))
                held += len(ids) // 4
                if held >= stretch:
                    yield packed()
        if rows:
            yield packed()

    return docs.select("doc_id", text_or_empty("text")).mapInArrow(run, PIECES)
