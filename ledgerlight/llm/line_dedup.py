"""Line dedup over range-partitioned line hashes, returning keep bitmaps instead of text.

A line's key is the line with all of U+0020 and U+0009 to U+000D stripped at both ends and A-Z
lower-cased. Keys of at least ``min_chars`` code points found in at least ``min_docs`` documents lose
all their lines except those in the largest doc_id that holds the key.

Documents are hashed in Arrow batches; a batch sends one row for each distinct key, its occurrences
packed, so a line found in a third of all documents arrives as one row a batch. Rows go to ranges of
the 128-bit hash, are sorted there by hash and descending document, and are read as a stream: the
first row of a key names the document that keeps it, and at most the rows before the
``min_docs``-th document are held back. Dropped places are gathered for each document into a
compressed bitmap (zlib, bit i of byte i // 8 set: line i stays, lines past the end stay).

Defined cases: a null or empty text is one empty line; a null doc_id counts as a document smaller than
any other; rows that share a doc_id count as one document, and each text among them has a bitmap of
its own (``text_tag``); rows that repeat share it; a table without repeated lines gives no bitmap;
further columns are ignored by ``keep_bitmaps`` and ``digests`` and kept by ``drop_lines``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, text_or_empty

SPACES = b" \t\n\x0b\x0c\r"
NO_ID = -(1 << 63)
#: An occurrence of a key: document, tag of its text, line number.
PLACE = np.dtype([("doc", "<i8"), ("tag", "<i8"), ("line", "<i4")])
KEYS = "range int, hi long, lo long, n_docs int, doc long, places binary"


def keyed(df: DataFrame, tag: str = "text_tag", id_: str = "id_key") -> DataFrame:
    """Adds the tag of the text and the doc_id with nulls replaced: together they name a text."""
    return df.withColumns({tag: F.xxhash64(text_or_empty("text")), id_: F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))})


def _code_points(key: bytes) -> int:
    return len(key) if key.isascii() else len(key.decode("utf-8", "replace"))


def _batch_keys(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            found: dict[bytes, list[tuple[int, int, int]]] = {}
            for doc, tag, text in zip(ids.tolist(), tags.tolist(), texts):
                for i, line in enumerate(text.as_py().split(b"\n")):
                    if len(line) >= min_chars and len(key := line.strip(SPACES).lower()) >= min_chars and _code_points(key) >= min_chars:
                        found.setdefault(xxhash.xxh3_128_digest(key), []).append((doc, tag, i))
            if not found:
                continue
            places, tops, counts = [], [], []
            for at in found.values():
                if len(at) == 1:
                    places.append(struct.pack("<qqi", *at[0]))
                    tops.append(at[0][0])
                    counts.append(1)
                else:
                    docs = {x[0] for x in at}
                    places.append(np.array(at, PLACE).tobytes())
                    tops.append(max(docs))
                    counts.append(len(docs))
            both = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            hi, lo = np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])
            yield pa.record_batch([
                pa.array((hi >> 48).astype("i4")), pa.array(hi), pa.array(lo), pa.array(counts, pa.int32()), pa.array(tops, pa.int64()), pa.array(places, pa.binary()),
            ], ["range", "hi", "lo", "n_docs", "doc", "places"])

    return run


class _Key:
    """The rows of one key as they arrive, largest document first."""

    def __init__(self, key: tuple[int, int], keeper: int, min_docs: int):
        self.key, self.keeper, self.min_docs = key, keeper, min_docs
        self.docs: set[int] | None = set()
        self.held: list[bytes] = []

    def add(self, places: bytes) -> list[np.ndarray]:
        """The places that are known to go by now."""
        if self.docs is not None:
            self.held.append(places)
            self.docs.update(np.frombuffer(places, PLACE)["doc"].tolist())
            if len(self.docs) < self.min_docs:
                return []
            self.docs, places, self.held = None, b"".join(self.held), []
        at = np.frombuffer(places, PLACE)
        return [at[at["doc"] != self.keeper]]


def _stream_drops(min_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Key | None = None
        for batch in batches:
            hi, lo, docs = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n_docs, places = batch.column(3).to_numpy(zero_copy_only=False), batch.column(4)
            # Rows with a neighbour of the same key, or with enough documents alone; the last may go on in the next batch.
            same = (hi[1:] == hi[:-1]) & (lo[1:] == lo[:-1])
            look = n_docs >= min_docs
            look[1:] |= same
            look[:-1] |= same
            if len(look):
                look[0] = look[-1] = True
            out: list[np.ndarray] = []
            for i in np.flatnonzero(look).tolist():
                key = (hi[i], lo[i])
                if now is None or now.key != key:
                    now = _Key(key, docs[i], min_docs)
                out += now.add(places[i].as_py())
            if out and len(all_ := np.concatenate(out)):
                yield pa.record_batch([pa.array(np.ascontiguousarray(all_[c])) for c in ("doc", "tag", "line")], ["id_key", "text_tag", "line"])

    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for lines in batch.column(2):
            at = np.asarray(lines.values)
            bits = np.ones(-(-(int(at.max()) + 1) // 8) * 8, np.uint8)
            bits[at] = 0
            maps.append(zlib.compress(np.packbits(bits, bitorder="little").tobytes()))
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], ["id_key", "text_tag", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """id_key, text_tag and the compressed ``keep`` bitmap of each text that loses a line."""
    texts = keyed(docs.select("doc_id", "text")).select("id_key", "text_tag", F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    rows = texts.mapInArrow(_batch_keys(min_chars), KEYS)
    rows = rows.repartition("range").sortWithinPartitions("hi", "lo", F.desc("doc")).select("hi", "lo", "doc", "n_docs", "places")
    drops = rows.mapInArrow(_stream_drops(min_docs), "id_key long, text_tag long, line int")
    lines = drops.groupBy("id_key", "text_tag").agg(F.collect_list("line").alias("lines"))
    return lines.mapInArrow(_bitmaps, "id_key long, text_tag long, keep binary")


def kept_lines(text: bytes, keep: bytes | None) -> tuple[int, list[bytes]]:
    """The number of lines of a text, and those that its bitmap keeps."""
    lines = text.split(b"\n")
    if keep is None:
        return len(lines), lines
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)].tolist()
    return len(lines), [x for x, stays in zip(lines, bits) if stays] + lines[len(bits) :]


def _with_bitmap(docs: DataFrame, bitmaps: DataFrame, n: dict[str, str]) -> DataFrame:
    marked = keyed(docs, n["tag"], n["id"])
    maps = bitmaps.select(F.col("id_key").alias(n["id"]), F.col("text_tag").alias(n["tag"]), F.col("keep").alias(n["keep"]))
    return marked.join(maps, [n["id"], n["tag"]], "left")


def _names(taken: list[str]) -> dict[str, str]:
    return {k: fresh_name(taken, f"_line_{k}") for k in ("tag", "id", "keep", "text")}


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, digests = [], [], []
        for text, keep in zip(batch.column(1), batch.column(2)):
            n, kept = kept_lines(raw := text.as_py(), keep.as_py())
            total.append(n)
            gone.append(n - len(kept))
            digests.append(sha256(b"\n".join(kept) if n > len(kept) else raw).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text of every row."""
    n = _names(["doc_id", "text"])
    df = _with_bitmap(docs.select(F.col("doc_id").cast("long"), "text"), bitmaps, n)
    return df.select("doc_id", F.encode(text_or_empty("text"), "UTF-8"), n["keep"]).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def drop_lines(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with the lines gone that the bitmaps drop; texts without a bitmap stay as they are."""
    n = _names(docs.columns)
    df = _with_bitmap(docs, bitmaps, n).drop(n["tag"], n["id"])
    places, columns_out, keep = {c: i for i, c in enumerate(df.columns)}, docs.columns, n["keep"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keeps = batch.column(places["text"]), batch.column(places[keep])
            new = [t.as_py() if not k.is_valid else b"\n".join(kept_lines(t.as_py().encode(), k.as_py())[1]).decode() for t, k in zip(texts, keeps)]
            columns = [pa.array(new, pa.string()) if c == "text" else batch.column(places[c]) for c in columns_out]
            yield pa.record_batch(columns, columns_out)

    out = df.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
