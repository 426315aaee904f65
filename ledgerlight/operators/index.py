"""A stored inverted index over fields of rows, kept current by segments, and top-k search that skips blocks.

A segment is written once and without a shuffle: each task turns its rows into postings, sorts them by term, and writes blocks, one for each term,
field and range, with the keys, counts and lengths of the rows that hold the term, and the greatest count and least length among
them. A range holds the rows of one task and of like length, so these bounds are close and all words of a row have their blocks in one range. Files are
sorted by term, so a search reads the row groups of its words in each; a frequent word is spread over all of them. A second, small
table has the rows of a segment with their number of words.

A sync adds a segment with the changed rows and the set of keys that earlier segments have lost by it; those aren't rewritten, and of
them only the table of rows is read. Reading takes away what later segments have replaced; compaction makes one segment of
several. The record of what holds (version of the data, segments, totals) is written last, so a reader never sees half a sync. A search
uses the index only at the version that it was brought to; at any other one it counts terms in the rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import any_of, tokens
from ..sources.store import new_path
from .search import B, K1, query_terms

#: Ranges of a task: one for each doubling of the rows' length, of this many at most.
BANDS = 64
#: Ranges that are scored first, for a score to beat; room for rounding in the comparison with it.
FIRST, SLACK = 4, 1e-9
#: The term that every row holds, as often as it has words.
EVERY = ""
RECORD = "number long, version long, key string, key_type string, fields array<string>, segments array<string>, n_rows long, n_words long"

Words = Callable[[Column], Column]


@dataclass(frozen=True)
class Index:
    """An index as its last record has it; ``words`` turns a text into its terms."""

    spark: SparkSession
    path: str
    key: str
    key_type: str
    fields: tuple[str, ...]
    version: int
    number: int
    segments: tuple[str, ...]
    n_rows: int
    n_words: int
    words: Words = tokens

    def blocks(self, which: tuple[str, ...] | None = None) -> DataFrame:
        """All blocks of words, with their segment's place."""
        schema = f"term string, field int, `range` long, n int, max_tf int, min_length int, `keys` array<{self.key_type}>, tfs array<int>, lengths array<int>"
        return self._tables("blocks", schema, which)

    def rows_of(self, which: tuple[str, ...] | None = None) -> DataFrame:
        """(key, place, length): the rows of segments with their number of words."""
        return self._tables("rows", f"key {self.key_type}, length int", which)

    def _tables(self, name: str, schema: str, which: tuple[str, ...] | None) -> DataFrame:
        found = [self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{name}").withColumn("place", F.lit(self.segments.index(s))) for s in which or self.segments]
        return reduce(DataFrame.unionByName, found)

    def lost(self) -> DataFrame | None:
        """Keys that segments before a place have lost, with that place."""
        found = [self.spark.read.parquet(f"{self.path}/{s}/lost").withColumn("until", F.lit(i)) for i, s in enumerate(self.segments) if i]
        return reduce(DataFrame.unionByName, found).groupBy("key").agg(F.max("until").alias("until")) if found else None

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (key, place) that no later segment has replaced."""
        lost = self.lost()
        if lost is None:
            return rows
        lost = lost.withColumnRenamed("key", "lost_key")
        return rows.join(lost, (F.col("key") == F.col("lost_key")) & (F.col("place") < F.col("until")), "left_anti")


# Building


def _counts(words: Column) -> Column:
    """(term, tf) of an array of words; the array has to be a column of its own, sorted."""
    last = F.transform(words, lambda t, i: F.when(F.get(words, i + 1).isNull() | (F.get(words, i + 1) != t), i))
    ends = F.filter(last, lambda i: i.isNotNull())
    counted = lambda es: F.transform(es, lambda e, i: F.struct(F.get(words, e).alias("term"), (e - F.coalesce(F.get(es, i - 1), F.lit(-1))).cast("int").alias("tf")))
    # An array of one binds the ends to a name, so that they aren't made again for each of them.
    return F.get(F.transform(F.array(ends), counted), F.lit(0))


def postings(rows: DataFrame, key: str, text: str) -> DataFrame:
    """term, key and how often the row holds the term; counted inside the row, so nothing is shuffled."""
    words = rows.select(key, F.array_sort(tokens(F.coalesce(F.col(text), F.lit("")))).alias("w"))
    return words.select(key, F.inline(_counts(F.col("w")))).select("term", key, "tf")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted postings (term, field, range, key, tf, length): a run of equal term, field and range is one block."""
    held: pa.Table | None = None

    def blocks(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        table = table.combine_chunks()
        starts = np.concatenate([[0], ends[:-1]])
        tf, length = (table[c].to_numpy() for c in ("tf", "length"))
        offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, table[c].chunk(0)) for c in ("key", "tf", "length")]
        first = table.take(pa.array(starts))
        return pa.RecordBatch.from_arrays([
            *(first[c].chunk(0) for c in ("term", "field", "range")), pa.array((ends - starts).astype(np.int32)),
            pa.array(np.maximum.reduceat(tf, starts)), pa.array(np.minimum.reduceat(length, starts)), *lists,
        ], ["term", "field", "range", "n", "max_tf", "min_length", "keys", "tfs", "lengths"])

    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if held is None else pa.concat_tables([held, table])
        if not len(table):
            continue
        change = np.zeros(len(table) - 1, bool)
        for c in ("term", "field", "range"):
            codes = table[c].combine_chunks().dictionary_encode().indices if c == "term" else table[c]
            change |= np.diff(codes.to_numpy(zero_copy_only=False) if c == "term" else codes.to_numpy()) != 0
        ends = np.flatnonzero(change) + 1
        if len(ends):
            yield blocks(table.slice(0, int(ends[-1])), ends)
            table = table.slice(int(ends[-1]))
        held = table
    if held is not None and len(held):
        yield blocks(held, np.array([len(held)]))


def _write_segment(path: str, postings: DataFrame, lost: DataFrame) -> None:
    """Blocks, rows and lost keys of a segment; ``postings`` is (term, field, range, key, tf, length), a range in one partition."""
    key_type = postings.schema["key"].dataType.simpleString()
    schema = f"term string, field int, `range` long, n int, max_tf int, min_length int, `keys` array<{key_type}>, tfs array<int>, lengths array<int>"
    postings.sortWithinPartitions("term", "field", "range").mapInArrow(_runs, schema).write.parquet(f"{path}/blocks")
    every = postings.sparkSession.read.schema(schema).parquet(f"{path}/blocks").filter(F.col("term") == EVERY)
    every.select(F.explode(F.arrays_zip("keys", "lengths")).alias("r")).select(F.col("r.keys").alias("key"), F.col("r.lengths").alias("length")).write.parquet(f"{path}/rows")
    lost.select("key").distinct().write.parquet(f"{path}/lost")


def _posted(rows: DataFrame, key: str, fields: tuple[str, ...], words: Words) -> DataFrame:
    """(term, field, range, key, tf, length) of rows, the empty term among them. Counted inside the row."""
    texts = rows.select(F.col(key).alias("key"), *[F.coalesce(F.col(f), F.lit("")).alias(f"field{i}") for i, f in enumerate(fields)])
    split = texts.select("key", *[F.array_sort(words(F.col(f"field{i}"))).alias(f"w{i}") for i in range(len(fields))])
    length = sum((F.size(f"w{i}") for i in range(len(fields))), F.lit(0)).cast("int")
    band = F.spark_partition_id().cast("long") * BANDS + F.floor(F.log2(length + 1))
    every = F.array(F.struct(F.lit(EVERY).alias("term"), length.alias("tf"), F.lit(-1).alias("field")))
    own = [_of_field(f"w{i}", i) for i in range(len(fields))]
    flat = split.select("key", band.alias("range"), length.alias("length"), F.inline(F.concat(every, *own)))
    return flat.select("term", "field", "range", "key", "tf", "length")


def _of_field(column: str, number: int) -> Column:
    return F.transform(_counts(F.col(column)), lambda c: F.struct(c["term"].alias("term"), c["tf"].alias("tf"), F.lit(number).alias("field")))


def _recorded(index: Index) -> Index:
    row = (index.number, index.version, index.key, index.key_type, list(index.fields), list(index.segments), index.n_rows, index.n_words)
    index.spark.createDataFrame([row], RECORD).coalesce(1).write.mode("append").parquet(f"{index.path}/record")
    return index


def _totals(rows: DataFrame) -> tuple[int, int]:
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    return n, words


def _entries(blocks: DataFrame) -> DataFrame:
    return blocks.select("term", "field", "range", "place", F.explode(F.arrays_zip("keys", "tfs", "lengths")).alias("p")).select(
        "term", "field", "range", "place", F.col("p.keys").alias("key"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"))


def build(rows: DataFrame, key: str, fields: tuple[str, ...], version: int, path: str | None = None, words: Words = tokens) -> Index:
    """An index of all rows in one segment. Rows whose fields are all null aren't in it."""
    spark = rows.sparkSession
    path, name = path or new_path(spark, "index"), f"segment-{uuid.uuid4().hex}"
    live = rows.filter(any_of([F.col(f).isNotNull() for f in fields]))
    _write_segment(f"{path}/{name}", _posted(live, key, fields, words), live.limit(0).select(F.col(key).alias("key")))
    index = Index(spark, path, key, rows.schema[key].dataType.simpleString(), tuple(fields), version, 1, (name,), 0, 0, words)
    n, total = _totals(index.rows_of())
    return _recorded(replace(index, n_rows=n, n_words=total))


def sync(index: Index, changed: DataFrame, version: int) -> Index:
    """The index at ``version``, with the changed rows anew; those whose fields are all null are taken out."""
    name = f"segment-{uuid.uuid4().hex}"
    keys = changed.select(F.col(index.key).alias("key")).distinct()
    live = changed.filter(any_of([F.col(f).isNotNull() for f in index.fields]))
    _write_segment(f"{index.path}/{name}", _posted(live, index.key, index.fields, index.words), keys)
    before = index.live(index.rows_of())
    gone, gone_words = _totals(before.join(index.spark.read.parquet(f"{index.path}/{name}/lost"), "key", "left_semi"))
    after = replace(index, version=version, number=index.number + 1, segments=(*index.segments, name))
    new, new_words = _totals(after.rows_of((name,)))
    return _recorded(replace(after, n_rows=index.n_rows - gone + new, n_words=index.n_words - gone_words + new_words))


def compact(index: Index, last: int | None = None) -> Index:
    """The index with its last segments, or all, made one; what earlier segments have lost by them is kept."""
    last = len(index.segments) if last is None else last
    kept, merged = index.segments[: len(index.segments) - last], index.segments[len(index.segments) - last :]
    if len(merged) < 2:
        return index
    name = f"segment-{uuid.uuid4().hex}"
    lost = reduce(DataFrame.unionByName, [index.spark.read.parquet(f"{index.path}/{s}/lost") for s in merged])
    # The ranges stay as they are, each in one partition.
    live = index.live(_entries(index.blocks(merged))).withColumn("range", F.xxhash64("place", "range")).drop("place").repartition("range")
    _write_segment(f"{index.path}/{name}", live, lost if kept else lost.limit(0))
    return _recorded(replace(index, number=index.number + 1, segments=(*kept, name)))


def opened(spark: SparkSession, path: str, words: Words = tokens) -> Index | None:
    """The index as its last record has it; None where there is none."""
    try:
        records = spark.read.schema(RECORD).parquet(f"{path}/record")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    r = records.orderBy(F.desc("number")).first()
    return r and Index(spark, path, r.key, r.key_type, tuple(r.fields), r.version, r.number, tuple(r.segments), r.n_rows, r.n_words, words)


# Searching


@dataclass(frozen=True)
class Scheme:
    """How rows are scored: what a term of the question matches, and the score of (tf of each term, length)."""

    terms: tuple[str, ...]
    prefix: bool

    def matches(self, term: Column, i: int) -> Column:
        return term.startswith(self.terms[i]) if self.prefix else term == self.terms[i]

    def wanted(self) -> Column:
        """Terms of the question; none of them is empty, so none is the empty term."""
        return any_of([self.matches(F.col("term"), i) for i in range(len(self.terms))])

    def tfs(self, tf: Column, over: Callable[[Column], Column] = F.sum) -> list[Column]:
        return [over(F.when(self.matches(F.col("term"), i), tf).otherwise(0)).cast("double").alias(f"tf{i}") for i in range(len(self.terms))]


def _weights(index: Index, scheme: Scheme, wanted: DataFrame) -> list[float]:
    """The weight of each term of the question, from how many live rows hold it; these need the keys alone."""
    if not scheme.prefix:
        return [1.0] * len(scheme.terms)
    keys = index.live(wanted.select("term", "place", F.explode("keys").alias("key")))
    held = keys.groupBy("key").agg(*[F.max(scheme.matches(F.col("term"), i)).alias(f"h{i}") for i in range(len(scheme.terms))])
    n = held.agg(*[F.count_if(f"h{i}").cast("double").alias(f"n{i}") for i in range(len(scheme.terms))])
    rows = float(index.n_rows)
    idf = n.select([F.greatest(F.log((F.lit(rows) - F.col(c) + 0.5) / (F.col(c) + 0.5)), F.lit(1e-6)).alias(c) for c in n.columns])
    return list(idf.first())


def _score(index: Index, scheme: Scheme, weights: list[float], length: Column) -> Column:
    """The score of columns tf0, tf1, ...; it rises with them and falls with the length, so block bounds bound it."""
    if not scheme.prefix:
        return sum((F.col(f"tf{i}") for i in range(len(weights))), F.lit(0.0))
    norm = K1 * (1 - B + B * length / F.lit(index.n_words / max(1, index.n_rows)))
    return sum((F.lit(w) * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + norm) for i, w in enumerate(weights)), F.lit(0.0))


def _scored(index: Index, scheme: Scheme, weights: list[float], blocks: DataFrame, allowed: DataFrame | None) -> DataFrame:
    entries = index.live(_entries(blocks))
    if allowed is not None:
        entries = entries.join(allowed.select("key").distinct(), "key", "left_semi")
    summed = entries.groupBy("key").agg(*scheme.tfs(F.col("tf")), F.max("length").cast("double").alias("length"))
    return summed.select("key", _score(index, scheme, weights, F.col("length")).alias("score"))


@dataclass(frozen=True)
class Found:
    """The rows found (key, score), unordered and at least the ``k`` best, and how many blocks of the words there are and were scored."""

    rows: DataFrame
    blocks: DataFrame


def scan(index: Index, question: str, k: int, prefix: bool = True, allowed: DataFrame | None = None) -> Found | None:
    """Exact search that skips ranges that can't reach the k-th score of the best-looking ones; None for a question without words."""
    terms = tuple(query_terms(question))
    if not prefix:
        terms = tuple(sorted(set(terms)))
    if not terms:
        return None
    scheme = Scheme(terms, prefix)
    wanted = index.blocks().filter(scheme.wanted())
    weights = _weights(index, scheme, wanted)
    bounds = wanted.groupBy("place", "range").agg(*scheme.tfs(F.col("max_tf")), F.min("min_length").cast("double").alias("length"), F.count("*").alias("n_blocks"))
    bounds = bounds.select("place", "range", "n_blocks", _score(index, scheme, weights, F.col("length")).alias("most"))
    first = bounds.orderBy(F.desc("most"), "place", "range").limit(FIRST).select("place", "range")
    best = _scored(index, scheme, weights, wanted.join(F.broadcast(first), ["place", "range"], "left_semi"), allowed).orderBy(F.desc("score")).limit(k)  # FIRST rows
    n, least = best.agg(F.count("*"), F.min("score")).first()
    # A later segment's row may stand in another range than an earlier one's; each live row is in one range, whose bound holds for it.
    beat = least * (1 - SLACK) if n == k else 0.0
    kept = bounds.withColumn("kept", F.col("most") >= beat)
    rows = _scored(index, scheme, weights, wanted.join(kept.filter("kept"), ["place", "range"], "left_semi"), allowed)
    return Found(rows, kept.agg(F.coalesce(F.sum("n_blocks"), F.lit(0)).alias("n_blocks"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("n_blocks"))), F.lit(0)).alias("n_scored")))


def top(rows: DataFrame, key: str, fields: tuple[str, ...], question: str, k: int, index: Index | None, version: int, allowed: DataFrame | None = None, ties: tuple[Column, ...] = ()) -> DataFrame:
    """key, score and backend of the k best rows: BM25 over the index where it is of this version, else counts of terms in ``rows``.

    The index is never built or brought up to date here. Equal scores go by ``ties`` over the key, or by the key.
    """
    if index is not None and index.version == version:
        found = scan(index, question, k, allowed=allowed)
        scored = None if found is None else found.rows.select(F.col("key").alias(key), "score", F.lit("postings").alias("backend"))
    else:
        held = rows if allowed is None else rows.join(allowed.select(F.col("key").alias(key)).distinct(), key, "left_semi")
        terms = sorted(set(query_terms(question)))
        words = F.concat(*[tokens(F.coalesce(F.col(f), F.lit(""))) for f in fields])
        scored = held.select(key, F.size(F.filter(words, lambda t: t.isin(*terms))).cast("double").alias("score"), F.lit("term-count").alias("backend")).filter("score > 0") if terms else None
    if scored is None:
        return rows.select(key, F.lit(0.0).alias("score"), F.lit("postings").alias("backend")).limit(0)
    return scored.orderBy(F.desc("score"), *(ties or (F.col(key),))).limit(k)
