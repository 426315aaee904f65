"""Neighbours over learned partitions: exact ranks of what is found, recall against brute force, odd rows."""

import math

import numpy as np
import pytest

from ledgerlight.llm import neighbours, queries

SCHEMA = "vec_id long, embedding array<double>, label int, part string, kind int, v string, class string"


def brute(rows, k, every):
    """query_id: its ranked (vec_id, score) of all rows that take part."""
    by_id = {}
    for vec_id, v in rows:
        if vec_id is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        by_id[vec_id] = min(by_id.get(vec_id, tuple(v)), tuple(v))
    out = {}
    for q, a in by_id.items():
        if q % every == 0:
            scored = [(c, math.fsum(x * y for x, y in zip(a, b))) for c, b in by_id.items() if c != q]
            out[q] = sorted(scored, key=lambda r: (-r[1], r[0]))[:k]
    return out


def found(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, "a", 1, "b", "c") for i, v in rows], SCHEMA).repartition(3)
    out = {}
    for r in sorted(neighbours.nearest(df, **options).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({v for v, _ in got.get(q, [])} & {v for v, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def sound(got, rows):
    """Every result has its exact score and is in order."""
    vectors = dict(rows)
    for q, ranked in got.items():
        for v, score in ranked:
            assert v != q and score == math.fsum(x * y for x, y in zip(vectors[q], vectors[v]))
        assert ranked == sorted(ranked, key=lambda r: (-r[1], r[0]))


def clustered(rng, count, dim=16, centres=12, hot=0.35):
    middle = rng.normal(size=(centres, dim))
    which = np.where(rng.random(count) < hot, 0, rng.integers(0, centres, count))
    x = middle[which] + 0.3 * rng.normal(size=(count, dim))
    return [(i, [float(v) for v in x[i]]) for i in range(count)]


@pytest.mark.parametrize("part_rows", [4096, 60])
def test_recall_with_lengths_that_differ(spark, part_rows):
    """One level of parts, and parts that are partitioned again; a third of the rows lie about one centre."""
    rows = clustered(np.random.default_rng(4), 1500)
    want = brute(rows, 10, 15)
    got = found(spark, rows, k=10, every=15, part_rows=part_rows, parts=8, sample=400)
    sound(got, rows)
    assert set(got) == set(want) and recall(got, want) >= 0.9


def test_odd_rows(spark):
    """Few rows are all visited, so the results are exact: nulls, copies, ties, a zero vector, short vectors."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 4)]) for i in range(40)]
    rows += [(100 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(30)] + [(200 + i, [1.0, 2.0, 0.0, 1.0]) for i in range(3)]
    rows += [(300, None), (None, [1.0]), (301, [None, 1.0]), (302, [float("nan")]), (303, [float("inf"), 1.0]), (304, [0.0, 0.0]), (305, []), (310, [5.0]), (320, [1.0, 2.0])]
    rows += [rows[3], rows[3], (5, [9.0, 9.0, 9.0, 9.0]), (5, [-9.0, 0.0, 0.0, 0.0])]
    assert found(spark, rows, k=20, every=10) == brute(rows, 20, 10)


def test_fewer_candidates_and_empty(spark):
    assert found(spark, [(0, [1.0, 0.0]), (7, [0.5, 0.5])], k=20) == {0: [(7, 0.5)]}
    assert found(spark, [(0, [1.0, 0.0])], k=20) == {}
    assert found(spark, []) == {} and found(spark, [(1, [1.0])]) == {}


def test_chunks_of_a_part(spark, monkeypatch):
    """A part dealt to several tasks gives what one task gives."""
    rows = clustered(np.random.default_rng(6), 400)
    whole = found(spark, rows, k=5, every=20, parts=4)
    monkeypatch.setattr(neighbours, "CHUNK", 13)
    assert found(spark, rows, k=5, every=20, parts=4) == whole


def test_parts_are_balanced():
    """A third of the rows about one centre doesn't make a part larger than its share and the slack."""
    x = np.array([v for _, v in clustered(np.random.default_rng(8), 1000)])
    longest = float(np.sqrt((x * x).sum(axis=1)).max())
    candidates, asked = neighbours.candidates_of(x, longest), neighbours.queries_of(x)
    graph = neighbours.neighbour_graph(asked, candidates, 8)
    label = neighbours.balanced_parts(candidates, graph, 8)
    assert np.bincount(label, minlength=8).max() <= math.ceil(1000 / 8 * (1 + neighbours.SLACK))
    cut = (label[graph] != label[:, None]).mean()
    shuffled = np.random.default_rng(1).permutation(label)
    assert cut < 0.6 * (shuffled[graph] != shuffled[:, None]).mean()
    again = neighbours.Router.from_bytes(neighbours.fitted(x, longest, 8).to_bytes())
    assert 0 < again.share <= 1 and again.probabilities(asked).sum(axis=1) == pytest.approx(1)


def test_recall_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.1"
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = {}
    for r in sorted(queries.op13_neighbours(spark, sf_dir).collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    sound(got, rows)
    assert all(len(x) == 20 for x in got.values()) and recall(got, brute(rows, 20, 20)) >= 0.9
