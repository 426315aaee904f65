"""The fold of job events, at once and as a stream, against a walk through them."""

import random

import pytest

from ledgerlight.operators import jobs

EVENT = "at long, kind string, key string, event string, status string, n_events int"


def walk(events):
    found = {}
    for at, kind, key, event, *_ in sorted(e for e in events if e[1] in jobs.KINDS):
        j = found.setdefault((kind, key), dict(status=None, created_at=None, updated_at=None, n_events=0, n_repeats=0, n_refused=0))
        j["n_events"] += 1
        asks = {"create": "queued", "cancel": "cancelled"}.get(event, event)
        if j["status"] is None and event == "create":
            j.update(status="queued", created_at=at, updated_at=at)
        elif j["status"] is None:
            j["n_refused"] += 1
        elif event == "create" or j["status"] in jobs.ENDED and asks == j["status"]:
            j["n_repeats"] += 1
        elif j["status"] in jobs.ENDED or asks not in jobs.STATES or event == "cancel" and j["status"] == "running":
            j["n_refused"] += 1
        else:
            j.update(status=asks, updated_at=at)
    return sorted((k[0], k[1], *j.values()) for k, j in found.items() if j["status"])


def made(rng, count, keys=25):
    kinds, names = [*jobs.KINDS[:2], "unknown"], ["create", "queued", "running", "completed", "failed", "cancelled", "cancel", "odd", None]
    pick = lambda: (rng.choices(kinds, [5, 5, 1])[0], f"k{0 if rng.random() < 0.35 else rng.randrange(keys)}", rng.choices(names, [4, 3, 4, 1, 0.5, 0.3, 2, 0.5, 0.3])[0])
    return [(at, *pick(), "x", 1) for at in range(count)]


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_walk(spark, seed):
    """A third of the events are those of one key."""
    events = made(random.Random(seed), 400)
    assert rows_of(jobs.folded(spark.createDataFrame(events, EVENT).repartition(3))) == walk(events)


def test_fold_of_nothing(spark):
    assert rows_of(jobs.folded(spark.createDataFrame([], EVENT))) == []


def test_stream_equals_walk(spark, tmp_path):
    events = made(random.Random(9), 240, keys=12)
    for i in range(3):  # three files, in order, each a batch
        spark.createDataFrame(events[i * 80 : (i + 1) * 80], EVENT).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={i}"))
    source = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    assert rows_of(jobs.streamed(source)) == walk(events)
