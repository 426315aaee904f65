"""The stored index against scans: builds, syncs, compaction, freshness, skipped blocks, hooks and answers."""

import math
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import hooks, index, retrieve
from ledgerlight.operators.stems import stem

SCHEMA = "id long, head string, body string, score double, key string, term string, place int"
WORDS = ["sand", "sander", "stone", "stand", "river", "rose", "ß", "straße", "é", "x1", "tide"]


def words_of(row):
    return [w for t in row[1:3] for w in re.findall(r"[^\W]+", (t or "").casefold())]


def bm25(rows, question):
    """Scores of all rows by the published formula, over both fields."""
    live = {r[0]: words_of(r) for r in rows if r[1] is not None or r[2] is not None}
    mean = sum(map(len, live.values())) / max(1, len(live))
    out = {}
    for p in re.findall(r"\w+", question.casefold()):
        n = sum(any(w.startswith(p) for w in ws) for ws in live.values())
        idf = max(math.log((len(live) - n + 0.5) / (n + 0.5)), 1e-6)
        for key, ws in live.items():
            tf = sum(w.startswith(p) for w in ws)
            if tf:
                out[key] = out.get(key, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(ws) / mean))
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def made(rng, ids):
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    return [(i, text(rng.randint(0, 2)), text(rng.choice([1, 3, 9, 30, 200])), 0.0, "k", "t", 1) for i in ids]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def searched(spark, rows, built, question, k, version=1):
    return [(r.id, r.score, r.backend) for r in index.top(frame(spark, rows), "id", ("head", "body"), question, k, built, version).collect()]


def same(got, want, backend="postings"):
    assert [(i, b) for i, _, b in got] == [(i, backend) for i, _ in want] and [s for _, s, _ in got] == pytest.approx([s for _, s in want])


def files_of(path):
    return {(d, f): os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(path) for f in names}


ODD = [(900, None, "Straße sand", 0.0, None, None, None), (901, "STAND", None, 0.0, None, None, None), (902, "", "", 0.0, None, None, None), (903, None, None, 0.0, None, None, None), (904, "sand " * 3000, "\U0001f600", 0.0, None, None, None)]


def test_syncs_equal_a_whole_build(spark):
    rng = random.Random(1)
    first = made(rng, range(60)) + ODD
    built = index.build(frame(spark, first), "id", ("head", "body"), version=1)
    same(searched(spark, first, built, "sand st", 12), bm25(first, "sand st")[:12])

    before = files_of(f"{built.path}/{built.segments[0]}")
    changed = made(rng, range(50, 75)) + [(i, None, None, 0.0, None, None, None) for i in (3, 4, 901, 5000)]
    now = {r[0]: r for r in first} | {r[0]: r for r in changed}
    synced = index.sync(built, frame(spark, changed), version=2)
    again = made(rng, (60, 3)) + [(61, None, None, 0.0, None, None, None)]
    now |= {r[0]: r for r in again}
    synced = index.sync(synced, frame(spark, again), version=3)
    assert files_of(f"{built.path}/{built.segments[0]}") == before  # what was written stays as it was

    rows = list(now.values())
    whole = index.build(frame(spark, rows), "id", ("head", "body"), version=3)
    assert (synced.n_rows, synced.n_words) == (whole.n_rows, whole.n_words)
    for question in ("sand st", "ro", "nothing", "strasse é", "x1 x1"):
        want = bm25(rows, question)
        same(searched(spark, rows, synced, question, 15, 3), want[:15])
        same(searched(spark, rows, whole, question, 15, 3), want[:15])
    tail = index.compact(synced, last=2)
    one = index.compact(tail)
    assert (len(tail.segments), len(one.segments)) == (2, 1) and tail.segments[0] == built.segments[0]
    same(searched(spark, rows, tail, "sand st", 15, 3), bm25(rows, "sand st")[:15])
    same(searched(spark, rows, one, "sand st", 15, 3), bm25(rows, "sand st")[:15])
    assert index.opened(spark, built.path).segments == one.segments


def test_sync_reads_no_words_of_earlier_segments(spark):
    """A sync asks earlier segments for their rows alone: the files of their words may be away meanwhile."""
    rows = made(random.Random(2), range(300))
    built = index.build(frame(spark, rows), "id", ("head", "body"), version=1)
    words = f"{built.path.removeprefix('file:')}/{built.segments[0]}/blocks"
    os.rename(words, built.path.removeprefix("file:") + "-words")
    synced = index.sync(built, frame(spark, [(0, None, None, 0.0, None, None, None)]), version=2)
    os.rename(built.path.removeprefix("file:") + "-words", words)
    same(searched(spark, rows[1:], synced, "sand", 10, 2), bm25(rows[1:], "sand")[:10])


def test_stale_or_missing_index_counts_terms(spark):
    rows = made(random.Random(3), range(30)) + ODD
    built = index.build(frame(spark, rows), "id", ("head", "body"), version=1)
    count = {r[0]: sum(words_of(r).count(w) for w in ("sand", "rose")) for r in rows}
    want = sorted(((i, float(n)) for i, n in count.items() if n), key=lambda x: (-x[1], x[0]))[:7]
    before = files_of(built.path)
    for held in (built, None, index.opened(spark, built.path + "-none")):
        same(searched(spark, rows, held, "Sand rose sand", 7, 2), want, "term-count")
    assert files_of(built.path) == before
    same(searched(spark, rows, built, "...", 7), []), same(searched(spark, rows, None, "...", 7), [])


def test_blocks_are_skipped(spark):
    """Ranges of few rows: the best are found without all of the blocks, by BM25 and by counts."""
    rows = made(random.Random(4), range(400))
    built = index.build(frame(spark, rows).repartition(20), "id", ("head", "body"), version=1)
    same(searched(spark, rows, built, "sander ro", 5), bm25(rows, "sander ro")[:5])
    found = index.scan(built, "sander ro", 5)
    n = found.blocks.first()
    assert 0 < n.n_scored < n.n_blocks
    counted = index.scan(built, "tide", 5, prefix=False)
    got = sorted(((r.key, r.score) for r in counted.rows.collect()), key=lambda x: (-x[1], x[0]))[:5]
    assert got == sorted(((r[0], float(words_of(r).count("tide"))) for r in rows), key=lambda x: (-x[1], x[0]))[:5]
    n = counted.blocks.first()
    assert 0 < n.n_scored < n.n_blocks / 2
    allowed = frame(spark, rows).filter("id % 7 = 0").select(F.col("id").alias("key"))
    some = index.top(frame(spark, rows), "id", ("head", "body"), "sander ro", 5, built, 1, allowed)
    assert [r.id for r in some.collect()] == [i for i, _ in bm25(rows, "sander ro") if i % 7 == 0][:5]


def test_stemmed_words(spark):
    """Words of the index and the question's prefixes by stem."""
    from ledgerlight.functions.text import tokens

    @F.udf("array<string>")
    def stems(words):
        return [stem(w) for w in words]

    rows = [(1, "standing stones", "", 0.0, "", "", 0), (2, "stand", "relational", 0.0, "", "", 0), (3, "sand", "", 0.0, "", "", 0)]
    built = index.build(frame(spark, rows), "id", ("head", "body"), version=1, words=lambda x: stems(tokens(x)))
    assert {r.id for r in index.top(frame(spark, rows), "id", ("head", "body"), stem("standing"), 5, built, 1).collect()} == {1, 2}


def test_empty_index(spark):
    built = index.build(frame(spark, []), "id", ("head", "body"), version=1)
    assert (built.n_rows, built.n_words) == (0, 0) and searched(spark, [], built, "sand", 5) == []
    rows = made(random.Random(5), range(5))
    same(searched(spark, rows, index.sync(built, frame(spark, rows), 2), "st", 5, 2), bm25(rows, "st")[:5])


# Hooks and answers

CLAIM = "key long, text string, entity string, status string"


def claims_of(spark):
    rows = [(1, "the stone stands", "river", "reviewed"), (2, "sand and stone", None, "reviewed"), (3, "a rose", "stone", "candidate"), (4, "stone", "sea", "retracted"), (5, "nothing here", "x", "reviewed")]
    quotes = [(1, "the stone stands", "here the stone stands still"), (1, "the stone stands", "no"), (2, "sand and stone", "sand"), (3, "a rose", "a rose")]
    return spark.createDataFrame(rows, CLAIM), spark.createDataFrame(quotes, "key long, claim_text string, quote string")


def scorers():
    """The heuristic as callables; made here so that they travel to the executors by value."""

    def words(text):
        import re

        return set(re.findall(r"\w+", text.casefold()))

    def jaccard(questions, texts):
        return [len(words(q) & words(t)) / len(words(q) | words(t)) for q, t in zip(questions, texts)]

    def contained(claims, quotes):
        return [len(words(c) & words(q)) / len(words(c)) for c, q in zip(claims, quotes)]

    return jaccard, contained


def test_hook_equals_column_form(spark):
    claims, quotes = claims_of(spark)
    jaccard, contained = scorers()
    built = index.build(claims, "key", ("text", "entity"), version=1)
    ask = lambda ranking, **o: [r.asDict() for r in retrieve.search(claims, quotes, "the stone", built, 1, states=("reviewed", "candidate"), ranking=ranking, verify=True, **o).drop("semantic_backend").orderBy("place").collect()]
    column = ask(retrieve.Ranking())
    assert column == ask(retrieve.Ranking(semantic=jaccard, citation=contained)) and [r["key"] for r in column] == [1, 2, 3]
    assert [(r["support"], r["supported"]) for r in column] == [(1.0, True), (0.333333, False), (1.0, True)]
    off = retrieve.search(claims, quotes, "the stone", built, 1, ranking=retrieve.Ranking(semantic="off"), verify=True)
    assert "supported" not in off.columns and {r.method for r in off.collect()} == {"lexical"}


def test_hook_fails_and_budget(spark, tmp_path):
    pool = spark.createDataFrame([(i, f"t{i}") for i in range(10)], "i int, t string")
    log = str(tmp_path / "calls")

    def flaky(texts):
        with open(log, "a") as f:
            f.write("x")
        n = len(open(log).read())
        if n == 1:
            raise RuntimeError("down")
        return [float("nan")] * len(texts) if n == 2 else [float(t[1:]) for t in texts]

    got = {r.i: r.s for r in hooks.scored_by(pool.coalesce(1), flaky, ["t"], "s", batch=4, retries=2, budget=4, wait=0.0).collect()}
    # Two failures, then two batches of four; the budget of four calls is spent before the third.
    assert sum(s is None for s in got.values()) == 2
    assert all(s is None or s == i for i, s in got.items()) and len(open(log).read()) == 4


def test_ask_and_errors(spark):
    claims, quotes = claims_of(spark)
    ask = lambda **o: retrieve.ask(claims, quotes, "the stone", None, 1, **o).first()
    found = ask()
    assert found.answer == "the stone stands [1]" and [(c.number, c.key, c.support) for c in found.citations] == [(1, 1, 1.0)] and not found.insufficient
    assert ask(ranking=retrieve.Ranking(semantic="off")).answer == "the stone stands [1] sand and stone [2]"
    assert ask(states=("superseded",)).reason.startswith("No matching") and ask(ranking=retrieve.Ranking(threshold=1.1)).reason.startswith("Matching claims lacked")
    for bad in ({"question": " "}, {"states": ()}, {"states": ("unknown",)}):
        with pytest.raises(ValueError):
            retrieve.search(claims, quotes, **({"question": "x", "index": None, "version": 1} | bad))
