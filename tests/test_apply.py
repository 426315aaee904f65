"""Proposals against a walk through them one by one, and the table of states."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ledgerlight.operators import apply as A

RUN = "run_id long, status string, state_version long, result_version long"
INPUT = "run_id long, revision long, digest string"
PROPOSAL = "run_id long, number long, entity string, text string, supersedes long, contradicts array<long>"
QUOTE = "run_id long, number long, revision long, start int, end int, quote string"
REVISION = "revision long, digest string, is_current boolean, text string"
CLAIM = "claim long, entity string, digest string, status string, is_current boolean"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_transitions(spark):
    pairs = [(a, b) for a in A.FOLLOWING for b in A.FOLLOWING]
    got = {(r.a, r.b) for r in spark.createDataFrame(pairs, "a string, b string").filter(A.may_follow(F.col("a"), F.col("b"))).collect()}
    assert got == {(a, b) for a, after in A.FOLLOWING.items() for b in after} and len(got) == 14


def walk(runs, inputs, proposals, quotes, revisions, claims, deps, state):
    """Each run on its own: (outcome, reason, proposal, created, reused), and what accepted runs make."""
    rev = {r[0]: r for r in revisions}
    claim = {c[0]: c for c in claims}
    deps_of = {}
    for c, r in deps:
        deps_of.setdefault(c, set()).add(r)
    out, superseded = {}, set()
    for run, status, version, result in runs:
        def refuse(reason, at=None):
            out[run] = ("refused", reason, at, 0, 0)

        mine = sorted(p for p in proposals if p[0] == run)
        asked = {r: d for i, r, d in inputs if i == run}
        if status not in A.OPEN_RUNS:
            refuse("run closed")
        elif version != state or result != version:
            refuse("stale state")
        elif any(r not in rev or not rev[r][2] or rev[r][1] != d for r, d in asked.items()):
            refuse("stale input")
        else:
            made, reused, ended, bad = [], 0, set(), None
            for _, number, entity, text, prior, against in mine:
                own = [q for q in quotes if q[:2] == (run, number)]
                text, entity = (text or "").strip(), (entity or "").strip()
                wrong = lambda q: q[2] not in rev or not 0 <= q[3] < q[4] <= len(rev[q[2]][3]) or rev[q[2]][3][q[3] : q[4]] != q[5]
                tests = [("entity", not entity), ("text", not 1 <= len(text) <= 4000), ("revision not in request", any(q[2] not in asked for q in own)), ("quote", any(wrong(q) for q in own if q[2] in asked))]
                bad = next((name for name, fails in tests if fails), None)
                if bad:
                    break
                key = (entity, sha(text), frozenset(q[2] for q in own))
                if own and (key in made or any(c[4] and (c[1], c[2], frozenset(deps_of.get(c[0], ()))) == key for c in claims)):
                    reused += 1
                    continue
                if prior is not None:
                    c = claim.get(prior)
                    if not c or not c[4] or c[1] != entity or "superseded" not in A.FOLLOWING[c[3]] or prior in ended:
                        bad = "supersession"
                        break
                    ended.add(prior)
                if any(t not in claim for t in against):
                    bad = "contradiction target"
                    break
                made.append(key)
            if bad:
                refuse(bad, number)
            else:
                out[run] = ("applied", None, None, len(made), reused)
                superseded |= ended
    return out, superseded


@pytest.mark.parametrize("seed", [1, 2])
def test_apply_equals_walk(spark, seed):
    rng = random.Random(seed)
    texts = {i: f"text {i} says stone and sand {i % 3}" for i in range(12)}
    revisions = [(i, sha(t), i != 11, t) for i, t in texts.items()]
    claims = [(100 + i, f"e{i % 3}", sha(f"claim {i % 4}"), list(A.FOLLOWING)[i % 6], i % 5 != 0) for i in range(14)]
    deps = [(c[0], r) for c in claims for r in rng.sample(range(4), rng.randint(1, 2))]
    runs, inputs, proposals, quotes = [], [], [], []
    for run in range(60):
        runs.append((run, rng.choices(["exported", "running", "completed"], [8, 4, 1])[0], rng.choices([7, 6], [15, 1])[0], 7))
        mine = rng.sample(range(4), 2) + ([11] if rng.random() < 0.05 else [])
        inputs += [(run, r, sha(texts[r]) if rng.random() < 0.97 else "old") for r in mine]
        for number in range(rng.randint(0, 4)):
            text = rng.choices([f"claim {rng.randrange(4)}", f" new {rng.randrange(3)} ", "", None, "x" * 4001], [10, 10, 0.3, 0.3, 0.3])[0]
            proposals.append((run, number, rng.choices(["e0", "e1", "e2", " "], [8, 8, 8, 0.3])[0], text, rng.choices([None, rng.choice(claims)[0], 999], [10, 2, 0.3])[0], rng.choices([[], [101], [101, 998]], [10, 2, 0.3])[0]))
            for r in rng.choices([mine[:1], mine[:2], [], [9]], [8, 5, 1, 0.3])[0]:
                a, b = sorted(rng.sample(range(len(texts[r])), 2))
                quotes.append((run, number, r, a, b, texts[r][a:b] + ("?" if rng.random() < 0.08 else "")))
        if proposals and proposals[-1][0] == run and rng.random() < 0.4:  # the last proposal again
            last = proposals[-1]
            proposals.append((run, 9, *last[2:]))
            quotes += [(run, 9, *q[2:]) for q in quotes if q[:2] == last[:2]]
    frames = [spark.createDataFrame(rows, s).repartition(2) for rows, s in ((runs, RUN), (inputs, INPUT), (proposals, PROPOSAL), (quotes, QUOTE), (revisions, REVISION), (claims, CLAIM), (deps, "claim long, revision long"))]
    found = A.apply(*frames, 7)
    got = {r.run_id: (r.outcome, r.reason, r.at_proposal, r.n_created, r.n_reused) for r in found.outcomes.collect()}
    want, superseded = walk(runs, inputs, proposals, quotes, revisions, claims, deps, 7)
    assert got == want
    assert {o[1] for o in want.values()} >= {None, "run closed", "quote", "supersession"} and sum(o[4] for o in want.values()) > 3
    created = found.created.collect()
    assert len(created) == sum(o[3] for o in want.values()) and len({r.claim for r in created}) == len(created)
    assert {r.claim for r in found.superseded.collect()} == superseded
    against = {(p[0], p[1]) for p in proposals if p[5]}
    assert all((r.status == "disputed") == ((r.run_id, r.number) in against) for r in created)
    assert all(r.left_claim < r.right_claim and r.disputed in (r.left_claim, r.right_claim) for r in found.contradictions.collect())
    assert found.reused.count() == sum(o[4] for o in want.values())


def test_equal_signatures_are_compared_as_sets(spark):
    """Pairs whose counts and sums agree by accident aren't taken for equal."""
    left = spark.createDataFrame([(1, 10), (1, 20), (2, 10), (2, 30)], "l long, m long")
    right = spark.createDataFrame([(5, 10), (5, 20)], "r long, m long")
    pairs = spark.createDataFrame([(1, 5, 2), (2, 5, 2)], "l long, r long, set_size long")
    assert [(p.l, p.r) for p in A.same_sets(pairs, left, right, ["l"], ["r"], "m").collect()] == [(1, 5)]
    sizes = {r.l: (r.set_size, r.set_sum) for r in A.signed(left.union(left), ["l"], "m").collect()}
    assert sizes[1][0] == sizes[2][0] == 2 and sizes[1][1] != sizes[2][1]


def test_apply_of_nothing(spark):
    frames = [spark.createDataFrame([], s) for s in (RUN, INPUT, PROPOSAL, QUOTE, REVISION, CLAIM, "claim long, revision long")]
    found = A.apply(*frames, 7)
    assert all(df.count() == 0 for df in (found.outcomes, found.created, found.reused, found.superseded, found.contradictions))


def test_long_claims_stay_too_long(spark, tmp_path):
    """Claims at the limit, and longer ones with a space just beyond it, against the query's SQL."""
    import duckdb

    from ledgerlight import catalog

    cut = "ab " * 1333 + "a"  # 4000 characters; one more is a space
    texts = {426: "short", 637: cut + " and on", 848: cut, 1059: cut + "b", 1060: cut + " and on", 1066: cut, 1069: cut + "  "}
    tables = {
        "documents": spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long"),
        "benchmark": spark.createDataFrame([(1, "a claim that no document holds")], "item_id long, text string"),
        "labels": spark.createDataFrame([(426, 1, 0)], "doc_id long, quality int, toxic int"),
    }
    con = duckdb.connect()
    for name, df in tables.items():
        df.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    df = catalog.QUERIES["applied_runs"](spark, str(tmp_path))
    got = {r[0]: tuple(r) for r in df.collect()}
    assert got == {r[0]: r for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({catalog.ORACLES['applied_runs']})").fetchall()}
    assert got[637 // 3][1:4] == ("refused", "text", 637 * 2) and got[1066 // 3][1] == "applied"
