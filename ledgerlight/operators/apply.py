"""Proposals of claims applied to the record, each run whole or not at all.

Tables: runs (run_id, status, state_version, result_version), inputs (run_id, revision, digest), proposals (run_id, number, entity,
text, supersedes, contradicts), quotes (run_id, number, revision, start, end, quote), revisions (revision, digest, is_current, text),
claims (claim, entity, digest, status, is_current) and dependencies (claim, revision).

Every test of every proposal is made for all runs at once, and the first that fails, by the order of tests and proposals, refuses its run. Quotes
are tested before duplicates, so that a wrong proposal isn't passed over because the same claim exists. Two claims are the same
if entity, text and the set of revisions that they rest on are equal; sets are compared by a count and a sum of hashes, which
doesn't need their order, and only where these agree as sets.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.store import new_path

# The states of a claim and those that may follow each, and the states in which a run takes results.
FOLLOWING = {
    "candidate": ("reviewed", "disputed", "retracted", "stale"),
    "reviewed": ("disputed", "stale", "superseded", "retracted"),
    "disputed": ("reviewed", "stale", "superseded", "retracted"),
    "stale": ("superseded", "retracted"),
    "superseded": (),
    "retracted": (),
}
OPEN_RUNS = ("exported", "running")
LONGEST = 4000
#: What may speak against a proposal, in the order of the tests.
FAULTS = ("run closed", "stale state", "stale input", "entity", "text", "revision not in request", "quote", "supersession", "contradiction target")


def may_follow(before: Column, after: Column) -> Column:
    """Whether a claim may go from one state to another."""
    return reduce(lambda a, b: a | b, [(before == k) & after.isin(*v) for k, v in FOLLOWING.items() if v])


def _stored(df: DataFrame, label: str) -> DataFrame:
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fault(name: str, test: Column) -> Column:
    return F.when(test, F.lit(FAULTS.index(name)))


def signed(rows: DataFrame, key: list[str], member: str, label: str = "set") -> DataFrame:
    """For each key the size and the sum of hashes of its set of members; the set itself isn't gathered."""
    once = rows.select(*key, member).distinct()
    return once.groupBy(*key).agg(F.count("*").alias(f"{label}_size"), F.sum(F.xxhash64(member).cast("decimal(38,0)")).alias(f"{label}_sum"))


def same_sets(pairs: DataFrame, left: DataFrame, right: DataFrame, left_key: list[str], right_key: list[str], member: str) -> DataFrame:
    """The pairs whose sets are equal. ``pairs`` has both keys and sizes that are equal already; members are matched, never paired with each other."""
    mine = pairs.select(*left_key, *right_key, "set_size").join(left.select(*left_key, member).distinct(), left_key)
    shared = mine.join(right.select(*right_key, member).distinct(), [*right_key, member]).groupBy(*left_key, *right_key).agg(F.count("*").alias("shared"))
    return pairs.join(shared.withColumnRenamed("shared", "n_shared"), [*left_key, *right_key]).filter(F.col("n_shared") == F.col("set_size")).drop("n_shared")


@dataclass(frozen=True)
class Applied:
    """outcomes: a row a run; created: the new claims; reused: proposals and the claims they equal; superseded: claims that aren't current any more; contradictions: sorted pairs."""

    outcomes: DataFrame
    created: DataFrame
    reused: DataFrame
    superseded: DataFrame
    contradictions: DataFrame


def _run_faults(runs: DataFrame, inputs: DataFrame, revisions: DataFrame, state_version: int) -> DataFrame:
    now = revisions.filter("is_current").select("revision", F.col("digest").alias("now"))
    old = inputs.join(now, "revision", "left").filter(F.col("now").isNull() | (F.col("now") != F.col("digest"))).select("run_id").distinct().withColumn("old", F.lit(True))
    state = (F.col("state_version") != state_version) | (F.col("result_version") != F.col("state_version"))
    fault = F.coalesce(_fault("run closed", ~F.col("status").isin(*OPEN_RUNS)), _fault("stale state", state), _fault("stale input", F.col("old").isNotNull()))
    return runs.join(old, "run_id", "left").filter(fault.isNotNull()).select("run_id", F.lit(-1).cast("long").alias("number"), fault.alias("fault"))


def _duplicates(proposals: DataFrame, members: DataFrame, claims: DataFrame, dependencies: DataFrame) -> DataFrame:
    """run_id, number and the claim that a proposal equals: a current one, or that of an earlier proposal of the run (``earlier``, its number)."""
    key = ["run_id", "number"]
    own = proposals.select(*key, "entity", T.digest(F.col("text")).alias("digest")).join(signed(members, key, "revision"), key)
    held = claims.filter("is_current").select("claim", "entity", "digest").join(signed(dependencies, ["claim"], "revision"), "claim")
    like = own.join(held, ["entity", "digest", "set_size", "set_sum"])
    known = same_sets(like, members, dependencies, key, ["claim"], "revision").groupBy(*key).agg(F.min("claim").alias("claim"))
    # Equal proposals of a run: each is compared with the first of its signature.
    first = F.min("number").over(Window.partitionBy("run_id", "entity", "digest", "set_size", "set_sum"))
    later = own.withColumn("earlier", first).filter(F.col("number") > F.col("earlier"))
    earlier = members.select("run_id", F.col("number").alias("earlier"), "revision")
    mine = later.select(*key, "earlier", "set_size").join(members, key)
    shared = mine.join(earlier, ["run_id", "earlier", "revision"]).groupBy(*key, "earlier", "set_size").agg(F.count("*").alias("n"))
    again = shared.filter(F.col("n") == F.col("set_size")).select(*key, "earlier")
    return known.join(again, key, "full").select(*key, "claim", "earlier")


def apply(runs: DataFrame, inputs: DataFrame, proposals: DataFrame, quotes: DataFrame, revisions: DataFrame, claims: DataFrame, dependencies: DataFrame, state_version: int) -> Applied:
    """Tests all proposals against the record at ``state_version``, and says what the accepted runs make of it.

    A run without proposals is accepted and makes nothing. A proposal without quotes has the empty set of revisions, which no claim equals. Repeated quotes count once in the set.
    """
    key = ["run_id", "number"]
    proposals = _stored(proposals.withColumn("text", T.strip(T.text_of("text"))).withColumn("entity", T.strip(T.text_of("entity"))), "proposals")
    shape = F.coalesce(_fault("entity", F.col("entity") == ""), _fault("text", ~F.length("text").between(1, LONGEST)))
    shaped = proposals.filter(shape.isNotNull()).select(*key, shape.alias("fault"))

    asked = inputs.select("run_id", "revision").distinct().withColumn("asked", F.lit(True))
    placed = quotes.join(asked, ["run_id", "revision"], "left").join(revisions.select("revision", F.col("text").alias("body")), "revision", "left")
    exact = F.col("body").isNotNull() & (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("body")) & (T.piece(F.col("body"), F.col("start"), F.col("end")) == F.col("quote"))
    fault = F.coalesce(_fault("revision not in request", F.col("asked").isNull()), _fault("quote", ~F.coalesce(exact, F.lit(False))))
    quoted = placed.select(*key, fault.alias("fault")).filter("fault IS NOT NULL")

    members = _stored(quotes.select(*key, "revision").distinct(), "quoted-revisions")
    doubles = _stored(_duplicates(proposals, members, claims, dependencies), "duplicates")
    fresh = proposals.join(doubles, key, "left_anti")
    prior = claims.select(F.col("claim").alias("supersedes"), F.col("entity").alias("prior_entity"), "status", "is_current")
    first = F.min("number").over(Window.partitionBy("run_id", "supersedes"))
    ended = fresh.filter("supersedes IS NOT NULL").withColumn("first", first).join(prior, "supersedes", "left")
    fits = F.col("is_current") & (F.col("prior_entity") == F.col("entity")) & may_follow(F.col("status"), F.lit("superseded")) & (F.col("number") == F.col("first"))
    unfit = ended.filter(~F.coalesce(fits, F.lit(False))).select(*key, F.lit(FAULTS.index("supersession")).alias("fault"))
    against = fresh.select(*key, F.explode("contradicts").alias("target"))
    missing = against.join(claims.select(F.col("claim").alias("target")).distinct(), "target", "left_anti").select(*key, F.lit(FAULTS.index("contradiction target")).alias("fault"))

    faults = reduce(DataFrame.unionByName, [_run_faults(runs, inputs, revisions, state_version), shaped, quoted, unfit, missing])
    refused = faults.groupBy("run_id").agg(F.min(F.struct("number", "fault")).alias("f"))
    counted = proposals.groupBy("run_id").agg(F.count("*").alias("n")).join(doubles.groupBy("run_id").agg(F.count("*").alias("d")), "run_id", "left")
    judged = runs.select("run_id").join(refused, "run_id", "left").join(counted, "run_id", "left")
    ok = F.col("f").isNull()
    zero = lambda x: F.when(ok, F.coalesce(x, F.lit(0))).otherwise(0)
    outcomes = _stored(judged.select(
        "run_id", F.when(ok, "applied").otherwise("refused").alias("outcome"), F.get(F.array(*[F.lit(x) for x in FAULTS]), F.col("f.fault")).alias("reason"), F.when(F.col("f.number") >= 0, F.col("f.number")).alias("at_proposal"),
        zero(F.col("n") - F.coalesce("d", F.lit(0))).alias("n_created"), zero(F.col("d")).alias("n_reused"),
    ), "outcomes")

    accepted = outcomes.filter("outcome = 'applied'").select("run_id")
    name = F.concat_ws("\n", F.col("run_id").cast("string"), F.col("number").cast("string"), "entity", "text")
    made = fresh.join(accepted, "run_id", "left_semi").withColumn("claim", T.uuid5(name))
    status = F.when(F.size(F.coalesce("contradicts", F.array().cast("array<string>"))) > 0, "disputed").otherwise("candidate")
    created = made.select("claim", *key, "entity", "text", T.digest(F.col("text")).alias("digest"), status.alias("status"), "supersedes")
    own = made.select("run_id", F.col("number").alias("earlier"), F.col("claim").alias("own"))
    reused = doubles.join(accepted, "run_id", "left_semi").join(own, ["run_id", "earlier"], "left").select(*key, F.coalesce(F.col("claim").cast("string"), F.col("own")).alias("claim"))
    pairs = made.select("claim", F.explode(F.col("contradicts").cast("array<string>")).alias("target"))
    contradictions = pairs.select(F.least("claim", "target").alias("left_claim"), F.greatest("claim", "target").alias("right_claim"), F.col("claim").alias("disputed")).distinct()
    superseded = made.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("claim"), F.col("claim").alias("next_claim"))
    return Applied(outcomes, created, reused, superseded, contradictions)
