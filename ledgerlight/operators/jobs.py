"""A log of job events folded to the state of each job: at once, and as a stream.

A job is created once for each kind and key; another create with the same key is a repeat of it. A job that has ended stays as it
is, a running job can't be cancelled, and events for a job that doesn't exist, of an unknown kind, or to an unknown state are
refused. Events that say what holds already change nothing.

Events are (at, kind, key, event), ``at`` being unique in a job. At once a job's state follows from a few firsts and lasts, so
that no job's events meet in one list; the stream keeps the same few values for each job with transformWithState.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.store import new_path

# Kinds and states of jobs, and the states that end one.
KINDS = ("ingest_file", "ingest_url", "compile", "render", "refresh", "import_json")
STATES = ("queued", "running", "completed", "failed", "cancelled")
ENDED = ("completed", "failed", "cancelled")
#: What an event asks for: create, a state by its name, or cancel.
CREATE, CANCEL = "create", "cancel"
JOB = "kind string, key string, status string, created_at long, updated_at long, n_events long, n_repeats long, n_refused long"
OUTCOMES = ("done", "repeated", "refused")


def _known(event: Column) -> Column:
    return event.isin(*STATES)


def folded(events: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The jobs and how many of their events were repeats or refused. Keys of which no create is seen have no job and aren't here.

    Before a job's end its state is that of its last event of state; its end is the first ending event that may happen: one by name, or a cancel
    that comes when the job isn't running. After that, only events that ask for the same end are repeats.
    """
    key = ["kind", "key"]
    rows = events.filter(F.col("kind").isin(*kinds))
    created = rows.filter(F.col("event") == CREATE).groupBy(*key).agg(F.min("at").alias("created_at"))
    later = rows.join(created, key)
    live = later.filter(F.col("at") > F.col("created_at"))
    by_name = F.min(F.when(F.col("event").isin(*ENDED), F.struct("at", F.col("event").alias("status"))))
    # A cancel counts if the last event of state before it isn't "running"; only those before the first ending by name matter.
    ends = live.groupBy(*key).agg(by_name.alias("named"))
    steps = live.join(ends, key).filter(F.col("named").isNull() | (F.col("at") < F.col("named.at")))
    marks = steps.filter(F.col("event").isin("queued", "running", CANCEL))
    cancel = _first_cancel(marks, key)
    over = created.join(ends, key, "left").join(cancel, key, "left")
    end = F.when(F.col("cancel_at").isNotNull(), F.struct(F.col("cancel_at").alias("at"), F.lit("cancelled").alias("status"))).otherwise(F.col("named"))
    known = over.select(*key, "created_at", end.alias("end"))
    met = rows.join(known, key)
    before = (F.col("at") > F.col("created_at")) & (F.col("end").isNull() | (F.col("at") < F.col("end.at")))
    state = before & F.col("event").isin("queued", "running")
    asks = F.when(F.col("event") == CANCEL, "cancelled").otherwise(F.col("event"))
    repeat = (F.col("event") == CREATE) & (F.col("at") > F.col("created_at")) | (F.col("at") > F.col("end.at")) & (asks == F.col("end.status"))
    done = F.coalesce((F.col("at") == F.col("created_at")) | state, F.lit(False)) | F.col("at").eqNullSafe(F.col("end.at"))
    last = F.max(F.when(state, F.struct("at", F.col("event").alias("status"))))
    out = met.groupBy(*key, "created_at", "end").agg(last.alias("last"), F.count("*").alias("n_events"), F.count_if(F.coalesce(repeat, F.lit(False)) & ~done).alias("n_repeats"), F.count_if(~(done | F.coalesce(repeat, F.lit(False)))).alias("n_refused"))
    return out.select(
        *key, F.coalesce("end.status", "last.status", F.lit("queued")).alias("status"), "created_at",
        F.coalesce(F.col("end.at"), F.col("last.at"), F.col("created_at")).alias("updated_at"), "n_events", "n_repeats", "n_refused",
    )


def _first_cancel(marks: DataFrame, key: list[str]) -> DataFrame:
    """The first cancel whose job isn't running: before any "running", or after a "queued" that came later than it."""
    kinds = {"cancel": CANCEL, "run": "running", "queue": "queued"}
    first = marks.groupBy(*key).agg(*[F.min(F.when(F.col("event") == v, F.col("at"))).alias(f"first_{k}") for k, v in kinds.items()])
    early = first.filter("first_cancel IS NOT NULL AND (first_run IS NULL OR first_cancel < first_run)").select(*key, F.col("first_cancel").alias("cancel_at"))
    # The rest is rare: jobs that ran before the cancel. Their marks are put in order, by key and time, to see what the last one was.
    others = marks.join(early, key, "left_anti").join(first.filter("first_cancel IS NOT NULL AND first_queue IS NOT NULL").select(*key), key, "left_semi")
    state = F.last(F.when(F.col("event") != CANCEL, F.col("event")), ignorenulls=True).over(Window.partitionBy(*key).orderBy("at"))
    late = others.withColumn("state", state).filter((F.col("event") == CANCEL) & (F.col("state") != "running")).groupBy(*key).agg(F.min("at").alias("cancel_at"))
    return early.unionByName(late)


class Jobs(StatefulProcessor):
    """Keeps a job's state between batches; every batch gives the job as it is now."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("job", "status string, created_at long, updated_at long, n_events long, n_repeats long, n_refused long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  names of the interface
        events = sorted((at, event) for part in rows for at, event in zip(part["at"].tolist(), part["event"].tolist()))
        status, created, updated, *counts = self.state.get() if self.state.exists() else (None, None, None, 0, 0, 0)
        for at, event in events:
            counts[0] += 1
            wanted = {CREATE: "queued", CANCEL: "cancelled"}.get(event, event)
            if status is None:
                if event == CREATE:
                    status, created, updated = "queued", at, at
                else:
                    counts[2] += 1
            elif event == CREATE or status in ENDED and wanted == status:
                counts[1] += 1
            elif wanted not in STATES or status in ENDED or event == CANCEL and status == "running":
                counts[2] += 1
            else:
                status, updated = wanted, at
        self.state.update((status, created, updated, *counts))
        if status is not None:
            yield pd.DataFrame({"kind": [key[0]], "key": [key[1]], "status": [status], "created_at": [created], "updated_at": [updated], "n_events": [counts[0]], "n_repeats": [counts[1]], "n_refused": [counts[2]]})

    def close(self) -> None:
        pass


def streamed(events: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The same jobs from a stream of events, run until its source is exhausted. Events of a job must arrive in their order, batch by batch.

    A batch writes the jobs that it changed under its number, so one that is repeated after a failure replaces its own rows; a job's last row counts.
    """
    spark = events.sparkSession
    base = new_path(spark, "jobs")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        jobs = events.filter(F.col("kind").isin(*kinds)).groupBy("kind", "key").transformWithStateInPandas(Jobs(), JOB, "Update", "None")

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{base}/batches/batch={number}")

        jobs.writeStream.outputMode("update").option("checkpointLocation", f"{base}/checkpoint").foreachBatch(write).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.schema(f"{JOB}, batch long").parquet(f"{base}/batches")
    columns = [f.split()[0] for f in JOB.split(", ")]
    return found.groupBy("kind", "key").agg(F.max_by(F.struct(*columns[2:]), "batch").alias("j")).select("kind", "key", "j.*")
