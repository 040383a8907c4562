"""Work taken from a queue or a run in bounded parts, each committed whole, so that a run that is killed goes on without loss or repeat.

A part's results and the state that tells of them become one version of a :class:`Store`: either both are seen or neither is. What
was under way when a run died is still waiting in the version that stands, and is taken again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import fold_items, fold_queue, fold_runs
from ..operators.sessions import numbered
from ..operators.state import available, planned
from ..sources.store import Store

#: Results of work: session_id, error (null where it went well) and whatever else it gives.
Work = Callable[[DataFrame], DataFrame]


def _without(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.drop(*[c for c in columns if c in rows.columns])


def drain_once(store: Store, work: Work, now: Column, limit: int, retry_minutes: int = 15) -> int:
    """Take the ``limit`` most urgent jobs of table ``queue``, do ``work`` on them, and commit the queue and the results; the number taken.

    A job whose result has an error fails and waits for ``retry_minutes``; one without a result fails too; all others are
    completed, and their results are added to table ``results``.
    """
    queue = store.read("queue")
    taken = available(queue, now, limit).select("session_id", "repository")
    held = store.kept("taken", taken)
    count = held.count()
    if not count:
        return 0
    done = store.kept("done", work(held))
    outcome = held.select("session_id").join(done.groupBy("session_id").agg(F.max("error").alias("error"), F.lit(True).alias("_done")), "session_id", "left")
    failed = F.col("_done").isNull() | F.col("error").isNotNull()
    event = F.explode(F.array(F.lit("started"), F.when(failed, "failed").otherwise("completed")))
    none = F.lit(None)
    events = outcome.select("session_id", "error", "_done", F.lit(None).cast("string").alias("repository"), event.alias("event")).select(
        "session_id", "event", now.alias("at"), F.when(F.col("event") == "started", 0).otherwise(1).alias("seq"), "repository", none.cast("int").alias("priority"),
        none.cast("string").alias("reason"), none.cast("int").alias("delay_minutes"), F.coalesce("error", F.when(F.col("_done").isNull(), "no result")).alias("error"),
    )
    good = done.where("error is null")
    store.commit({"queue": fold_queue(queue, events, retry_minutes)}, append={"results": _without(good, "error")})
    return count


def begin_run(store: Store, run_id: int, candidates: DataFrame, now: Column, batch: int) -> int:
    """Start a run over ``candidates`` (session_id, updated_at): its items, in the order of their ids, and its row; the number of items.

    What table ``episode`` (session_id, updated_at) lacks is created, what is newer than there refreshed, the rest not taken. A run that has begun
    already is left as it is.
    """
    tables = store.tables()
    if "runs" in tables and not store.read("runs").where(F.col("run_id") == run_id).isEmpty():
        return store.read("items").where(F.col("run_id") == run_id).count()
    actions = planned(candidates, store.read("episode"), "session_id", "updated_at").where("action <> 'skip'")
    items = store.kept("planned", actions.select(F.lit(run_id).cast("long").alias("run_id"), "session_id", F.col("action").alias("planned")))
    total = items.count()
    row = store.spark.range(1).select(
        F.lit(run_id).cast("long").alias("run_id"), F.lit("running").alias("status"), F.lit(total).cast("long").alias("total"), F.lit(batch).cast("long").alias("batch"),
        F.lit(None).cast("string").alias("last_error"), now.alias("started_at"),
    )
    store.commit({}, append={"runs": row, "items": items})
    return total


def run_batch(store: Store, run_id: int, work: Work, now: Column) -> int:
    """Work on the next batch of a run's items that have no outcome yet, and commit their results and outcomes; the number of items.

    The cursor is the table of outcomes itself: an item is pending until an outcome of it stands in a committed version.
    """
    mine = F.col("run_id") == run_id
    batch = store.read("runs").where(mine).first()["batch"]
    waiting = store.read("items").where(mine)
    if "outcomes" in store.tables():
        waiting = waiting.join(store.read("outcomes").where(mine).select("session_id"), "session_id", "left_anti")
    # a batch may be large: it is told by places, which are counted over ranges of ids, and gathered by no task
    first = numbered(waiting.select("run_id", "session_id", "planned"), "run_id", "session_id").where(F.col("position") < batch)
    taken = store.kept("taken", first.select("session_id", "planned"))
    count = taken.count()
    if not count:
        return 0
    done = store.kept("done", work(taken))
    told = done.groupBy("session_id").agg(F.max("error").alias("error"), F.lit("ok").alias("_done"))
    status = F.when(F.col("_done").isNull(), "skipped").when(F.col("error").isNotNull(), "failed").otherwise("completed")
    outcomes = taken.select("session_id").join(told, "session_id", "left").select(
        F.lit(run_id).cast("long").alias("run_id"), "session_id", status.alias("status"), "error", now.alias("at"), F.lit(0).cast("long").alias("seq")
    )
    store.commit({}, append={"outcomes": outcomes, "results": _without(done.where("error is null"), "error")})
    return count


def run_to_the_end(store: Store, run_id: int, work: Work, now: Column) -> None:
    """Go on with a run, from wherever it stands, until none of its items waits."""
    while run_batch(store, run_id, work, now):
        pass


def run_state(store: Store, now: Column) -> tuple[DataFrame, DataFrame]:
    """Runs and items as they stand: :func:`fold_runs` refreshed now, and :func:`fold_items`."""
    runs, items = store.read("runs"), store.read("items")
    if "outcomes" in store.tables():
        outcomes = store.read("outcomes")
    else:
        outcomes = items.limit(0).select("run_id", "session_id", F.lit("").alias("status"), F.lit("").alias("error"), now.alias("at"), F.lit(0).cast("long").alias("seq"))
    last = outcomes.groupBy("run_id").agg(F.max(F.when(F.col("status") == "failed", F.col("error"))).alias("error"))
    refreshes = runs.select("run_id").join(last, "run_id", "left").select("run_id", now.alias("at"), "error")
    return fold_runs(runs, items, outcomes, refreshes), fold_items(items, outcomes)


def drain_stream(spark: SparkSession, arrivals: DataFrame, work: Work, out: str, checkpoint: str) -> DataFrame:
    """Work on everything that has arrived as a stream, a batch at a time; all results so far.

    Each batch's results are written under its number, over what a batch that died may have left, and the offsets of
    ``checkpoint`` move on only then: a run that is killed goes on with the batch that it was at.
    """

    def put(rows: DataFrame, batch: int) -> None:
        work(rows).write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = arrivals.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(out).drop("batch")
