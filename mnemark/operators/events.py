"""State after ordered lists of events: queues of jobs and runs over many items, folded without one task that reads a key's events.

What a sequential reader would remember is told by aggregates and by values carried from earlier rows. A group is cut
into parts by time; what a part hands on is one row, so that a key that holds a third of all events is many tasks' work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def day_of(stamp: str) -> Column:
    return F.coalesce(F.floor(F.unix_seconds(stamp) / 86400), F.lit(-(1 << 40)))


def carried(rows: DataFrame, by: list[str], part: Column, order: list[str], last: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """``rows`` with, for each name of ``last``, the last value that is not null in an earlier row of the group, and for each of ``sums`` the running sum up to the row.

    ``part`` must grow with ``order``. Rows of one place come in the order of their hashes, in every part alike. Rows with
    a null in ``by`` are left out.
    """
    last, sums = last or {}, sums or {}
    order = [*order, "_tie"]
    at = F.struct(*order)
    named = {"_part": part, "_tie": F.xxhash64(*rows.columns)} | {f"_v_{k}": v for k, v in (last | sums).items()}
    dealt = rows.where(" and ".join(f"{c} is not null" for c in by)).withColumns(named)
    parts = dealt.groupBy(*by, "_part").agg(
        *[F.max_by(f"_v_{k}", F.when(F.col(f"_v_{k}").isNotNull(), at)).alias(f"_v_{k}") for k in last], *[F.sum(f"_v_{k}").alias(f"_v_{k}") for k in sums]
    )
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = parts.select(
        *by, "_part", *[F.last(f"_v_{k}", ignorenulls=True).over(before).alias(f"_b_{k}") for k in last], *[F.sum(f"_v_{k}").over(before).alias(f"_b_{k}") for k in sums]
    )
    within = Window.partitionBy(*by, "_part").orderBy(*order)
    earlier, so_far = within.rowsBetween(Window.unboundedPreceding, -1), within.rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(handed, [*by, "_part"])
    out = {k: F.coalesce(F.last(f"_v_{k}", ignorenulls=True).over(earlier), F.col(f"_b_{k}")) for k in last}
    out |= {k: F.coalesce(F.sum(f"_v_{k}").over(so_far), F.lit(0)) + F.coalesce(f"_b_{k}", F.lit(0)) for k in sums}
    return joined.withColumns(out).select(*rows.columns, *out)


JOB = ("repository", "status", "priority", "reason", "queued_at", "available_at", "attempts", "started_at", "completed_at", "last_error")


def fold_queue(queue: DataFrame, events: DataFrame, retry_minutes: int = 15) -> DataFrame:
    """The queue (session_id and ``JOB``) after events ``enqueued``, ``started``, ``completed`` and ``failed``, in order of (at, seq).

    ``events`` has session_id, event, at, seq, repository, priority, reason, delay_minutes and error. An enqueued job
    takes the new repository, reason and time and the larger priority, and its error goes; a running one keeps status and
    available_at, any other is pending from ``delay_minutes`` on. A start adds an attempt and clears the error, a
    completion clears it, a failure tells it and waits for ``retry_minutes``. Events of a session that is not in the queue
    count from its first enqueuing. Events of other kinds, or without a session, do nothing.
    """
    order = ["at", "seq", "_place"]
    at = F.struct(*order)
    known = events.where(F.col("event").isin("enqueued", "started", "completed", "failed")).withColumn("_place", F.xxhash64(*events.columns))
    asked = F.col("event") == "enqueued"
    first = known.where(asked).groupBy("session_id").agg(F.min(at).alias("_first"))
    began = first.join(queue.select("session_id", F.col("status").alias("_was")), "session_id", "full")
    live = known.join(began, "session_id").where(F.col("_was").isNotNull() | (at >= F.col("_first")))
    seen = carried(live, ["session_id"], day_of("at"), order, last={"_mark": F.when(~asked, F.col("event"))})
    running = F.coalesce(F.col("_mark") == "started", F.col("_was") == "running", F.lit(False))
    waits = F.make_dt_interval(mins=F.when(asked, F.coalesce("delay_minutes", F.lit(0))).otherwise(F.lit(retry_minutes)).cast("int"))
    moved = (asked & ~running) | (F.col("event") == "failed")
    status = F.when(asked & ~running, "pending").when(F.col("event") == "started", "running").when(~asked, F.col("event"))
    newest = lambda value, where: F.max_by(value, F.when(where, at))
    told = seen.withColumns({"_status": status, "_available": F.when(moved, F.col("at") + waits), "_moved": moved}).groupBy("session_id").agg(
        newest("_status", F.col("_status").isNotNull()).alias("n_status"), newest("_available", F.col("_moved")).alias("n_available"),
        newest(F.struct("repository", "reason", "at"), asked).alias("n_asked"), F.max(F.when(asked, F.col("priority"))).alias("n_priority"),
        F.max_by(F.struct(F.when(F.col("event") == "failed", F.col("error")).alias("error")), at).alias("n_error"),
        F.count_if(F.col("event") == "started").alias("n_starts"), F.max(F.when(F.col("event") == "started", F.col("at"))).alias("n_started"),
        F.max(F.when(F.col("event") == "completed", F.col("at"))).alias("n_completed"),
    )
    joined = queue.join(told, "session_id", "full")
    renewed = lambda field, old: F.when(F.col("n_asked").isNotNull(), F.col(f"n_asked.{field}")).otherwise(F.col(old)).alias(old)
    return joined.select(
        "session_id", renewed("repository", "repository"), F.coalesce("n_status", "status").alias("status"), F.greatest("priority", "n_priority").alias("priority"),
        renewed("reason", "reason"), renewed("at", "queued_at"), F.coalesce("n_available", "available_at").alias("available_at"),
        (F.coalesce("attempts", F.lit(0)) + F.coalesce("n_starts", F.lit(0))).cast("long").alias("attempts"), F.coalesce("n_started", "started_at").alias("started_at"),
        F.coalesce("n_completed", "completed_at").alias("completed_at"), F.when(F.col("n_error").isNotNull(), F.col("n_error.error")).otherwise(F.col("last_error")).alias("last_error"),
    )


#: Counters of a run, each with the items that it counts.
COUNTERS = {
    "pending": "s = 'pending'", "processed": "s in ('completed', 'skipped', 'failed')", "created": "planned = 'create' and s = 'completed'",
    "refreshed": "planned = 'refresh' and s = 'completed'", "skipped": "s = 'skipped'", "failed": "s = 'failed'",
}


def same_place() -> Column:
    """The order of an item's updates of one (at, seq)."""
    return F.xxhash64("status", "error")


def fold_items(items: DataFrame, updates: DataFrame) -> DataFrame:
    """Items (run_id, session_id, planned) with the status, error and time of their last update; ``pending`` without any.

    Updates of what is no item do nothing.
    """
    last = updates.groupBy("run_id", "session_id").agg(F.max_by(F.struct("status", "error", "at"), F.struct("at", "seq", same_place().alias("_tie"))).alias("u"))
    joined = items.join(last, ["run_id", "session_id"], "left")
    return joined.select("run_id", "session_id", "planned", F.coalesce("u.status", F.lit("pending")).alias("status"), F.col("u.error").alias("error"), F.col("u.at").alias("processed_at"))


def fold_runs(runs: DataFrame, items: DataFrame, updates: DataFrame, refreshes: DataFrame) -> DataFrame:
    """Runs (run_id, status, last_error, total, batch) after updates of their items and refreshes, in order of time.

    A refresh counts a run's items as they are then: it is running while any is pending, else failed if any failed, else
    completed; its error, if it has one, is kept. completed_at is the time of the last refresh that found none pending. A run that is never
    refreshed stays as it is, with zero counters. Of a time's events updates come before refreshes. Counters are those of
    the last refresh; earlier ones matter only to completed_at, and only in runs that items pending anew keep from being done.
    """
    latest = refreshes.groupBy("run_id").agg(
        F.max("at").alias("updated_at"), F.max_by("error", F.when(F.col("error").isNotNull(), F.struct("at", "error"))).alias("n_error"), F.lit(True).alias("asked")
    )
    named = items.where("session_id is not null")
    # what comes after a run's last refresh is seen by none
    mine = named.join(latest.select("run_id", "updated_at"), "run_id").groupBy("run_id", "session_id", "updated_at").agg(F.min("planned").alias("planned"))
    known = updates.select("run_id", "session_id", "status", "at", "seq", same_place().alias("_tie")).join(mine, ["run_id", "session_id"]).where("at <= updated_at and status is not null")
    of_item = Window.partitionBy("run_id", "session_id").orderBy("at", "seq", "_tie")
    prior = known.withColumns({"_prior": F.coalesce(F.lag("status").over(of_item), F.lit("pending")), "_last": F.lead("at").over(of_item).isNull()})
    moved = prior.withColumn("_d", (F.col("status") == "pending").cast("int") - (F.col("_prior") == "pending").cast("int")).where("_last or _d <> 0").withColumnRenamed("status", "s")
    rest = [k for k in COUNTERS if k != "pending"]
    # an item counts where its last update stands, but is pending, or no more, wherever that changes
    spans = moved.groupBy("run_id", "at").agg(F.sum("_d").alias("_d"), F.count_if(F.col("_d") > 0).alias("_again"), *[F.count_if(F.col("_last") & F.expr(COUNTERS[k])).alias(k) for k in rest])
    # true of every row: all uses look at the same columns, so that items are folded and shuffled once
    spans = spans.where(" and ".join(f"{k} >= 0" for k in ["_again", *rest]))
    size = named.groupBy("run_id").agg(F.count_distinct("session_id").alias("n_items"))
    summed = spans.groupBy("run_id").agg(*[F.sum(k).alias(k) for k in ["_d", "_again", *rest]])
    counted = size.join(summed, "run_id", "left").withColumn("pending", F.col("n_items") + F.coalesce("_d", F.lit(0)))
    # where items are pending at the end, all may have been done before, but only if as many became pending anew
    unsettled = counted.where("pending > 0 and pending <= _again").select("run_id", "n_items")
    asks = refreshes.select("run_id", "at", F.lit(1).alias("kind"), F.lit(0).cast("long").alias("_d")).distinct().join(unsettled, "run_id")
    deltas = spans.select("run_id", "at", F.lit(0).alias("kind"), "_d").join(unsettled, "run_id")
    told = carried(deltas.unionByName(asks), ["run_id"], day_of("at"), ["at", "kind"], sums={"_moved": F.col("_d")}).where("kind = 1 and n_items + _moved = 0")
    before = told.groupBy("run_id").agg(F.max("at").alias("_before"))
    pending = F.coalesce("pending", F.lit(0))
    status = F.when(F.col("asked").isNull(), F.col("status")).when(pending > 0, "running").when(F.col("failed") > 0, "failed").otherwise("completed")
    zero = lambda k: F.when(F.col("asked"), F.coalesce(k, F.lit(0))).otherwise(F.lit(0)).cast("long").alias(k)
    return runs.join(latest, "run_id", "left").join(counted, "run_id", "left").join(before, "run_id", "left").select(
        "run_id", status.alias("status"), "total", "batch", *map(zero, rest),
        F.when(pending == 0, F.col("updated_at")).otherwise(F.col("_before")).alias("completed_at"), "updated_at", F.coalesce("n_error", "last_error").alias("last_error"),
    )
