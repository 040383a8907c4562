"""Draining goes on after a run is killed, without loss or repeat."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemark.sources.store import Store
from mnemark.streaming import drain

T0 = dt.datetime(2024, 1, 1)
JOBS = "session_id long, repository string, status string, priority int, reason string, queued_at timestamp, available_at timestamp, attempts long, started_at timestamp, completed_at timestamp, last_error string"


def at(*day):
    return F.lit(dt.datetime(2024, 1, *day))


def job(s, status="pending", priority=1, ready=T0):
    return (s, "r", status, priority, "x", T0, ready, 0, None, None, "old" if status == "failed" else None)


def work(rows):
    """3 fails, 4 gives nothing, the rest tell their double."""
    error = F.when(F.col("session_id") == 3, "bad")
    return rows.where("session_id <> 4").select("session_id", (F.col("session_id") * 2).alias("double"), error.alias("error"))


def dies(rows):
    return rows.select("session_id", F.raise_error(F.lit("killed")).cast("long").alias("double"), F.lit(None).cast("string").alias("error"))


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_a_queue_is_drained_in_order_and_survives_a_kill(spark, store):
    later = dt.datetime(2024, 1, 3)
    queue = [job(1), job(2, "failed", 5), job(3, priority=4), job(4, priority=3), job(5, "running"), job(6, ready=later), job(7, "completed"), job(8)]
    store.commit({"queue": spark.createDataFrame(queue, JOBS)})
    with pytest.raises(Exception, match="killed"):
        drain.drain_once(store, dies, at(2), 3)
    assert store.versions() == [1]
    assert drain.drain_once(store, work, at(2), 3) == 3
    state = {r.session_id: r for r in store.read("queue").collect()}
    assert [(state[s].status, state[s].attempts, state[s].last_error) for s in (2, 3, 4)] == [("completed", 1, None), ("failed", 1, "bad"), ("failed", 1, "no result")]
    assert state[3].available_at == dt.datetime(2024, 1, 2, 0, 15) and state[1].status == "pending"
    with pytest.raises(Exception, match="killed"):
        drain.drain_once(store, dies, at(2), 9)
    assert drain.drain_once(store, work, at(2), 9) == 2  # 1 and 8; 3 and 4 wait for their time
    assert drain.drain_once(store, work, at(2), 9) == 0
    assert sorted((r.session_id, r.double) for r in store.read("results").collect()) == [(1, 2), (2, 4), (8, 16)]
    assert drain.drain_once(store, lambda rows: work(rows).withColumn("error", F.lit(None).cast("string")), F.lit(later), 9) == 3
    assert sorted(r.session_id for r in store.read("results").collect()) == [1, 2, 3, 6, 8]
    store.clear_work()
    assert store.read("queue").count() == 8


def test_a_run_goes_on_where_it_was_killed(spark, store):
    store.commit({"episode": spark.createDataFrame([(1, T0), (2, T0)], "session_id long, updated_at timestamp")})
    candidates = spark.createDataFrame([(s, T0 + dt.timedelta(days=s == 2)) for s in range(1, 9)], "session_id long, updated_at timestamp")
    assert drain.begin_run(store, 7, candidates, at(2), 3) == 7  # 1 is as new as it was
    assert drain.begin_run(store, 7, candidates, at(2), 3) == 7 and store.versions() == [1, 2]
    runs, _ = drain.run_state(store, at(2))
    assert [(r.status, r.processed) for r in runs.collect()] == [("running", 0)]
    assert drain.run_batch(store, 7, work, at(2)) == 3
    with pytest.raises(Exception, match="killed"):
        drain.run_to_the_end(store, 7, dies, at(2))
    runs, items = drain.run_state(store, at(2))
    assert [(r.status, r.processed, r.refreshed, r.failed, r.skipped) for r in runs.collect()] == [("running", 3, 1, 1, 1)]
    drain.run_to_the_end(Store(spark, store.root), 7, work, at(2))
    runs, items = drain.run_state(store, at(2))
    run = runs.first()
    assert (run.status, run.processed, run.created, run.refreshed, run.failed, run.skipped, run.last_error) == ("failed", 7, 4, 1, 1, 1, "bad")
    assert sorted((r.session_id, r.double) for r in store.read("results").collect()) == [(2, 4), (5, 10), (6, 12), (7, 14), (8, 16)]
    assert {r.session_id: (r.planned, r.status) for r in items.collect()}[2] == ("refresh", "completed")
    assert drain.begin_run(store, 8, candidates.limit(0), at(2), 3) == 0 and drain.run_batch(store, 8, work, at(2)) == 0


def test_a_stream_goes_on_with_the_batch_it_was_at(spark, tmp_path):
    where = str(tmp_path)
    for k in range(4):
        spark.createDataFrame([(k,), (10 + k,)], "session_id long").coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = lambda: spark.readStream.schema("session_id long").option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    seen = []

    def fails_once(rows):
        seen.append(1)
        return dies(rows).select("session_id", "double") if len(seen) == 3 else rows.select("session_id", (F.col("session_id") * 2).alias("double"))

    with pytest.raises(Exception, match="killed"):
        drain.drain_stream(spark, stream(), fails_once, f"{where}/out", f"{where}/state")
    got = drain.drain_stream(spark, stream(), fails_once, f"{where}/out", f"{where}/state")
    assert sorted((r.session_id, r.double) for r in got.collect()) == sorted((s, 2 * s) for k in range(4) for s in (k, 10 + k))
    assert len(seen) == 5


def test_no_task_gathers_a_large_batch(spark, tmp_path):
    store, n = Store(spark, str(tmp_path)), 20_000
    at = F.lit("2024-01-01").cast("timestamp")
    ids = spark.range(n).select(F.col("id").alias("session_id"), at.alias("updated_at"))
    store.commit({"episode": ids.limit(0)})
    sc = spark.sparkContext
    stages = lambda: sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        drain.begin_run(store, 1, ids, at, n // 2)
        known = {stages().apply(i).stageId() for i in range(stages().size())}
        took = drain.run_batch(store, 1, lambda rows: rows.select("session_id", F.lit(None).cast("string").alias("error")), at)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    found = stages()
    assert took == n // 2
    assert store.read("results").agg(F.min("session_id"), F.max("session_id"), F.count_distinct("session_id")).first() == (0, n // 2 - 1, n // 2)
    new = [found.apply(i) for i in range(found.size()) if found.apply(i).stageId() not in known]
    assert max(s.shuffleReadRecords() for s in new if s.numTasks() == 1) < n // 4
