"""Ordered events against readers that take them one by one."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from mnemark.operators import aggregates, events, snapshots, state
from mnemark.operators.diagnostics import episodes_of_day, hit_rates, run_progress

T0 = dt.datetime(2024, 1, 1)
JOBS = "session_id long, repository string, status string, priority int, reason string, queued_at timestamp, available_at timestamp, attempts long, started_at timestamp, completed_at timestamp, last_error string"
EVENTS = "session_id long, event string, at timestamp, seq long, repository string, priority int, reason string, delay_minutes int, error string"


def walk(queue, happened):
    """The queue after the events, by one reader."""
    jobs = {j[0]: list(j[1:]) for j in queue}
    for s, event, at, _, repository, priority, reason, delay, error in sorted((e for e in happened if e[0] is not None), key=lambda e: (e[2], e[3])):
        job = jobs.get(s)
        if event == "enqueued":
            running = job is not None and job[1] == "running"
            old = job or [None, None, None, None, None, None, 0, None, None, None]
            most = max(p for p in (old[2], priority) if p is not None)
            jobs[s] = [repository, "running" if running else "pending", most, reason, at, old[5] if running else at + dt.timedelta(minutes=delay or 0), old[6], old[7], old[8], None]
        elif job is None:
            continue
        elif event == "started":
            job[1], job[6], job[7], job[9] = "running", job[6] + 1, at, None
        elif event == "completed":
            job[1], job[8], job[9] = "completed", at, None
        elif event == "failed":
            job[1], job[5], job[9] = "failed", at + dt.timedelta(minutes=15), error
    return {s: tuple(j) for s, j in jobs.items()}


@pytest.mark.parametrize("seed", range(3))
def test_queue_equals_a_reader(spark, seed):
    rnd = random.Random(seed)
    queue = [(s, "r", rnd.choice(["pending", "running", "failed", "completed"]), rnd.randrange(9), "old", T0, T0, rnd.randrange(3), None, None, rnd.choice([None, "e"])) for s in range(12)]
    kinds = ["enqueued", "started", "completed", "failed", "unknown"]
    happened = []
    for k in range(600):
        s = rnd.choice([0, 0, rnd.randrange(20), None if k % 50 == 0 else 7])  # session 0 is hot, some are in no queue
        at = T0 + dt.timedelta(hours=rnd.randrange(24 * 9))
        happened.append((s, rnd.choice(kinds), at, k, rnd.choice([None, "a", "b"]), rnd.randrange(9), f"w{k}", rnd.choice([None, 0, 30]), f"x{k}"))
    got = events.fold_queue(spark.createDataFrame(queue, JOBS), spark.createDataFrame(happened, EVENTS)).collect()
    assert {r.session_id: tuple(r)[1:] for r in got} == walk(queue, happened)


def test_empty_queues(spark):
    none, queue = spark.createDataFrame([], EVENTS), spark.createDataFrame([(1, "r", "failed", 1, "o", T0, T0, 2, None, None, "e")], JOBS)
    assert [tuple(r) for r in events.fold_queue(queue, none).collect()] == [(1, "r", "failed", 1, "o", T0, T0, 2, None, None, "e")]
    assert events.fold_queue(queue.limit(0), none).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_a_reader(spark, seed):
    rnd = random.Random(seed)
    runs = [(r, "running", 20, 10, rnd.choice([None, "old"])) for r in range(5)]
    items = [(r, s, rnd.choice(["create", "refresh"])) for r in range(4) for s in range(6)]
    happened = [(rnd.randrange(5), rnd.randrange(8), rnd.choice(["completed", "failed", "skipped", "pending"]), T0 + dt.timedelta(hours=rnd.randrange(99)), k, f"e{k}") for k in range(150)]
    refreshes = [(rnd.randrange(6), T0 + dt.timedelta(hours=k * 5), rnd.choice([None, f"f{k}"])) for k in range(24)]
    now = {(r, s): ["pending", p, None, None] for r, s, p in items}
    told = {r: [status, 0, 0, 0, 0, 0, None, None, error] for r, status, _, _, error in runs}
    for at, kind, _, row in sorted([(u[3], 0, u[4], u) for u in happened] + [(f[1], 1, 0, f) for f in refreshes], key=lambda x: x[:3]):
        if kind == 0 and (row[0], row[1]) in now:
            now[row[0], row[1]][0], now[row[0], row[1]][2:] = row[2], [row[5], at]
        elif kind == 1 and row[0] in told:
            mine = [v for (r, _), v in now.items() if r == row[0]]
            count = lambda *states, plan=None: sum(v[0] in states and plan in (None, v[1]) for v in mine)  # noqa: B023, E731
            status = "running" if count("pending") else "failed" if count("failed") else "completed"
            old = told[row[0]]
            told[row[0]] = [
                status, count("completed", "skipped", "failed"), count("completed", plan="create"), count("completed", plan="refresh"), count("skipped"), count("failed"),
                old[6] if status == "running" else at, at, row[2] if row[2] is not None else old[8],
            ]
    tables = (
        spark.createDataFrame(runs, "run_id long, status string, total long, batch long, last_error string"), spark.createDataFrame(items, "run_id long, session_id long, planned string"),
        spark.createDataFrame(happened, "run_id long, session_id long, status string, at timestamp, seq long, error string"), spark.createDataFrame(refreshes, "run_id long, at timestamp, error string"),
    )
    got = {r.run_id: [r.status, r.processed, r.created, r.refreshed, r.skipped, r.failed, r.completed_at, r.updated_at, r.last_error] for r in events.fold_runs(*tables).collect()}
    assert got == told
    states = {(r.run_id, r.session_id): [r.status, r.planned, r.error, r.processed_at] for r in events.fold_items(*tables[1:3]).collect()}
    assert states == now


def run_tables(spark, items, happened, refreshes):
    runs = [(r, "running", 9, 3, None) for r in sorted({i[0] for i in items})]
    return (
        spark.createDataFrame(runs, "run_id long, status string, total long, batch long, last_error string"), spark.createDataFrame(items, "run_id long, session_id long, planned string"),
        spark.createDataFrame(happened, "run_id long, session_id long, status string, at timestamp, seq long, error string"), spark.createDataFrame(refreshes, "run_id long, at timestamp, error string"),
    )


def test_runs_shuffle_their_updates_once(spark, shuffled_rows):
    items = [(r, s, "create") for r in range(20) for s in range(10)]
    happened = [(r, s, "completed", T0 + dt.timedelta(days=k), k, "e") for r, s, _ in items for k in range(30)]
    tables = run_tables(spark, items, happened, [(r, T0 + dt.timedelta(days=40), None) for r in range(20)])
    before = shuffled_rows()
    got = events.fold_runs(*tables).collect()
    assert shuffled_rows() - before < 1.5 * len(happened)
    assert {(r.run_id, r.status, r.created, r.completed_at) for r in got} == {(r, "completed", 10, T0 + dt.timedelta(days=40)) for r in range(20)}


def test_items_named_twice_or_pending_anew(spark):
    day = lambda k: T0 + dt.timedelta(days=k)
    items = [(1, 1, "create"), (1, 1, "create"), (1, None, "create"), (2, 1, "create"), (2, 2, "refresh"), (3, 1, "create"), (3, 2, "create")]
    happened = [
        (1, 1, "completed", day(1), 1, None), (1, 1, None, day(2), 2, None), (2, 1, "failed", day(1), 1, None), (2, 2, "completed", day(2), 1, None), (2, 2, "pending", day(4), 2, None),
        (2, 2, "completed", day(9), 3, None), (3, 1, "completed", day(1), 1, None), (3, 1, "pending", day(2), 2, None),
    ]
    tables = run_tables(spark, items, happened, [(r, day(k), None) for r in (1, 2, 3) for k in (1, 3, 5)])
    got = {r.run_id: (r.status, r.processed, r.created, r.failed, r.completed_at, r.updated_at) for r in events.fold_runs(*tables).collect()}
    assert got == {1: ("completed", 1, 1, 0, day(5), day(5)), 2: ("running", 1, 0, 1, day(3), day(5)), 3: ("running", 0, 0, 0, None, day(5))}


def test_progress(spark):
    rows = [(1, "running", 0, 5, 0), (2, "running", 8, 5, 1), (3, "failed", 3, 5, 2), (4, "completed", 2, 5, 9), (5, "preview", 4, 5, 0), (6, "other", 1, 5, 0)]
    got = {r.run_id: tuple(r)[1:] for r in run_progress(spark.createDataFrame(rows, "run_id int, status string, total long, batch long, processed long")).collect()}
    assert got == {1: (0, 0, 100, "processing"), 2: (7, 5, 13, "processing"), 3: (1, 0, 67, "failed"), 4: (0, 0, 100, "complete"), 5: (4, 0, 0, "planning"), 6: (1, 0, 0, "idle")}


def test_rates_rank_by_what_was_included(spark):
    rows = [("often", 1, 0, 0)] * 9 + [("rare", 0, 1, 0)] + [("b", 1, 1, 0), ("b", 0, 0, 0)] + [("a", 1, 1, 0), ("a", 0, 0, 0)]
    assert [r.name for r in hit_rates(spark.createDataFrame(rows, "name string, matched int, included int, dropped int")).collect()] == ["rare", "a", "b", "often"]


def test_days_without_summaries_and_days_of_noise(spark):
    day = dt.date(2024, 1, 1)
    rows = [(1, day, "a", " ", 1), (2, day, "b", "Session 0a1b2c3d", 1), (3, day, "b", " ", 2), (4, day, None, "real  work", 1), (5, day, "", "call the tool x", 2)]
    rows += [(10 + k, day, "c", f"s{k}", k) for k in range(10)]
    frame = spark.createDataFrame(rows, "session_id long, date_key date, repository string, summary string, updated long")
    got = {r.repository: (r.summary, r.episodes) for r in aggregates.day_summaries(frame).collect()}
    assert got == {"a": ("No remembered activity.", 0), "b": ("- Session 0a1b2c3d", 1), "": ("- real work", 1), "c": ("\n".join(f"- s{k}" for k in range(9, 1, -1)), 8)}
    held = aggregates.day_summaries(frame.where("session_id <> 19"))
    again = aggregates.refreshed_days(held, frame, frame.where("session_id = 19"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, aggregates.day_summaries(frame).collect()))


def test_deletion_overwrites_and_tells_when(spark):
    memory = spark.createDataFrame([(1, None, T0), (2, "5", T0), (3, "6", T0)], "id long, superseded_by string, updated_at timestamp")
    gone = spark.createDataFrame([(1, None), (2, 9), (8, 1)], "id long, by long")
    got = sorted(tuple(r) for r in state.soft_deleted(memory, gone, F.lit("2024-02-01 10:00:00").cast("timestamp")).collect())
    later = dt.datetime(2024, 2, 1, 10)
    assert got == [(1, "manual:2024-02-01T10:00:00.000Z", later), (2, "9", later), (3, "6", T0)]


APPROVALS = "family string, repository string, target long, decision string, durable boolean, expires_at timestamp, created_at long, updated_at long"


@pytest.mark.parametrize("seed", range(3))
def test_approvals_equal_a_reader(spark, seed):
    rnd = random.Random(seed)
    now, old, new = T0, T0 - dt.timedelta(days=1), T0 + dt.timedelta(days=1)
    pick = lambda k: ("f", rnd.choice([None, "", "r"]), rnd.choice([None, -1]), rnd.choice(["ask", "allow", "deny"]), rnd.random() < 0.2, rnd.choice([None, old, new, None]), k)
    held = [(*x, x[-1]) for x in map(pick, range(5))]
    asked = [pick(100 + k) for k in range(30)]
    rows = [list(h) for h in held]
    for f, r, t, decision, durable, expires, at in asked:
        first = next((x for x in rows if x[:3] == [f, r, t]), None)
        if first and not first[4] and not (first[5] and first[5] < now):
            first[3:6], first[7] = [decision, durable, expires], at
        else:
            rows.append([f, r, t, decision, durable, expires, at, at])
    requests = spark.createDataFrame(asked, "family string, repository string, target long, decision string, durable boolean, expires_at timestamp, at long")
    got = snapshots.record_approvals(spark.createDataFrame(held, APPROVALS), requests, F.lit(now)).collect()
    assert sorted(map(str, map(list, got))) == sorted(map(str, rows))


def test_task_results_move_the_time_whatever_their_status(spark):
    held = spark.createDataFrame([("a", 2, 1, 0, "completed", 5, 6), ("b", 1, 0, 0, "running", 3, None)], "task string, runs long, failures long, attention long, last_status string, last_started long, last_completed long")
    results = spark.createDataFrame([("a", "failed", 8, 9), ("a", "needs_attention", None, 10), ("c", "completed", None, 4)], "task string, status string, started long, at long")
    got = sorted(tuple(r) for r in snapshots.task_results(held, results).collect())
    assert got == [("a", 4, 2, 1, "needs_attention", 8, 10), ("b", 1, 0, 0, "running", 3, None), ("c", 1, 0, 0, "completed", None, 4)]


def test_episodes_of_a_day(spark):
    day = dt.date(2024, 1, 1)
    rows = [
        (1, "a", "repo", 9, 1, "Session 0a1b2c3d"), (2, "a", "repo", 8, 1, "Worked in a (0a1b2c3d)"), (3, None, "global", 9, 1, "Real  work"), (4, "a", "repo", 5, 1, "real work"),
        (5, "b", "repo", 10, 1, "of others"), (6, "a", "repo", 4, 1, " "), (7, "a", "repo", 4, 0, ""),
    ]
    episodes = spark.createDataFrame([(*r[:5], r[5], day) for r in rows], "session_id long, repository string, scope string, significance long, updated long, summary string, date_key date")
    asked = spark.createDataFrame([(1, day, "a"), (2, day, "zz"), (3, None, "a")], "prompt_id long, date_key date, repository string")
    got = sorted((r.prompt_id, r.place, r.session_id) for r in episodes_of_day(asked, episodes, 5).collect())
    assert got == [(1, 0, 4), (1, 0, 6), (1, 0, 7), (2, 1, 3)]
    assert sorted(r.session_id for r in episodes_of_day(asked.where("prompt_id = 2"), episodes, 2, True).collect()) == [3, 5]
