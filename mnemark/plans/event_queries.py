"""Registered queries on ordered events: the queue of jobs, runs over many items, and their progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import aggregates as G
from ..operators import diagnostics as D
from ..operators import events as V
from ..sources import bindings as S
from .memory_queries import EPISODE, NORMAL, SQL, TOLD, registered
from .prompt_queries import any_of

QUEUED = """
jobs AS (SELECT o_orderkey AS session_id, 'r' || o_custkey % 50 AS repository, CASE WHEN o_orderkey % 11 = 0 THEN 'failed' WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderkey % 3 = 0 THEN 'pending' ELSE 'running' END AS status,
  CAST(left(o_orderpriority, 1) AS INT) AS priority, o_orderpriority AS reason, o_orderdate AS queued_at, o_orderdate AS available_at, CAST(1 AS BIGINT) AS attempts, CAST(NULL AS TIMESTAMP) AS started_at,
  CAST(NULL AS TIMESTAMP) AS completed_at, 'old' AS last_error FROM orders WHERE o_orderstatus <> 'P'),
happened AS (SELECT l_orderkey AS session_id, CASE WHEN l_returnflag = 'A' THEN 'completed' WHEN l_returnflag = 'R' AND l_quantity > 25 THEN 'failed' WHEN (l_partkey + l_linenumber) % 2 = 0 THEN 'started' ELSE 'enqueued' END AS event,
  l_shipdate AS stamp, l_linenumber::bigint * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, CASE WHEN l_suppkey % 5 > 0 THEN 'n' || l_suppkey % 5 END AS repository, CAST(l_quantity AS INT) % 9 AS priority, l_linestatus AS reason, CAST(l_quantity AS INT) AS delay_minutes, 'e' || l_partkey % 7 AS error FROM lineitem)
"""
STATE = "live, repository, status, priority, reason, queued_at, available_at, attempts, started_at, completed_at, last_error, ev"


def state_sql(**fields) -> str:
    names = STATE.split(", ")
    return "struct_pack(" + ", ".join(f"{n} := {fields.get(n, f'x.{n}')}" for n in names) + ")"


FOLD = f"""CASE WHEN y.ev = 'enqueued' THEN {state_sql(live="true", repository="y.repository", status="CASE WHEN x.status = 'running' THEN 'running' ELSE 'pending' END", priority="greatest(x.priority, y.priority)", reason="y.reason",
 queued_at="y.queued_at", available_at="CASE WHEN x.status = 'running' THEN x.available_at ELSE y.available_at END", last_error="CAST(NULL AS VARCHAR)")}
 WHEN NOT x.live THEN x
 WHEN y.ev = 'started' THEN {state_sql(status="'running'", attempts="x.attempts + 1", started_at="y.queued_at", last_error="CAST(NULL AS VARCHAR)")}
 WHEN y.ev = 'completed' THEN {state_sql(status="'completed'", completed_at="y.queued_at", last_error="CAST(NULL AS VARCHAR)")}
 ELSE {state_sql(status="'failed'", available_at="y.available_at", last_error="y.last_error")} END"""
NONE = {"live": "false", "repository": "CAST(NULL AS VARCHAR)", "status": "CAST(NULL AS VARCHAR)", "priority": "CAST(NULL AS INT)", "reason": "CAST(NULL AS VARCHAR)", "queued_at": "CAST(NULL AS TIMESTAMP)", "available_at": "CAST(NULL AS TIMESTAMP)", "attempts": "CAST(0 AS BIGINT)", "started_at": "CAST(NULL AS TIMESTAMP)", "completed_at": "CAST(NULL AS TIMESTAMP)", "last_error": "CAST(NULL AS VARCHAR)", "ev": "''"}


@registered("M5_folded_queue", f"""WITH {QUEUED},
packed AS (SELECT session_id, {state_sql(**NONE | dict(ev="event", repository="repository", priority="priority", reason="reason", queued_at="stamp", available_at="stamp + to_minutes(CASE WHEN event = 'enqueued' THEN delay_minutes ELSE 15 END)", last_error="error"))} AS y, stamp, seq FROM happened),
lists AS (SELECT session_id, list(y ORDER BY stamp, seq) AS ys FROM packed GROUP BY 1),
began AS (SELECT coalesce(j.session_id, l.session_id) AS session_id, ys, CASE WHEN j.session_id IS NULL THEN {state_sql(**NONE)} ELSE {state_sql(**{n: f'j.{n}' for n in STATE.split(', ')} | dict(live='true', ev="''"))} END AS x0 FROM jobs j FULL JOIN lists l USING (session_id)),
ended AS (SELECT session_id, list_reduce(list_prepend(x0, coalesce(ys, [])), lambda x, y: {FOLD}) AS s FROM began)
SELECT session_id, {', '.join(f's.{n} AS {n}' for n in STATE.split(', ')[1:-1])} FROM ended WHERE s.live""")
def folded_queue(spark, sf_dir):
    return V.fold_queue(S.jobs(spark, sf_dir), S.job_events(spark, sf_dir))


def folded_sql(kinds: str) -> str:
    return SQL["M5_folded_queue"].replace("FROM happened)", f"FROM happened WHERE event {kinds})")


@registered("M5_enqueue", folded_sql("= 'enqueued'"))
def enqueue(spark, sf_dir):
    return V.fold_queue(S.jobs(spark, sf_dir), S.job_events(spark, sf_dir).where("event = 'enqueued'"))


@registered("M5_advanced_queue", folded_sql("<> 'enqueued'"))
def advanced_queue(spark, sf_dir):
    return V.fold_queue(S.jobs(spark, sf_dir), S.job_events(spark, sf_dir).where("event <> 'enqueued'"))


RUNS = """
items AS (SELECT o_custkey AS run_id, o_orderkey AS session_id, CASE WHEN o_orderkey % 3 = 0 THEN 'create' ELSE 'refresh' END AS planned FROM orders),
updates AS (SELECT o_custkey AS run_id, l_orderkey AS session_id, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN CASE WHEN l_quantity > 40 THEN 'failed' ELSE 'completed' END ELSE CASE WHEN l_linestatus = 'F' OR l_linenumber > 1 THEN 'skipped' ELSE 'pending' END END AS status,
  l_shipdate AS stamp, l_linenumber::bigint * 1000000000000 + l_partkey * 1000000 + l_suppkey AS seq, 'e' || l_partkey % 7 AS error FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
refreshes AS (SELECT o_custkey AS run_id, o_orderdate + INTERVAL 60 DAY AS stamp, CASE WHEN o_orderstatus = 'F' THEN 'x' || o_orderpriority END AS error FROM orders),
begun AS (SELECT c_custkey AS run_id, 'running' AS status, CAST(c_custkey % 30 AS BIGINT) AS total, CAST(10 AS BIGINT) AS batch, CASE WHEN c_custkey % 2 = 0 THEN 'before' END AS last_error FROM customer),
seen AS (SELECT r.run_id, r.stamp, r.error, i.session_id, any_value(i.planned) AS planned, coalesce(arg_max(u.status, (u.stamp, u.seq)), 'pending') AS s
  FROM (SELECT DISTINCT run_id, stamp, error FROM refreshes) r LEFT JOIN items i USING (run_id) LEFT JOIN updates u ON u.run_id = r.run_id AND u.session_id = i.session_id AND u.stamp <= r.stamp GROUP BY 1, 2, 3, 4),
counted AS (SELECT run_id, stamp, error, """ + ", ".join(f"count(session_id) FILTER ({rule}) AS {k}" for k, rule in V.COUNTERS.items()) + """ FROM seen GROUP BY 1, 2, 3),
latest AS (SELECT run_id, arg_max(counted, (stamp, coalesce(error, ''))) AS c, max(stamp) FILTER (pending = 0) AS completed_at, arg_max(error, (stamp, error)) FILTER (error IS NOT NULL) AS n_error, max(stamp) AS updated_at FROM counted GROUP BY 1),
folded AS (SELECT b.run_id, CASE WHEN l.run_id IS NULL THEN status WHEN c.pending > 0 THEN 'running' WHEN c.failed > 0 THEN 'failed' ELSE 'completed' END AS status, total, batch, """ + ", ".join(f"coalesce(c.{k}, 0)::bigint AS {k}" for k in V.COUNTERS if k != "pending") + """,
  completed_at, updated_at, coalesce(n_error, last_error) AS last_error FROM begun b LEFT JOIN latest l USING (run_id))
"""  # fmt: skip


@registered("M9_folded_runs", f"WITH {RUNS} SELECT * FROM folded")
def folded_runs(spark, sf_dir):
    return V.fold_runs(*S.backfill(spark, sf_dir))


@registered("M9_folded_items", f"""WITH {RUNS} SELECT i.run_id, i.session_id, any_value(i.planned) AS planned, coalesce(arg_max(u.status, (u.stamp, u.seq)), 'pending') AS status, arg_max(u.error, (u.stamp, u.seq)) AS error, max(u.stamp) AS processed_at
FROM items i LEFT JOIN updates u ON u.run_id = i.run_id AND u.session_id = i.session_id GROUP BY 1, 2""")
def folded_items(spark, sf_dir):
    _, items, updates, _ = S.backfill(spark, sf_dir)
    return V.fold_items(items, updates)


@registered("G26_progress", f"""WITH {RUNS} SELECT run_id, greatest(0, total - processed) AS waiting, CASE WHEN status = 'running' THEN greatest(0, least(greatest(0, total - processed), batch)) ELSE 0 END AS under_way,
 CASE WHEN total > 0 THEN CAST(least(100, greatest(0, floor(100.0 * processed / total + 0.5))) AS BIGINT) ELSE 100 END AS percent, CASE status WHEN 'running' THEN 'processing' WHEN 'failed' THEN 'failed' WHEN 'completed' THEN 'complete' WHEN 'preview' THEN 'planning' ELSE 'idle' END AS phase FROM folded""")
def run_progress(spark, sf_dir):
    return D.run_progress(V.fold_runs(*S.backfill(spark, sf_dir)))


def days_sql(episodes: str) -> str:
    return f"""WITH {episodes}, l AS (SELECT date_key, coalesce(repository, '') AS repository, session_id, {NORMAL.format('summary')} AS t, row_number() OVER (PARTITION BY date_key, coalesce(repository, '') ORDER BY updated DESC, session_id DESC) AS pos FROM episode),
m AS (SELECT *, {any_of('t', L.NOISE_SUMMARIES)} AS noise FROM l WHERE pos <= 8),
k AS (SELECT *, count(*) FILTER (t <> '' AND NOT noise) OVER (PARTITION BY date_key, repository) AS real FROM m)
SELECT date_key, repository, coalesce(string_agg('- ' || t, chr(10) ORDER BY pos) FILTER (t <> '' AND (real = 0 OR NOT noise)), 'No remembered activity.') AS summary, count(*) FILTER (t <> '' AND (real = 0 OR NOT noise)) AS episodes FROM k GROUP BY 1, 2"""


@registered("G7_day_summaries", days_sql(EPISODE))
def day_summaries(spark, sf_dir):
    return G.day_summaries(S.episode(spark, sf_dir))


@registered("G7_told_days", days_sql(TOLD))
def told_days(spark, sf_dir):
    return G.day_summaries(S.told_episodes(spark, sf_dir))


@registered("M3_refreshed_days", days_sql(TOLD))
def refreshed_days(spark, sf_dir):
    """Summaries made before the last tenth of the episodes came, then brought up to date for the days that these touch."""
    every = S.told_episodes(spark, sf_dir)
    late = F.pmod(F.xxhash64("session_id"), F.lit(10)) == 0
    return G.refreshed_days(G.day_summaries(every.where(~late)), every, every.where(late))
