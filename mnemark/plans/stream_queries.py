"""Registered queries that run as streams, and the same over tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import bindings as S
from ..functions.text import normalize
from ..sources.store import Store, shared_folder
from ..streaming import drain as D
from ..streaming import rings as R
from .event_queries import QUEUED
from .memory_queries import NORMAL, TRACE, now, registered


def records(rows, key):
    return rows.select(F.col(key).cast("string").alias("key"), F.col("recorded_at").cast("timestamp").alias("at"), "id", F.col("latency_ms").alias("value"))


def streamed(spark, sf_dir, key):
    """The records of ``trace`` as a stream of four batches: 64 files, of which a batch reads sixteen, side by side."""
    where = shared_folder(spark, "stream")
    table = records(S.trace(spark, sf_dir), key)
    table.repartition(64, "id").write.parquet(f"{where}/in")
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 16).parquet(f"{where}/in"), where


METRICS = f"""WITH {TRACE}, ring AS (SELECT hook AS key, latency_ms AS value, recorded_at, id FROM trace WHERE hook IS NOT NULL QUALIFY row_number() OVER (PARTITION BY hook ORDER BY recorded_at DESC, id DESC) <= 200),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY key) AS c FROM ring)
SELECT key, count(*) AS n, max(value) FILTER (pos = floor((c - 1) * 0.5)) AS p50, max(value) FILTER (pos = floor((c - 1) * 0.95)) AS p95, round(avg(value), 6) AS mean, max(value) AS most, arg_max(value, (recorded_at, id)) AS latest,
 CASE WHEN count(*) < 50 THEN 'warming' WHEN max(value) FILTER (pos = floor((c - 1) * 0.95)) <= 150 THEN 'met' ELSE 'missed' END AS target FROM r GROUP BY 1"""


@registered("T4_latency_ring", METRICS)
def latency_ring(spark, sf_dir):
    stream, where = streamed(spark, sf_dir, "hook")
    return R.ring_metrics(R.run_rings(spark, R.ring_of_stream(stream, 200), f"{where}/out", f"{where}/state"), 150.0, 50)


RING = f"""WITH {TRACE}, k AS (SELECT CAST(repository AS VARCHAR) AS key, recorded_at AS at_, id, latency_ms AS value, max(recorded_at) OVER (PARTITION BY repository) AS last_, row_number() OVER (PARTITION BY repository ORDER BY recorded_at DESC, id DESC) AS pos FROM trace WHERE repository IS NOT NULL)
SELECT key, at_ AS at, id, value FROM k WHERE pos <= 5 AND at_ >= last_ - INTERVAL 36 HOUR"""
AGE = 36 * 3600.0


@registered("T6_trace_ring", RING)
def trace_ring(spark, sf_dir):
    stream, where = streamed(spark, sf_dir, "repository")
    return R.run_rings(spark, R.ring_of_stream(stream, 5, AGE), f"{where}/out", f"{where}/state")


@registered("R23_ring_records", RING)
def ring_records(spark, sf_dir):
    return R.ring_of_table(records(S.trace(spark, sf_dir), "repository"), 5, AGE)


@registered("R23_ring_stats", f"""WITH {TRACE}, k AS (SELECT CAST(repository AS VARCHAR) AS key, recorded_at AS t, lead(recorded_at, 5) OVER w AS then_, max(recorded_at) OVER (PARTITION BY repository) AS last_ FROM trace WHERE repository IS NOT NULL WINDOW w AS (PARTITION BY repository ORDER BY recorded_at, id)),
e AS (SELECT *, coalesce(then_ - INTERVAL 36 HOUR <= t, false) AS evicted FROM k), x AS (SELECT *, NOT evicted AND coalesce(then_, last_) - INTERVAL 36 HOUR > t AS expired FROM e)
SELECT key, count(*) AS recorded, count(*) FILTER (NOT evicted AND NOT expired) AS stored, count(*) FILTER (evicted) AS evicted, count(*) FILTER (expired) AS expired FROM x GROUP BY 1""")
def ring_stats(spark, sf_dir):
    return R.ring_stats(records(S.trace(spark, sf_dir), "repository"), 5, AGE)


def digest_of(spark, sf_dir):
    """Work that is done on queued sessions: the digest of an order's price; orders whose price ends in 7 cents fail."""
    orders = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"))
    failed = F.when(F.col("cents") % 10 == 7, F.concat(F.lit("bad price "), F.col("cents").cast("string")))
    return lambda jobs: jobs.select("session_id").join(orders, "session_id").select("session_id", F.md5(F.col("cents").cast("string")).alias("digest"), failed.alias("error"))


CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
#: Jobs that a cycle takes, and cycles.
TAKEN, CYCLES = 700, 3


@registered("P7_drained_queue", f"""WITH {QUEUED}, ready AS (SELECT * FROM jobs WHERE status IN ('pending', 'failed') AND available_at <= TIMESTAMP '1998-01-01 00:00:00'),
taken AS (SELECT *, {CENTS} AS cents FROM ready JOIN orders ON o_orderkey = session_id QUALIFY row_number() OVER (ORDER BY priority DESC, available_at, session_id) <= {TAKEN * CYCLES})
SELECT j.session_id, CASE WHEN t.session_id IS NULL THEN j.status WHEN cents % 10 = 7 THEN 'failed' ELSE 'completed' END AS status, j.attempts + CASE WHEN t.session_id IS NULL THEN 0 ELSE 1 END AS attempts,
 CASE WHEN t.session_id IS NULL THEN j.last_error WHEN cents % 10 = 7 THEN 'bad price ' || cents END AS last_error, CASE WHEN cents % 10 <> 7 THEN md5(cents::varchar) END AS digest FROM jobs j LEFT JOIN taken t USING (session_id)""")
def drained_queue(spark, sf_dir):
    """The most urgent jobs of the queue, worked on in a few cycles; each commits the queue and its results as one version."""
    store = Store(spark, shared_folder(spark, "drain"))
    store.commit({"queue": S.jobs(spark, sf_dir)})
    for _ in range(CYCLES):
        D.drain_once(store, digest_of(spark, sf_dir), now(), TAKEN)
    return store.read("queue").select("session_id", "status", "attempts", "last_error").join(store.read("results"), "session_id", "left")


@registered("P8_controlled_backfill", f"""WITH seen AS (SELECT l_orderkey AS session_id, max(l_shipdate) AS known FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1),
planned AS (SELECT o_orderkey AS session_id, CASE WHEN known IS NULL THEN 'create' ELSE 'refresh' END AS planned, {CENTS} AS cents FROM orders LEFT JOIN seen ON o_orderkey = session_id WHERE known IS NULL OR o_orderdate > known)
SELECT session_id, planned, CASE WHEN cents % 10 = 7 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN cents % 10 <> 7 THEN md5(cents::varchar) END AS digest,
 (SELECT count(*) FROM planned WHERE cents % 10 = 7) AS failed, CASE WHEN (SELECT count(*) FROM planned WHERE cents % 10 = 7) > 0 THEN 'failed' ELSE 'completed' END AS run_status FROM planned""")
def controlled_backfill(spark, sf_dir):
    """A run over all orders that the episodes lack or have older, to its end, in three batches at most."""
    store = Store(spark, shared_folder(spark, "backfill"))
    known = S.table(spark, sf_dir, "lineitem").where("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("session_id")).agg(F.max("l_shipdate").cast("timestamp").alias("updated_at"))
    store.commit({"episode": known})
    orders = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    D.begin_run(store, 1, orders, now(), orders.count() // 2)
    D.run_to_the_end(store, 1, digest_of(spark, sf_dir), now())
    runs, items = D.run_state(store, now())
    run = runs.first()
    rows = items.select("session_id", "planned", "status").join(store.read("results"), "session_id", "left")
    return rows.withColumns({"failed": F.lit(run.failed).cast("long"), "run_status": F.lit(run.status)})


@registered("T3_drained_stream", f"""SELECT conv_id, turn, md5({NORMAL.format('text')}) AS digest, CAST(length({NORMAL.format('text')}) AS BIGINT) AS n FROM conversations""")
def drained_stream(spark, sf_dir):
    """Turns that arrive as files, worked on batch by batch."""
    where = shared_folder(spark, "arrivals")
    table = S.table(spark, sf_dir, "conversations")
    table.repartition(6, "conv_id").write.parquet(f"{where}/in")
    arrivals = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    text = normalize(F.col("text"))
    return D.drain_stream(spark, arrivals, lambda rows: rows.select("conv_id", "turn", F.md5(text).alias("digest"), F.length(text).cast("long").alias("n")), f"{where}/out", f"{where}/state")
