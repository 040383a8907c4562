"""Registered queries of the memory engine over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregates as G
from ..operators import ranking as R
from ..operators import rules as C
from ..operators import state as M
from ..sources import bindings as S
from ..streaming.latency import latency_windows

Query = Callable[[SparkSession, str], DataFrame]
NOW = "1998-01-01 00:00:00"
TODAY = "2024-03-27"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def now():
    return F.lit(NOW).cast("timestamp")


MEMORY = """
lab AS (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id),
memory AS (SELECT d.doc_id AS id, d.text AS content, CASE WHEN d.doc_id % 5 <> 0 THEN d.source END AS repository,
  (['user_preference','rejected_approach','interaction_style','assistant_goal','recurring_mistake','open_loop','blocker','commitment','directive','fact'])[1 + d.doc_id % 10] AS type,
  (['global','transferable','repo'])[1 + d.doc_id % 3] AS scope, CAST(coalesce(quality, 0) * 4 + d.doc_id % 4 AS BIGINT) AS confidence,
  d.lang AS tags, CASE WHEN d.doc_id % 7 = 0 THEN d.doc_id END AS superseded_by, d.doc_id % 5 + 1 AS reinforcement,
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes(d.doc_id) AS updated_at
  FROM documents d LEFT JOIN lab USING (doc_id))
"""
EPISODE = """
episode AS (SELECT doc_id AS session_id, text AS summary, doc_id % 10 AS significance,
  CASE WHEN doc_id % 5 <> 0 THEN source END AS repository, (['global','transferable','repo'])[1 + doc_id % 3] AS scope,
  CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS date_key, doc_id AS updated FROM documents)
"""
TOLD = EPISODE.replace("text AS summary", "CASE WHEN doc_id % 9 < 6 THEN (['Session 0a1b2c3d', 'Worked in src  (0a1b2c3d-99)', ' ', 'Call the tool now', 'Using only local repo files: x', 'Worked in src'])[1 + doc_id % 9] ELSE text END AS summary")
QUEUE = """
queue AS (SELECT o_orderkey AS session_id, o_custkey AS repository, CASE WHEN o_orderkey % 11 = 0 THEN 'failed'
  WHEN o_orderstatus = 'F' THEN 'completed' WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'running' END AS status,
  CAST(substring(o_orderpriority, 1, 1) AS INT) AS priority, o_orderdate AS available_at FROM orders)
"""
TRACE = """
trace AS (SELECT event_id AS id, event_type AS hook, user_id AS repository, value AS latency_ms, ts AS recorded_at,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
"""
WORDS = "list_filter(regexp_split_to_array(lower(coalesce({0}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
STEM = """CASE WHEN length({0}) > 4 AND ends_with({0}, 'ies') THEN left({0}, length({0}) - 3) || 'y'
  WHEN length({0}) > 5 AND ends_with({0}, 'ing') THEN left({0}, length({0}) - 3)
  WHEN length({0}) > 4 AND ends_with({0}, 'ed') THEN left({0}, length({0}) - 2)
  WHEN length({0}) > 4 AND ends_with({0}, 's') THEN left({0}, length({0}) - 1) ELSE {0} END"""
NORMAL = r"trim(regexp_replace(coalesce({0}, ''), '[ \t\r\n\f]+', ' ', 'g'))"


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = X.words(F.col("text"))
    long = F.filter(w, lambda t: F.length(t) > 3)
    return S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_distinct(long).alias("terms"), X.tokens(F.col("text")).alias("stems"))


PROMPTS = f"""
plain AS (SELECT item_id AS query_id, list_filter({WORDS.format('text')}, lambda w: length(w) > 3) AS w FROM benchmark),
asked AS (SELECT DISTINCT query_id, unnest(w) AS term FROM plain),
sizes AS (SELECT query_id, count(*) AS terms FROM asked GROUP BY 1)
"""


def bm25_sql(source: str, doc: str, text: str) -> str:
    return f"""
each AS (SELECT {doc} AS doc, {WORDS.format(text)} AS w FROM {source}),
corpus AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM each),
postings AS (SELECT doc, term, count(*) AS tf, max(dl) AS dl FROM (SELECT doc, len(w) AS dl, unnest(w) AS term FROM each) WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
scored AS (SELECT query_id, doc, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score, count(*) AS held
  FROM postings JOIN asked USING (term) JOIN df USING (term), corpus GROUP BY 1, 2),
hits AS (SELECT query_id, doc, score FROM scored JOIN sizes USING (query_id) WHERE held = terms)
"""


@registered("R4_episode_search", f"""WITH {EPISODE}, {PROMPTS}, {bm25_sql('episode', 'session_id', 'summary')}
SELECT query_id, session_id, score, significance FROM (SELECT query_id, session_id, score, significance, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, significance DESC, updated DESC) AS pos
  FROM hits JOIN episode ON doc = session_id) WHERE pos <= 5""")
def episode_search(spark, sf_dir):
    episodes = S.episode(spark, sf_dir)
    hits = R.bm25(episodes, prompts(spark, sf_dir), "session_id", "summary", "query_id").join(episodes, "session_id")
    return R.first_of(hits, ["query_id"], [F.desc("score"), F.desc("significance"), F.desc("updated")], 5).select("query_id", "session_id", "score", "significance")


@registered("R13_budget_packing", f"""WITH {EPISODE}, costed AS (SELECT *, CAST(ceil(length(summary) / 4.0) AS BIGINT) AS cost FROM episode WHERE length(trim(summary)) > 0),
run AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY date_key ORDER BY updated DESC, session_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS spent FROM costed)
SELECT date_key, session_id, cost, spent FROM run WHERE spent <= 320""")
def budget_packing(spark, sf_dir):
    return R.packed(S.episode(spark, sf_dir), "date_key", [F.desc("updated"), F.col("session_id")], "summary", 320).select("date_key", "session_id", "cost", "spent")


@registered("S3_recent_window", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def recent_window(spark, sf_dir):
    return R.page(S.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.desc("o_orderkey")], 25, 50)


@registered("S4_keyset_page", f"SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate < TIMESTAMP '{NOW}' OR (o_orderdate = TIMESTAMP '{NOW}' AND o_orderkey < 500) ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25")
def keyset_page(spark, sf_dir):
    return R.after(S.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")), "o_orderdate", "o_orderkey", (now(), 500), 25)


@registered("S6_sessions_by_date", "SELECT o_orderkey, o_custkey FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-03-15' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def sessions_by_date(spark, sf_dir):
    orders = S.table(spark, sf_dir, "orders").where(F.to_date("o_orderdate") == F.lit("1995-03-15").cast("date"))
    return orders.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(5).select("o_orderkey", "o_custkey")


@registered("S7_session_artifacts", """SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns,
  max(turn) AS last_turn, arg_max(text, (turn, role, text)) AS last_text FROM conversations GROUP BY conv_id""")
def session_artifacts(spark, sf_dir):
    return S.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"), F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.max("turn").alias("last_turn"), F.max_by("text", F.struct("turn", "role", "text")).alias("last_text"),
    )


@registered("G1_store_stats", f"""WITH {MEMORY} SELECT count(*) AS memories, count(*) FILTER (superseded_by IS NULL) AS active, count(*) FILTER (superseded_by IS NOT NULL) AS superseded,
  count(*) FILTER (superseded_by IS NULL AND scope = 'global') AS scope_global, count(*) FILTER (superseded_by IS NULL AND scope = 'transferable') AS scope_transferable,
  count(*) FILTER (superseded_by IS NULL AND scope = 'repo') AS scope_repo, count(*) FILTER (superseded_by IS NULL AND reinforcement > 1) AS reinforced, CAST(sum(reinforcement) AS BIGINT) AS reinforcements FROM memory""")
def store_stats(spark, sf_dir):
    return G.store_stats(S.memory(spark, sf_dir))


@registered("G2_backfill_rollup", """WITH c AS (SELECT l_orderkey AS run_id, count(*) AS total, count(*) FILTER (l_returnflag NOT IN ('A', 'R')) AS pending, count(*) FILTER (l_returnflag = 'R') AS failed,
  count(*) FILTER (l_returnflag = 'A') AS completed, count(*) FILTER (l_linestatus = 'O') AS creates, max(l_shipdate) AS updated_at FROM lineitem GROUP BY 1)
SELECT *, CASE WHEN pending > 0 THEN 'running' WHEN failed > 0 THEN 'failed' ELSE 'completed' END AS status, CAST(round(100.0 * (completed + failed) / total) AS BIGINT) AS percent FROM c""")
def backfill_rollup(spark, sf_dir):
    return G.rollup_runs(S.backfill_item(spark, sf_dir))


@registered("G4_facets", f"""WITH {MEMORY}, p AS (SELECT 'type' AS facet, type AS value FROM memory UNION ALL SELECT 'scope', scope FROM memory UNION ALL SELECT 'repository', repository FROM memory),
c AS (SELECT facet, value, count(*) AS n FROM p WHERE value IS NOT NULL GROUP BY 1, 2) SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY facet ORDER BY n DESC, value) <= 200""")
def facets(spark, sf_dir):
    return G.facets(S.memory(spark, sf_dir), ["type", "scope", "repository"])


@registered("G5_merged_duplicates", f"""WITH {MEMORY} SELECT type, content_key, arg_max(id, (confidence, reinforcement, updated_at, id)) AS winner, count(*) AS n, max(confidence) AS confidence,
  CAST(sum(reinforcement) AS BIGINT) AS reinforcement, array_to_string(list_sort(list(DISTINCT tags) FILTER (tags IS NOT NULL)), ' ') AS tags
  FROM (SELECT *, md5(lower({NORMAL.format('content')})) AS content_key FROM memory) GROUP BY 1, 2 HAVING count(*) > 1""")
def merged_duplicates(spark, sf_dir):
    return G.merged_duplicates(S.memory(spark, sf_dir).withColumn("content_key", F.md5(F.lower(X.normalize(F.col("content"))))), ["type", "content_key"])


@registered("G8_latency_summary", f"""WITH {TRACE}, r AS (SELECT *, row_number() OVER (PARTITION BY hook ORDER BY latency_ms, id) - 1 AS pos, count(*) OVER (PARTITION BY hook) AS c FROM trace WHERE latency_ms IS NOT NULL),
s AS (SELECT hook, count(*) AS n, max(latency_ms) FILTER (pos = floor((c - 1) * 0.5)) AS p50, max(latency_ms) FILTER (pos = floor((c - 1) * 0.95)) AS p95, max(latency_ms) AS most, round(avg(latency_ms), 6) AS mean,
  arg_max(latency_ms, (recorded_at, id)) AS latest FROM r GROUP BY 1)
SELECT *, CASE WHEN n < 50 THEN 'warming' WHEN p95 <= 150 THEN 'met' ELSE 'missed' END AS target FROM s""")
def latency_summary(spark, sf_dir):
    return G.latency_summary(S.trace(spark, sf_dir), "hook", 150.0, 50)


@registered("G9_latency_trend", f"""WITH {TRACE}, r AS (SELECT hook, latency_ms, row_number() OVER (PARTITION BY hook ORDER BY recorded_at DESC, id DESC) AS pos, count(*) OVER (PARTITION BY hook) AS n FROM trace),
w AS (SELECT *, greatest(1, least(10, n // 2)) AS w FROM r),
m AS (SELECT hook, round(avg(latency_ms) FILTER (pos <= w), 6) AS recent, round(avg(latency_ms) FILTER (pos > w AND pos <= 2 * w), 6) AS previous FROM w GROUP BY 1)
SELECT *, round(recent - previous, 6) AS change, CASE WHEN abs(round(recent - previous, 6)) <= 5 THEN 'flat' WHEN recent > previous THEN 'up' WHEN recent < previous THEN 'down' ELSE 'unknown' END AS trend FROM m""")
def latency_trend(spark, sf_dir):
    return G.latency_trend(S.trace(spark, sf_dir), "hook")


@registered("G12_repeated_lookups", f"WITH {TRACE} SELECT hook, k, count(*) AS n FROM trace GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, hook, k LIMIT 8")
def repeated_lookups(spark, sf_dir):
    return G.repeated(S.trace(spark, sf_dir), ["hook", "k"], 2, 8)


@registered("G22_pattern_highlights", f"""WITH {EPISODE}, t AS (SELECT DISTINCT date_key, session_id, {STEM.format('t')} AS token FROM (SELECT date_key, session_id, unnest({WORDS.format('summary')}) AS t FROM episode)),
c AS (SELECT date_key, token, count(*) AS n FROM t WHERE length(token) > 2 GROUP BY 1, 2 HAVING count(*) > 1)
SELECT date_key, token, n, row_number() OVER (PARTITION BY date_key ORDER BY n DESC, token) AS place FROM c QUALIFY place <= 3""")
def pattern_highlights(spark, sf_dir):
    return G.pattern_highlights(S.episode(spark, sf_dir), "date_key", "summary")


@registered("R15_available_jobs", f"WITH {QUEUE} SELECT * FROM queue WHERE status IN ('pending', 'failed') AND available_at <= TIMESTAMP '{NOW}' ORDER BY priority DESC, available_at, session_id LIMIT 50")
def available_jobs(spark, sf_dir):
    return M.available(S.work_queue(spark, sf_dir), now(), 50)


@registered("R17_queue_view", f"""WITH {QUEUE} SELECT *, CASE status WHEN 'running' THEN 0 WHEN 'pending' THEN 1 WHEN 'failed' THEN 2 ELSE 3 END AS place FROM queue ORDER BY place, priority DESC, available_at, session_id LIMIT 100""")
def queue_view(spark, sf_dir):
    return M.queue_view(S.work_queue(spark, sf_dir), 100)


@registered("R16_retained_traces", f"""WITH {TRACE}, k AS (SELECT * FROM trace WHERE recorded_at >= (SELECT max(ts) FROM events) - INTERVAL 14 DAY QUALIFY row_number() OVER (PARTITION BY repository ORDER BY recorded_at DESC, id DESC) <= 120)
SELECT id, hook, repository FROM k ORDER BY recorded_at DESC, id DESC LIMIT 240""")
def retained_traces(spark, sf_dir):
    rows = S.trace(spark, sf_dir)
    newest = rows.agg((F.max("recorded_at") - F.expr("interval 14 days")).alias("since"))  # one row
    return R.retained(rows.crossJoin(F.broadcast(newest)), "repository", "recorded_at", "id", F.col("since"), 120, 240).select("id", "hook", "repository")


@registered("R21_rotating_window", "SELECT p_partkey, p_name FROM part WHERE ((p_partkey - 17) % 97 + 97) % 97 < 14")
def rotating_window(spark, sf_dir):
    return R.rotating(S.table(spark, sf_dir, "part"), "p_partkey", 97, 17, 14).select("p_partkey", "p_name")


@registered("J10_planned_sessions", """WITH known AS (SELECT l_orderkey AS session_id, max(l_shipdate) AS known_at FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1)
SELECT o_orderkey AS session_id, CASE WHEN known_at IS NULL THEN 'create' WHEN o_orderdate > known_at THEN 'refresh' ELSE 'skip' END AS action FROM orders LEFT JOIN known ON o_orderkey = session_id""")
def planned_sessions(spark, sf_dir):
    candidates = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderdate").alias("at"))
    existing = S.table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_orderkey").alias("session_id"), F.col("l_shipdate").alias("at"))
    return M.planned(candidates, existing, "session_id", "at").select("session_id", "action")


@registered("J12_resolved_approvals", f"""WITH a AS (SELECT s_suppkey AS id, CAST(s_suppkey % 3 AS INT) AS family, CASE WHEN s_suppkey % 4 <> 0 THEN s_nationkey END AS repository, CASE WHEN s_suppkey % 4 IN (1, 2) THEN s_suppkey % 7 END AS target,
  CASE WHEN s_acctbal > 2000 THEN 'allow' ELSE 'deny' END AS decision, s_acctbal AS updated_at, CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '1997-01-01 00:00:00' END AS expires_at FROM supplier),
live AS (SELECT * FROM a WHERE expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}'),
t AS (SELECT family, repository, target, arg_max(decision, (updated_at, id)) AS d1 FROM live WHERE target IS NOT NULL AND repository IS NOT NULL GROUP BY ALL),
r AS (SELECT family, repository, arg_max(decision, (updated_at, id)) AS d2 FROM live WHERE target IS NULL AND repository IS NOT NULL GROUP BY ALL),
g AS (SELECT family, arg_max(decision, (updated_at, id)) AS d3 FROM live WHERE target IS NULL AND repository IS NULL GROUP BY ALL),
q AS (SELECT c_custkey AS request, CAST(c_custkey % 3 AS INT) AS family, c_nationkey AS repository, c_custkey % 7 AS target FROM customer)
SELECT request, coalesce(d1, d2, d3, 'ask') AS decision, CASE WHEN d1 IS NOT NULL THEN 'target' WHEN d2 IS NOT NULL THEN 'repository' WHEN d3 IS NOT NULL THEN 'global' ELSE 'default' END AS source
FROM q LEFT JOIN t USING (family, repository, target) LEFT JOIN r USING (family, repository) LEFT JOIN g USING (family)""")
def resolved_approvals(spark, sf_dir):
    k = F.col("s_suppkey")
    approvals = S.table(spark, sf_dir, "supplier").select(
        k.alias("id"), (k % 3).cast("int").alias("family"), F.when(k % 4 != 0, F.col("s_nationkey")).alias("repository"), F.when((k % 4).isin(1, 2), k % 7).alias("target"),
        F.when(F.col("s_acctbal") > 2000, "allow").otherwise("deny").alias("decision"), F.col("s_acctbal").alias("updated_at"), F.when(k % 5 == 0, F.lit("1997-01-01").cast("timestamp")).alias("expires_at"),
    )
    c = F.col("c_custkey")
    asked = S.table(spark, sf_dir, "customer").select(c.alias("request"), (c % 3).cast("int").alias("family"), F.col("c_nationkey").alias("repository"), (c % 7).alias("target"))
    return M.resolved(asked, approvals, now()).select("request", "decision", "source")


@registered("J15_capability_match", f"""WITH w AS (SELECT p_partkey, p_name AS name, unnest({WORDS.format('p_name')}) AS token, 4 AS weight FROM part UNION ALL SELECT p_partkey, p_name, unnest({WORDS.format("p_brand || ' ' || p_type")}), 3 FROM part),
s AS (SELECT name, token, sum(weight) AS weight FROM w GROUP BY 1, 2), q AS (SELECT DISTINCT c_custkey AS prompt_id, unnest({WORDS.format("c_mktsegment || ' small brass ' || c_name")}) AS token FROM customer)
SELECT prompt_id, name, CAST(sum(weight) AS BIGINT) AS score FROM s JOIN q USING (token) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY sum(weight) DESC, name) <= 3""")
def capability_match(spark, sf_dir):
    parts = S.table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat_ws(" ", "p_brand", "p_type").alias("description"))
    asked = S.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("prompt_id"), F.concat_ws(" small brass ", "c_mktsegment", "c_name").alias("text"))
    return C.best_capabilities(parts, asked, 3)


@registered("C16_due_tasks", f"""SELECT o_orderkey AS task, CASE WHEN o_orderkey % 13 = 0 THEN 'forced' WHEN o_orderkey % 5 = 0 THEN 'never_run' WHEN o_orderkey % 7 = 0 THEN 'always_due'
 WHEN floor((epoch(TIMESTAMP '{NOW}') - epoch(o_orderdate)) / 60) >= CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE (o_orderkey % 7) * 500000 END THEN 'due' ELSE 'within_cadence' END AS reason FROM orders""")
def due_tasks(spark, sf_dir):
    k = F.col("o_orderkey")
    last = F.when(k % 5 != 0, F.col("o_orderdate").cast("timestamp"))
    return S.table(spark, sf_dir, "orders").select(k.alias("task"), C.due(F.lit(None).cast("timestamp"), last, k % 7 * 500000, now(), k % 13 == 0).alias("reason"))


@registered("F14_stalled_jobs", f"""WITH {QUEUE}, s AS (SELECT *, CASE WHEN status = 'running' AND available_at <= TIMESTAMP '{NOW}' - INTERVAL 2 HOUR THEN 'running' WHEN status IN ('pending', 'failed') AND available_at <= TIMESTAMP '{NOW}' - INTERVAL 6 HOUR THEN 'due' END AS stall FROM queue)
SELECT stall, CASE WHEN stall = 'running' THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM s WHERE stall IS NOT NULL GROUP BY 1, 2""")
def stalled_jobs(spark, sf_dir):
    return C.stalled(S.work_queue(spark, sf_dir), now()).groupBy("stall", "severity").agg(F.count(F.lit(1)).alias("n"))


@registered("P18_provenance", f"""WITH {EPISODE}, asked AS (SELECT item_id AS prompt_id, CAST(DATE '2024-01-01' + CAST(item_id % 60 AS INT) AS DATE) AS date_key FROM benchmark),
days AS (SELECT DISTINCT date_key FROM episode WHERE significance = 9), eps AS (SELECT DISTINCT date_key FROM episode WHERE significance > 2), raw AS (SELECT DISTINCT date_key FROM episode)
SELECT prompt_id, date_key, CASE WHEN date_key IN (SELECT date_key FROM days) THEN 'day_summary' WHEN date_key IN (SELECT date_key FROM eps) THEN 'episode_fallback' WHEN date_key IN (SELECT date_key FROM raw) THEN 'session_store_verifier' ELSE 'none' END AS source,
 CASE WHEN date_key IN (SELECT date_key FROM days) THEN 'high' WHEN date_key IN (SELECT date_key FROM eps) THEN 'medium' WHEN date_key IN (SELECT date_key FROM raw) THEN 'low' ELSE 'none' END AS confidence FROM asked""")
def provenance(spark, sf_dir):
    asked = S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("item_id") % 60).cast("int")).alias("date_key"))
    e = S.episode(spark, sf_dir)
    return C.provenance(asked, e.where("significance = 9"), e.where("significance > 2"), e).select("prompt_id", "date_key", "source", "confidence")


@registered("M1_upsert_memory", f"""WITH {MEMORY}, cur AS (SELECT type, md5(content) AS key, max(confidence) AS confidence, CAST(sum(reinforcement) AS BIGINT) AS reinforcement, max(id) AS last_seen, min(tags) AS tags, bool_or(id % 4 = 0) AS manual FROM memory WHERE id % 3 <> 0 GROUP BY 1, 2),
inc AS (SELECT type, md5(content) AS key, arg_max(confidence, (id + 7, confidence)) AS c, CAST(sum(reinforcement) AS BIGINT) AS r, max(id + 7) AS s, list(DISTINCT tags) AS t FROM memory WHERE id % 2 = 0 GROUP BY 1, 2)
SELECT type, key, CASE WHEN c IS NULL THEN confidence WHEN manual THEN greatest(confidence, c) ELSE c END AS confidence, coalesce(reinforcement, 0) + coalesce(r, 0) AS reinforcement, greatest(last_seen, s) AS last_seen,
 array_to_string(list_sort(list_distinct(list_concat(CASE WHEN tags IS NULL THEN [] ELSE [tags] END, coalesce(t, [])))), ' ') AS tags, coalesce(manual, false) AS manual FROM cur FULL JOIN inc USING (type, key)""")
def upsert_memory(spark, sf_dir):
    rows = S.memory(spark, sf_dir).withColumn("key", F.md5("content"))
    current = rows.where("id % 3 <> 0").groupBy("type", "key").agg(
        F.max("confidence").alias("confidence"), F.sum("reinforcement").alias("reinforcement"), F.max("id").alias("last_seen"), F.min("tags").alias("tags"), F.bool_or(F.col("id") % 4 == 0).alias("manual")
    )
    return M.upsert_memory(current, rows.where("id % 2 = 0").withColumn("last_seen", F.col("id") + 7))


@registered("M10_soft_delete", f"WITH {MEMORY} SELECT id, CASE WHEN id % 6 = 1 THEN CASE WHEN id % 4 = 3 THEN 'manual:1998-01-01T00:00:00.000Z' ELSE CAST(id + 1 AS VARCHAR) END ELSE CAST(superseded_by AS VARCHAR) END AS superseded_by, id % 6 = 1 AS moved FROM memory")
def soft_delete(spark, sf_dir):
    rows = S.memory(spark, sf_dir)
    named = rows.where("id % 6 = 1").select("id", F.when(F.col("id") % 4 != 3, F.col("id") + 1).alias("by"))
    return M.soft_deleted(rows, named, now()).select("id", "superseded_by", (F.col("updated_at") == now()).alias("moved"))


@registered("U1_latest_activity", "SELECT * FROM (SELECT 'events' AS source, CAST(max(ts) AS TIMESTAMP) AS happened_at FROM events UNION ALL SELECT 'orders', max(o_orderdate) FROM orders UNION ALL SELECT 'lineitem', max(l_shipdate) FROM lineitem) ORDER BY happened_at DESC, source LIMIT 1")
def latest_activity(spark, sf_dir):
    return M.latest_activity(*[(n, S.table(spark, sf_dir, n).withColumn("_at", F.col(c).cast("timestamp")), "_at") for n, c in (("events", "ts"), ("orders", "o_orderdate"), ("lineitem", "l_shipdate"))])


@registered("X_text_functions", rf"""SELECT doc_id, md5({NORMAL.format('text')}) AS normal, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost, CASE WHEN length(text) > 72 THEN rtrim(left(text, 71)) || '…' ELSE text END AS short,
 left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug, array_to_string(list_transform({WORDS.format('text')}, lambda w: {STEM.format('w')}), ' ') AS stems FROM documents""")
def text_functions(spark, sf_dir):
    t = F.col("text")
    return S.table(spark, sf_dir, "documents").select(
        "doc_id", F.md5(X.normalize(t)).alias("normal"), X.estimated_tokens(t).alias("cost"), X.truncated(t, 72).alias("short"), X.slug(t).alias("slug"),
        F.array_join(F.transform(X.words(t), X.stem_word), " ").alias("stems"),
    )


@registered("X18_hashed_pick", "SELECT p_partkey, CAST(list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda h, c: (h * 31 + c) % 2147483647) % 7 AS BIGINT) AS pick FROM part")
def hashed_pick(spark, sf_dir):
    return S.table(spark, sf_dir, "part").select("p_partkey", X.hashed_pick(F.col("p_name"), 7).alias("pick"))


@registered("X19_without_blocks", r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', '', 'gis'), '<style[^>]*>.*?</style>', '', 'gis')) AS body FROM pages")
def without_blocks(spark, sf_dir):
    return S.table(spark, sf_dir, "pages").select("page_id", F.md5(X.before_headings(X.without_blocks(F.col("html"), ("script", "style")))).alias("body"))


LEADS = ("what did we do today ", "yesterday we ", "on 2024-01-15 ", "last monday ", "march 15 ", "april 1 ", "last sunday ", "")
DAYS = ("DATE '2024-03-27'", "DATE '2024-03-26'", "DATE '2024-01-15'", "DATE '2024-03-25'", "DATE '2024-03-15'", "DATE '2023-04-01'", "DATE '2024-03-24'", "NULL")


@registered("X12_inferred_date", f"SELECT item_id, CAST(CASE item_id % 8 {' '.join(f'WHEN {i} THEN {d}' for i, d in enumerate(DAYS))} END AS DATE) AS day FROM benchmark")
def inferred_date(spark, sf_dir):
    lead = F.array(*map(F.lit, LEADS))[(F.col("item_id") % 8).cast("int")]
    return S.table(spark, sf_dir, "benchmark").select("item_id", X.inferred_date(F.concat(lead, F.coalesce("text", F.lit(""))), F.lit(TODAY).cast("date")).alias("day"))


@registered("P15_graph_edges", """SELECT DISTINCT 'placed_by' AS kind, 'order' AS from_kind, CAST(o_orderkey AS VARCHAR) AS from_id, 'customer' AS to_kind, CAST(o_custkey AS VARCHAR) AS to_id FROM orders
UNION ALL SELECT DISTINCT 'lives_in', 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR) FROM customer""")
def graph_edges(spark, sf_dir):
    orders, customers = S.table(spark, sf_dir, "orders"), S.table(spark, sf_dir, "customer")
    nodes = [("order", orders, "o_orderkey"), ("customer", customers, "c_custkey")]
    return C.graph(nodes, [("placed_by", orders, "order", "o_orderkey", "customer", "o_custkey"), ("lives_in", customers, "customer", "c_custkey", "nation", "c_nationkey")])[1]


@registered("T4_latency_windows", f"WITH {TRACE} SELECT time_bucket(INTERVAL 1 HOUR, recorded_at) AS began, hook, count(*) AS n, round(sum(latency_ms), 4) AS total, max(latency_ms) AS most FROM trace GROUP BY 1, 2")
def windows_of_latency(spark, sf_dir):
    return latency_windows(S.trace(spark, sf_dir))
