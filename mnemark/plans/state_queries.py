"""Registered queries on state: merges, queues, overrides, approvals, and what is told of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import diagnostics as D
from ..operators import snapshots as P
from ..sources import bindings as S
from .memory_queries import EPISODE, MEMORY, NORMAL, NOW, QUEUE, STEM, TOLD, TRACE, WORDS, now, registered
from .prompt_queries import any_of

def number():
    return F.col("id")


@registered("M1_insert_memories", f"""WITH {MEMORY}, m AS (SELECT type, md5(content) AS key, scope, coalesce(repository, '') AS r, id % 8 = 0 AS manual, id % 6 = 0 AS saved, confidence, reinforcement, id AS last_seen, tags FROM memory),
cur AS (SELECT type, key, scope, r, bool_or(manual) AS manual, bool_or(saved) AS saved, max(confidence) AS confidence, CAST(sum(reinforcement) AS BIGINT) AS reinforcement, max(last_seen) AS last_seen, min(tags) AS tags FROM m WHERE last_seen % 3 <> 0 GROUP BY ALL),
pins AS (SELECT type, key, max((last_seen, scope, r)) AS p FROM cur WHERE manual GROUP BY ALL),
inc AS (SELECT m.type, m.key, CASE WHEN p IS NOT NULL THEN p[2] ELSE m.scope END AS scope, CASE WHEN p IS NOT NULL THEN p[3] ELSE m.r END AS r, p IS NOT NULL AS pinned, saved, confidence, reinforcement, last_seen, tags FROM m LEFT JOIN pins ON m.type = pins.type AND m.key = pins.key WHERE last_seen % 2 = 0),
f AS (SELECT type, key, scope, r, bool_or(pinned) AS pinned, bool_or(saved) AS s, max(confidence) AS most, arg_max(confidence, (last_seen, confidence)) AS lastc, CAST(sum(reinforcement) AS BIGINT) AS n, max(last_seen) AS seen, list(DISTINCT tags) FILTER (tags IS NOT NULL) AS t FROM inc GROUP BY ALL)
SELECT type, key, scope, nullif(r, '') AS repository, coalesce(manual, false) AS manual, coalesce(saved, false) OR coalesce(s, false) AS saved,
 CASE WHEN n IS NULL THEN confidence WHEN manual IS NULL THEN lastc WHEN coalesce(pinned, false) OR ((manual OR saved) AND NOT s) THEN greatest(confidence, most) ELSE lastc END AS confidence,
 coalesce(reinforcement, 0) + coalesce(n, 0) AS reinforcement, greatest(last_seen, seen) AS last_seen,
 array_to_string(list_concat(CASE WHEN tags IS NULL THEN [] ELSE [tags] END, list_filter(list_sort(coalesce(t, [])), lambda x: tags IS NULL OR x <> tags)), ' ') AS tags FROM cur FULL JOIN f USING (type, key, scope, r)""")
def insert_memories(spark, sf_dir):
    m = S.memory(spark, sf_dir).select("type", F.md5("content").alias("key"), "scope", "repository", (number() % 8 == 0).alias("manual"), (number() % 6 == 0).alias("saved"), "confidence", "reinforcement", number().alias("last_seen"), "tags")
    current = m.where("last_seen % 3 <> 0").groupBy("type", "key", "scope", "repository").agg(
        F.bool_or("manual").alias("manual"), F.bool_or("saved").alias("saved"), F.max("confidence").alias("confidence"), F.sum("reinforcement").alias("reinforcement"), F.max("last_seen").alias("last_seen"), F.min("tags").alias("tags")
    )
    return P.insert_memories(current, m.where("last_seen % 2 = 0"))


@registered("M2_upsert_episodes", f"""WITH {EPISODE}, cur AS (SELECT session_id, summary, scope, repository, session_id % 7 = 0 AS manual, updated AS created_at, updated AS updated_at FROM episode WHERE session_id % 3 <> 0),
b AS (SELECT session_id, md5(summary) AS summary, 'repo' AS scope, 'moved' AS repository, updated + 5 AS updated_at FROM episode WHERE session_id % 2 = 0)
SELECT session_id, md5(CASE WHEN b.updated_at IS NOT NULL THEN b.summary ELSE cur.summary END) AS summary, CASE WHEN b.updated_at IS NOT NULL AND NOT coalesce(manual, false) THEN b.scope ELSE cur.scope END AS scope,
 CASE WHEN b.updated_at IS NOT NULL AND NOT coalesce(manual, false) THEN b.repository ELSE cur.repository END AS repository, coalesce(manual, false) AS manual, coalesce(created_at, b.updated_at) AS created_at,
 coalesce(b.updated_at, cur.updated_at) AS updated_at FROM cur FULL JOIN b USING (session_id)""")
def upsert_episodes(spark, sf_dir):
    e = S.episode(spark, sf_dir)
    current = e.where("session_id % 3 <> 0").select("session_id", "summary", "scope", "repository", (F.col("session_id") % 7 == 0).alias("manual"), F.col("updated").alias("created_at"), F.col("updated").alias("updated_at"))
    batch = e.where("session_id % 2 = 0").select("session_id", F.md5("summary").alias("summary"), F.lit("repo").alias("scope"), F.lit("moved").alias("repository"), (F.col("updated") + 5).alias("updated_at"))
    return P.upsert_episodes(current, batch).withColumn("summary", F.md5("summary"))


@registered("M4_upsert_domains", """WITH t AS (SELECT lower(c_mktsegment) || (c_custkey % 40) AS domain_key, arg_max(c_name, c_custkey) AS title, max(c_custkey) AS updated_at FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1),
b AS (SELECT lower(trim(CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE ' ' || c_mktsegment || (c_custkey % 50) END)) AS domain_key, arg_max(CASE WHEN c_custkey % 4 > 0 THEN c_name END, c_custkey) AS title, max(c_custkey) AS updated_at FROM customer WHERE c_custkey % 3 = 0 GROUP BY 1),
c AS (SELECT lower(trim(' ' || c_mktsegment || (c_custkey % 50))) AS domain_key, max((c_custkey, CASE WHEN c_custkey % 4 > 0 THEN c_name END)) AS x FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 9 <> 0 GROUP BY 1)
SELECT domain_key, coalesce(x[2], title) AS title, coalesce(x[1], updated_at) AS updated_at FROM t FULL JOIN c USING (domain_key)""")
def upsert_domains(spark, sf_dir):
    c, k = S.table(spark, sf_dir, "customer"), F.col("c_custkey")
    held = c.where(k % 2 == 0).groupBy(F.concat(F.lower("c_mktsegment"), (k % 40).cast("string")).alias("domain_key")).agg(F.max_by("c_name", k).alias("title"), F.max(k).alias("updated_at"))
    key = F.when(k % 9 == 0, " ").otherwise(F.concat(F.lit(" "), "c_mktsegment", (k % 50).cast("string")))
    batch = c.where(k % 3 == 0).select(key.alias("domain_key"), F.when(k % 4 > 0, F.col("c_name")).alias("title"), k.alias("updated_at"))
    return P.upsert_keyed(held, batch, "domain_key", ["title"], "updated_at")


@registered("M7_activity", f"""WITH {QUEUE}, s AS (SELECT repository, available_at AS happened, CASE WHEN priority > 2 THEN session_id END AS extraction, CASE WHEN priority < 4 THEN session_id END AS maintenance FROM queue),
n AS (SELECT 'repo:' || repository AS scope_key, * FROM s UNION ALL SELECT 'global', * FROM s),
x AS (SELECT scope_key, (max((happened, extraction)) FILTER (extraction IS NOT NULL))[2] AS extraction, (max((happened, maintenance)) FILTER (maintenance IS NOT NULL))[2] AS maintenance FROM n GROUP BY 1),
held AS (SELECT 'repo:' || c_custkey AS scope_key, -c_custkey AS extraction, CASE WHEN c_custkey % 2 = 0 THEN -c_nationkey END AS maintenance FROM customer)
SELECT coalesce(x.scope_key, held.scope_key) AS scope_key, coalesce(x.extraction, held.extraction) AS extraction, coalesce(x.maintenance, held.maintenance) AS maintenance FROM x FULL JOIN held ON x.scope_key = held.scope_key""")
def activity(spark, sf_dir):
    s = S.work_queue(spark, sf_dir).select(F.col("repository").cast("string").alias("repository"), F.col("available_at").alias("at"), F.when(F.col("priority") > 2, F.col("session_id")).alias("extraction"), F.when(F.col("priority") < 4, F.col("session_id")).alias("maintenance"))
    c = F.col("c_custkey")
    held = S.table(spark, sf_dir, "customer").select(F.concat(F.lit("repo:"), c.cast("string")).alias("scope_key"), (-c).alias("extraction"), F.when(c % 2 == 0, -F.col("c_nationkey")).cast("long").alias("maintenance"))
    return P.activity(held, s, ["extraction", "maintenance"], "at")


@registered("M8_task_results", """WITH r AS (SELECT l_linestatus || (l_suppkey % 9) AS task, CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE CASE WHEN l_quantity > 25 THEN 'needs_attention' ELSE 'skipped' END END AS status,
 CASE WHEN l_linenumber % 2 = 0 THEN l_shipdate - INTERVAL 1 DAY END AS started, l_shipdate AS happened FROM lineitem),
x AS (SELECT task, count(*) AS r, count(*) FILTER (status = 'failed') AS f, count(*) FILTER (status = 'needs_attention') AS a, max((happened, status)) AS last, (max((happened, status, started)) FILTER (started IS NOT NULL))[3] AS began FROM r GROUP BY 1),
held AS (SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'F' ELSE 'Z' END || n_nationkey AS task, n_nationkey AS runs, n_nationkey // 2 AS failures, CAST(1 AS BIGINT) AS attention, 'running' AS last_status, TIMESTAMP '1990-01-01' AS last_started, CAST(NULL AS TIMESTAMP) AS last_completed FROM nation)
SELECT coalesce(x.task, h.task) AS task, CAST(coalesce(runs, 0) + coalesce(r, 0) AS BIGINT) AS runs, CAST(coalesce(failures, 0) + coalesce(f, 0) AS BIGINT) AS failures, coalesce(attention, 0) + coalesce(a, 0) AS attention, coalesce(last[2], last_status) AS last_status,
 coalesce(began, last_started) AS last_started, CASE WHEN x.task IS NULL THEN last_completed ELSE last[1] END AS last_completed FROM x FULL JOIN held h ON x.task = h.task""")
def task_results(spark, sf_dir):
    flag, n = F.col("l_returnflag"), F.col("n_nationkey")
    status = F.when(flag == "A", "completed").when(flag == "R", "failed").when(F.col("l_quantity") > 25, "needs_attention").otherwise("skipped")
    at = F.col("l_shipdate").cast("timestamp")
    r = S.table(spark, sf_dir, "lineitem").select(F.concat("l_linestatus", (F.col("l_suppkey") % 9).cast("string")).alias("task"), status.alias("status"), F.when(F.col("l_linenumber") % 2 == 0, at - F.expr("interval 1 day")).alias("started"), at.alias("at"))
    held = S.table(spark, sf_dir, "nation").select(
        F.concat(F.when(n % 2 == 0, "F").otherwise("Z"), n.cast("string")).alias("task"), n.cast("long").alias("runs"), F.floor(n / 2).alias("failures"), F.lit(1).cast("long").alias("attention"),
        F.lit("running").alias("last_status"), F.lit("1990-01-01").cast("timestamp").alias("last_started"), F.lit(None).cast("timestamp").alias("last_completed"),
    )
    return P.task_results(held, r)


SOURCED = "src AS (SELECT *, id % 97 AS session_id, (['rule_extractor', 'memory_save', NULL, 'onboarding'])[1 + id % 4] AS origin, id % 10 = 3 AS by_hand FROM memory)"


def sourced(spark, sf_dir):
    return S.memory(spark, sf_dir).withColumns({"session_id": number() % 97, "source": F.array(F.lit("rule_extractor"), F.lit("memory_save"), F.lit(None), F.lit("onboarding"))[(number() % 4).cast("int")], "manual": number() % 10 == 3})


@registered("M11_without_generated", f"WITH {MEMORY}, {SOURCED} SELECT id, session_id FROM src WHERE session_id NOT IN (SELECT DISTINCT c_nationkey FROM customer) OR coalesce(origin, '') IN ('memory_save', 'onboarding') OR by_hand")
def without_generated(spark, sf_dir):
    return P.without_generated(sourced(spark, sf_dir), S.table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("session_id"))).select("id", "session_id")


@registered("G6_generated_counts", f"WITH {MEMORY}, {SOURCED} SELECT session_id, count(*) AS generated FROM src WHERE coalesce(origin, '') NOT IN ('memory_save', 'onboarding') GROUP BY 1")
def generated_counts(spark, sf_dir):
    return P.generated_counts(sourced(spark, sf_dir))


OVERRIDES = f"""WITH {MEMORY}, m AS (SELECT id, type, scope, CASE WHEN scope <> 'global' THEN repository END AS repository, (['repo', 'global'])[1 + id % 2] AS auto_scope, id % 5 = 0 AS manual FROM memory),
r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'clear' ELSE 'set' END AS action, (['global', 'transferable', 'repo'])[1 + c_nationkey % 3] AS new, CASE WHEN c_nationkey % 2 = 0 THEN 'src1' END AS repo FROM customer),
n AS (SELECT *, CASE action WHEN 'set' THEN new WHEN 'clear' THEN auto_scope ELSE scope END AS new_scope, CASE WHEN action = 'set' THEN coalesce(repo, repository) ELSE repository END AS place FROM m FULL JOIN r USING (id)),
e AS (SELECT *, CASE WHEN new_scope <> 'global' THEN place END AS new_repository, type IS NOT NULL AS found FROM n)"""


def overrides(spark, sf_dir):
    memory = S.memory(spark, sf_dir).select("id", "type", "scope", F.when(F.col("scope") != "global", F.col("repository")).alias("repository"), F.array(F.lit("repo"), F.lit("global"))[(number() % 2).cast("int")].alias("auto_scope"), (number() % 5 == 0).alias("manual"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    requests = S.table(spark, sf_dir, "customer").select(
        k.alias("id"), F.when(k % 3 == 0, "clear").otherwise("set").alias("action"), F.array(*map(F.lit, S.SCOPES))[(n % 3).cast("int")].alias("scope"), F.when(n % 2 == 0, "src1").alias("repository"), k.alias("at")
    )
    return P.scope_overrides(memory, requests)


@registered("M12_override_preview", OVERRIDES + """ SELECT id, found, coalesce(found AND NOT (new_scope IS NOT DISTINCT FROM scope AND new_repository IS NOT DISTINCT FROM repository), false) AS changed, scope, new_scope, repository, new_repository FROM e WHERE action IS NOT NULL""")
def override_preview(spark, sf_dir):
    return overrides(spark, sf_dir)[0]


@registered("M12_overridden", OVERRIDES + """ SELECT id, CASE WHEN action IS NOT NULL THEN new_scope ELSE scope END AS scope, CASE WHEN action IS NOT NULL THEN new_repository ELSE repository END AS repository,
 CASE action WHEN 'set' THEN true WHEN 'clear' THEN false ELSE manual END AS manual FROM e WHERE found""")
def overridden(spark, sf_dir):
    return overrides(spark, sf_dir)[1]


APPROVING = """a AS (SELECT s_suppkey % 3 AS family, CASE WHEN s_suppkey % 4 <> 0 THEN s_suppkey % 5 - 1 END AS repository, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey % 7 END AS target, CASE WHEN s_acctbal > 2000 THEN 'allow' ELSE 'deny' END AS decision, s_suppkey % 5 = 0 AS durable,
 CASE WHEN s_suppkey % 7 = 0 THEN TIMESTAMP '1997-01-01 00:00:00' END AS expires_at, s_suppkey AS created_at, s_suppkey AS updated_at FROM supplier),
q AS (SELECT c_custkey % 3 AS family, CASE WHEN c_custkey % 4 <> 0 THEN c_custkey % 5 - 1 END AS repository, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 11 END AS target, CASE WHEN c_acctbal > 0 THEN 'allow' ELSE 'deny' END AS decision, c_nationkey = 3 AS durable,
 CASE WHEN c_nationkey = 7 THEN TIMESTAMP '1996-01-01 00:00:00' WHEN c_nationkey = 8 THEN TIMESTAMP '1999-01-01 00:00:00' END AS expires_at, 100000 + c_custkey AS happened FROM customer)"""


@registered("M13_recorded_approvals", f"""WITH RECURSIVE {APPROVING},
ids AS (SELECT row_number() OVER (ORDER BY family, repository, target) AS k, * FROM (SELECT DISTINCT family, repository, target FROM (SELECT family, repository, target FROM a UNION ALL SELECT family, repository, target FROM q))),
keyed AS (SELECT k, a.*, row_number() OVER (PARTITION BY k ORDER BY created_at) AS nth FROM a JOIN ids i ON a.family = i.family AND a.repository IS NOT DISTINCT FROM i.repository AND a.target IS NOT DISTINCT FROM i.target),
asks AS (SELECT k, q.*, row_number() OVER (PARTITION BY k ORDER BY happened) AS n FROM q JOIN ids i ON q.family = i.family AND q.repository IS NOT DISTINCT FROM i.repository AND q.target IS NOT DISTINCT FROM i.target),
walk AS (SELECT i.k, 0::bigint AS n, f.k IS NOT NULL AS there, f.decision, f.durable, f.expires_at, f.created_at, f.updated_at, false AS adds FROM ids i LEFT JOIN keyed f ON f.k = i.k AND f.nth = 1
 UNION ALL SELECT w.k, s.n, true, CASE WHEN l.free THEN s.decision ELSE w.decision END, CASE WHEN l.free THEN s.durable ELSE w.durable END, CASE WHEN l.free THEN s.expires_at ELSE w.expires_at END, CASE WHEN w.there THEN w.created_at ELSE s.happened END,
  CASE WHEN l.free THEN s.happened ELSE w.updated_at END, NOT l.free FROM walk w JOIN asks s ON s.k = w.k AND s.n = w.n + 1, LATERAL (SELECT NOT w.there OR (NOT w.durable AND coalesce(w.expires_at >= TIMESTAMP '{NOW}', true)) AS free) l),
firsts AS (SELECT * FROM walk WHERE there QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1)
SELECT family, repository, target, f.decision, f.durable, f.expires_at, f.created_at, f.updated_at FROM firsts f JOIN ids USING (k)
UNION ALL SELECT family, repository, target, decision, durable, expires_at, created_at, updated_at FROM keyed WHERE nth > 1
UNION ALL SELECT s.family, s.repository, s.target, s.decision, s.durable, s.expires_at, s.happened, s.happened FROM asks s JOIN walk w ON w.k = s.k AND w.n = s.n WHERE w.adds""")
def recorded_approvals(spark, sf_dir):
    k, c, nation = F.col("s_suppkey"), F.col("c_custkey"), F.col("c_nationkey")
    place = lambda x, m: (
        (x % 3).alias("family"), F.when(x % 4 != 0, x % 5 - 1).alias("repository"), F.when(x % 2 == 0, x % m).alias("target"))
    day = lambda d: F.lit(d).cast("timestamp")
    held = S.table(spark, sf_dir, "supplier").select(
        *place(k, 7), F.when(F.col("s_acctbal") > 2000, "allow").otherwise("deny").alias("decision"), (k % 5 == 0).alias("durable"), F.when(k % 7 == 0, day("1997-01-01")).alias("expires_at"), k.alias("created_at"), k.alias("updated_at"),
    )
    asked = S.table(spark, sf_dir, "customer").select(
        *place(c, 11), F.when(F.col("c_acctbal") > 0, "allow").otherwise("deny").alias("decision"), (nation == 3).alias("durable"),
        F.when(nation == 7, day("1996-01-01")).when(nation == 8, day("1999-01-01")).alias("expires_at"), (c + 100000).alias("at"),
    )
    return P.record_approvals(held, asked, now())


@registered("G3_cluster_summaries", f"WITH {MEMORY} SELECT md5(lower({NORMAL.format('content')})) AS canonical, count(*) AS n, count(*) FILTER (superseded_by IS NULL) AS active, CAST(sum(reinforcement) AS BIGINT) AS reinforcement FROM memory GROUP BY 1")
def cluster_summaries(spark, sf_dir):
    return D.cluster_summaries(keyed_memory(spark, sf_dir), "canonical")


def keyed_memory(spark, sf_dir):
    from ..functions.text import normalize

    return S.memory(spark, sf_dir).withColumn("canonical", F.md5(F.lower(normalize(F.col("content")))))


@registered("G11_hit_rates", """WITH l AS (SELECT l_returnflag || l_linestatus || (l_suppkey % 7) AS name, l_linenumber % 4 AS matched, l_linenumber % 3 AS included, CAST(l_quantity AS BIGINT) AS dropped FROM lineitem),
s AS (SELECT name, count(*) AS seen, count(*) FILTER (matched > 0) AS hits, count(*) FILTER (included > 0) AS used, CAST(sum(dropped) AS BIGINT) AS dropped FROM l GROUP BY 1)
SELECT *, round(hits / seen, 4) AS hit_rate, round(used / seen, 4) AS use_rate FROM s ORDER BY used / seen DESC, hits / seen DESC, name LIMIT 8""")
def hit_rates(spark, sf_dir):
    rows = S.table(spark, sf_dir, "lineitem").select(
        F.concat("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 7).cast("string")).alias("name"), (F.col("l_linenumber") % 4).alias("matched"), (F.col("l_linenumber") % 3).alias("included"), F.col("l_quantity").cast("long").alias("dropped")
    )
    return D.hit_rates(rows)


def routed(spark, sf_dir):
    return S.trace(spark, sf_dir).withColumns({"route": F.concat(F.lit("r"), (F.col("repository") % 4).cast("string")), "injected": F.col("latency_ms") > 50, "reason": F.concat(F.lit("k"), (F.col("k") % 5).cast("string"))})


@registered("G13_routes", f"WITH {TRACE} SELECT hook, 'r' || (repository % 4) AS route, count(*) AS n, count(*) FILTER (latency_ms > 50) AS with_context FROM trace GROUP BY 1, 2")
def route_counts(spark, sf_dir):
    return D.routes(routed(spark, sf_dir))


@registered("G21_reasons", f"""WITH {TRACE}, c AS (SELECT hook, 'k' || (k % 5) AS reason, count(*) AS n FROM trace WHERE k IS NOT NULL GROUP BY 1, 2) SELECT hook, string_agg(reason || ' x' || n, ', ' ORDER BY n DESC, reason) AS reasons FROM c GROUP BY 1""")
def left_out(spark, sf_dir):
    return D.reasons(routed(spark, sf_dir).where("reason is not null"), ["hook"])


@registered("G18_themes", "SELECT p_brand AS kind, CAST(p_size % 6 AS INT) AS theme, count(*) AS n, max(p_partkey) AS updated_at FROM part GROUP BY 1, 2 HAVING count(*) >= 2 ORDER BY n DESC, updated_at DESC, kind, theme LIMIT 5")
def improvement_themes(spark, sf_dir):
    return D.themes_of(S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind"), (F.col("p_size") % 6).cast("int").alias("theme"), F.col("p_partkey").alias("updated_at")))


@registered("G19_newest_kinds", f"WITH {TRACE} SELECT hook, count(*) AS n FROM (SELECT hook FROM trace ORDER BY recorded_at DESC, id DESC LIMIT 200) GROUP BY 1")
def newest_kinds(spark, sf_dir):
    return D.newest_kinds(S.trace(spark, sf_dir), [F.desc("recorded_at"), F.desc("id")], 200, "hook")


PARTS = f"w AS (SELECT p_name AS name, unnest({WORDS.format('p_name')}) AS token, 4 AS weight FROM part UNION ALL SELECT p_name, unnest({WORDS.format('p_type')}), 3 FROM part)"


@registered("G29_keyword_weights", f"WITH {PARTS}, s AS (SELECT name, token, CAST(sum(weight) AS BIGINT) AS weight FROM w GROUP BY 1, 2) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY name ORDER BY weight DESC, token) <= 3")
def keyword_weights(spark, sf_dir):
    from ..functions.text import words

    p = S.table(spark, sf_dir, "part")
    each = [p.select(F.col("p_name").alias("name"), F.explode(words(F.col(c))).alias("token"), F.lit(w).alias("weight")) for c, w in (("p_name", 4), ("p_type", 3))]
    return D.keyword_weights(each[0].union(each[1]), 3)


EXPECTED = """x AS (SELECT c_custkey % 500 AS case_id, c_custkey AS item, lower(left(c_mktsegment, 4)) AS snippet, CASE WHEN c_custkey % 3 = 0 THEN [] WHEN c_custkey % 3 = 1 THEN ['F', 'O'] ELSE ['P'] END AS kinds FROM customer),
r AS (SELECT o_orderkey % 500 AS case_id, o_orderstatus AS kind, o_orderpriority || CASE WHEN o_orderkey % 3 = 0 THEN ' building' WHEN o_orderkey % 7 = 0 THEN ' MACHINERY  x' ELSE '' END AS text, o_orderkey AS rank, o_orderkey % 4 = 0 AS included FROM orders),
h AS (SELECT x.case_id, item, min(rank) FILTER (hit) AS best_rank, count(*) FILTER (hit AND included) AS a, count(*) FILTER (hit) AS b FROM (SELECT x.case_id, item, rank, included, coalesce(contains(lower(text), snippet) AND (len(kinds) = 0 OR list_contains(kinds, kind)), false) AS hit FROM x LEFT JOIN r USING (case_id)) x GROUP BY 1, 2),
o AS (SELECT case_id, item, best_rank, CASE WHEN a > 0 THEN 'included' WHEN b > 0 THEN 'ranked_only' ELSE 'missing' END AS outcome FROM h)"""


def expected(spark, sf_dir):
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    none = F.array().cast("array<string>")
    items = S.table(spark, sf_dir, "customer").select(
        (k % 500).alias("case_id"), k.alias("item"), F.substring("c_mktsegment", 1, 4).alias("snippet"), F.when(k % 3 == 0, none).when(k % 3 == 1, F.array(F.lit("F"), F.lit("O"))).otherwise(F.array(F.lit("P"))).alias("kinds")
    )
    text = F.concat("o_orderpriority", F.when(o % 3 == 0, " building").when(o % 7 == 0, " MACHINERY  x").otherwise(""))
    shown = S.table(spark, sf_dir, "orders").select((o % 500).alias("case_id"), F.col("o_orderstatus").alias("kind"), text.alias("text"), o.alias("rank"), (o % 4 == 0).alias("included"))
    return D.evidence(items, shown)


@registered("C17_backfill_decisions", f"""WITH {QUEUE}, r AS (SELECT repository, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status IN ('pending', 'failed')) AS waiting FROM queue GROUP BY 1)
SELECT repository, CASE WHEN running > 0 THEN 'resume' WHEN waiting = 0 THEN 'skip' ELSE 'start' END AS decision FROM r""")
def backfill_decisions(spark, sf_dir):
    return D.backfill_decisions(S.work_queue(spark, sf_dir))


@registered("P10_upkeep_plan", f"""WITH t AS (SELECT n_name AS task, n_nationkey AS place, (n_nationkey % 4) * 500000 AS cadence, n_nationkey % 6 <> 5 AS enabled FROM nation),
s AS (SELECT n_name AS task, max(CAST(o_orderdate AS TIMESTAMP)) AS last FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_nationkey % 5 <> 2 GROUP BY 1),
w AS (SELECT t.*, CASE WHEN last IS NULL THEN 'never_run' WHEN cadence = 0 THEN 'always_due' WHEN floor((epoch(TIMESTAMP '{NOW}') - epoch(last)) / 60) >= cadence THEN 'due' ELSE 'within_cadence' END AS reason FROM t LEFT JOIN s USING (task)),
p AS (SELECT *, reason <> 'within_cadence' AND enabled AS wanted FROM w)
SELECT task, reason, wanted AND sum(CASE WHEN wanted THEN 1 ELSE 0 END) OVER (ORDER BY place, task ROWS UNBOUNDED PRECEDING) <= 4 AS selected FROM p""")
def upkeep_plan(spark, sf_dir):
    n = S.table(spark, sf_dir, "nation")
    tasks = n.select(F.col("n_name").alias("task"), F.col("n_nationkey").alias("place"), (F.col("n_nationkey") % 4 * 500000).alias("cadence"), (F.col("n_nationkey") % 6 != 5).alias("enabled"))
    ran = n.join(S.table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey")).join(S.table(spark, sf_dir, "orders"), F.col("o_custkey") == F.col("c_custkey"))
    state = ran.groupBy(F.col("n_name").alias("task")).agg(F.max(F.when(F.col("n_nationkey") % 5 != 2, F.col("o_orderdate").cast("timestamp"))).alias("last_completed")).withColumn("last_started", F.col("last_completed"))
    return D.upkeep_plan(tasks, state, now(), 4)


@registered("C9_incidents", f"""WITH {TRACE}, r AS (SELECT hook, latency_ms, row_number() OVER (PARTITION BY hook ORDER BY latency_ms, id) - 1 AS pos, count(*) OVER (PARTITION BY hook) AS c FROM trace WHERE latency_ms IS NOT NULL),
l AS (SELECT hook, max(latency_ms) FILTER (pos = floor((c - 1) * 0.95)) AS p95 FROM r GROUP BY 1 HAVING count(*) >= 50),
t AS (SELECT l_linestatus || (l_suppkey % 9) AS task, arg_max(CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'R' THEN 'failed' ELSE 'needs_attention' END, (l_shipdate, l_returnflag, l_orderkey, l_linenumber)) AS s FROM lineitem GROUP BY 1)
SELECT 'latency' AS kind, 'warning' AS severity, hook AS subject FROM l WHERE p95 > 20 UNION ALL SELECT 'maintenance', CASE s WHEN 'failed' THEN 'critical' ELSE 'info' END, task FROM t WHERE s <> 'completed'
UNION ALL SELECT 'backlog', 'info', p_brand FROM part GROUP BY p_brand HAVING count(*) > 20""")
def incidents(spark, sf_dir):
    from ..operators.aggregates import latency_summary

    flag = F.col("l_returnflag")
    tasks = S.table(spark, sf_dir, "lineitem").groupBy(F.concat("l_linestatus", (F.col("l_suppkey") % 9).cast("string")).alias("task")).agg(
        F.max_by(F.when(flag == "A", "completed").when(flag == "R", "failed").otherwise("needs_attention"), F.struct("l_shipdate", "l_returnflag", "l_orderkey", "l_linenumber")).alias("last_status")
    )
    found = D.incidents(
        D.latency_incidents(latency_summary(S.trace(spark, sf_dir), "hook", 20.0, 50)), D.task_incidents(tasks), D.backlog_incidents(S.table(spark, sf_dir, "part").select(F.col("p_brand").alias("kind")))
    )
    return found.select("kind", "severity", "subject")


@registered("J13_evidence", f"WITH {EXPECTED} SELECT case_id, item, best_rank, outcome FROM o")
def evidence(spark, sf_dir):
    return expected(spark, sf_dir)


@registered("G17_case_outcomes", f"WITH {EXPECTED}, n AS (SELECT case_id, count(*) FILTER (outcome = 'missing') AS missing, count(*) FILTER (outcome <> 'missing') AS found FROM o GROUP BY 1) SELECT *, CASE WHEN missing = 0 AND found > 0 THEN 'included' WHEN found > 0 THEN 'partial' ELSE 'missing' END AS outcome FROM n")
def case_outcomes(spark, sf_dir):
    return D.case_outcomes(expected(spark, sf_dir))


@registered("P15_drill_down", f"""WITH {MEMORY}, {EPISODE}, m AS (SELECT id, id % 300 AS session_id, superseded_by + 3 AS above, md5(lower({NORMAL.format('content')})) AS canonical FROM memory),
f AS (SELECT * FROM m WHERE id IN (SELECT item_id FROM benchmark)), days AS (SELECT DISTINCT date_key, CASE WHEN session_id % 3 = 0 THEN '' ELSE coalesce(repository, '') END AS r FROM episode),
own AS (SELECT f.id, e.session_id, date_key, coalesce(repository, '') AS r FROM f JOIN episode e USING (session_id))
SELECT 'from_session' AS kind, CAST(id AS VARCHAR) AS from_id, CAST(session_id AS VARCHAR) AS to_id FROM own
UNION ALL SELECT 'on_day', CAST(id AS VARCHAR), d FROM (SELECT id, own.date_key || '/' || days.r AS d, row_number() OVER (PARTITION BY id ORDER BY days.r = own.r DESC) AS k FROM own JOIN days ON own.date_key = days.date_key AND (days.r = own.r OR days.r = '')) WHERE k = 1
UNION ALL SELECT DISTINCT 'superseded_by', CAST(id AS VARCHAR), CAST(above AS VARCHAR) FROM m WHERE above IS NOT NULL AND (id IN (SELECT id FROM f) OR above IN (SELECT id FROM f))
UNION ALL SELECT 'same_meaning', CAST(f.id AS VARCHAR), CAST(m.id AS VARCHAR) FROM f JOIN m ON f.canonical = m.canonical AND f.id <> m.id
UNION ALL SELECT 'same_day', CAST(o.session_id AS VARCHAR), CAST(e.session_id AS VARCHAR) FROM (SELECT DISTINCT session_id, date_key, r FROM own) o JOIN episode e ON o.date_key = e.date_key AND o.r = coalesce(e.repository, '') AND o.session_id <> e.session_id""")
def drill_down(spark, sf_dir):
    memory = keyed_memory(spark, sf_dir).withColumns({"session_id": number() % 300, "superseded_by": F.col("superseded_by") + 3})
    e = S.episode(spark, sf_dir)
    days = e.select("date_key", F.when(F.col("session_id") % 3 == 0, "").otherwise(F.coalesce("repository", F.lit(""))).alias("repository")).distinct()
    return D.drill_down(S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id")), memory, e, days)


@registered("R11_episodes_of_day", f"""WITH {TOLD}, a AS (SELECT item_id AS prompt_id, CAST(DATE '2024-01-01' + CAST(item_id % 40 AS INT) AS DATE) AS date_key, 'src' || (item_id % 6) AS own FROM benchmark),
m AS (SELECT prompt_id, e.*, {NORMAL.format('summary')} AS t, CASE WHEN repository = own THEN 0 WHEN scope = 'global' THEN 1 ELSE 2 END AS place FROM a JOIN episode e USING (date_key) WHERE repository = own OR scope = 'global'),
p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY place, significance DESC, updated DESC, session_id DESC) <= 15),
x AS (SELECT *, {any_of('t', L.NOISE_SUMMARIES[1:2])} AS generic FROM p WHERE NOT {any_of('t', (L.NOISE_SUMMARIES[0], *L.NOISE_SUMMARIES[2:]))}),
o AS (SELECT * FROM x QUALIFY t = '' OR row_number() OVER (PARTITION BY prompt_id, lower(t) ORDER BY place, significance DESC, updated DESC, session_id DESC) = 1),
g AS (SELECT * FROM o QUALIFY NOT generic OR NOT bool_or(NOT generic) OVER (PARTITION BY prompt_id))
SELECT prompt_id, session_id, place FROM g QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY place, significance DESC, updated DESC, session_id DESC) <= 5""")
def episodes_of_day(spark, sf_dir):
    i = F.col("item_id")
    asked = S.table(spark, sf_dir, "benchmark").select(i.alias("prompt_id"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 40).cast("int")).alias("date_key"), F.concat(F.lit("src"), (i % 6).cast("string")).alias("repository"))
    return D.episodes_of_day(asked, S.told_episodes(spark, sf_dir), 5)


@registered("R10_without_generic", f"WITH {EPISODE}, g AS (SELECT date_key, repository, session_id, significance < 8 AS generic FROM episode) SELECT date_key, session_id FROM g QUALIFY generic = false OR NOT bool_or(NOT generic) OVER (PARTITION BY date_key, repository)")
def without_generic(spark, sf_dir):
    rows = S.episode(spark, sf_dir).withColumn("repository", F.coalesce("repository", F.lit("")))
    return D.without_generic(rows, ["date_key", "repository"], F.col("significance") < 8).select("date_key", "session_id")
