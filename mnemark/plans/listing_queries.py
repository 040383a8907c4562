"""Registered queries on lists: optional filters, browsing, day summaries, ranked items, links, counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import terms as T
from ..operators import listing as O
from ..operators import rules as C
from ..sources import bindings as S
from .memory_queries import EPISODE, MEMORY, QUEUE, STEM, WORDS, registered
from .prompt_queries import DIRECT, GENERIC, any_of, list_of


@registered("F2_listed_memory", f"WITH {MEMORY} SELECT id, type, scope FROM memory WHERE type IN ('fact', 'directive', 'blocker') AND tags = 'en' AND superseded_by IS NULL AND updated_at <= TIMESTAMP '2024-01-01 02:00:00'")
def listed_memory(spark, sf_dir):
    rows = O.narrowed(
        S.memory(spark, sf_dir), equal={"tags": "en", "repository": None}, within={"type": ["fact", "directive", "blocker"], "scope": []}, given={"superseded_by": False},
        until=("updated_at", F.lit("2024-01-01 02:00:00").cast("timestamp")),
    )
    return rows.select("id", "type", "scope")


@registered("F9_states", f"WITH {MEMORY} SELECT id, 'active' AS state FROM memory WHERE superseded_by IS NULL UNION ALL SELECT id, 'superseded' FROM memory WHERE superseded_by IS NOT NULL UNION ALL SELECT id, 'all' FROM memory")
def states(spark, sf_dir):
    one = lambda s: O.in_state(S.memory(spark, sf_dir), s).select("id", F.lit(s).alias("state"))
    return one("active").unionByName(one("superseded")).unionByName(one("all"))


@registered("F8_repository_or_shared", f"WITH {EPISODE} SELECT session_id, 'src2' AS asked FROM episode WHERE repository = 'src2' OR scope = 'global' UNION ALL SELECT session_id, 'every' FROM episode")
def repository_or_shared(spark, sf_dir):
    e = S.episode(spark, sf_dir)
    one = lambda name, r: O.of_repository(e, r, F.col("scope") == "global").select("session_id", F.lit(name).alias("asked"))
    return one("src2", "src2").unionByName(one("every", None))


@registered("F12_from_elsewhere", f"""WITH {EPISODE}, e AS (SELECT session_id, coalesce(repository, '') AS r, CASE session_id % 3 WHEN 0 THEN 'src1' WHEN 1 THEN '' END AS cur FROM episode)
SELECT session_id, r <> '' AND (coalesce(cur, '') = '' OR r <> cur) AS wide, r <> '' AND coalesce(cur, '') <> '' AND r <> cur AS narrow FROM e""")
def from_elsewhere(spark, sf_dir):
    k, r = F.col("session_id"), F.col("repository")
    current = F.when(k % 3 == 0, "src1").when(k % 3 == 1, "")
    return S.episode(spark, sf_dir).select(k, O.from_elsewhere(r, current, True).alias("wide"), O.from_elsewhere(r, current, False).alias("narrow"))


@registered("F16_by_ids", f"WITH {EPISODE} SELECT session_id, date_key FROM episode WHERE session_id IN (SELECT item_id * 3 FROM benchmark)")
def by_ids(spark, sf_dir):
    return O.by_ids(S.episode(spark, sf_dir), asked_ids(spark, sf_dir), "session_id").select("session_id", "date_key")


def asked_ids(spark, sf_dir):
    return S.table(spark, sf_dir, "benchmark").select((F.col("item_id") * 3).alias("session_id"))


@registered("U7_missing_ids", "SELECT DISTINCT item_id * 30 AS session_id FROM benchmark WHERE item_id * 30 NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def missing_ids(spark, sf_dir):
    return O.missing_ids(S.episode(spark, sf_dir), asked_ids(spark, sf_dir).select((F.col("session_id") * 10).alias("session_id")), "session_id")


@registered("U6_without_digest", f"WITH {QUEUE} SELECT DISTINCT session_id FROM queue WHERE session_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def without_digest(spark, sf_dir):
    digests = S.table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("session_id"))
    return O.missing_ids(digests, S.work_queue(spark, sf_dir), "session_id")


@registered("R2_browse", f"WITH {MEMORY}, {EPISODE} (SELECT 'memory' AS kind, id FROM memory ORDER BY confidence DESC, updated_at DESC, id LIMIT 20) UNION ALL (SELECT 'episode', session_id FROM episode ORDER BY updated DESC, significance DESC, session_id LIMIT 20)")
def browse(spark, sf_dir):
    m = O.browse_memory(S.memory(spark, sf_dir), 20).select(F.lit("memory").alias("kind"), "id")
    return m.unionByName(O.browse_episodes(S.episode(spark, sf_dir), 20).select(F.lit("episode").alias("kind"), F.col("session_id").alias("id")))


@registered("R12_day_summaries_for", f"""WITH {EPISODE}, days AS (SELECT date_key, coalesce(repository, '') AS repository, max(updated) AS computed_at FROM episode GROUP BY 1, 2),
a AS (SELECT item_id AS prompt_id, CAST(DATE '2024-01-01' + CAST(item_id % 40 AS INT) AS DATE) AS date_key, CASE WHEN item_id % 4 > 0 THEN 'src' || (item_id % 6) END AS own FROM benchmark),
m AS (SELECT prompt_id, repository, computed_at, CASE WHEN own IS NOT NULL AND repository = own THEN 0 WHEN repository = '' THEN 1 ELSE 2 END AS place FROM a JOIN days USING (date_key))
SELECT prompt_id, repository, place FROM m QUALIFY row_number() OVER (PARTITION BY prompt_id ORDER BY place, computed_at DESC, repository) <= 4""")
def day_summaries_for(spark, sf_dir):
    i = F.col("item_id")
    days = S.episode(spark, sf_dir).groupBy("date_key", F.coalesce("repository", F.lit("")).alias("repository")).agg(F.max("updated").alias("computed_at"))
    asked = S.table(spark, sf_dir, "benchmark").select(
        i.alias("prompt_id"), F.date_add(F.lit("2024-01-01").cast("date"), (i % 40).cast("int")).alias("date_key"), F.when(i % 4 > 0, F.concat(F.lit("src"), (i % 6).cast("string"))).alias("own")
    )
    return O.day_summaries_for(asked, days, 4, include_other=True).select("prompt_id", "repository", "place")


ITEMS = ("Files modified: ", "the rollback/", "Remaining work:", "", "keep `names` short ", "Trace schema ")


@registered("R18_ranked_items", f"""WITH t AS (SELECT item_id, unnest(range(0, 6)) AS i, coalesce(text, '') AS txt FROM benchmark),
v AS (SELECT item_id, i, {DIRECT.format('txt')}[1:4] AS terms, trim(regexp_replace(({[*ITEMS]!r})[i + 1] || CASE WHEN i % 2 = 1 OR i = 4 THEN txt ELSE '' END, '\\s+', ' ', 'g')) AS value FROM t),
n AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS position, len(list_intersect(list_distinct(list_filter(list_transform({WORDS.format('value')}, lambda w: {STEM.format('w')}), lambda w: length(w) > 2)), terms)) AS matched FROM v WHERE value <> ''),
s AS (SELECT *, matched * 2 + CASE WHEN regexp_matches(value, '[`_/]') THEN 1.5 ELSE 0 END + CASE WHEN {any_of('value', [L.DOMAIN_WORDS])} THEN 1.5 ELSE 0 END + CASE WHEN length(value) BETWEEN 20 AND 220 THEN 0.5 ELSE 0 END
 - CASE WHEN {any_of("regexp_replace(value, ': *$', '')", [f"^(?:{'|'.join(L.LOW_SIGNAL_ITEMS)})"])} THEN 3 ELSE 0 END - CASE WHEN ends_with(value, ':') THEN 1 ELSE 0 END AS score FROM n)
SELECT item_id, string_agg(position || '/' || matched || '/' || CAST(score AS DOUBLE), ' ' ORDER BY matched DESC, score DESC, position) AS places FROM s GROUP BY 1""")
def ranked_items(spark, sf_dir):
    rows = S.table(spark, sf_dir, "benchmark").select("item_id", F.coalesce("text", F.lit("")).alias("txt"))
    items = F.array(*[F.concat(F.lit(lead), F.col("txt") if i % 2 == 1 or i == 4 else F.lit("")) for i, lead in enumerate(ITEMS)])
    ranked = O.ranked_items(items, F.slice(T.direct_terms(F.col("txt")), 1, 4))
    told = F.transform(ranked, lambda r: F.concat_ws("/", r["position"].cast("string"), r["matched"].cast("string"), r["score"].cast("string")))
    return rows.select("item_id", F.array_join(told, " ").alias("places"))


@registered("R24_workstreams", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'done' ELSE 'active' END AS status FROM orders WHERE o_custkey % 50 = 7 ORDER BY o_orderstatus = 'F', o_orderdate DESC, o_orderkey LIMIT 12")
def workstreams(spark, sf_dir):
    rows = S.table(spark, sf_dir, "orders").where("o_custkey % 50 = 7").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("active").alias("status"), F.col("o_orderdate").alias("updated_at")
    )
    return O.workstreams(rows, 12).select("id", "status")


@registered("J3_indexed_text", "SELECT conv_id AS session_id, turn, source AS repository, lang AS branch FROM conversations JOIN documents ON conv_id = doc_id")
def indexed_text(spark, sf_dir):
    index = S.table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "session_id").select("session_id", "turn")
    sessions = S.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("session_id"), F.col("source").alias("repository"), F.col("lang").alias("branch"))
    return O.indexed_text(index, sessions)


@registered("J5_with_workspace", """WITH s AS (SELECT doc_id AS session_id, CASE WHEN doc_id % 4 > 0 THEN source ELSE '' END AS repository, lang AS branch, n_chars AS updated_at FROM documents),
w AS (SELECT c_custkey AS session_id, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_mktsegment END AS repository, c_mktsegment AS branch, CASE WHEN c_custkey % 2 = 0 THEN 7 END AS updated_at, CASE WHEN c_custkey % 5 > 0 THEN c_name ELSE '' END AS summary FROM customer)
SELECT session_id, coalesce(nullif(w.repository, ''), nullif(s.repository, '')) AS repository, coalesce(nullif(w.branch, ''), nullif(s.branch, '')) AS branch, coalesce(w.updated_at, s.updated_at) AS updated_at, s.updated_at AS stored_at, nullif(w.summary, '') AS workspace_summary FROM s LEFT JOIN w USING (session_id)""")
def with_workspace(spark, sf_dir):
    d, k = F.col("doc_id"), F.col("c_custkey")
    sessions = S.table(spark, sf_dir, "documents").select(d.alias("session_id"), F.when(d % 4 > 0, F.col("source")).otherwise("").alias("repository"), F.col("lang").alias("branch"), F.col("n_chars").alias("updated_at"))
    workspace = S.table(spark, sf_dir, "customer").select(
        k.alias("session_id"), F.when(k % 3 == 0, "").when(k % 3 == 1, F.col("c_mktsegment")).alias("repository"), F.col("c_mktsegment").alias("branch"),
        F.when(k % 2 == 0, F.lit(7).cast("long")).alias("updated_at"), F.when(k % 5 > 0, F.col("c_name")).otherwise("").alias("summary"),
    )
    return O.with_workspace(sessions, workspace)


IMPROVED = """mem AS (SELECT doc_id AS id, doc_id % 60 AS session_id FROM documents), imp AS (SELECT o_orderkey AS improvement_id, o_custkey AS linked_memory_id, o_orderdate AS updated_at FROM orders),
f AS (SELECT session_id, improvement_id, linked_memory_id FROM imp JOIN mem ON id = linked_memory_id WHERE session_id IN (SELECT item_id FROM benchmark) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY updated_at DESC, improvement_id) <= 16)"""


def improved(spark, sf_dir):
    memory = S.memory(spark, sf_dir).withColumn("session_id", F.col("id") % 60)
    found = S.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("improvement_id"), F.col("o_custkey").alias("linked_memory_id"), F.col("o_orderdate").alias("updated_at"))
    return O.improvements_of(S.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("session_id")), found, memory, 16)


@registered("J4_improvements", f"WITH {IMPROVED} SELECT * FROM f")
def improvements(spark, sf_dir):
    return improved(spark, sf_dir).select("session_id", "improvement_id", "linked_memory_id")


@registered("J16_improvement_edges", f"WITH {IMPROVED} SELECT DISTINCT 'from_session' AS kind, CAST(linked_memory_id AS VARCHAR) AS from_id, CAST(session_id AS VARCHAR) AS to_id FROM f UNION ALL SELECT DISTINCT 'improves', CAST(improvement_id AS VARCHAR), CAST(linked_memory_id AS VARCHAR) FROM f")
def improvement_edges(spark, sf_dir):
    return O.improvement_edges(improved(spark, sf_dir))


@registered("G20_severities", "SELECT count(*) FILTER (l_returnflag = 'A') AS critical, count(*) FILTER (l_returnflag = 'R') AS warning, count(*) FILTER (l_returnflag = 'N') AS info FROM lineitem")
def severities(spark, sf_dir):
    flag = F.col("l_returnflag")
    return O.severity_counts(S.table(spark, sf_dir, "lineitem").select(F.when(flag == "A", "critical").when(flag == "N", "info").otherwise("odd").alias("severity")))


@registered("G24_tiers", """WITH t AS (SELECT l_suppkey % 5 AS place, CASE WHEN s >= 12 THEN 'critical' WHEN s >= 8 THEN 'high' WHEN s >= 4 THEN 'moderate' ELSE 'low' END AS tier, s FROM (SELECT l_suppkey, l_linenumber + l_suppkey % 5 * 2 - 2 AS s FROM lineitem))
SELECT place, count(*) AS n, count(*) FILTER (tier = 'low') AS low, count(*) FILTER (tier = 'moderate') AS moderate, count(*) FILTER (tier = 'high') AS high, count(*) FILTER (tier = 'critical') AS critical, arg_max(tier, s) AS highest FROM t GROUP BY 1""")
def tiers(spark, sf_dir):
    place = F.col("l_suppkey") % 5
    return O.tier_counts(S.table(spark, sf_dir, "lineitem").select(place.alias("place"), C.risk_tier(F.col("l_linenumber") + place * 2 - 2).alias("tier")), ["place"])


@registered("M6_improvements", """WITH h AS (SELECT p_brand AS case_id, p_size % 4 AS source, p_name AS title, CASE WHEN p_partkey % 3 > 0 THEN p_partkey END AS linked_memory_id, CASE WHEN p_partkey % 5 = 0 THEN 'resolved' ELSE 'active' END AS status, p_partkey AS created_at, p_partkey AS updated_at FROM part),
b AS (SELECT trim(p_brand) AS case_id, p_size % 3 AS source, trim(p_type) AS title, CASE WHEN p_partkey % 2 = 0 THEN p_partkey + 10000000 END AS linked, p_partkey + 20000000 AS updated_at FROM part WHERE p_partkey % 4 = 0 AND p_partkey % 12 <> 0),
n AS (SELECT case_id, source, arg_max(title, updated_at) AS title, arg_max(linked, updated_at) FILTER (linked IS NOT NULL) AS linked, min(updated_at) AS first, max(updated_at) AS last FROM b GROUP BY 1, 2),
r AS (SELECT *, status = 'active' AND row_number() OVER (PARTITION BY case_id, source, status ORDER BY updated_at DESC) = 1 AS renewed FROM h)
SELECT case_id, source, title, linked_memory_id, status, created_at, updated_at FROM r WHERE NOT renewed
UNION ALL SELECT case_id, source, coalesce(n.title, r.title), coalesce(n.linked, r.linked_memory_id), 'active', coalesce(r.created_at, n.first), coalesce(n.last, r.updated_at) FROM (SELECT * FROM r WHERE renewed) r FULL JOIN n USING (case_id, source)""")
def upserted_improvements(spark, sf_dir):
    p, k = S.table(spark, sf_dir, "part"), F.col("p_partkey")
    held = p.select(
        F.col("p_brand").alias("case_id"), (F.col("p_size") % 4).alias("source"), F.col("p_name").alias("title"), F.when(k % 3 > 0, k).alias("linked_memory_id"),
        F.when(k % 5 == 0, "resolved").otherwise("active").alias("status"), k.alias("created_at"), k.alias("updated_at"),
    )
    batch = p.where(k % 4 == 0).select(
        F.when(k % 12 == 0, " ").otherwise(F.concat(F.lit(" "), "p_brand")).alias("case_id"), (F.col("p_size") % 3).alias("source"), F.col("p_type").alias("title"),
        F.when(k % 2 == 0, k + 10000000).alias("linked_memory_id"), (k + 20000000).alias("updated_at"),
    )
    return O.upsert_improvements(held, batch)


RAW_ALIAS_MAP = "MAP {" + ", ".join(f"'{k}': {list_of(v)}" for k, v in L.RAW_ALIASES.items()) + "}"


@registered("X7_raw_terms", f"""WITH t AS (SELECT item_id, unnest({DIRECT.format("coalesce(text, '') || ' tests CI rollback plans'")}) AS w FROM benchmark),
a AS (SELECT item_id, w AS term FROM t UNION ALL SELECT item_id, {STEM.format('x')} FROM (SELECT item_id, regexp_replace(lower(unnest({RAW_ALIAS_MAP}[w])), '[^a-z0-9]+', '', 'g') AS x FROM t))
SELECT item_id, string_agg(DISTINCT term, ' ' ORDER BY term) AS terms FROM a WHERE length(term) > 2 AND NOT list_contains({GENERIC}, term) GROUP BY 1""")
def raw_terms(spark, sf_dir):
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" tests CI rollback plans"))
    rows = S.table(spark, sf_dir, "benchmark").select("item_id", F.array_join(F.array_sort(T.raw_search_terms(text)), " ").alias("terms"))
    return rows.where("terms <> ''")
