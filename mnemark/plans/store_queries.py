"""Registered queries on the versioned store: committed, restored and migrated tables, read back from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..operators import state as M
from ..sources import bindings as S
from ..sources.store import Store, migrated, shared_folder, snapshot_before
from .memory_queries import EPISODE, MEMORY, NORMAL, now, registered
from .prompt_queries import any_of, list_of, name_sql

#: Names that users of the invented store have.
NAMES = ("Ana", "José", "Li", "O’Neil", "maria", "Ana", "Zoë")


@registered("K1_committed_versions", f"""WITH {MEMORY}, {EPISODE} SELECT id, CASE WHEN id % 6 = 1 THEN 'manual:1998-01-01T00:00:00.000Z' ELSE CAST(superseded_by AS VARCHAR) END AS superseded_by, superseded_by AS earlier,
 (SELECT count(*) FROM episode) AS episodes, CAST(2 AS BIGINT) AS versions FROM memory""")
def committed_versions(spark, sf_dir):
    """Two versions: all tables, then memories after a deletion that reads the store itself; the first stays readable."""
    store = Store(spark, shared_folder(spark, "store"))
    first = store.commit({"memory": S.memory(spark, sf_dir), "episode": S.episode(spark, sf_dir)})
    held = store.read("memory")
    second = store.commit({"memory": M.soft_deleted(held, held.where("id % 6 = 1").select("id", F.lit(None).cast("string").alias("by")), now())})
    earlier = store.read("memory", first).select("id", F.col("superseded_by").alias("earlier"))
    rows = store.read("memory", second).select("id", "superseded_by").join(earlier, "id")
    return rows.withColumn("episodes", F.lit(store.read("episode", second).count())).withColumn("versions", F.lit(len(store.versions())).cast("long"))


@registered("K3_restored", f"WITH {MEMORY} SELECT id, type, md5(content) AS content, repository, superseded_by FROM memory")
def restored(spark, sf_dir):
    """A table kept before a run, spoiled by it, and restored; the versions in between are pruned."""
    store = Store(spark, shared_folder(spark, "store"))
    store.commit({"memory": S.memory(spark, sf_dir).withColumn("content", F.md5("content"))})
    name = snapshot_before(store, "before-run", candidates=1)
    store.commit({"memory": store.read("memory").where("id % 2 = 0").withColumn("repository", F.lit("spoiled"))})
    store.restore(name)
    store.prune(1)
    return store.read("memory").select("id", "type", "content", "repository", "superseded_by")


LEGACY = f"""legacy AS (SELECT id, CASE WHEN id % 10 = 9 THEN 'user_identity' ELSE type END AS type, CASE WHEN id % 10 = 9 THEN 'The user''s preferred name is ' || ({list_of(NAMES)})[1 + id // 10 % {len(NAMES)}] || '.' ELSE content END AS content,
 repository, CASE WHEN id % 3 = 0 THEN 'extra ' || tags ELSE tags END AS tags, confidence, superseded_by, updated_at FROM memory)"""
CANONICAL = f"trim(regexp_replace(regexp_replace(regexp_replace(lower({NORMAL.format('content')}), '[''’\"]', '', 'g'), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))"


@registered("K9_migrated_memory", f"""WITH {MEMORY}, {LEGACY}, said AS (SELECT *, concat_ws(' ', type, content, coalesce(tags, '')) AS txt FROM legacy),
f AS (SELECT *, {name_sql(NORMAL.format('txt'))} AS name, {any_of('txt', L.REPO_SPECIFIC)} AS local, {any_of('txt', L.TRANSFERABLE)} AS moves, {any_of('txt', L.GLOBAL_PREFERENCE)} AS general, regexp_extract(content, 'preferred name is\\s+(.+?)[.!?]*$', 1) AS called FROM said),
g AS (SELECT *, CASE WHEN type = 'interaction_style' OR name IS NOT NULL OR type = 'user_identity' THEN 'global' WHEN type IN ('open_loop', 'blocker', 'commitment') THEN 'repo' WHEN type = 'directive' THEN 'global'
 WHEN type IN ('user_preference', 'rejected_approach') THEN CASE WHEN local THEN 'repo' WHEN moves AND NOT general THEN 'transferable' ELSE 'global' END
 WHEN type = 'recurring_mistake' THEN 'global' WHEN type = 'assistant_goal' THEN CASE WHEN local THEN 'repo' WHEN moves THEN 'transferable' ELSE 'global' END
 WHEN moves THEN 'transferable' WHEN repository IS NULL THEN 'global' ELSE 'repo' END AS scope,
 CASE WHEN superseded_by IS NULL THEN CASE WHEN type = 'user_identity' THEN CASE WHEN regexp_matches(called, '^\\p{{Lu}}[\\p{{L}}''’-]*$') THEN 'user_identity:' || trim(regexp_replace(regexp_replace(regexp_replace(lower(called), '[''’"]', '', 'g'), '[^a-z0-9\\s-]', ' ', 'g'), '\\s+', ' ', 'g')) END
  WHEN type IN ('assistant_goal', 'recurring_mistake') AND {CANONICAL} <> '' THEN type || ':' || {CANONICAL} END END AS key FROM f),
same AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY key) AS n, first_value(id) OVER w AS winner FROM g WHERE type = 'user_identity' AND superseded_by IS NULL AND key IS NOT NULL WINDOW w AS (PARTITION BY key ORDER BY confidence DESC, updated_at DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
tagged AS (SELECT key, string_agg(tag, ' ' ORDER BY first) AS tags FROM (SELECT key, tag, min((-confidence, -epoch_us(updated_at), id, at_)) AS first FROM (SELECT *, unnest(string_split(tags, ' ')) AS tag, generate_subscripts(string_split(tags, ' '), 1) AS at_ FROM same WHERE n > 1) GROUP BY 1, 2) GROUP BY 1),
won AS (SELECT key, any_value(winner) AS winner, max(confidence) AS confidence, count(*) AS count_, max(updated_at) AS seen FROM same WHERE n > 1 GROUP BY 1)
SELECT g.id, scope, CASE WHEN scope <> 'global' THEN repository END AS repository, 'auto' AS scope_source, md5(g.key) AS canonical_key, CASE WHEN g.id = winner THEN CAST(count_ AS INT) ELSE 1 END AS reinforcement_count,
 CASE WHEN g.id = winner THEN won.confidence ELSE g.confidence END AS confidence, CASE WHEN g.id = winner THEN won.seen ELSE g.updated_at END AS last_seen_at, CASE WHEN s.id IS NOT NULL AND winner IS NOT NULL AND g.id <> winner THEN winner ELSE superseded_by END AS superseded_by,
 CASE WHEN g.id = winner THEN t.tags ELSE g.tags END AS tags FROM g LEFT JOIN (SELECT id FROM same) s ON s.id = g.id LEFT JOIN won ON won.key = g.key AND s.id IS NOT NULL LEFT JOIN tagged t ON t.key = g.key""")
def migrated_memory(spark, sf_dir):
    """Memories of schema 2, kept as a backup, restored and thereby migrated."""
    k = F.col("id")
    own = k % 10 == 9
    named = F.concat(F.lit("The user's preferred name is "), F.get(F.array(*map(F.lit, NAMES)), (F.floor(k / 10) % len(NAMES)).cast("int")), F.lit("."))
    legacy = S.memory(spark, sf_dir).select(
        "id", F.when(own, "user_identity").otherwise(F.col("type")).alias("type"), F.when(own, named).otherwise(F.col("content")).alias("content"), "repository",
        F.when(k % 3 == 0, F.concat(F.lit("extra "), "tags")).otherwise(F.col("tags")).alias("tags"), "confidence", "superseded_by", "updated_at",
    )
    store = Store(spark, shared_folder(spark, "store"))
    store.commit({"memory": legacy}, schema=2)
    store.restore(store.backup("old"), lambda tables, schema: migrated(tables, schema, now=now()))
    columns = ("id", "scope", "repository", "scope_source", "reinforcement_count", "confidence", "last_seen_at", "superseded_by", "tags")
    return store.read("memory").select(*columns, F.md5("canonical_key").alias("canonical_key"))
