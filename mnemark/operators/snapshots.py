"""State as snapshots: each function takes the table as it is and a batch of changes, and gives the table as it will be.

A batch may name a key more than once; its rows are folded in order before they meet the table, with partial sums ahead
of the exchange, so a key that a third of a batch names is no single row's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.terms import merged_tags


def last_of(batch: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """The last row of each key, by ``order``."""
    best = F.max_by(F.struct(*columns), F.struct(*order))
    return batch.groupBy(*keys).agg(best.alias("_r")).select(*keys, *[F.col("_r")[c].alias(f"new_{c}") for c in columns])


def insert_memories(memory: DataFrame, batch: DataFrame) -> DataFrame:
    """Live memories merged with a batch, both (type, key, scope, repository, manual, saved, confidence, reinforcement, last_seen, tags).

    A row whose scope was set by hand takes every incoming row of its type and key, wherever these belong, and keeps the
    larger confidence and its scope. Else rows meet within scope and repository: one that was saved by hand keeps the
    larger confidence against rows that were not; any other takes the last incoming confidence. What meets nothing is new.
    """
    own = ["type", "key"]
    place = [*own, "scope", "_repository"]
    told = batch.withColumn("_repository", F.coalesce("repository", F.lit("")))
    held = memory.withColumn("_repository", F.coalesce("repository", F.lit("")))
    pins = memory.where("manual").groupBy(*own).agg(F.max(F.struct("last_seen", "scope", F.coalesce("repository", F.lit("")).alias("r"))).alias("p"))
    pins = pins.select(*own, F.col("p.scope").alias("_scope"), F.col("p.r").alias("_r"), F.lit(True).alias("_pinned"))
    routed = told.join(pins, own, "left")
    pinned = F.coalesce("_pinned", F.lit(False))
    routed = routed.select(
        *own, F.when(pinned, F.col("_scope")).otherwise(F.col("scope")).alias("scope"), F.when(pinned, F.col("_r")).otherwise(F.col("_repository")).alias("_repository"),
        pinned.alias("_pinned"), "saved", "confidence", "reinforcement", "last_seen", "tags",
    )
    folded = routed.groupBy(*place).agg(
        F.bool_or("_pinned").alias("_pinned"), F.bool_or("saved").alias("_saved"), F.max("confidence").alias("_most"), F.max_by("confidence", F.struct("last_seen", "confidence")).alias("_last"),
        F.sum("reinforcement").alias("_n"), F.max("last_seen").alias("_seen"), F.array_join(F.array_sort(F.collect_set("tags")), " ").alias("_tags"),
    )
    joined = held.join(folded, place, "full")
    keeps = F.coalesce("_pinned", F.lit(False)) | ((F.col("manual") | F.col("saved")) & ~F.col("_saved"))
    confidence = F.when(F.col("_n").isNull(), F.col("confidence")).when(F.col("manual").isNull(), F.col("_last")).when(keeps, F.greatest("confidence", "_most")).otherwise(F.col("_last"))
    return joined.select(
        *own, "scope", F.nullif("_repository", F.lit("")).alias("repository"), F.coalesce("manual", F.lit(False)).alias("manual"), (F.coalesce("saved", F.lit(False)) | F.coalesce("_saved", F.lit(False))).alias("saved"),
        confidence.alias("confidence"), (F.coalesce("reinforcement", F.lit(0)) + F.coalesce("_n", F.lit(0))).alias("reinforcement"), F.greatest("last_seen", "_seen").alias("last_seen"),
        merged_tags(F.coalesce("tags", F.lit("")), F.coalesce("_tags", F.lit(""))).alias("tags"),
    )


def upsert_episodes(episodes: DataFrame, batch: DataFrame) -> DataFrame:
    """(session_id, summary, scope, repository, manual, created_at, updated_at): the batch's last row of a session; what was placed by hand stays placed."""
    new = last_of(batch, ["session_id"], ["updated_at"], ["summary", "scope", "repository", "updated_at"])
    joined = episodes.join(new, "session_id", "full")
    came = F.col("new_updated_at").isNotNull()
    fixed = F.coalesce("manual", F.lit(False))
    pick = lambda c: F.when(came & ~fixed, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(
        "session_id", F.when(came, F.col("new_summary")).otherwise(F.col("summary")).alias("summary"), pick("scope"), pick("repository"), fixed.alias("manual"),
        F.coalesce("created_at", "new_updated_at").alias("created_at"), F.when(came, F.col("new_updated_at")).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def upsert_keyed(table: DataFrame, batch: DataFrame, key: str, columns: list[str], stamp: str) -> DataFrame:
    """Rows of a normalised key: the batch's last values where it has any, else those there were; rows without a key go."""
    named = F.nullif(F.lower(F.trim(key)), F.lit(""))
    new = last_of(batch.withColumn(key, named).where(F.col(key).isNotNull()), [key], [stamp], [*columns, stamp])
    joined = table.join(new, key, "full")
    return joined.select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in (*columns, stamp)])


def activity(state: DataFrame, successes: DataFrame, columns: list[str], stamp: str) -> DataFrame:
    """Latest marks of each scope: every success counts for its repository and for all; a later one wins field by field."""
    both = F.explode(F.array_distinct(F.array(F.concat(F.lit("repo:"), F.coalesce("repository", F.lit(""))), F.lit("global")))).alias("scope_key")
    named = successes.select(both, stamp, *columns).where("scope_key <> 'repo:'")
    latest = named.groupBy("scope_key").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(stamp, c))).alias(f"new_{c}") for c in columns])
    joined = state.join(latest, "scope_key", "full")
    return joined.select("scope_key", *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def task_results(state: DataFrame, results: DataFrame) -> DataFrame:
    """(task, runs, failures, attention, last_status, last_started, last_completed) after results (task, status, started, at).

    Counters add up; the last result gives the status and the time of completion, whatever its status; the last start that
    a result names stands.
    """
    order = F.struct("at", "status")
    done = results.groupBy("task").agg(
        F.count(F.lit(1)).alias("r"), F.count_if(F.col("status") == "failed").alias("f"), F.count_if(F.col("status") == "needs_attention").alias("a"),
        F.max_by(F.struct("status", "at"), order).alias("last"), F.max_by("started", F.when(F.col("started").isNotNull(), order)).alias("began"),
    )
    total = lambda old, new: (F.coalesce(old, F.lit(0)) + F.coalesce(new, F.lit(0))).alias(old)
    return state.join(done, "task", "full").select(
        "task", total("runs", "r"), total("failures", "f"), total("attention", "a"), F.coalesce("last.status", "last_status").alias("last_status"),
        F.coalesce("began", "last_started").alias("last_started"), F.when(F.col("last").isNotNull(), F.col("last.at")).otherwise(F.col("last_completed")).alias("last_completed"),
    )


def without_generated(memory: DataFrame, sessions: DataFrame, kept_sources: tuple[str, ...] = ("memory_save", "onboarding")) -> DataFrame:
    """Memories less those that rules made of the named sessions; what was saved, asked at the start or placed by hand stays."""
    by_hand = F.coalesce("source", F.lit("")).isin(*kept_sources) | F.coalesce("manual", F.lit(False))
    named = sessions.select("session_id").distinct().withColumn("_named", F.lit(True))
    return memory.join(named, "session_id", "left").where(F.col("_named").isNull() | by_hand).drop("_named")


def generated_counts(memory: DataFrame, kept_sources: tuple[str, ...] = ("memory_save", "onboarding")) -> DataFrame:
    live = memory.where(~F.coalesce("source", F.lit("")).isin(*kept_sources))
    return live.groupBy("session_id").agg(F.count(F.lit(1)).alias("generated"))


def scope_overrides(memory: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Preview of overrides (id, found, changed, old and new scope and repository), and the table with them applied.

    ``requests`` (id, action, scope, repository): ``set`` places a row by hand; ``clear`` gives it back to the rules,
    whose answer the table holds as auto_scope. Ids that are not there are told as not found.
    """
    last = requests.groupBy("id").agg(F.max_by(F.struct("action", "scope", "repository"), "at").alias("r"))
    joined = memory.join(last, "id", "full")
    asked, found = F.col("r").isNotNull(), F.col("type").isNotNull()
    new_scope = F.when(F.col("r.action") == "set", F.col("r.scope")).when(F.col("r.action") == "clear", F.col("auto_scope")).otherwise(F.col("scope"))
    place = F.when(F.col("r.action") == "set", F.coalesce("r.repository", "repository")).otherwise(F.col("repository"))
    new_repository = F.when(new_scope != "global", place)
    changed = found & asked & ~(new_scope.eqNullSafe(F.col("scope")) & new_repository.eqNullSafe(F.col("repository")))
    each = joined.withColumns({"new_scope": new_scope, "new_repository": new_repository, "found": found, "changed": changed, "asked": asked})
    preview = each.where("asked").select("id", "found", "changed", "scope", "new_scope", "repository", "new_repository")
    applied = each.where("found").select(
        "id", F.when(F.col("asked"), F.col("new_scope")).otherwise(F.col("scope")).alias("scope"), F.when(F.col("asked"), F.col("new_repository")).otherwise(F.col("repository")).alias("repository"),
        F.when(F.col("r.action") == "set", True).when(F.col("r.action") == "clear", False).otherwise(F.col("manual")).alias("manual"),
    )
    return preview, applied


APPROVAL = ("decision", "durable", "expires_at")


def record_approvals(approvals: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Approvals (family, repository, target, ``APPROVAL``, created_at, updated_at) after requests (the same, and at), in order of time.

    Of a target's rows the first counts: while it is neither durable nor expired a request renews it, decision, durability
    and expiry alike; from then on, and where it never was so, each request adds a row. Nulls are equal to each other as keys. Expired
    rows stay until they are purged. Requests of one time come in the order of their decisions.
    """
    keys = ["family", "repository", "target"]
    whose = F.struct(*keys)
    fixed = lambda: F.coalesce("durable", F.lit(False)) | F.coalesce(F.col("expires_at") < now, F.lit(False))
    place = F.struct("at", *APPROVAL)
    held = approvals.withColumn("_key", whose)
    rank = F.struct("created_at", "updated_at", *APPROVAL)
    first = held.groupBy("_key").agg(F.min(rank).alias("_first")).join(held.withColumn("_rank", rank), "_key").where("_first = _rank").dropDuplicates(["_key"])
    locked = first.select("_key", fixed().alias("_locked"), F.col("created_at").alias("_since"))
    asked = requests.withColumn("_key", whose).withColumn("_place", place).join(locked, "_key", "left")
    until = asked.where(fixed()).groupBy("_key").agg(F.min("_place").alias("_until"))
    dealt = asked.join(until, "_key", "left").withColumn("_renews", ~F.coalesce("_locked", F.lit(False)) & (F.col("_until").isNull() | (F.col("_place") <= F.col("_until"))))
    renewed = dealt.where("_renews").groupBy("_key").agg(F.max("_place").alias("n"), F.coalesce(F.min("_since"), F.min("at")).alias("_since"))
    columns = [*keys, *APPROVAL, "created_at", "updated_at"]
    fresh = renewed.select("_key.*", *[f"n.{c}" for c in APPROVAL], F.col("_since").alias("created_at"), F.col("n.at").alias("updated_at"))
    added = dealt.where("not _renews").select(*keys, *APPROVAL, F.col("at").alias("created_at"), F.col("at").alias("updated_at"))
    # the renewed row goes once, equal rows of the same key stay
    ranked = held.withColumn("_rank", rank).withColumn("_nth", F.row_number().over(Window.partitionBy("_key", "_rank").orderBy(F.lit(1))))
    gone = first.join(renewed.select("_key"), "_key", "left_semi").select("_key", F.col("_first").alias("_rank"), F.lit(1).alias("_nth"))
    kept = ranked.join(gone, ["_key", "_rank", "_nth"], "left_anti")
    return kept.select(*columns).unionByName(fresh).unionByName(added)


def superseded_duplicates(memory: DataFrame, kind: str, now: Column) -> DataFrame:
    """Live memories of a type that share a canonical key become one: the winner takes what all have, the others are superseded by it.

    Rows set by hand win, then the surest, the most often seen, the newest, the least id. The winner gets the largest
    confidence, the sum of reinforcements, the latest time seen, and all tags in the order of their rows.
    """
    columns = memory.columns
    same = F.col("superseded_by").isNull() & (F.col("type") == kind) & F.col("canonical_key").isNotNull()
    by_hand = F.coalesce("scope_source", F.lit("auto")) == "manual"
    sure, count = F.coalesce("confidence", F.lit(1)), F.coalesce("reinforcement_count", F.lit(1))
    rank = F.struct((~by_hand).alias("a"), (-sure).alias("b"), (-count).alias("c"), (-F.unix_micros("updated_at")).alias("d"), "id")
    live = memory.where(same).withColumn("_rank", rank)
    groups = live.groupBy("canonical_key").agg(
        F.min("_rank").alias("w"), F.count(F.lit(1)).alias("n"), F.max(sure).alias("n_confidence"), F.sum(count).cast("int").alias("n_count"), F.max("last_seen_at").alias("n_seen"),
    ).where("n > 1")
    tag = F.posexplode(F.filter(F.split(F.coalesce("tags", F.lit("")), r"\s+"), lambda t: t != "")).alias("at", "tag")
    first = live.select("canonical_key", "_rank", tag).groupBy("canonical_key", "tag").agg(F.min(F.struct("_rank", "at")).alias("r"))
    tags = first.groupBy("canonical_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "tag"))), lambda x: x["tag"]), " ").alias("n_tags"))  # distinct tags
    told = groups.join(tags, "canonical_key", "left").select("canonical_key", F.col("w.id").alias("_winner"), "n_confidence", "n_count", "n_seen", "n_tags")
    # rows that no group can change are spread by their hashes, a group's rows over 32 parts: no task reads a crowd of one key
    spread = F.xxhash64("id")
    told = told.withColumnRenamed("canonical_key", "_key").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(31).cast("long"))))
    joined = memory.withColumns({"_key": F.when(same, F.col("canonical_key")), "_salt": F.when(same, F.pmod(spread, F.lit(32))).otherwise(spread)}).join(told, ["_key", "_salt"], "left")
    wins, loses = same & (F.col("id") == F.col("_winner")), same & (F.col("id") != F.col("_winner"))
    taken = {"confidence": "n_confidence", "reinforcement_count": "n_count", "last_seen_at": "n_seen", "tags": "n_tags"}
    return joined.select(
        *[
            (F.when(wins, F.col(taken[c]).cast(memory.schema[c].dataType)).otherwise(F.col(c)) if c in taken
             else F.when(loses, F.col("_winner").cast(memory.schema[c].dataType)).otherwise(F.col(c)) if c == "superseded_by"
             else F.when(F.col("_winner").isNotNull() & same, now.cast(memory.schema[c].dataType)).otherwise(F.col(c)) if c == "updated_at" else F.col(c)).alias(c)
            for c in columns
        ]
    )
