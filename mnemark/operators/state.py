"""State as pure functions: the current snapshot and a batch of changes give the next snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_memory(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Merge a batch into (type, key, confidence, reinforcement, last_seen, tags, manual).

    Rows of one (type, key) in the batch are folded first: counts add up, the last row's confidence counts. A manual
    row that exists keeps the larger confidence; any other takes the incoming one.
    """
    keys = ["type", "key"]
    folded = incoming.groupBy(*keys).agg(
        F.max_by("confidence", F.struct("last_seen", "confidence")).alias("new_confidence"), F.sum("reinforcement").alias("new_reinforcement"),
        F.max("last_seen").alias("new_last_seen"), F.array_sort(F.collect_set("tags")).alias("new_tags"),
    )
    held = F.col("manual")
    joined = current.join(folded, keys, "full")
    confidence = F.when(F.col("new_confidence").isNull(), F.col("confidence")).when(held, F.greatest("confidence", "new_confidence")).otherwise(F.col("new_confidence"))
    tags = F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(F.split("tags", " "), F.array().cast("array<string>")), F.coalesce("new_tags", F.array().cast("array<string>"))))), " ")
    return joined.select(
        *keys,
        confidence.alias("confidence"),
        (F.coalesce("reinforcement", F.lit(0)) + F.coalesce("new_reinforcement", F.lit(0))).alias("reinforcement"),
        F.greatest("last_seen", "new_last_seen").alias("last_seen"),
        tags.alias("tags"),
        F.coalesce(held, F.lit(False)).alias("manual"),
    )


def available(queue: DataFrame, now: Column, limit: int) -> DataFrame:
    """Jobs that may run, most urgent first."""
    return queue.where(F.col("status").isin("pending", "failed") & (F.col("available_at") <= now)).orderBy(F.desc("priority"), "available_at", "session_id").limit(limit)


def queue_view(queue: DataFrame, limit: int) -> DataFrame:
    place = F.when(F.col("status") == "running", 0).when(F.col("status") == "pending", 1).when(F.col("status") == "failed", 2).otherwise(3)
    return queue.withColumn("place", place).orderBy("place", F.desc("priority"), "available_at", "session_id").limit(limit)


def planned(candidates: DataFrame, existing: DataFrame, key: str, stamp: str) -> DataFrame:
    """Each candidate with what to do: create, refresh (seen before, but newer now) or skip."""
    known = existing.groupBy(key).agg(F.max(stamp).alias("known_at"))
    joined = candidates.join(known, key, "left")
    action = F.when(F.col("known_at").isNull(), "create").when(F.col(stamp) > F.col("known_at"), "refresh").otherwise("skip")
    return joined.withColumn("action", action).drop("known_at")


def resolved(requests: DataFrame, approvals: DataFrame, now: Column) -> DataFrame:
    """The decision for each request: its target's, else its repository's, else the general one, else ``ask``.

    Tiers are equi-joins: each tier's live approvals are reduced to the newest of a key first.
    """
    live = approvals.where(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
    newest = F.max_by("decision", F.struct("updated_at", "id"))
    target = live.where("target is not null").groupBy("family", "repository", "target").agg(newest.alias("d1"))
    repo = live.where("target is null and repository is not null").groupBy("family", "repository").agg(newest.alias("d2"))
    general = live.where("target is null and repository is null").groupBy("family").agg(newest.alias("d3"))
    joined = requests.join(target, ["family", "repository", "target"], "left").join(repo, ["family", "repository"], "left").join(general, "family", "left")
    source = F.when(F.col("d1").isNotNull(), "target").when(F.col("d2").isNotNull(), "repository").when(F.col("d3").isNotNull(), "global").otherwise("default")
    return joined.withColumn("decision", F.coalesce("d1", "d2", "d3", F.lit("ask"))).withColumn("source", source).drop("d1", "d2", "d3")


def soft_deleted(memory: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Rows named in ``ids`` (id, by) are superseded by what is named there, whatever they were before, and are updated ``now``.

    Where nothing is named it is ``manual:`` and the time; of several names for an id the least counts. superseded_by is text.
    """
    named = ids.groupBy("id").agg(F.min(F.col("by").cast("string")).alias("by")).withColumn("_named", F.lit(True))
    by = F.coalesce("by", F.concat(F.lit("manual:"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss'.000Z'")))
    out = memory.join(named, "id", "left").withColumn("superseded_by", F.when(F.col("_named"), by).otherwise(F.col("superseded_by").cast("string")))
    return out.withColumn("updated_at", F.when(F.col("_named"), now).otherwise(F.col("updated_at"))).drop("by", "_named")


def latest_activity(*sources: tuple[str, DataFrame, str]) -> DataFrame:
    """Name and time of the newest row over several tables."""
    each = [df.agg(F.max(stamp).alias("happened_at")).select(F.lit(name).alias("source"), "happened_at") for name, df, stamp in sources]
    every = each[0]
    for df in each[1:]:
        every = every.union(df)
    return every.where("happened_at is not null").orderBy(F.desc("happened_at"), "source").limit(1)
