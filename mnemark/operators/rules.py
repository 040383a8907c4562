"""Rule ladders: scopes, incidents, risk, due tasks, provenance and capability matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.terms import assistant_name, java, let, matches, mentions
from ..functions.text import normalize, words
from .ranking import first_of

# How much each part of a capability's description counts.
NAME_WEIGHT, DESCRIPTION_WEIGHT = 4, 3


def memory_scope(type_: Column, text: Column, repository: Column, given: Column, name: Column | None = None) -> Column:
    """The first rule that holds: a given scope, then the type's own, then what the text speaks of.

    ``text`` is all that is said of the memory: type, content, tags, reason and note; ``name`` is its
    :func:`assistant_name`, where that is known already.
    """
    name = assistant_name(text) if name is None else name
    local, moves, general = matches(text, L.REPO_SPECIFIC), matches(text, L.TRANSFERABLE), matches(text, L.GLOBAL_PREFERENCE)
    asked = F.lower(F.trim(given))
    return (
        F.when(asked.isin("global", "transferable", "repo"), asked)
        .when(type_ == "interaction_style", "global")
        .when((type_ == "assistant_identity") | name.isNotNull(), "global")
        .when(type_ == "user_identity", "global")
        .when(type_.isin("open_loop", "blocker", "commitment"), "repo")
        .when(type_ == "directive", "global")
        .when(type_ == "workstream_overlay", F.when(repository.isNotNull(), "repo").otherwise("global"))
        .when(type_.isin("user_preference", "rejected_approach"), F.when(local, "repo").when(moves & ~general, "transferable").otherwise("global"))
        .when(type_ == "recurring_mistake", "global")
        .when(type_ == "assistant_goal", F.when(local, "repo").when(moves, "transferable").otherwise("global"))
        .when(moves, "transferable")
        .when(repository.isNull(), "global")
        .otherwise("repo")
    )


def episode_scope(open_items: Column, text: Column, given: Column) -> Column:
    """A given scope; the repository's own while items are open; what can move; else the repository's own."""
    asked = F.lower(F.trim(given))
    return F.when(asked.isin("global", "transferable", "repo"), asked).when(F.size(open_items) > 0, "repo").when(matches(text, L.TRANSFERABLE), "transferable").otherwise("repo")


def effective_repository(scope: Column, repository: Column, origin: Column, fallback: Column) -> Column:
    return F.when(scope != "global", F.coalesce(repository, origin, fallback))


def task_terms(prompt: Column) -> Column:
    """What is left of a prompt to look up once address, style and manners are taken out: long words, without stop words."""
    text = normalize(prompt)
    for p in L.FRAMES:
        text = F.regexp_replace(text, java(p), "")
    for p in (*L.TONE, *L.COLLEAGUE_STYLE, *L.COLLABORATIVE_STYLE, *L.LIGHT_HUMOUR, *L.NO_JOKES, *L.ADDRESSING):
        text = F.regexp_replace(text, java(p), " ")

    def long_words(left: Column) -> Column:
        name = F.array(F.lower(F.coalesce(assistant_name(left), F.lit(""))))
        every = F.filter(F.split(F.regexp_replace(F.lower(left), r"[^a-z0-9\s./_-]", " "), r"\s+"), lambda w: F.length(w) > 3)
        return F.array_except(every, F.concat(F.array(*map(F.lit, (*L.TASK_STOP_WORDS, *L.PHATIC_TERMS))), name))

    return let(text, long_words)


def prompt_need(prompts: DataFrame, text: str) -> DataFrame:
    """``prompts`` with what each asks for: memories of a time, continuity, examples, style, or only a greeting."""
    prompts, t = prompts.withColumn("_t", F.trim(F.coalesce(F.col(text), F.lit("")))), F.col("_t")
    colleague, together = matches(t, L.COLLEAGUE_STYLE), matches(t, L.COLLABORATIVE_STYLE)
    humour, no_jokes = matches(t, L.LIGHT_HUMOUR), matches(t, L.NO_JOKES)
    style = matches(t, (*L.TONE, *L.COLLEAGUE_STYLE, *L.COLLABORATIVE_STYLE, *L.LIGHT_HUMOUR, *L.NO_JOKES, *L.ADDRESSING))
    called = lambda p: F.nullif(F.lower(F.regexp_extract(t, java(p), 1)), F.lit(""))
    direct = called(r"^([a-z][a-z0-9_-]{2,20})[,:]\s")
    greeted = called(r"^(?:hi|hello|hey)\s+([a-z][a-z0-9_-]{2,20})(?:[!?,.]|\s|$)")
    named = lambda c: c.isNotNull() & ~F.coalesce(c, F.lit("")).isin(*L.NO_ADDRESS)
    facts = prompts.withColumns({
        "addressed": named(direct) | named(greeted) | assistant_name(t).isNotNull(),
        "continuity": mentions(t, L.CONSISTENCY_SIGNALS), "examples": mentions(t, L.TRANSFER_SIGNALS), "time": mentions(t, L.TEMPORAL_SIGNALS),
        "style": style, "explicit_style": colleague | together | humour | no_jokes, "has_task": F.size(task_terms(t)) > 0,
        "serious": matches(t, L.SERIOUS), "no_humour": no_jokes | (~humour & matches(t, L.SERIOUS)), "local_only": matches(t, L.LOCAL_SCOPE),
    })
    c = F.col
    timed = facts.withColumn("temporal", c("time") & (~c("addressed") | c("continuity") | c("examples") | c("has_task")))
    only = timed.withColumn("identity_only", c("addressed") & ~c("temporal") & ~c("continuity") & ~c("examples") & ~c("style") & ~c("has_task"))
    return only.withColumns({
        "needs_lookup": c("temporal") | c("addressed") | c("continuity") | c("style") | c("examples"),
        "local_context": ~c("identity_only") & (c("temporal") | c("continuity") | c("has_task")),
        "cross_repository": c("examples") | (c("temporal") & ~c("local_only")),
    }).drop("time", "has_task", "local_only", "_t")


def risk(actions: DataFrame) -> DataFrame:
    """Risk score and tier of planned actions by mutability, reversibility, reach and trust; what is unknown counts as such."""
    def part(column: str, table: dict[str, int], unknown: str) -> Column:
        at = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
        return F.coalesce(F.try_element_at(at, F.trim(column)), F.lit(table[unknown]))

    score = part("mutability", L.MUTABILITY, "read-only") + part("reversibility", L.REVERSIBILITY, "reversible") + part("reach", L.REACH, "isolated") + part("trust", L.TRUST, "unknown")
    return actions.withColumn("score", score).withColumn("tier", risk_tier(F.col("score")))


def risk_tier(score: Column) -> Column:
    return F.when(score >= 12, "critical").when(score >= 8, "high").when(score >= 4, "moderate").otherwise("low")


def due(last_completed: Column, last_started: Column, cadence_minutes: Column, now: Column, force: Column) -> Column:
    """Why a task is or is not due."""
    age = F.floor((F.unix_seconds(now) - F.unix_seconds(F.coalesce(last_completed, last_started))) / 60)
    return (
        F.when(force, "forced")
        .when(F.coalesce(last_completed, last_started).isNull(), "never_run")
        .when(cadence_minutes == 0, "always_due")
        .when(age >= cadence_minutes, "due")
        .otherwise("within_cadence")
    )


def stalled(queue: DataFrame, now: Column, running_hours: int = 2, due_hours: int = 6) -> DataFrame:
    """Jobs that run, or wait, for longer than they should, with the incident's severity."""
    late = F.when((F.col("status") == "running") & (F.col("available_at") <= now - F.make_interval(hours=F.lit(running_hours))), "running").when(
        F.col("status").isin("pending", "failed") & (F.col("available_at") <= now - F.make_interval(hours=F.lit(due_hours))), "due"
    )
    return queue.withColumn("stall", late).where("stall is not null").withColumn("severity", F.when(F.col("stall") == "running", "warning").otherwise("info"))


def provenance(asked: DataFrame, days: DataFrame, episodes: DataFrame, raw: DataFrame) -> DataFrame:
    """Where an answer about a day comes from: day summary, episodes, raw sessions, or nowhere."""
    marks = [df.select("date_key").distinct().withColumn(name, F.lit(True)) for name, df in (("has_day", days), ("has_episode", episodes), ("has_raw", raw))]
    joined = asked
    for m in marks:
        joined = joined.join(m, "date_key", "left")
    pick = lambda a, b, c, d: F.when(F.col("has_day"), a).when(F.col("has_episode"), b).when(F.col("has_raw"), c).otherwise(d)
    return joined.withColumn("source", pick("day_summary", "episode_fallback", "session_store_verifier", "none")).withColumn("confidence", pick("high", "medium", "low", "none")).drop("has_day", "has_episode", "has_raw")


def capability_match(capabilities: DataFrame, prompts: DataFrame) -> DataFrame:
    """prompt_id, name, score: weights of the words that a prompt and a capability share, each occurrence counting."""
    parts = [
        capabilities.select("name", F.explode(words(F.col(c))).alias("token"), F.lit(w).alias("weight"))
        for c, w in (("name", NAME_WEIGHT), ("description", DESCRIPTION_WEIGHT))
    ]
    weights = parts[0].union(parts[1]).groupBy("name", "token").agg(F.sum("weight").alias("weight"))
    asked = prompts.select("prompt_id", F.explode(F.array_distinct(words(F.col("text")))).alias("token"))
    return weights.join(asked, "token").groupBy("prompt_id", "name").agg(F.sum("weight").alias("score"))


def best_capabilities(capabilities: DataFrame, prompts: DataFrame, most: int) -> DataFrame:
    """prompt_id, name, score of the ``most`` best of each prompt, by score and name.

    Prompts that share the same words with any capability at all are matched once, and the answer is joined back.
    """
    known = capabilities.select(F.explode(words(F.concat_ws(" ", "name", "description"))).alias("token")).distinct()
    asked = prompts.select("prompt_id", F.explode(F.array_distinct(words(F.col("text")))).alias("token")).join(known, "token", "left_semi")
    alike = asked.groupBy("prompt_id").agg(F.array_join(F.array_sort(F.collect_set("token")), " ").alias("text"))
    once = alike.select(F.col("text").alias("prompt_id"), "text").distinct()
    best = first_of(capability_match(capabilities, once), ["prompt_id"], [F.desc("score"), F.col("name")], most)
    return alike.join(best.withColumnRenamed("prompt_id", "text"), "text").select("prompt_id", "name", "score")


def graph(nodes: list[tuple[str, DataFrame, str]], links: list[tuple[str, DataFrame, str, str, str, str]]) -> tuple[DataFrame, DataFrame]:
    """Nodes (kind, id) and edges (kind, from_kind, from_id, to_kind, to_id) of a provenance graph."""
    every = None
    for kind, df, key in nodes:
        one = df.select(F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id")).distinct()
        every = one if every is None else every.union(one)
    edges = None
    for kind, df, a_kind, a, b_kind, b in links:
        one = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(
            F.lit(kind).alias("kind"), F.lit(a_kind).alias("from_kind"), F.col(a).cast("string").alias("from_id"), F.lit(b_kind).alias("to_kind"), F.col(b).cast("string").alias("to_id")
        ).distinct()
        edges = one if edges is None else edges.union(one)
    return every, edges
