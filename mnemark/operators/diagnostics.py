"""What the engine tells of itself: hit rates, routes, clusters, evidence, plans of upkeep, incidents, drill-downs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.terms import matches
from ..functions.text import normalize
from .ranking import excluded, first_of, newest
from .rules import due

#: Most severe first.
SEVERITIES = ("critical", "warning", "info")


def part_of(count: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(count / whole, 4)).otherwise(0.0)


def cluster_summaries(memory: DataFrame, key: str) -> DataFrame:
    """Rows that share a canonical key: how many, how many live, and how often they were seen."""
    live = F.col("superseded_by").isNull()
    return memory.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(live).alias("active"), F.sum("reinforcement").alias("reinforcement"))


def hit_rates(lookups: DataFrame, most: int = 8) -> DataFrame:
    """Of each lookup (name, matched, included, dropped): times seen, matched and included, and the rates; those included most often first, then those matched most often."""
    sums = lookups.groupBy("name").agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("matched") > 0).alias("hits"), F.count_if(F.col("included") > 0).alias("used"), F.sum("dropped").alias("dropped")
    )
    rated = sums.withColumn("hit_rate", part_of(F.col("hits"), F.col("seen"))).withColumn("use_rate", part_of(F.col("used"), F.col("seen")))
    return rated.orderBy(F.desc(F.col("used") / F.col("seen")), F.desc(F.col("hits") / F.col("seen")), "name").limit(most)


def routes(trace: DataFrame) -> DataFrame:
    """Of each hook and route: records, and those that gave context."""
    return trace.groupBy("hook", "route").agg(F.count(F.lit(1)).alias("n"), F.count_if("injected").alias("with_context"))


def reasons(dropped: DataFrame, by: list[str]) -> DataFrame:
    """``reason xN`` of what was left out, the most frequent first."""
    counts = dropped.groupBy(*by, "reason").agg(F.count(F.lit(1)).alias("n"))
    said = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "reason"))), lambda x: F.concat(x["reason"], F.lit(" x"), (-x["m"]).cast("string")))
    return counts.groupBy(*by).agg(F.array_join(said, ", ").alias("reasons"))  # one entry for each reason, of which there are few


def themes_of(backlog: DataFrame, least: int = 2, most: int = 5) -> DataFrame:
    """Clusters of improvements by kind and theme: how many, how new, the largest first."""
    counts = backlog.groupBy("kind", "theme").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("updated_at")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), F.desc("updated_at"), "kind", "theme").limit(most)


def newest_kinds(rows: DataFrame, order: list[Column], newest: int, kind: str) -> DataFrame:
    return rows.orderBy(*order).limit(newest).groupBy(kind).agg(F.count(F.lit(1)).alias("n"))


def progress(runs: DataFrame) -> DataFrame:
    """Percent done, half up, and the phase, of runs with total, pending, running and failed counts."""
    done = F.col("total") - F.col("pending") - F.col("running")
    phase = F.when(F.col("total") == 0, "empty").when(F.col("pending") + F.col("running") == 0, F.when(F.col("failed") > 0, "failed").otherwise("completed")).when(done == 0, "queued").otherwise("running")
    return runs.withColumn("percent", F.when(F.col("total") > 0, F.floor(100 * done / F.col("total") + 0.5)).otherwise(0).cast("long")).withColumn("phase", phase)


def run_progress(runs: DataFrame) -> DataFrame:
    """Of runs (run_id, status, total, batch, processed) what waits, what is under way, the percent done, half up, and the phase; nothing to do is all done."""
    waiting = F.greatest(F.lit(0), F.col("total") - F.col("processed"))
    percent = F.least(F.lit(100), F.greatest(F.lit(0), F.floor(100 * F.col("processed") / F.col("total") + 0.5)))
    phases = {"running": "processing", "failed": "failed", "completed": "complete", "preview": "planning"}
    phase = F.coalesce(*[F.when(F.col("status") == s, p) for s, p in phases.items()], F.lit("idle"))
    return runs.select(
        "run_id", waiting.alias("waiting"), F.when(F.col("status") == "running", F.least(waiting, "batch")).otherwise(0).cast("long").alias("under_way"),
        F.when(F.col("total") > 0, percent).otherwise(100).cast("long").alias("percent"), phase.alias("phase"),
    )


def backfill_decisions(queue: DataFrame) -> DataFrame:
    """What a backfill of each repository does: go on with what runs, skip where nothing waits, else start."""
    counts = queue.groupBy("repository").agg(F.count_if(F.col("status") == "running").alias("running"), F.count_if(F.col("status").isin("pending", "failed")).alias("waiting"))
    return counts.select("repository", F.when(F.col("running") > 0, "resume").when(F.col("waiting") == 0, "skip").otherwise("start").alias("decision"))


def keyword_weights(parts: DataFrame, most: int) -> DataFrame:
    """Summed weights of each name's tokens, the heaviest first."""
    sums = parts.groupBy("name", "token").agg(F.sum("weight").alias("weight"))
    return first_of(sums, ["name"], [F.desc("weight"), F.col("token")], most)


def evidence(expected: DataFrame, shown: DataFrame) -> DataFrame:
    """Of each expected item (case_id, item, snippet, kinds) its best rank and outcome among the case's rows (case_id, kind, text, rank, included).

    Rows meet by case; a snippet matches where the row's plain text holds it and its kind is among the item's. What a case asks
    and what it shows are compared once for each distinct (snippet, kinds) and (kind, text), however many items and rows are alike.
    """
    plain = lambda c: F.lower(normalize(F.col(c)))
    wanted = expected.select("case_id", "item", plain("snippet").alias("snippet"), "kinds")
    texts = shown.where("text is not null").select("case_id", "kind", plain("text").alias("text"), "rank", "included").groupBy("case_id", "kind", "text").agg(
        F.min("rank").alias("rank"), F.coalesce(F.bool_or("included"), F.lit(False)).alias("included")
    )
    hit = F.contains("text", "snippet") & ((F.size("kinds") == 0) | F.array_contains("kinds", F.col("kind")))
    asked = wanted.select("case_id", "snippet", "kinds").distinct().join(texts, "case_id").where(hit)
    told = asked.groupBy("case_id", "snippet", "kinds").agg(F.min("rank").alias("rank"), F.bool_or("included").alias("included"))
    found = wanted.join(told, ["case_id", "snippet", "kinds"], "left").groupBy("case_id", "item").agg(
        F.min("rank").alias("best_rank"), F.count_if("included").alias("_in"), F.count("included").alias("_any")
    )
    outcome = F.when(F.col("_in") > 0, "included").when(F.col("_any") > 0, "ranked_only").otherwise("missing")
    return found.withColumn("outcome", outcome).drop("_in", "_any")


def case_outcomes(items: DataFrame) -> DataFrame:
    """A case is included if no item is missing, partial if any was found, else missing."""
    n = items.groupBy("case_id").agg(F.count_if(F.col("outcome") == "missing").alias("missing"), F.count_if(F.col("outcome") != "missing").alias("found"))
    return n.withColumn("outcome", F.when((F.col("missing") == 0) & (F.col("found") > 0), "included").when(F.col("found") > 0, "partial").otherwise("missing"))


def upkeep_plan(tasks: DataFrame, state: DataFrame, now: Column, most: int, only: Column | None = None) -> DataFrame:
    """Tasks (task, place, cadence, enabled) with their reason and whether this run takes them: the first ``most`` that are due."""
    known = tasks.join(state, "task", "left")
    reason = due(F.col("last_completed"), F.col("last_started"), F.col("cadence"), now, F.lit(False))
    told = known.withColumn("reason", reason)
    wanted = (F.col("reason") != "within_cadence") & F.col("enabled") & (F.lit(True) if only is None else only)
    # a plan has as many rows as there are kinds of task
    at = F.sum(wanted.cast("int")).over(Window.orderBy("place", "task").rowsBetween(Window.unboundedPreceding, 0))
    return told.withColumn("selected", wanted & (at <= most)).select("task", "reason", "selected")


def incidents(*sources: DataFrame) -> DataFrame:
    """Incidents (kind, severity, subject, detail) of several checks as one list, the most severe first."""
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return reduce(DataFrame.unionByName, sources).orderBy(order, "kind", "subject")


def latency_incidents(summary: DataFrame) -> DataFrame:
    late = summary.where(F.col("target") == "missed")
    return late.select(F.lit("latency").alias("kind"), F.lit("warning").alias("severity"), F.col("hook").cast("string").alias("subject"), F.concat(F.lit("p95 "), F.round("p95", 2).cast("string")).alias("detail"))


def task_incidents(tasks: DataFrame) -> DataFrame:
    bad = tasks.where(F.col("last_status").isin("failed", "needs_attention"))
    severity = F.when(F.col("last_status") == "failed", "critical").otherwise("info")
    return bad.select(F.lit("maintenance").alias("kind"), severity.alias("severity"), F.col("task").alias("subject"), F.col("last_status").alias("detail"))


def backlog_incidents(backlog: DataFrame, most: int = 20) -> DataFrame:
    n = backlog.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    return n.select(F.lit("backlog").alias("kind"), F.lit("info").alias("severity"), F.col("kind").cast("string").alias("subject"), F.col("n").cast("string").alias("detail"))


def drill_down(focus: DataFrame, memory: DataFrame, episodes: DataFrame, days: DataFrame) -> DataFrame:
    """Edges (kind, from_id, to_id) around the memories named in ``focus`` (id): session, day, supersession, cluster, sessions of the day.

    Everything starts from the few rows in focus, so a day or a cluster with very many members adds one edge for each.
    """
    ids = focus.select("id").distinct()
    seen = memory.join(ids, "id", "left_semi")
    edge = lambda df, kind, a, b: df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("from_id"), F.col(b).cast("string").alias("to_id"))
    own = seen.join(episodes.select("session_id", "date_key", F.coalesce("repository", F.lit("")).alias("_r")), "session_id")
    # the day of the repository itself before the day of all
    day = days.select("date_key", F.coalesce("repository", F.lit("")).alias("_day_r"))
    near = own.join(day, "date_key").where((F.col("_day_r") == F.col("_r")) | (F.col("_day_r") == ""))
    best = first_of(near, ["id"], [F.desc(F.col("_day_r") == F.col("_r"))]).withColumn("day", F.concat_ws("/", F.col("date_key").cast("string"), "_day_r"))
    above = seen.select(F.col("id").alias("_a"), F.col("superseded_by").alias("_b"))
    below = memory.join(ids.withColumnRenamed("id", "superseded_by"), "superseded_by", "left_semi").select(F.col("id").alias("_a"), F.col("superseded_by").alias("_b"))
    keyed = seen.where("canonical is not null").select("canonical", F.col("id").alias("_a"))
    cluster = memory.select("canonical", F.col("id").alias("_b")).join(keyed, "canonical").where("_a <> _b")
    beside = episodes.select("date_key", F.coalesce("repository", F.lit("")).alias("_r"), F.col("session_id").alias("_b"))
    siblings = own.select("date_key", "_r", F.col("session_id").alias("_a")).distinct().join(beside, ["date_key", "_r"]).where("_a <> _b")
    parts = [
        edge(own, "from_session", "id", "session_id"), edge(best, "on_day", "id", "day"), edge(above.union(below).distinct(), "superseded_by", "_a", "_b"), edge(cluster, "same_meaning", "_a", "_b"), edge(siblings, "same_day", "_a", "_b"),
    ]
    return reduce(DataFrame.unionByName, parts)


def without_generic(rows: DataFrame, by: list[str], generic: Column) -> DataFrame:
    """Rows of each group less the generic ones, if there is any other."""
    some = rows.groupBy(*by).agg(F.bool_or(~generic).alias("_some"))
    return rows.join(some, by).where(~F.col("_some") | ~generic).drop("_some")


def episodes_of_day(asked: DataFrame, episodes: DataFrame, limit: int, include_other: bool = False) -> DataFrame:
    """Episodes of each asked day (prompt_id, date_key, repository): the prompt's own repository, then all's, then others' if asked.

    The best ``max(3 * limit, 12)`` are looked at; of these placeholders and tool calls go, then repeated sessions and
    summaries, then generic work where there is any other. Ids alone are ranked, and only the chosen ones' texts are fetched.
    """
    place = F.when(F.col("repository") == F.col("_own"), 0).when(F.col("scope") == "global", 1).otherwise(2)
    light = episodes.select("date_key", "session_id", "repository", "scope", "significance", "updated")
    met = asked.withColumnRenamed("repository", "_own").join(light, "date_key").withColumn("place", place)
    seen = met if include_other else met.where("place < 2")
    order = [F.col("place"), F.desc("significance"), F.desc("updated"), F.desc("session_id")]
    pool = newest(seen.select("prompt_id", "session_id", "date_key", "place", "significance", "updated"), ["prompt_id"], order, max(3 * limit, 12))
    texts = episodes.join(pool.select("session_id").distinct(), "session_id", "left_semi").select("session_id", "date_key", "updated", normalize(F.col("summary")).alias("_t"))
    told = pool.join(texts, ["session_id", "date_key", "updated"]).where(excluded(F.col("_t")).isNull())
    facts = told.select("prompt_id", "session_id", "place", "significance", "updated", F.md5(F.lower("_t")).alias("same"), (F.col("_t") == "").alias("empty"), matches(F.col("_t"), L.NOISE_SUMMARIES[1:2]).alias("generic"))
    item = F.struct("place", (-F.col("significance")).alias("s"), (-F.col("updated")).alias("u"), (-F.col("session_id")).alias("i"), "session_id", "same", "empty", "generic")
    lists = facts.groupBy("prompt_id").agg(F.array_sort(F.collect_list(item)).alias("pool"))  # as many as are looked at
    repeated = lambda kept, x: F.exists(kept, lambda k: (k["session_id"] == x["session_id"]) | (~x["empty"] & (k["same"] == x["same"])))
    once = F.aggregate("pool", F.slice("pool", 1, 0), lambda kept, x: F.when(repeated(kept, x), kept).otherwise(F.concat(kept, F.array(x))))
    preferred = lists.withColumn("once", once).withColumn("real", F.filter("once", lambda x: ~x["generic"]))
    chosen = preferred.select("prompt_id", F.explode(F.slice(F.when(F.size("real") > 0, F.col("real")).otherwise(F.col("once")), 1, limit)).alias("e"))
    return chosen.select("prompt_id", "e.session_id", "e.place")


def sampled(rows: DataFrame, key: str, part: float) -> DataFrame:
    """A steady sample: rows whose key's hash falls into the first ``part`` of all."""
    return rows.where(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(1000)) < int(part * 1000))
