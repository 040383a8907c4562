"""Statistics, roll-ups, latency summaries, facets and day summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.terms import is_noise
from ..functions.text import normalize, tokens
from .ranking import newest


def store_stats(memory: DataFrame) -> DataFrame:
    live = F.col("superseded_by").isNull()
    return memory.agg(
        F.count(F.lit(1)).alias("memories"),
        F.count_if(live).alias("active"),
        F.count_if(~live).alias("superseded"),
        *[F.count_if(live & (F.col("scope") == s)).alias(f"scope_{s}") for s in ("global", "transferable", "repo")],
        F.count_if(live & (F.col("reinforcement") > 1)).alias("reinforced"),
        F.sum("reinforcement").alias("reinforcements"),
    )


def rollup_runs(items: DataFrame) -> DataFrame:
    """Counters of each run and the status they give: pending rows first, then failed ones."""
    counted = items.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("pending", "failed", "completed")],
        F.count_if(F.col("planned") == "create").alias("creates"),
        F.max("updated_at").alias("updated_at"),
    )
    status = F.when(F.col("pending") > 0, "running").when(F.col("failed") > 0, "failed").otherwise("completed")
    done = F.col("completed") + F.col("failed")
    return counted.withColumn("status", status).withColumn("percent", F.round(100 * done / F.col("total")).cast("long"))


def facets(memory: DataFrame, columns: list[str], most: int = 200) -> DataFrame:
    """Counts by each column in one pass: the rows are expanded before, and counted in part before, the shuffle."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns])).alias("p")
    counts = memory.select(pairs).select("p.*").where("value is not null").groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))
    at = F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))
    return counts.withColumn("_at", at).where(F.col("_at") <= most).drop("_at")


def day_summaries(episodes: DataFrame, most: int = 8) -> DataFrame:
    """The newest ``most`` summaries of each day and repository as one text, without noise where anything else is there.

    Days whose newest episodes have no summary are told to have none.
    """
    by = ["date_key", "repository"]
    rows = episodes.withColumn("repository", F.coalesce("repository", F.lit("")))
    light = newest(rows.select(*by, "session_id", "updated"), by, [F.desc("updated"), F.desc("session_id")], most)
    texts = light.join(rows.select(*by, "session_id", "updated", normalize(F.col("summary")).alias("summary")), [*by, "session_id", "updated"])
    lines = F.array_sort(F.collect_list(F.struct("updated", "session_id", "summary")))  # ``most`` at most
    listed = texts.groupBy(*by).agg(F.reverse(lines).alias("every"))
    full = F.transform(F.filter("every", lambda x: x["summary"] != ""), lambda x: x["summary"])
    real = F.filter(full, lambda s: ~is_noise(s))
    told = listed.select(*by, F.when(F.size(real) > 0, real).otherwise(full).alias("kept"))
    text = F.when(F.size("kept") == 0, "No remembered activity.").otherwise(F.array_join(F.transform("kept", lambda s: F.concat(F.lit("- "), s)), "\n"))
    return told.select(*by, text.alias("summary"), F.size("kept").cast("long").alias("episodes"))


def refreshed_days(held: DataFrame, episodes: DataFrame, changed: DataFrame) -> DataFrame:
    """``held`` (:func:`day_summaries`) brought up to date: only the days and repositories of ``changed`` episodes are made anew."""
    by = ["date_key", "repository"]
    keys = changed.select("date_key", F.coalesce("repository", F.lit("")).alias("repository")).distinct()
    touched = episodes.withColumn("repository", F.coalesce("repository", F.lit(""))).join(keys, by, "left_semi")
    return held.join(keys, by, "left_anti").unionByName(day_summaries(touched))


def latency_summary(trace: DataFrame, by: str, target_ms: float, least: int, bins: int = 1024) -> DataFrame:
    """n, mean, p50, p95, max and latest of each group, by the floor rule: the value at place floor((n - 1) p).

    Equal values are counted first. Bins between a group's least and largest value then tell in which bin a place lies,
    and only that bin is sorted, so a group that holds most rows is never sorted whole.
    """
    rows = trace.where(F.col("latency_ms").isNotNull())
    facts = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.min("latency_ms").alias("_lo"), F.max("latency_ms").alias("most"), F.round(F.avg("latency_ms"), 6).alias("mean"), F.max_by("latency_ms", F.struct("recorded_at", "id")).alias("latest")
    )
    width = F.col("most") - F.col("_lo")
    at_bin = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("latency_ms") - F.col("_lo")) / width * bins))).otherwise(0).cast("int")
    counts = rows.groupBy(by, "latency_ms").agg(F.count(F.lit(1)).alias("c")).join(facts.select(by, "_lo", "most", "n"), by).withColumn("bin", at_bin)
    sums = counts.groupBy(by, "bin").agg(F.sum("c").alias("s"), F.max("n").alias("n"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(by).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = {"p50": F.floor((F.col("n") - 1) * 0.5), "p95": F.floor((F.col("n") - 1) * 0.95)}
    holds = lambda t: (F.col("before") <= t) & (t < F.col("before") + F.col("s"))
    wanted = sums.withColumn("before", before).where(holds(place["p50"]) | holds(place["p95"])).select(by, "bin", "before", "s")
    upto = F.col("before") + F.sum("c").over(Window.partitionBy(by, "bin").orderBy("latency_ms"))
    placed = counts.join(wanted, [by, "bin"]).withColumn("upto", upto)
    value = lambda t: F.min(F.when(holds(t) & (F.col("upto") > t), F.col("latency_ms")))
    ranks = placed.groupBy(by).agg(*[value(t).alias(name) for name, t in place.items()])
    ready = F.when(F.col("n") < least, "warming").when(F.col("p95") <= target_ms, "met").otherwise("missed")
    return facts.drop("_lo").join(ranks, by).withColumn("target", ready)


def latency_trend(trace: DataFrame, by: str, flat_ms: float = 5.0) -> DataFrame:
    """Mean of the newest samples against that of those before: w = max(1, min(10, n div 2)) of each."""
    last = newest(trace.select(by, "latency_ms", "recorded_at", "id"), [by], [F.desc("recorded_at"), F.desc("id")], 20)
    order = Window.partitionBy(by).orderBy(F.desc("recorded_at"), F.desc("id"))
    rows = last.withColumn("at", F.row_number().over(order)).join(trace.groupBy(by).agg(F.count(F.lit(1)).alias("n")), by)
    w = F.greatest(F.lit(1), F.least(F.lit(10), F.floor(F.col("n") / 2)))
    means = rows.withColumn("w", w).groupBy(by).agg(
        F.round(F.avg(F.when(F.col("at") <= F.col("w"), F.col("latency_ms"))), 6).alias("recent"),
        F.round(F.avg(F.when((F.col("at") > F.col("w")) & (F.col("at") <= 2 * F.col("w")), F.col("latency_ms"))), 6).alias("previous"),
    )
    change = F.round(F.col("recent") - F.col("previous"), 6)
    return means.withColumn("change", change).withColumn("trend", F.when(F.abs("change") <= flat_ms, "flat").when(F.col("change") > 0, "up").when(F.col("change") < 0, "down").otherwise("unknown"))


def repeated(df: DataFrame, keys: list[str], least: int, most: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return counts.orderBy(F.desc("n"), *keys).limit(most)


def pattern_highlights(df: DataFrame, by: str, text: str, most: int = 3) -> DataFrame:
    """Tokens that several texts of a group hold, the most frequent first."""
    each = df.select(by, F.explode(tokens(F.col(text))).alias("token")).groupBy(by, "token").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    at = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("n"), "token"))
    return each.withColumn("place", at).where(F.col("place") <= most)


def merged_duplicates(memory: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that share their keys as one: the surest stays, counts add up, tags unite."""
    best = F.max_by("id", F.struct("confidence", "reinforcement", F.col("updated_at"), F.col("id")))
    return memory.groupBy(*keys).agg(
        best.alias("winner"), F.count(F.lit(1)).alias("n"), F.max("confidence").alias("confidence"),
        F.sum("reinforcement").alias("reinforcement"), F.array_join(F.array_sort(F.collect_set("tags")), " ").alias("tags"),
    ).where("n > 1")


