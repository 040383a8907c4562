"""Sessions: their turns in order, and the memories that rules take from them, for all sessions at once.

``turns`` has session_id, turn_index, user_message and assistant_response. Only the newest turns of a session are read
by a rule, and these are found in two steps, so that a session that holds a third of all turns is no single task's work.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import lexicon as L
from ..functions.terms import captured, matches, uncorrected
from ..functions.text import normalize, truncated, without_injected
from .ranking import first_of, newest


def numbered(rows: DataFrame, by: str, place: str, out: str = "position", width: int = 4096) -> DataFrame:
    """Gapless positions from 0 by a whole-number column within each group; ranges of it are counted first, so none is gathered."""
    dealt = rows.withColumn("_part", F.floor(F.col(place) / width))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(by, "_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy(place, *[c for c in rows.columns if c not in (by, place)]))
    return dealt.withColumn("_row", within).join(offsets, [by, "_part"]).withColumn(out, F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def clean(message: Column) -> Column:
    return normalize(without_injected(message))


def interaction_style(message: Column) -> Column:
    """voice, warmth, humour, frequency, collaborative and by_name of a message that asks for a manner; else null."""
    said = {k: matches(message, getattr(L, k)) for k in ("AS_COLLEAGUE", "AS_FRIEND", "AS_PARTNER", "WITH_HUMOUR", "WITHOUT_HUMOUR", "BY_NAME")}
    any_sign = reduce(lambda a, b: a | b, said.values())
    light = said["WITH_HUMOUR"] & ~said["WITHOUT_HUMOUR"]
    profile = F.struct(
        F.when(said["AS_COLLEAGUE"], "colleague").when(said["AS_PARTNER"], "collaborative").otherwise("friendly").alias("voice"),
        F.when(said["AS_FRIEND"], "warm").otherwise("balanced").alias("warmth"),
        F.when(light, "light").otherwise("none").alias("humour"),
        F.when(light & matches(message, L.OFTEN_HUMOUR), "frequent").when(light, "occasional").otherwise("never").alias("frequency"),
        (said["AS_PARTNER"] | said["AS_COLLEAGUE"]).alias("collaborative"),
        said["BY_NAME"].alias("by_name"),
    )
    return F.when(matches(message, L.STYLE_REQUESTS) & any_sign, profile)


def memories(rows: DataFrame, kind: Column | str, content: Column, confidence: float | Column) -> DataFrame:
    value = confidence if isinstance(confidence, Column) else F.lit(confidence)
    return rows.select("session_id", "turn_index", (kind if isinstance(kind, Column) else F.lit(kind)).alias("type"), content.alias("content"), value.alias("confidence"))


def stated_preferences(turns: DataFrame) -> DataFrame:
    """Manners, preferences and rejections said in the newest twelve turns; one memory a message, in this order."""
    rows = _short(turns, 12, 240)
    style, m = F.col("style").isNotNull(), F.col("message")
    rows = rows.withColumn("style", interaction_style(m))
    kind = F.when(style, "interaction_style").when(matches(m, [L.PREFERENCE]), "user_preference").when(matches(m, [L.REJECTION]), "rejected_approach")
    content = F.when(style, F.concat(F.lit("Interaction style preference: "), m)).otherwise(m)
    return memories(rows.withColumn("kind", kind).where("kind is not null"), F.col("kind"), content, F.when(style, 0.92).otherwise(0.95))


def latest_messages(turns: DataFrame, count: int) -> DataFrame:
    """session_id, turn_index and cleaned message of the newest ``count`` turns of each session."""
    last = newest(turns.select("session_id", "turn_index", "user_message"), ["session_id"], [F.desc("turn_index"), F.col("user_message")], count)
    return last.withColumn("message", clean(F.col("user_message"))).drop("user_message")


def _short(turns: DataFrame, count: int, most: int) -> DataFrame:
    """Of the newest turns those whose cleaned message is not longer than ``most``."""
    return latest_messages(turns, count).where((F.col("message") != "") & (F.length("message") <= most))


def captured_memories(turns: DataFrame, kind: str, pattern: str, lead: str, count: int, most: int, least: int, confidence: float) -> DataFrame:
    """What a pattern captures in the newest turns, each wording once in a session, at its first turn."""
    rows = _short(turns, count, most).withColumn("found", captured(F.col("message"), pattern)).where(F.length("found") >= least)
    once = rows.withColumn("low", F.lower("found")).groupBy("session_id", "low").agg(F.min(F.struct("turn_index", "found")).alias("f")).select("session_id", "f.*")
    return memories(once, kind, F.concat(F.lit(lead), "found"), confidence)


def stated_goals(turns: DataFrame) -> DataFrame:
    return captured_memories(turns, "assistant_goal", L.GOAL, "Current assistant goal: ", 12, 240, 10, 0.85)


def stated_mistakes(turns: DataFrame) -> DataFrame:
    return captured_memories(turns, "recurring_mistake", L.MISTAKE, "Recurring mistake to avoid: ", 20, 260, 8, 0.9)


def implied_mistakes(turns: DataFrame) -> DataFrame:
    """One memory for each session whose newest twenty turns correct the assistant twice or more."""
    rows = _short(turns, 20, 280).where(matches(F.col("message"), L.CORRECTIONS)).where(F.length(uncorrected(F.col("message"))) >= 12)
    several = rows.groupBy("session_id").agg(F.count(F.lit(1)).alias("n"), F.max("turn_index").alias("turn_index")).where("n >= 2")
    return memories(several, "recurring_mistake", F.lit(f"Recurring mistake to avoid: {L.IMPLICIT_MISTAKE}."), 0.93)


def implied_goals(turns: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """One memory for each session with two different failures that stay unresolved, by what the first four speak of.

    They are sought in the newest sixteen turns, then in the actions, decisions and open items of ``items``.
    """
    last = newest(turns.select("session_id", "turn_index", "user_message", "assistant_response"), ["session_id"], [F.desc("turn_index"), F.col("user_message")], 16)
    sides = last.select("session_id", F.lit(0).alias("list"), F.col("turn_index").cast("long").alias("turn_index"), F.posexplode(F.array("user_message", "assistant_response")).alias("side", "text"))
    each = sides.withColumn("text", clean(F.col("text")))
    if items is not None:
        placed = lambda k, name: F.transform(name, lambda t, i: F.struct(F.lit(k).alias("list"), i.alias("side"), t.alias("text")))
        lists = [placed(k, name) for k, name in enumerate(("actions", "decisions", "open_items"), 1)]
        more = items.select("session_id", F.explode(F.concat(*lists)).alias("i")).select("session_id", F.lit(None).cast("long").alias("turn_index"), "i.*")  # one reading for all lists
        each = each.unionByName(more.withColumn("text", normalize(F.col("text"))))
    failing = each.where((F.col("text") != "") & (F.length("text") <= 280)).where(matches(F.col("text"), L.FAILURES) & ~matches(F.col("text"), L.RESOLUTIONS))
    once = failing.withColumn("text", truncated(F.col("text"), 140)).groupBy("session_id", "text").agg(F.min(F.struct("list", "turn_index", "side")).alias("at"))
    first = first_of(once, ["session_id"], [F.col("at"), F.col("text")], 4)
    lists = first.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("found")).where(F.size("found") >= 2)  # four at most
    corpus = F.array_join(F.transform("found", lambda x: x["text"]), " ")
    goal = reduce(lambda other, rule: F.when(matches(corpus, [rule[0]]), rule[1]).otherwise(other), reversed(L.FAILURE_GOALS), F.lit(L.OTHER_FAILURE_GOAL))
    return memories(lists.withColumn("turn_index", F.element_at("found", -1)["at"]["turn_index"]), "assistant_goal", F.concat(F.lit("Current assistant goal: "), goal), 0.82)
