"""Lists as a user asks for them: optional filters, states, own and other repositories, orders of browsing, links between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.terms import java
from ..functions.text import SPACE, normalize, tokens
from .diagnostics import SEVERITIES
from .ranking import first_of

#: Least risky first.
TIERS = ("low", "moderate", "high", "critical")


def narrowed(
    rows: DataFrame,
    equal: Mapping[str, object] | None = None,
    within: Mapping[str, Sequence] | None = None,
    given: Mapping[str, bool | None] | None = None,
    until: tuple[str, Column] | None = None,
) -> DataFrame:
    """Rows under whichever conditions are asked: null values, empty lists and null ``given`` ask nothing."""
    for column, value in (equal or {}).items():
        rows = rows if value is None or value == "" else rows.where(F.col(column) == value)
    for column, values in (within or {}).items():
        rows = rows.where(F.col(column).isin(*values)) if values else rows
    for column, wanted in (given or {}).items():
        rows = rows if wanted is None else rows.where(F.col(column).isNotNull() == F.lit(wanted))
    return rows if until is None else rows.where(F.col(until[0]) <= until[1])


def in_state(rows: DataFrame, state: str) -> DataFrame:
    """Rows that are ``active``, those ``superseded``, or all of them."""
    asked = {"active": False, "superseded": True}.get(state)
    return narrowed(rows, given={"superseded_by": asked})


def of_repository(rows: DataFrame, repository: str | None, shared: Column) -> DataFrame:
    """Rows of one repository and those shared by all; without a repository every row."""
    return rows if repository is None else rows.where((F.col("repository") == repository) | shared)


def from_elsewhere(repository: Column, current: Column, where_unknown: bool) -> Column:
    """Whether a row belongs to another repository; ``where_unknown`` says so of any row where there is no current one."""
    named, known = F.coalesce(repository, F.lit("")) != "", F.coalesce(current, F.lit("")) != ""
    return F.when(~named, False).when(~known, where_unknown).otherwise(repository != current)


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows asked for."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def missing_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Ids asked for that no row has, each once; also the sessions that have no digest yet."""
    return ids.select(key).distinct().join(rows, key, "left_anti")


def browse_memory(memory: DataFrame, limit: int) -> DataFrame:
    """What a search without terms shows: the surest first, then the newest."""
    return memory.orderBy(F.desc("confidence"), F.desc("updated_at"), "id").limit(limit)


def browse_episodes(episodes: DataFrame, limit: int) -> DataFrame:
    return episodes.orderBy(F.desc("updated"), F.desc("significance"), "session_id").limit(limit)


def day_summaries_for(asked: DataFrame, days: DataFrame, limit: int, include_other: bool = False) -> DataFrame:
    """Summaries of each asked day (prompt_id, date_key, own): the own repository, then none, then others; the newest first."""
    repository, own = F.coalesce("repository", F.lit("")), F.coalesce("own", F.lit(""))
    place = F.when((own != "") & (repository == own), 0).when(repository == "", 1).otherwise(2)
    met = asked.join(days, "date_key").withColumn("place", place)
    met = met if include_other else met.where(repository == own)
    return first_of(met, ["prompt_id"], [F.col("place"), F.desc("computed_at"), F.asc("repository")], limit)


def is_low_signal(item: Column) -> Column:
    return F.regexp_replace(normalize(item), r": *$", "").rlike(rf"(?i)^(?:{'|'.join(L.LOW_SIGNAL_ITEMS)})")


def ranked_items(items: Column, terms: Column) -> Column:
    """(value, matched, score, position) of a row's items, the best first. The list stays in its row: nothing is shuffled."""
    clean = F.filter(F.transform(items, normalize), lambda v: v != "")

    def scored(value: Column, position: Column) -> Column:
        matched = F.size(F.array_intersect(tokens(value), terms))
        score = (
            matched * 2.0
            + F.when(value.rlike("[`_/]"), 1.5).otherwise(0.0)
            + F.when(value.rlike(java(L.DOMAIN_WORDS)), 1.5).otherwise(0.0)
            + F.when(F.length(value).between(20, 220), 0.5).otherwise(0.0)
            - F.when(is_low_signal(value), 3.0).otherwise(0.0)
            - F.when(value.endswith(":"), 1.0).otherwise(0.0)
        )
        return F.struct((-matched).alias("m"), (-score).alias("s"), position.alias("position"), value.alias("value"))

    order = F.array_sort(F.transform(clean, scored))
    return F.transform(order, lambda r: F.struct(r["value"].alias("value"), (-r["m"]).alias("matched"), (-r["s"]).alias("score"), r["position"].alias("position")))


def chosen_items(ranked: Column, limit: int) -> Column:
    """The first items that matched a term, or the first of all where none did."""
    matching = F.filter(ranked, lambda r: r["matched"] > 0)
    return F.transform(F.slice(F.when(F.size(matching) > 0, matching).otherwise(ranked), 1, limit), lambda r: r["value"])


def workstreams(rows: DataFrame, limit: int) -> DataFrame:
    """Open workstreams before those done, the newest first."""
    return rows.orderBy(F.col("status") == "done", F.desc("updated_at"), "id").limit(limit)


def indexed_text(index: DataFrame, sessions: DataFrame) -> DataFrame:
    """Entries of the search index with the repository and branch of their sessions."""
    return index.join(sessions.select("session_id", "repository", "branch"), "session_id")


def with_workspace(sessions: DataFrame, workspace: DataFrame) -> DataFrame:
    """Sessions with what their workspace says of them, where it says anything."""
    said = lambda c: F.nullif(F.col(f"w.{c}"), F.lit(""))
    told = lambda c: F.nullif(F.col(f"s.{c}"), F.lit(""))
    return sessions.alias("s").join(workspace.alias("w"), "session_id", "left").select(
        "session_id", *[F.coalesce(said(c), told(c)).alias(c) for c in ("repository", "branch")],
        F.coalesce("w.updated_at", "s.updated_at").alias("updated_at"), F.col("s.updated_at").alias("stored_at"), said("summary").alias("workspace_summary"),
    )


def improvements_of(asked: DataFrame, improvements: DataFrame, memory: DataFrame, limit: int) -> DataFrame:
    """The newest improvements that are linked to a memory of each asked session."""
    linked = memory.select(F.col("id").alias("linked_memory_id"), "session_id", "type").join(asked.select("session_id").distinct(), "session_id", "left_semi")
    return first_of(improvements.join(linked, "linked_memory_id"), ["session_id"], [F.desc("updated_at"), F.asc("improvement_id")], limit)


def improvement_edges(improvements: DataFrame) -> DataFrame:
    """Two steps from a session: memories taken from it, and improvements linked to those (the rows of :func:`improvements_of`)."""
    edge = lambda kind, start, end: improvements.select(F.lit(kind).alias("kind"), F.col(start).cast("string").alias("from_id"), F.col(end).cast("string").alias("to_id"))
    return edge("from_session", "linked_memory_id", "session_id").unionByName(edge("improves", "improvement_id", "linked_memory_id")).distinct()


def severity_counts(incidents: DataFrame) -> DataFrame:
    """One row: incidents of each severity, those of an unknown one among the warnings."""
    known = F.when(F.col("severity").isin(*SEVERITIES), F.col("severity")).otherwise("warning")
    return incidents.select(known.alias("s")).agg(*[F.count_if(F.col("s") == s).alias(s) for s in SEVERITIES])


def tier_counts(actions: DataFrame, by: list[str]) -> DataFrame:
    """Actions of each risk tier and the highest one; ``low`` where there is none."""
    at = F.array_position(F.array(*map(F.lit, TIERS)), F.col("tier"))
    return actions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("tier") == t).alias(t) for t in TIERS],
        F.array(*map(F.lit, TIERS))[F.greatest(F.coalesce(F.max(at), F.lit(1)), F.lit(1)).cast("int") - 1].alias("highest"),
    )


def merged_maps(mine: Column, theirs: Column) -> Column:
    """Entries of both maps; where both have a key, ``theirs`` holds."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    mine, theirs = F.coalesce(mine, none), F.coalesce(theirs, none)
    return F.map_concat(F.map_filter(mine, lambda k, v: ~F.map_contains_key(theirs, k)), theirs)


def upsert_improvements(held: DataFrame, batch: DataFrame) -> DataFrame:
    """``held`` after a batch of findings (case_id, source, title, linked_memory_id, updated_at).

    A finding renews the newest active row of its case and source, or makes one. Of several findings of a batch
    the last is told, with the last linked memory that any names. Rows without a case or title are not taken.
    """
    keys = ["case_id", "source"]
    taken = batch.where((F.trim("case_id") != "") & (F.trim("title") != "")).withColumns({"case_id": F.trim("case_id"), "title": F.trim("title")})
    at = F.struct("updated_at", "title")
    news = taken.groupBy(*keys).agg(
        F.max_by("title", at).alias("n_title"), F.max_by("linked_memory_id", F.when(F.col("linked_memory_id").isNotNull(), at)).alias("n_linked"),
        F.min("updated_at").alias("n_first"), F.max("updated_at").alias("n_last"),
    )
    active = F.col("status") == "active"
    renewed = first_of(held.where(active), keys, [F.desc("updated_at"), F.desc("created_at")])
    rest = held.join(renewed.select(*keys, "created_at", "updated_at", "status"), [*keys, "created_at", "updated_at", "status"], "left_anti")
    merged = renewed.join(news, keys, "full").select(
        *keys, F.coalesce("n_title", "title").alias("title"), F.coalesce("n_linked", "linked_memory_id").alias("linked_memory_id"), F.lit("active").alias("status"),
        F.coalesce("created_at", "n_first").alias("created_at"), F.coalesce("n_last", "updated_at").alias("updated_at"),
    )
    return rest.select(*merged.columns).unionByName(merged)


def retained_list(values: Column, most: int = 12) -> Column:
    """The first distinct non-empty values whatever their case, white space collapsed."""
    clean = F.filter(F.transform(values, normalize), lambda v: v != "")
    low = F.transform(clean, F.lower)
    return F.slice(F.filter(clean, lambda v, i: F.array_position(low, F.lower(v)) == i + 1), 1, most)


def without_markers(text: Column) -> Column:
    """A line less its list markers."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), rf"^(?:[-*](?:{SPACE})?|\d+[.)](?:{SPACE})?)+", ""), rf"^(?:{SPACE})|(?:{SPACE})$", "")


def without_prompt_prefix(text: Column) -> Column:
    """A prompt less the word that says what is being done, then less a word of address."""
    doing = F.regexp_replace(normalize(text), r"(?i)^(?:researching|planning|implementing) ?: ?", "")
    return F.regexp_replace(doing, r"(?i)^(?:please|ok(?:ay)?|hey) ", "")
