"""What a session's records tell: outlines of its checkpoints, its digest, and all memories that rules take from it.

Tables: ``sessions`` (session_id, repository, cwd, branch, summary, updated_at), ``checkpoints`` (session_id,
checkpoint_number, title, overview, history, work_done, technical_details, next_steps), ``files`` (session_id, file_path,
first_seen_at), ``refs`` (session_id, ref_type, ref_value, created_at) and ``turns``. Sessions are worked on all at once;
lists that a digest keeps are bounded, and of longer ones only the first entries are ever gathered.
"""

from __future__ import annotations

import bisect
import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions.terms import assistant_name, meaningful, significance, themes, unique, user_name
from ..functions.text import BLANKS, SPACE, UNEVEN, last_segments, normalize, truncated
from . import sessions as N
from .ranking import newest

CODE_SIGNS = re.compile("[`_/]")
UNEVEN_RUNS, MAYBE_UNEVEN = re.compile(UNEVEN), re.compile("[^!-~ ]|  ")
MARKERS = re.compile(rf"(?:[-*](?:{SPACE})?|[0-9]+[.)](?:{SPACE})?)+")
SUBJECTS, ACTORS, TITLES = (re.compile(p, re.IGNORECASE | re.ASCII) for p in (L.OUTLINE_WORDS, L.OUTLINE_ACTORS, L.OUTLINE_TITLES))
SUBJECT_WORDS = re.findall("[a-z-]{3,}", L.OUTLINE_WORDS)


def best_lines(text: str, most: int) -> list[str]:
    """One pass over a text's lines with a stack of headings; holds the ``most`` best lines alone, however long the text.

    What raises or lowers a line's worth is looked for once in each line, not again in all lines below a heading: nothing
    that is sought holds the ``: `` between the parts of a line.
    """
    low = text.lower()
    coded, subjects, actors = CODE_SIGNS.search(text), any(w in low for w in SUBJECT_WORDS), "user" in low or "conversation" in low
    above: list[tuple] = []
    best: list[tuple] = []
    held: set[str] = set()
    for place, line in enumerate(text.split("\n")):
        marked = MARKERS.match(line)  # markers count only where a line begins with one
        bare = line[marked.end() :] if marked else line
        bare = (UNEVEN_RUNS.sub(" ", bare) if MAYBE_UNEVEN.search(bare) else bare).strip(" ")
        if not bare:
            continue
        level = (len(line) - len(line.lstrip(BLANKS))) // 2
        while above and above[-1][0] >= level:
            above.pop()
        signs = [bool(coded and CODE_SIGNS.search(bare)), bool(subjects and SUBJECTS.search(bare)), bool(actors and ACTORS.search(bare))]
        if above:
            signs = [a or b for a, b in zip(signs, above[-1][2])]
        if bare.endswith(":"):
            above.append((level, bare[:-1] if not above else f"{above[-1][1]}: {bare[:-1]}", signs))
            continue
        full = f"{above[-1][1]}: {bare}" if above else bare
        same = full.lower()
        if same in held:
            continue
        code, subject, actor = signs
        worth = 2 * code + (24 <= len(full) <= 220) + 3 * subject - 2 * actor - (3 if not above and TITLES.search(full) else 0)
        if best and len(best) == most and -worth >= best[-1][0]:  # a later line enters a full list only by more worth
            continue
        bisect.insort(best, (-worth, place, full, same))
        held.add(same)
        if len(best) > most:
            held.remove(best.pop()[3])
    return [b[2] for b in best]


def outline(text: Column, most: int = 12) -> Column:
    """The worthiest distinct lines of a text, each behind the headings that it stands below; of equal worth the earlier first.

    Every two blanks of indent are a level; a line that ends in a colon is a heading until a line of its level or above.
    """

    @F.arrow_udf("array<string>")
    def lines(texts: pa.Array) -> pa.Array:
        return pa.array([best_lines(t.as_py() or "", most) for t in texts], pa.list_(pa.string()))

    return lines(text)


def latest_checkpoints(checkpoints: DataFrame) -> DataFrame:
    """The checkpoint of the largest number of each session; of repeated numbers one."""
    fields = ["title", "overview", "history", "work_done", "technical_details", "next_steps"]
    row = F.struct(*fields)
    return checkpoints.groupBy("session_id").agg(F.max_by(row, F.struct("checkpoint_number", row)).alias("c")).select("session_id", "c.*")


def first_distinct(rows: DataFrame, value: Column, at: str, most: int, out: str) -> DataFrame:
    """The first ``most`` distinct values of each session in the order in which they appear, as a list."""
    once = rows.select("session_id", normalize(value).alias("v"), F.col(at).alias("at")).where("v <> ''").groupBy("session_id", "v").agg(F.min("at").alias("at"))
    first = newest(once, ["session_id"], [F.col("at").asc_nulls_first(), F.col("v")], most)
    return first.groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda x: x["v"]).alias(out))  # ``most`` of a session


def checkpoint_items(checkpoints: DataFrame, files: DataFrame) -> DataFrame:
    """session_id, actions (12 at most), decisions (14) and open_items (10) of every session with a checkpoint or a file."""
    latest = latest_checkpoints(checkpoints)
    paths = first_distinct(files, F.col("file_path"), "first_seen_at", 12, "paths")
    worked = latest.withColumn("worked", outline(F.col("work_done"), 10))  # the best eight of these are an outline's of eight
    done = worked.select(
        "session_id", F.lit(True).alias("has_checkpoint"), "title", "overview", "work_done",
        F.concat("worked", outline(F.col("history"), 6)).alias("acts"),
        F.concat(outline(F.col("technical_details"), 12), F.slice("worked", 1, 8), outline(F.col("overview"), 6)).alias("decided"),
        outline(F.col("next_steps"), 10).alias("open"),
    )
    none = F.expr("cast(array() as array<string>)")
    both = done.join(paths, "session_id", "full")
    return both.select(
        "session_id", F.coalesce("has_checkpoint", F.lit(False)).alias("has_checkpoint"), "title", "overview", "work_done",
        unique(F.concat(F.coalesce("acts", none), F.coalesce("paths", none)), 12).alias("actions"),
        unique(F.coalesce("decided", none), 14).alias("decisions"), unique(F.coalesce("open", none), 10).alias("open_items"),
    )


def counted(rows: DataFrame, most: int, out: str) -> DataFrame:
    return rows.groupBy("session_id").agg(F.least(F.count(F.lit(1)), F.lit(most)).alias(out))


def outer_turns(turns: DataFrame) -> DataFrame:
    """The first turn's message and the last turn's answer of each session."""
    row = F.struct("turn_index", "user_message", "assistant_response")
    return turns.groupBy("session_id").agg(F.min_by("user_message", row).alias("first_message"), F.max_by("assistant_response", row).alias("last_answer"))


def digests(sessions: DataFrame, checkpoints: DataFrame, files: DataFrame, refs: DataFrame, turns: DataFrame) -> DataFrame:
    """One row a session: summary, actions, decisions, learnings, significance, themes, open_items, date_key.

    The summary begins with the first of six texts that says something of the work; where none does it tells where the
    work was. A session without records still has a digest. ``files`` and ``refs`` stay tables of their own.
    """
    items = checkpoint_items(checkpoints, files)
    label = F.concat_ws(":", "ref_type", "ref_value")
    learned = N.stated_preferences(turns).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "content"))), lambda x: x["content"]).alias("learnings"))  # twelve at most
    parts = [
        items, outer_turns(turns), first_distinct(files, last_segments(F.col("file_path")), "first_seen_at", 3, "paths"), first_distinct(refs, label, "created_at", 2, "labels"),
        counted(files, 3, "n_files"), counted(refs, 2, "n_refs"), learned,
    ]
    rows = reduce(lambda a, b: a.join(b, "session_id", "left"), parts, sessions)
    none = F.expr("cast(array() as array<string>)")
    listed = {c: F.coalesce(c, none) for c in ("actions", "decisions", "open_items", "learnings", "paths", "labels")}
    rows = rows.withColumns(listed | {"n_files": F.coalesce("n_files", F.lit(0)), "n_refs": F.coalesce("n_refs", F.lit(0)), "has_checkpoint": F.coalesce("has_checkpoint", F.lit(False))})
    candidates = (F.col("title"), F.col("summary"), N.clean(F.col("first_message")), F.col("overview"), F.col("work_done"), N.clean(F.col("last_answer")))
    highlights = unique(F.concat(F.slice("decisions", 1, 2), F.slice("actions", 1, 2), F.slice("open_items", 1, 1)), 2)
    told = lambda lead, c: F.when(F.size(c) > 0, F.array(F.concat(F.lit(lead), F.array_join(c, ", ")))).otherwise(none)
    rows = rows.withColumns({"_seed": F.coalesce(*[meaningful(c) for c in candidates]), "_details": F.array_join(F.concat(highlights, told("files: ", "paths"), told("refs: ", "labels")), " | ")})
    nonempty = lambda c: F.nullif(F.col(c), F.lit(""))
    where = F.concat(F.lit("Worked in "), F.coalesce(nonempty("repository"), nonempty("cwd"), F.lit("local workspace")), F.coalesce(F.concat(F.lit(" on "), nonempty("branch")), F.lit("")))
    details = F.nullif(F.col("_details"), F.lit(""))
    led = lambda lead: truncated(normalize(F.concat(lead, F.coalesce(F.concat(F.lit(" — "), details), F.lit("")))), 220)
    summary = F.when(F.col("_seed").isNotNull(), led(F.col("_seed"))).when(details.isNotNull(), led(where)).otherwise(F.concat(where, F.lit(" ("), F.col("session_id").cast("string"), F.lit(")")))
    rows = rows.withColumn("has_summary", F.coalesce("summary", F.lit("")) != "").withColumn("summary", summary)
    about = F.array_join(F.concat(F.array("summary"), F.slice("actions", 1, 3), F.slice("decisions", 1, 2), F.slice("open_items", 1, 2)), " ")
    return rows.select(
        "session_id", "repository", "branch", "summary", "actions", "decisions", "learnings", "open_items",
        significance(F.col("n_files"), F.col("n_refs"), F.col("has_checkpoint"), F.col("has_summary")).alias("significance"),
        themes(about, F.col("repository")).alias("themes"), F.to_date("updated_at").alias("date_key"), F.col("updated_at").alias("created_at"),
    )


def identities(turns: DataFrame) -> DataFrame:
    """Names that the newest twelve turns give the assistant, one memory a turn, and the user, each name once at its first turn."""
    rows = N.latest_messages(turns, 12).withColumns({"assistant": assistant_name(F.col("message")), "own": user_name(F.col("message"))})
    called = N.memories(rows.where("assistant is not null"), "assistant_identity", F.concat(F.lit("The user calls the assistant "), "assistant", F.lit(".")), 0.99)
    first = rows.where("own is not null").groupBy("session_id", F.lower("own").alias("low")).agg(F.min(F.struct("turn_index", "own")).alias("f")).select("session_id", "f.*")
    return called.unionByName(N.memories(first, "user_identity", F.concat(F.lit("The user's preferred name is "), "own", F.lit(".")), 0.99))


def open_loops(items: DataFrame) -> DataFrame:
    each = items.select("session_id", F.lit(None).cast("long").alias("turn_index"), F.explode("open_items").alias("item"))
    return N.memories(each, "open_loop", F.col("item"), 0.8)


def session_memories(turns: DataFrame, items: DataFrame) -> DataFrame:
    """session_id, turn_index, type, content, confidence of all memories that rules take from sessions.

    A goal or a mistake is inferred only for a session that states none. ``items`` is :func:`checkpoint_items`.
    """
    goals, mistakes = N.stated_goals(turns), N.stated_mistakes(turns)
    no_goal = N.implied_goals(turns, items).join(goals.select("session_id").distinct(), "session_id", "left_anti")
    no_mistake = N.implied_mistakes(turns).join(mistakes.select("session_id").distinct(), "session_id", "left_anti")
    return reduce(DataFrame.unionByName, [identities(turns), goals, no_goal, mistakes, no_mistake, N.stated_preferences(turns), open_loops(items)])
