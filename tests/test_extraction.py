"""Outlines, digests and session memories in small cases, each after the rule it shows."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from mnemark.functions.terms import meaningful, user_name
from mnemark.functions.text import without_injected
from mnemark.operators import extraction as E
from mnemark.plans import extraction_queries  # noqa: F401
from mnemark.plans.memory_queries import QUERIES

TURNS = "session_id long, turn_index long, user_message string, assistant_response string"
POINTS = "session_id long, checkpoint_number long, title string, overview string, history string, work_done string, technical_details string, next_steps string"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def lines(spark, text, most=12):
    return one(spark, E.outline(F.lit(text), most))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        (None, []),
        ("", []),
        ("\n \n\t\n", []),
        ("Only a heading:", []),
        ("one\ntwo\none", ["one", "two"]),
        ("One\nONE  ", ["One"]),
        ("Head:\n  a\n  Sub:\n    b\nc", ["Head: a", "Head: Sub: b", "c"]),
        ("Head:\nsame level\n  deeper", ["same level", "deeper"]),
        ("    Deep:\n  Shallow:\n    x", ["Shallow: x"]),
        ("- item\n1. two\n3) three\n  - indented keeps its mark", ["- indented keeps its mark", "item", "two", "three"]),
        ("- \n*\nx", ["x"]),
        ("A::\n  b", ["A:: b"]),
        ("plain short\nwe updated `lib/db`", ["we updated `lib/db`", "plain short"]),
        ("the user asked\nzz", ["zz", "the user asked"]),
        ("files created\nzz", ["zz", "files created"]),
        ("a\r\nH:\r\n  b\r", ["a", "H: b"]),
    ],
)
def test_outlines(spark, text, expected):
    assert lines(spark, text) == expected


def test_an_outline_keeps_the_best_lines_of_a_long_text(spark):
    text = "\n".join(f"H{k % 50}:\n  line {k}" for k in range(20000)) + "\nadded `scope` of a rollback snapshot"
    found = lines(spark, text, 3)
    assert found == ["added `scope` of a rollback snapshot", "H0: line 0", "H1: line 1"]
    assert lines(spark, "b\na", 0) == []


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("I'm Maria", "Maria"), ("Hi Atlas, my name is José.", "José"), ("call me Ng!", "Ng"), ("I am back", None), ("I'm Back", None), ("my name is Anna Lee", None),
        ("I am maria", None), ("I'm Maria " + "x" * 80, None), ("", None), (None, None),
    ],
)
def test_user_names(spark, text, expected):
    assert one(spark, user_name(F.lit(text).cast("string"))) == expected


def test_summaries_that_say_nothing(spark):
    said = ("Planning: please look", "Session 0a1b2c3d", "call the tool now", "using only local repo files, do", "  ", None, "hey you")
    assert [one(spark, meaningful(F.lit(s).cast("string"))) for s in said] == ["look", None, None, None, None, None, "you"]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<relevant_memories>secret</relevant_memories>hi", "hi"), ("a<LORE_CONTEXT x='1'>\nb</lore_context>c", "a\nc"), ("<memory>kept</memory>", "<memory>kept</memory>"),
        ("x\n\n\n\n## Cross-Repo Hints\nz\n## Active Workstream", "x"), ("<hindsight_memories>open", "<hindsight_memories>open"), ("a\n\n\n\nb", "a\n\nb"), (None, ""),
        ("<relevant_memories_x>a</relevant_memories>", "<relevant_memories_x>a</relevant_memories>"),
    ],
)
def test_injected_context_goes(spark, text, expected):
    assert one(spark, without_injected(F.lit(text).cast("string"))) == expected


def memories(spark, turns, points=()):
    items = E.checkpoint_items(spark.createDataFrame(list(points), POINTS), spark.createDataFrame([], "session_id long, file_path string, first_seen_at long"))
    rows = E.session_memories(spark.createDataFrame(turns, TURNS), items).collect()
    return sorted((r.session_id, r.type, r.content, r.turn_index) for r in rows)


def test_a_goal_is_inferred_only_where_none_is_stated(spark):
    fails = [(s, k, f"the build failed with error {k}", "") for s in (1, 2) for k in range(2)]
    corrections = [(s, k, f"no, it should be the other one {k}", "") for s in (1, 2) for k in range(2, 4)]
    stated = [(1, 4, "my goal is to finish the parser", ""), (1, 5, "you keep dropping all the tests", "")]
    got = memories(spark, fails + corrections + stated)
    goals = [(r[0], r[2]) for r in got if r[1] == "assistant_goal"]
    assert goals == [(1, "Current assistant goal: to finish the parser"), (2, "Current assistant goal: stabilize failing execution paths before continuing implementation")]
    mistakes = [(r[0], r[2]) for r in got if r[1] == "recurring_mistake"]
    assert mistakes[0] == (1, "Recurring mistake to avoid: dropping all the tests") and mistakes[1][0] == 2 and len(mistakes) == 2


def test_failures_of_checkpoints_count_after_those_of_turns(spark):
    points = [(7, 0, None, None, None, None, None, "older: failed"), (7, 3, None, None, None, None, "schema migration failed\nall fixed: error", "replay timeout")]
    got = memories(spark, [(7, 2, "it cannot start", None)], points)
    assert [r for r in got if r[1] == "assistant_goal"] == [(7, "assistant_goal", "Current assistant goal: stabilize failing validation and replay coverage before shipping", None)]
    assert [r[2] for r in got if r[1] == "open_loop"] == ["replay timeout"]
    assert memories(spark, []) == []


def test_digests(spark):
    day = dt.datetime(2024, 1, 2)
    sessions = spark.createDataFrame([(1, "org/a", "/w", "main", "Session 0a1b2c3d", day), (2, None, "/w", "dev", None, day), (3, None, None, None, "", None)], "session_id long, repository string, cwd string, branch string, summary string, updated_at timestamp")
    points = spark.createDataFrame([(1, 1, "old", None, None, None, None, None), (1, 2, None, "planning: the overview", None, "did a\ndid b", "chose x", "next y")], POINTS)
    files = spark.createDataFrame([(1, f"src/lib/f{k}.py", k) for k in range(5)] + [(2, "a.md", 1), (2, "a.md", 2)], "session_id long, file_path string, first_seen_at long")
    refs = spark.createDataFrame([(1, "pr", "9", 1), (1, "pr", "9", 2)], "session_id long, ref_type string, ref_value string, created_at long")
    turns = spark.createDataFrame([(1, 0, " ", "x"), (1, 1, "I always prefer small steps", "done")], TURNS)
    got = {r.session_id: r for r in E.digests(sessions, points, files, refs, turns).collect()}
    assert got[1].summary == "the overview — chose x | did a | files: lib/f0.py, lib/f1.py, lib/f2.py | refs: pr:9"
    assert got[1].actions[:3] == ["did a", "did b", "src/lib/f0.py"] and got[1].decisions == ["chose x", "did a", "did b", "planning: the overview"]
    assert (got[1].learnings, got[1].open_items, got[1].significance) == (["I always prefer small steps"], ["next y"], 10)
    assert (got[2].summary, got[2].significance) == ("Worked in /w on dev — a.md | files: a.md", 5)
    assert (got[3].summary, got[3].significance, got[3].actions, got[3].date_key) == ("Worked in local workspace (3)", 3, [], None)
    assert E.digests(sessions.limit(0), points, files, refs, turns).count() == 0


@pytest.mark.parametrize("name", ["C4c_identities", "C4_session_memories", "C4g_digests"])
def test_queries_find_rows(spark, name):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0


def test_outline_of_many_lines_below_headings_takes_seconds():
    """A heading's signs count for the lines below it, and 200,000 lines cost a few seconds in one pass."""
    text = "Scope of `x`:\n" + "\n".join(f"  the user said {k % 5000} of it" for k in range(200_000)) + "\nplain words that end this text here"
    began = time.process_time()
    best = E.best_lines(text, 3)
    assert time.process_time() - began < 20
    assert best == [f"Scope of `x`: the user said {k} of it" for k in range(3)]
    assert E.best_lines("files created\nThe User:\n  added a_b\n  ADDED A_B\n", 4) == ["The User: added a_b", "files created"]
