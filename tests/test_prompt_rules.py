"""Rules on prompts, sessions and state in small cases with known answers."""

import re
import time

import pytest
from pyspark.sql import functions as F

from mnemark.functions import terms as X
from mnemark.operators import aggregates, diagnostics, extraction, ranking, rules, sessions, snapshots


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize("text, want", [
    ("call yourself atlas", "Atlas"), ("Hey Juno, hello", "Juno"), ("hello there!", None), ("Your name is Max now", "Max"), ("Please, stop", None), ("écall you bob", "Bob"), ("xcall you bob", None), ("", None), (None, None),
])
def test_names_of_the_assistant(spark, text, want):
    assert one(spark, text, X.assistant_name) == want


def test_terms_of_queries(spark):
    text = "Recall the sessions AND rollback of `QueryNormalizer.mjs`"
    assert one(spark, text, X.search_terms) == ["recall", "memory", "remember", "the", "rollback", "restore", "snapshot", "backfill", "querynormalizer", "mjs"]
    assert one(spark, text, X.direct_terms) == ["recall", "the", "rollback", "querynormalizer", "mjs"]
    assert set(one(spark, text, X.entity_terms)) == {"querynormalizer", "query", "normalizer"}
    assert one(spark, None, X.search_terms) == []


@pytest.mark.parametrize("kind, text, repository, want", [
    ("user_preference", "prefer tabs in this repo", "a", "repo"), ("user_preference", "reuse the CI pattern", "a", "transferable"), ("user_preference", "reuse the tone pattern", "a", "global"),
    ("fact", "the CI runs", "a", "transferable"), ("fact", "éci runs", "a", "transferable"), ("fact", "plain", None, "global"), ("fact", "plain", "a", "repo"), ("blocker", "CI", None, "repo"), ("fact", "call yourself atlas", "a", "global"),
])
def test_scopes_of_memories(spark, kind, text, repository, want):
    row = spark.createDataFrame([(kind, text, repository)], "k string, t string, r string")
    assert row.select(rules.memory_scope(F.col("k"), F.col("t"), F.col("r"), F.lit(None).cast("string"))).first()[0] == want


def test_what_prompts_need(spark):
    rows = [("Hello Juno!",), ("Juno, what did we do yesterday about parsers?",), ("no jokes, this is an outage",), (None,)]
    got = [r.asDict() for r in rules.prompt_need(spark.createDataFrame(rows, "t string"), "t").collect()]
    assert got[0]["addressed"] and got[0]["identity_only"] and not got[0]["local_context"]
    assert got[1]["temporal"] and got[1]["continuity"] and got[1]["cross_repository"]
    assert got[2]["no_humour"] and got[2]["serious"] and got[2]["explicit_style"]
    assert not got[3]["needs_lookup"]


def test_corrections_and_failures_of_sessions(spark):
    talk = [
        (1, 0, "no, that should be the left one", "ok"), (1, 1, "actually use the older reader there", "the build failed twice here"), (1, 2, "fine", "lint error in main"), (1, 3, "fine", "the error is fixed"),
        (2, 0, "no, that should be the left one", None), (3, 0, None, None),
    ]
    turns = spark.createDataFrame(talk, "session_id int, turn_index int, user_message string, assistant_response string")
    points = "session_id int, checkpoint_number int, title string, overview string, history string, work_done string, technical_details string, next_steps string"
    none = extraction.checkpoint_items(spark.createDataFrame([], points), spark.createDataFrame([], "session_id int, file_path string, first_seen_at int"))
    got = {(r.session_id, r.type): (r.turn_index, r.content) for r in extraction.session_memories(turns, none).collect()}
    assert got[1, "recurring_mistake"][0] == 1
    assert got[1, "assistant_goal"] == (2, "Current assistant goal: stabilize failing execution paths before continuing implementation")
    assert {k for k, _ in got} == {1}
    assert extraction.session_memories(turns.limit(0), none).count() == 0


def test_turns_are_numbered_over_ranges(spark):
    rows = spark.createDataFrame([(g, 3 * k) for g in (1, 2) for k in range(50)], "g int, k int")
    assert all(r.position == r.k // 3 for r in sessions.numbered(rows, "g", "k", width=7).collect())


def test_rows_placed_by_hand_take_all_of_their_key(spark):
    schema = "type string, key string, scope string, repository string, manual boolean, saved boolean, confidence int, reinforcement int, last_seen int, tags string"
    held = spark.createDataFrame([("t", "a", "global", None, True, False, 5, 1, 1, "x"), ("t", "b", "repo", "r", False, True, 5, 1, 1, "x"), ("t", "c", "repo", "r", False, False, 5, 1, 1, "x")], schema)
    batch = spark.createDataFrame([("t", k, "repo", "r", False, False, c, 2, s, "y") for k, c, s in (("a", 3, 9), ("b", 3, 9), ("c", 4, 8), ("c", 3, 9), ("d", 1, 9))], schema)
    got = {r.key: (r.scope, r.repository, r.confidence, r.reinforcement, r.last_seen, r.tags) for r in snapshots.insert_memories(held, batch).collect()}
    assert got == {"a": ("global", None, 5, 3, 9, "x y"), "b": ("repo", "r", 5, 3, 9, "x y"), "c": ("repo", "r", 3, 5, 9, "x y"), "d": ("repo", "r", 1, 2, 9, "y")}


def test_overrides_tell_what_is_missing(spark):
    memory = spark.createDataFrame([(1, "t", "repo", "r", "global", False)], "id int, type string, scope string, repository string, auto_scope string, manual boolean")
    asked = spark.createDataFrame([(1, "set", "global", None, 1), (2, "set", "repo", None, 1)], "id int, action string, scope string, repository string, at int")
    preview, applied = snapshots.scope_overrides(memory, asked)
    assert {(r.id, r.found, r.changed) for r in preview.collect()} == {(1, True, True), (2, False, False)}
    assert [tuple(r) for r in applied.collect()] == [(1, "global", None, True)]


def test_percentiles_of_one_value_and_of_one_row(spark):
    import datetime

    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(i, "same", 7.0, at) for i in range(9)] + [(99, "one", 3.0, at)] + [(i, "wide", float(i % 100) ** 3, at) for i in range(100, 400)], "id long, hook string, latency_ms double, recorded_at timestamp")
    got = {r.hook: (r.n, r.p50, r.p95) for r in aggregates.latency_summary(rows, "hook", 1.0, 1).collect()}
    wide = sorted(float(i % 100) ** 3 for i in range(100, 400))
    assert got == {"same": (9, 7.0, 7.0), "one": (1, 3.0, 3.0), "wide": (300, wide[149], wide[284])}


def test_evidence_without_rows_is_missing(spark):
    items = spark.createDataFrame([(1, 1, "Red  box", ["a"]), (1, 2, "x", []), (2, 3, "y", [])], "case_id int, item int, snippet string, kinds array<string>")
    shown = spark.createDataFrame([(1, "a", "a red\nbox", 4, False), (1, "b", "red box", 1, True)], "case_id int, kind string, text string, rank int, included boolean")
    found = diagnostics.evidence(items, shown)
    assert {(r.item, r.best_rank, r.outcome) for r in found.collect()} == {(1, 4, "ranked_only"), (2, 1, "included"), (3, None, "missing")}
    assert {(r.case_id, r.outcome) for r in diagnostics.case_outcomes(found).collect()} == {(1, "included"), (2, "missing")}


def test_evidence_of_a_case_that_has_most_rows(spark):
    n = 30_000  # 900 million pairs of rows, and 20 of distinct texts
    k = F.col("id")
    items = spark.range(n).select(F.lit(1).alias("case_id"), k.alias("item"), F.concat(F.lit("Box "), (k % 4).cast("string")).alias("snippet"), F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("kinds"))
    shown = spark.range(n).select(F.lit(1).alias("case_id"), F.when(k % 3 > 0, "a").alias("kind"), F.concat(F.lit("a  box "), (k % 3).cast("string")).alias("text"), (k + 7).alias("rank"), (k % 3 == 1).alias("included"))
    began = time.perf_counter()
    told = diagnostics.evidence(items, shown).groupBy(F.col("item") % 4, "best_rank", "outcome").count().collect()
    assert time.perf_counter() - began < 60
    assert sorted(map(tuple, told), key=str) == [(0, None, "missing", n // 4), (1, 8, "included", n // 4), (2, 9, "ranked_only", n // 4), (3, None, "missing", n // 4)]


def test_newest_rows_of_a_group_that_has_most(spark):
    rows = spark.createDataFrame([(1, i) for i in range(500)] + [(2, 1)], "g int, at int")
    assert sorted((r.g, r.at) for r in ranking.newest(rows, ["g"], [F.desc("at")], 3).collect()) == [(1, 497), (1, 498), (1, 499), (2, 1)]


def test_a_prompt_of_twenty_thousand_words_takes_seconds(spark):
    text = "Hey Juno, " + " ".join(f"word{k} please keep" for k in range(7000)) + " needle"
    frame = spark.createDataFrame([(text,)], "t string")
    began = time.perf_counter()
    got = frame.select(rules.task_terms(F.col("t")).alias("w")).first().w
    assert rules.prompt_need(frame, "t").count() == 1
    assert time.perf_counter() - began < 30
    assert got[0] == "word0" and got[-1] == "needle" and len(got) == 7001 and "please" not in got and "juno" not in got


@pytest.mark.parametrize(("pattern", "text"), [(r"\bcat\b", "a Cat."), (r"\bcat\b", "concat"), (r"\bs?cat\b", "xcat"), (r"\b(?:x|cat)\b", "cats"), (r"cat\s+\b", "cat  dog"), (r"\d\b", "a1é"), (r"\bcafé", "un café")])
def test_boundaries_are_those_of_ascii_words(spark, pattern, text):
    want = re.search(pattern, text, re.IGNORECASE | re.ASCII) is not None
    assert spark.range(1).select(F.lit(text).rlike(X.java(pattern))).first()[0] == want


def test_patterns_are_tried_only_where_their_openings_stand(spark):
    from mnemark.functions import lexicon as L
    from mnemark.functions import terms as X

    assert [X.opening(p) for p in (r"\bthis repo\b", r"\blight(?:-|\s)?humou?r\b", r"\bhumou?r\b", r"^session [0-9a-f-]{8,}$", r"\b(?:a|b)\b", "yes|no")] == ["this repo", "light", "humo", "session", "", ""]
    texts = ["We use CI here", "ancient", "a LIGHT-humour voice", "humor", "Reuse", "reused", "on this\nbranch", "", None, "Package.JSON of x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = rows.select("i", *[X.matches(F.col("t"), p).alias(f"m{k}") for k, p in enumerate((L.TRANSFERABLE, L.GLOBAL_PREFERENCE, L.REPO_SPECIFIC))]).orderBy("i").collect()
    assert [[k for k in range(3) if r[k + 1]] for r in got] == [[0], [], [1], [1], [0], [], [], [], [], [2]]


def test_themes_look_at_the_whole_text_where_its_beginning_has_too_few_words(spark):
    from mnemark.functions import terms as X

    texts = ["a " * 400 + "alpha bravo! gamma-delta", "x" * 498 + "yz wordy later", "first second third fourth fifth sixth " + "pad " * 300]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.themes(F.col("t"), F.lit("org/x")).alias("w")).orderBy("i").collect()
    assert [r.w[2:] for r in got] == [["alpha", "bravo", "gamma-delta"], ["x" * 498 + "yz", "wordy", "later"], ["first", "second", "third", "fourth", "fifth"]]
