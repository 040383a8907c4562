"""Small cases of lists, items, merges of maps and retained text."""

import pytest
from pyspark.sql import functions as F

from mnemark.operators import listing as O
from mnemark.plans import listing_queries  # noqa: F401
from mnemark.plans.memory_queries import QUERIES

SF = "/root/testdata/sf0.01"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def texts(*values):
    return F.array(*[F.lit(v) for v in values])


@pytest.mark.parametrize("name", ["F2_listed_memory", "R12_day_summaries_for", "J4_improvements", "J16_improvement_edges", "U7_missing_ids", "R18_ranked_items", "X7_raw_terms"])
def test_queries_find_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_nothing_asked_narrows_nothing(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, None, 5)], "id int, kind string, superseded_by int")
    assert O.narrowed(rows, {"kind": None}, {"kind": []}, {"superseded_by": None}).count() == 2
    assert [r.id for r in O.narrowed(rows, given={"superseded_by": True}).collect()] == [2]
    assert O.in_state(rows, "active").count() == O.in_state(rows, "superseded").count() == 1 and O.in_state(rows, "all").count() == 2


@pytest.mark.parametrize(
    ("repository", "current", "wide", "narrow"),
    [("a", "b", True, True), ("a", "a", False, False), ("a", None, True, False), ("a", "", True, False), (None, "b", False, False), ("", None, False, False)],
)
def test_rows_from_elsewhere(spark, repository, current, wide, narrow):
    r, c = F.lit(repository).cast("string"), F.lit(current).cast("string")
    assert one(spark, F.struct(O.from_elsewhere(r, c, True), O.from_elsewhere(r, c, False))) == (wide, narrow)


def test_items_that_match_come_first_and_low_signal_last(spark):
    items = texts("Files modified:", " ", "rollback of the schema", "keep the parser short", "short")
    ranked = one(spark, O.ranked_items(items, texts("parser")))
    assert [(r["value"], r["matched"], r["score"], r["position"]) for r in ranked] == [
        ("keep the parser short", 1, 2.5, 2), ("rollback of the schema", 0, 2.0, 1), ("short", 0, 0.0, 3), ("Files modified:", 0, -4.0, 0),
    ]
    assert one(spark, O.chosen_items(O.ranked_items(items, texts("parser")), 3)) == ["keep the parser short"]
    assert one(spark, O.chosen_items(O.ranked_items(items, texts("absent")), 2)) == ["rollback of the schema", "keep the parser short"]
    assert one(spark, O.ranked_items(F.array().cast("array<string>"), texts("a"))) == []


def test_later_map_wins_and_null_maps_count_as_empty(spark):
    a, b = F.create_map(F.lit("k"), F.lit("1"), F.lit("m"), F.lit("2")), F.create_map(F.lit("k"), F.lit("9"))
    assert one(spark, O.merged_maps(a, b)) == {"k": "9", "m": "2"}
    assert one(spark, O.merged_maps(F.lit(None).cast("map<string,string>"), b)) == {"k": "9"}


def test_retained_lists_and_leads(spark):
    assert one(spark, O.retained_list(texts(" A  b", "a B", "", None, "c"), 2)) == ["A b", "c"]
    assert one(spark, O.without_markers(F.lit("- * 2) 3. do it "))) == "do it"
    assert one(spark, O.without_markers(F.lit(None).cast("string"))) == ""
    assert one(spark, O.without_prompt_prefix(F.lit(" Planning : okay fix  it"))) == "fix it"


def test_findings_renew_the_newest_active_row(spark):
    cols = "case_id string, source string, title string, linked_memory_id int, status string, created_at int, updated_at int"
    held = spark.createDataFrame([("c", "s", "old", 1, "active", 1, 1), ("c", "s", "newer", None, "active", 2, 2), ("c", "s", "done", 3, "resolved", 3, 3)], cols)
    batch = spark.createDataFrame([(" c ", "s", " told ", None, 8), ("c", "s", "earlier", 7, 6), ("", "s", "lost", 1, 9), ("d", "s", "made", None, 9)], "case_id string, source string, title string, linked_memory_id int, updated_at int")
    rows = sorted(tuple(r) for r in O.upsert_improvements(held, batch).collect())
    assert sorted(map(str, rows)) == sorted(map(str, [
        ("c", "s", "old", 1, "active", 1, 1), ("c", "s", "told", 7, "active", 2, 8), ("c", "s", "done", 3, "resolved", 3, 3), ("d", "s", "made", None, "active", 9, 9),
    ]))


def test_empty_lists(spark):
    none = spark.createDataFrame([], "severity string, tier string, place int")
    assert tuple(O.severity_counts(none).first()) == (0, 0, 0)
    assert O.tier_counts(none, ["place"]).count() == 0
