"""Versions, backups, restores and migrations of the store."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from mnemark.operators.snapshots import superseded_duplicates
from mnemark.sources import store as V

T0 = dt.datetime(2024, 1, 1)
LEGACY = "id long, type string, content string, repository string, tags string, confidence double, superseded_by long, updated_at timestamp"


@pytest.fixture()
def store(spark, tmp_path):
    return V.Store(spark, f"file://{tmp_path}/store")


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def held(store, table, version=None):
    return sorted(r.v for r in store.read(table, version).collect())


def test_a_version_names_all_tables_and_older_ones_stay(spark, store):
    assert store.versions() == [] and store.tables() == []
    assert store.commit({"a": numbers(spark, 1, 2), "b": numbers(spark, 9)}) == 1
    assert store.commit({"a": store.read("a").union(numbers(spark, 3))}) == 2
    assert held(store, "a") == [1, 2, 3] and held(store, "b") == [9] and held(store, "a", 1) == [1, 2]
    assert store.manifest(1)["tables"]["b"] == store.manifest(2)["tables"]["b"]  # what did not change is not written again
    with pytest.raises(KeyError):
        store.read("c")
    with pytest.raises(FileNotFoundError):
        store.read("a", 7)


def test_a_write_that_dies_or_comes_late_leaves_the_last_version(spark, store):
    store.commit({"a": numbers(spark, 1)})
    fails = spark.range(3).select(F.raise_error(F.lit("lost")).cast("long").alias("v"))
    with pytest.raises(Exception, match="lost"):
        store.commit({"a": fails})
    assert held(store, "a") == [1] and store.versions() == [1]
    store.commit({"a": numbers(spark, 2)}, base=1)
    with pytest.raises(RuntimeError):
        store.commit({"a": numbers(spark, 3)}, base=1)  # another writer came first
    assert held(store, "a") == [2]
    assert V.Store(spark, store.root).versions() == [1, 2]


def test_backups_outlast_pruning_and_restores_are_new_versions(spark, store):
    store.commit({"a": numbers(spark, 1), "b": numbers(spark, 5)})
    assert V.snapshot_before(store, "n", 0) is None and V.snapshot_before(store, "n", 3, "never") is None
    assert V.snapshot_before(store, "n", 3) == "n" and store.backups() == ["n"]
    with pytest.raises(ValueError):
        V.snapshot_before(store, "m", 3, "always")
    with pytest.raises(FileExistsError):
        store.backup("n")
    store.commit({"a": numbers(spark, 2), "c": numbers(spark, 7)})
    store.commit({"a": numbers(spark, 3)})
    assert store.prune(1) == 2 and store.versions() == [3] and held(store, "a") == [3] and held(store, "b") == [5]
    assert store.restore("n") == 4 and store.tables() == ["a", "b"] and held(store, "a") == [1]
    assert held(store, "a", 3) == [3]
    with pytest.raises(FileNotFoundError):
        store.restore("none")
    assert store.prune(0) == 3 and store.versions() == [4] and held(store, "b") == [5]


def test_a_migration_adds_columns_and_classifies_anew(spark, store):
    rows = [
        (1, "fact", "uses the CI playbook", "r", None, 1.0, None, T0), (2, "fact", "plain", "r", "a b", 1.0, None, T0), (3, "fact", "plain", " ", None, 1.0, None, T0),
        (4, "user_identity", "The user's preferred name is Ana.", "r", "x y", 0.5, None, T0), (5, "user_identity", "the user's preferred name is ANA", None, "y z", 0.9, None, T0),
        (6, "user_identity", "The user's preferred name is Ana.", None, None, 0.99, 1, T0), (7, "assistant_goal", "Ship it!", "r", "", 1.0, None, T0),
    ]
    episodes = spark.createDataFrame([(1, "r", "about auth", []), (2, "r", "about auth", ["open"]), (3, None, None, [])], "id long, repository string, summary string, open_items array<string>")
    store.commit({"memory": spark.createDataFrame(rows, LEGACY), "episode": episodes, "other": numbers(spark, 1)}, schema=2)
    store.restore(store.backup("old"), lambda tables, schema: V.migrated(tables, schema, now=F.lit(T0 + dt.timedelta(days=1))))
    assert store.manifest()["schema"] == V.SCHEMA and held(store, "other") == [1]
    got = {r.id: r for r in store.read("memory").collect()}
    assert [(got[i].scope, got[i].repository) for i in (1, 2, 3)] == [("transferable", "r"), ("repo", "r"), ("global", None)]
    assert (got[5].confidence, got[5].reinforcement_count, got[5].tags, got[5].superseded_by, got[5].updated_at.day) == (0.9, 2, "y z x", None, 2)
    assert (got[4].superseded_by, got[4].canonical_key, got[6].superseded_by, got[6].canonical_key) == (5, "user_identity:ana", 1, None)
    assert (got[7].canonical_key, got[7].reinforcement_count, got[7].last_seen_at, got[7].scope_source, got[7].expires_at) == ("assistant_goal:ship it", 1, T0, "auto", None)
    assert [r.scope for r in store.read("episode").orderBy("id").collect()] == ["transferable", "repo", "repo"]


def test_migrations_keep_what_is_there_and_stop_at_the_schema(spark):
    rows = spark.createDataFrame([(1, "repo", "manual")], "id long, scope string, scope_source string")
    assert V.migrated({"memory": rows}, V.SCHEMA)["memory"].columns == rows.columns
    seven = V.migrated({"memory": rows}, 8)["memory"]
    assert seven.first().scope_source == "manual" and set(seven.columns) == {"id", "scope", "scope_source", "domain_key", "expires_at"}
    legacy = spark.createDataFrame([], LEGACY)
    assert V.migrated({"memory": legacy}, 1)["memory"].count() == 0


def test_rows_set_by_hand_win(spark):
    schema = "id long, type string, canonical_key string, superseded_by long, scope_source string, confidence double, reinforcement_count int, updated_at timestamp, last_seen_at timestamp, tags string"
    late = T0 + dt.timedelta(days=3)
    rows = [(1, "t", "k", None, "auto", 0.9, 3, T0, late, "b a"), (2, "t", "k", None, "manual", 0.1, 1, T0, None, "a"), (3, "t", "z", None, None, 0.9, None, T0, None, None), (4, "u", "k", None, None, 1.0, 1, T0, None, None)]
    got = {r.id: tuple(r) for r in superseded_duplicates(spark.createDataFrame(rows, schema), "t", F.lit(late)).collect()}
    assert got[2] == (2, "t", "k", None, "manual", 0.9, 4, late, late, "a b") and got[1][3] == 2 and got[3] == rows[2] and got[4] == rows[3]


def test_duplicates_join_by_key_and_part(spark):
    """Rows that no group can change do not meet in one task, where their key is null or not."""
    from mnemark.operators.snapshots import superseded_duplicates

    rows = [(k, "user_identity" if k < 40 else "fact", "user_identity:ana" if k < 40 else None) for k in range(400)]
    memory = spark.createDataFrame(rows, "id long, type string, canonical_key string").selectExpr(
        "*", "cast(null as long) superseded_by", "'auto' scope_source", "1L confidence", "1 reinforcement_count", "timestamp'2024-01-01' updated_at", "timestamp'2024-01-01' last_seen_at", "'t' tags"
    )
    out = superseded_duplicates(memory, "user_identity", F.lit("2024-02-01").cast("timestamp"))
    got = {r.id: r for r in out.collect()}
    assert len(got) == 400 and got[0].reinforcement_count == 40 and sum(r.superseded_by == 0 for r in got.values()) == 39
    assert "_salt" in out._jdf.queryExecution().optimizedPlan().toString()
