"""Queries that read their tables whole, against their SQL with its cuts taken out, or against brute force."""

import hashlib
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from mnemark.plans import prompt_queries, session_queries, state_queries  # noqa: F401
from mnemark.plans.memory_queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
#: What the SQL of a query cuts, and what stands there in the whole job's SQL.
CUTS = [
    ("substring(text, 1, 160)", "text"), (" WHERE c_custkey <= 50", ""), ("left(content, 80)", "content"), ("<> ''), 1, 12)", "<> ''), 1, 1000000)"),
    ("lambda p: p[1]), 1, 2)", "lambda p: p[1]), 1, 1000000)"),
]


def uncut(name):
    sql = SQL[name]
    for cut, whole in CUTS:
        sql = sql.replace(cut, whole)
    return sql


def said(v):
    return f"{v:.6g}" if isinstance(v, (float, int)) and not isinstance(v, bool) else f"{v}"


def same(spark, name, sf_dir=SF):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    want = con.execute(uncut(name))
    columns = [c[0] for c in want.description]
    rows = sorted(str([said(v) for v in r]) for r in QUERIES[name](spark, sf_dir).select(*columns).collect())
    assert rows == sorted(str([said(v) for v in r]) for r in want.fetchall())


@pytest.mark.parametrize("name", ["R4_episode_search", "R9_relevant_episodes", "R13_budget_packing", "G7_day_summaries", "G22_pattern_highlights", "P18_provenance"])
def test_episodes_carry_whole_texts(spark, name):
    same(spark, name)


@pytest.mark.parametrize("name", ["R3_memory_search", "J15_capability_match", "C2_memory_scope", "X_text_functions"])
def test_tables_are_read_whole(spark, name):
    same(spark, name)


def test_every_customer_is_matched(spark):
    asked = spark.read.parquet(f"{SF}/customer.parquet")
    got = QUERIES["J15_capability_match"](spark, SF)
    assert got.select("prompt_id").distinct().count() == asked.select("c_custkey").distinct().count() > 50


def test_words_late_in_a_text_count(spark, tmp_path):
    """A scope phrase, a stem and a search term beyond the old cuts; dates anywhere in a prompt."""
    tail = "plain words " * 30
    pq.write_table(pa.table({"doc_id": [9], "text": [tail + "reuse this playbook zebras"], "lang": ["en"], "source": ["src3"], "n_chars": [1]}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": [9], "quality": [1], "toxic": [0]}), tmp_path / "labels.parquet")
    asked = ["then", "then", "then", "then", "then", "plain words zebra", "then", tail + "on march 15th", tail + "2024-99-99", "plain words zebras", tail + "dismay 12 and then yesterday"]
    items = [0, 1, 2, 3, 4, 5, 6, 7, 15, 23, 31]
    pq.write_table(pa.table({"item_id": items, "text": asked}), tmp_path / "benchmark.parquet")
    sf_dir = str(tmp_path)
    assert [r.scope for r in QUERIES["C2_memory_scope"](spark, sf_dir).collect()] == ["transferable"]
    assert QUERIES["X_text_functions"](spark, sf_dir).first().stems.endswith("reuse this playbook zebra")
    assert {r.query_id for r in QUERIES["R4_episode_search"](spark, sf_dir).collect()} == {23}
    days = {r.item_id: r.day and str(r.day) for r in QUERIES["X12_inferred_date"](spark, sf_dir).collect()}
    assert days == {
        0: "2024-03-27", 1: "2024-03-26", 2: "2024-01-15", 3: "2024-03-25", 4: "2024-03-15", 5: "2023-04-01", 6: "2024-03-24",
        7: "2024-03-15", 15: None, 23: None, 31: "2024-03-26",
    }


def test_pages_are_cut_at_the_earliest_heading(spark, tmp_path):
    html = ["kept\n## Active Workstream\nlost\n## Cross-Repo Hints\nlost", "kept\n## Active Workstreams\nkept", "a ## Active Workstream", "<style>x</style>kept\r\n## Cross-Repo Hints\r\nlost", None]
    pq.write_table(pa.table({"page_id": range(5), "html": pa.array(html, pa.string())}), tmp_path / "pages.parquet")
    got = {r.page_id: r.body for r in QUERIES["X19_without_blocks"](spark, str(tmp_path)).collect()}
    want = ["kept\n", html[1], html[2], "kept\r\n", None]
    assert got == {i: w and hashlib.md5(w.encode()).hexdigest() for i, w in enumerate(want)}
