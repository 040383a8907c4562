"""Every registered query of the memory engine against its SQL on DuckDB, and micro-cases with known answers."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from mnemark.functions import text as X
from mnemark.operators import aggregates, ranking, state
from mnemark.plans import listing_queries, prompt_queries, session_queries, state_queries  # noqa: F401
from mnemark.plans.memory_queries import QUERIES, SQL
from mnemark.sources import bindings
from mnemark.streaming.latency import latency_windows, run_once

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def said(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, (float, int)) and not isinstance(v, bool):
        return f"{v:.6g}"
    return f"{v}".removesuffix(" 00:00:00")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = sorted(str([said(v) for v in r]) for r in got.select(*columns).collect())
    assert rows == sorted(str([said(v) for v in r]) for r in want.fetchall())


CASES = [
    ("what did we do today", "2024-03-27"), ("this morning we", "2024-03-27"), ("yesterday", "2024-03-26"), ("last night", "2024-03-26"),
    ("2024-01-15 was yesterday", "2024-01-15"), ("last monday", "2024-03-25"), ("monday we", "2024-03-25"), ("last saturday", "2024-03-23"),
    ("last sunday", "2024-03-24"), ("march 15th", "2024-03-15"), ("april 1", "2023-04-01"), ("january 5th", "2024-01-05"), ("nothing", None), ("", None), (None, None),
]


def test_dates_of_prompts(spark):
    rows = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "i int, t string")
    got = dict(rows.select("i", X.inferred_date(F.col("t"), F.lit("2024-03-27").cast("date"))).collect())
    assert {i: d and str(d) for i, d in got.items()} == {i: d for i, (_, d) in enumerate(CASES)}


def test_percentiles_follow_the_floor_rule(spark):
    rows = spark.createDataFrame([(i, "h", float(i), datetime.datetime(2024, 1, 1, 0, i)) for i in range(1, 11)], "id long, hook string, latency_ms double, recorded_at timestamp")
    got = aggregates.latency_summary(rows, "hook", 150.0, 5).first()
    assert (got.n, got.p50, got.p95, got.most, got.latest, got.target) == (10, 5.0, 9.0, 10.0, 10.0, "met")


def test_pages_break_ties_by_id(spark):
    rows = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "id string, at int")
    order = [F.desc("at"), F.desc("id")]
    assert [r.id for r in ranking.page(rows, order, 2).collect()] == ["c", "b"]
    assert [r.id for r in ranking.page(rows, order, 2, 2).collect()] == ["a"]


def test_packing_stops_at_the_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, "x" * 40), (1, 2, " "), (1, 3, "x" * 80), (1, 4, "x")], "g int, o int, t string")
    assert [r.o for r in ranking.packed(rows, "g", [F.col("o")], "t", 25).orderBy("o").collect()] == [1]


def test_stream_gives_what_the_table_gives(spark, tmp_path):
    rows = bindings.trace(spark, SF).orderBy("recorded_at")
    rows.write.parquet(str(tmp_path / "in"))
    table = spark.read.parquet(str(tmp_path / "in"))
    stream = latency_windows(spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")))
    got = run_once(spark, stream, str(tmp_path / "out"), str(tmp_path / "state"))
    closed = latency_windows(table).where(F.col("began") + F.expr("interval 1 hour") <= F.lit(table.agg(F.max("recorded_at")).first()[0]) - F.expr("interval 10 minutes"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, closed.collect()))


def test_search_follows_the_rarest_term(spark, shuffled_rows):
    docs = [(k, "common usual " * (1 + k % 3) + (f"rare{k}" if k < 40 else "")) for k in range(400)] + [(None, "common rare1"), (None, "rare1"), (7, "rare1 common usual")]
    asked = [(q, ["common", "usual", f"rare{q}"]) for q in range(40)] + [(90, ["common", "absent"]), (91, [])]
    tables = spark.createDataFrame(docs, "doc long, text string").repartition(4), spark.createDataFrame(asked, "q long, terms array<string>")
    before = shuffled_rows()
    found = {(r.q, r.doc): r.score for r in ranking.bm25(*tables, "doc", "text", "q").collect()}
    assert shuffled_rows() - before < 6000  # 40 queries beside the 400 documents of a common term would be 16,000
    counts = {}
    for d, t in docs:
        for w in t.split():
            counts.setdefault((d, w), []).append(len(t.split()))
    # a document's repeated rows count as one, and so do rows without an id
    tf = {k: (sum(w == k[1] for d, t in docs if d == k[0] for w in t.split()), max(v)) for k, v in counts.items()}
    mean, want = sum(len(t.split()) for _, t in docs) / len(docs), {}
    for q, terms in asked:
        for d in {d for d, _ in docs if d is not None}:
            if terms and all((d, w) in tf for w in terms):
                df = {w: sum(k[1] == w for k in tf) for w in terms}
                idf = {w: max(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) for w in terms}
                want[q, d] = round(sum(idf[w] * tf[d, w][0] * 2.2 / (tf[d, w][0] + 1.2 * (0.25 + 0.75 * tf[d, w][1] / mean)) for w in terms), 6)
    assert found == pytest.approx(want, abs=2e-6) and len(found) == 41
