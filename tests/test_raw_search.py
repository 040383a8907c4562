"""Search of the raw log: all terms, the best entry of a session, ties, filters and empty input."""

import pytest

from mnemark.operators import raw_search as R

INDEX = [
    (1, 10, "the parser tests fail", "turn"),
    (2, 10, "parser tests, parser TESTS", "checkpoint_overview"),
    (3, 10, "tests parser", "checkpoint_title"),
    (4, 11, "tests of the parser", "turn"),
    (5, 12, "parser", "turn"),
    (6, 99, "parser tests of no session", "turn"),
    (7, 13, None, "turn"),
    (8, 13, "parser\n tests   " + "x" * 300, "file"),
]
SESSIONS = [(10, "a", None, 5), (11, "b", "main", 7), (12, "a", None, 9), (13, None, None, None)]


def tables(spark, queries):
    return (
        spark.createDataFrame(INDEX, "entry_id long, session_id long, content string, source_type string"),
        spark.createDataFrame(SESSIONS, "session_id long, repository string, branch string, updated_at long"),
        spark.createDataFrame(queries, "query_id long, terms array<string>"),
    )


def brute(queries, limit, repository=None):
    """Stems of the words above are the words themselves, but for ``tests``, which no stem equals."""
    known, out = {s[0]: s for s in SESSIONS}, []
    for q, terms in queries:
        best = {}
        for e, s, text, kind in INDEX:
            held = "".join(c if c.isalnum() else " " for c in (text or "").lower()).split()
            if terms and s in known and set(terms) <= set(held) and (repository is None or known[s][1] == repository):
                score = sum(t != "tests" for t in terms) + (1.5 if kind.startswith("checkpoint_") else 0.5 if kind == "turn" else 0)
                if any(t != "tests" for t in terms) and (s not in best or (score, -e) > best[s]):
                    best[s] = (score, -e)
        ranked = sorted(best.items(), key=lambda x: (-x[1][0], -(known[x[0]][3] or -1), x[0]))[:limit]
        out += [(q, s, score, -e) for s, (score, e) in ranked]
    return sorted(out)


@pytest.mark.parametrize(("limit", "repository"), [(5, None), (2, None), (5, "a")])
@pytest.mark.parametrize("bound", [20_000, 0])
def test_sessions_equal_brute_force(spark, monkeypatch, limit, repository, bound):
    monkeypatch.setattr(R, "IN_PLAN", bound)
    queries = [(1, ["parser", "tests"]), (2, ["parser"]), (3, ["absent", "parser"]), (4, []), (5, ["tests"])]
    index, sessions, asked = tables(spark, queries)
    got = R.relevant_sessions(index, sessions, asked, limit, repository).collect()
    entry = {(e[1], e[3]): e[0] for e in INDEX}
    assert sorted((r.query_id, r.session_id, r.score, entry[r.session_id, r.source_type]) for r in got) == brute(queries, limit, repository)
    assert all(len(r.excerpt) <= 220 and "  " not in r.excerpt for r in got)


def test_entries_come_in_order_and_only_of_known_sessions(spark):
    index, sessions, asked = tables(spark, [(1, ["parser", "tests"]), (2, ["tests"])])
    got = sorted((r.query_id, r.entry_id) for r in R.search_index(index, sessions, asked, 3).collect())
    assert got == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert sorted(r.entry_id for r in R.search_index(index, sessions, asked.where("query_id = 1"), 9, "b").collect()) == [4]
    assert R.search_index(index.limit(0), sessions, asked).count() == R.relevant_sessions(index, sessions, asked.limit(0)).count() == 0


def shuffled(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_an_entry_goes_once_however_many_queries_it_holds_terms_of(spark):
    n, common = 400, "a0 b0 c0 d0 e0 f0"
    contents = [(k, 1, f"{common} " + " ".join(f"w{i}x{i * 7919 % 1009}" for i in range(n) if (i + k) % 20 or i % 3) + (" g0" if k % 2 else ""), "turn") for k in range(40)]
    queries = [(i, [f"w{i}x{i * 7919 % 1009}", *common.split(), "g0"]) for i in range(n)]  # more terms than are looked at first
    index = spark.createDataFrame(contents, "entry_id long, session_id long, content string, source_type string")
    asked = spark.createDataFrame(queries, "query_id long, terms array<string>")
    before = shuffled(spark)
    got = sorted((r.query_id, r.entry_id) for r in R.matches(index, asked).collect())
    assert got == sorted((i, k) for k, _, text, _ in contents for i, terms in queries if set(terms) <= set(text.split()))
    assert shuffled(spark) - before < 2_000_000  # the contents are of 160,000 bytes


def test_memory_search_shuffles_keys_in_place_of_texts(spark):
    """The join of hits with memories carries a text's key alone; ties and equal contents come out as before."""
    from pyspark.sql import functions as F

    from mnemark.operators import ranking

    rows = [(1, "fact", "alpha  beta", "global", None, 2, None), (2, "fact", "Alpha beta", "global", None, 3, None), (3, "fact", "alpha beta", "repo", "r", 3, None), (4, "fact", "alpha beta", "global", None, 9, 7)]
    memory = spark.createDataFrame(rows, "id long, type string, content string, scope string, repository string, confidence long, superseded_by long").withColumn("updated_at", F.lit("2024-01-01").cast("timestamp"))
    queries = spark.createDataFrame([(1, ["alpha", "beta"])], "query_id long, terms array<string>")
    found = ranking.search_memory(memory, queries, repository="r")
    assert sorted(r.id for r in found.collect()) == [2, 3]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join" in line]
    assert joins and "_key" in plan and not any("content" in line for line in joins)


def test_matches_of_common_words_are_not_gathered(spark, shuffled_rows):
    index = spark.range(3000).selectExpr("id as entry_id", "id % 100 as session_id", "'alpha beta gamma' as content", "'turn' as source_type")
    sessions = spark.range(100).selectExpr("id as session_id", "'r' as repository", "'main' as branch", "id % 7 as updated_at")
    asked = spark.range(200).selectExpr("id as query_id", "array('alpha', 'beta') as terms")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for larger tables
    try:
        before = shuffled_rows()
        got = sorted((r.query_id, r.session_id) for r in R.relevant_sessions(index, sessions, asked).collect())
        first = sorted((r.query_id, r.entry_id) for r in R.search_index(index, sessions, asked).collect())
        spent = shuffled_rows() - before
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == [(q, s) for q in range(200) for s in (6, 13, 20, 27, 34)]
    assert first == [(q, e) for q in range(200) for e in range(5)]
    assert spent < 100_000, spent  # there are 600,000 matches


@pytest.mark.parametrize("together", [(512, 32_768), (3, 10)])
def test_bits_of_a_block_tell_what_brute_force_tells(monkeypatch, together):
    import random

    import pyarrow as pa

    rnd = random.Random(5)
    monkeypatch.setattr(R, "QUERIES", together[0])
    monkeypatch.setattr(R, "TERMS", together[1])
    pool = [b + e for b in ("story", "stor", "test", "bus", "glass", "need", "ring", "bed", "fly") for e in ("", "s", "ies", "ing", "ed", "eds", "ss")]
    contents = [None, "", *(" ".join(rnd.choices(pool, k=rnd.randrange(1, 40))) for _ in range(150))]
    queries = [(i, rnd.sample(pool, rnd.randrange(1, 5))) for i in range(200)] + [(200, ["absent", "test"])]
    asked = R._asked(pa.table({"query_id": [q for q, _ in queries], "terms": [t for _, t in queries]}))
    batch = pa.RecordBatch.from_pydict({"entry_id": list(range(len(contents))), "content": contents})
    known = {t: i for i, t in enumerate(asked["names"])}
    got = [x for q, e, n in R._met(batch, asked, known, dict(asked["forms"])) for x in zip(q.tolist(), e.tolist(), n.tolist(), strict=True)]
    held = [set((c or "").split()) for c in contents]
    stems = [{s for w in ws if len(s := R.stemmed(w)) > 2} for ws in held]
    assert sorted(got) == [(q, e, len(set(t) & stems[e])) for q, t in queries for e in range(len(contents)) if set(t) <= held[e]]
    assert any(n < len(queries[q][1]) for q, _, n in got) and len({n for *_, n in got}) > 2


def test_words_are_stemmed_as_by_columns(spark):
    from pyspark.sql import functions as F

    from mnemark.functions.text import stem_word

    words = ["ies", "flies", "dies", "ring", "bring", "caring", "bed", "shed", "need", "bus", "glass", "tests", "a", "ss", "going", "seeds"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", stem_word(F.col("w")).alias("s")).collect()
    assert [R.stemmed(r.w) for r in rows] == [r.s for r in rows]


def test_an_excerpt_is_the_beginning_of_the_normalised_text(spark):
    from pyspark.sql import functions as F

    from mnemark.functions.text import normalize

    texts = [None, "", "  a  b ", "x" * 219 + " " * 900 + "y z", " " * 2000 + "late  words", "w  " * 600, "x" * 220 + "  tail", ("ab" + "\t" * 40) * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(R.excerpt(F.col("t")).alias("e"), F.substring(normalize(F.col("t")), 1, 220).alias("w")).collect()
    assert [r.e for r in rows] == [r.w for r in rows]
