import random
import re
import time
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from mnemark.llm import near_text
from mnemark.llm.near_text import near_texts, one_of_each_group
from mnemark.llm.partenum import signatures
from mnemark.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, key string, n string"


def brute_set(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = [(i, brute_set(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(sets)), 2):
        s, t = sets[a][1], sets[b][1]
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            parent[root(b)] = root(a)
    least = {}
    for k, (i, _) in enumerate(sets):
        r = root(k)
        least[r] = i if least.get(r) is None else least[r] if i is None else min(i, least[r])
    return [(i, len(s), least[root(k)]) for k, (i, s) in enumerate(sets)]


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["Ab", "cd", "é", "x-y", "q", "zz", "T", "on", "of", "it"]) + str(rnd.randrange(30))
    rows, at = [(0, None), (1, ""), (2, " \n\t "), (3, "one"), (4, "One"), (5, "one two three four"), (6, "x " * 3000)], 7
    passage = [word() for _ in range(60)]
    for _ in range(40):
        base = [word() for _ in range(rnd.randrange(5, 160))] + (passage if rnd.random() < 0.5 else [])
        for _ in range(rnd.randrange(1, 6)):
            copy = list(base)
            for _ in range(rnd.randrange(0, 6)):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((at, rnd.choice([" ", "\n", "\t\x0b "]).join(copy)))
            at += 1
    return rows + [(9, rows[9][1]), (None, rows[9][1]), (None, "null id alone here today"), (10, "same id other text is here")]


@pytest.mark.parametrize("small", [64, 2])
def test_groups_are_those_of_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(near_text, "SMALL", small)
    monkeypatch.setattr(near_text, "TILE", 8)
    rows = corpus()
    got = near_texts(spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_components(rows)))


def test_an_empty_table_gives_no_rows(spark):
    assert near_texts(spark.createDataFrame([], SCHEMA)).count() == 0


def test_one_row_of_each_group_stays(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)
    kept = one_of_each_group(docs)
    assert kept.columns == docs.columns
    sets = [brute_set(r.text) for r in kept.collect()]
    assert sum(not s for s in sets) == sum(not brute_set(t) for _, t in rows)
    full = [s for s in sets if s]
    groups = brute_components(rows)
    assert len({c for i, n, c in groups if n and c is not None and i != 10}) <= len(full) <= len(rows)
    assert all(100 * len(a & b) < 75 * len(a | b) for a, b in combinations(full, 2))


def test_shingles_do_not_depend_on_blocks(monkeypatch):
    from mnemark.llm import shingles

    texts = pa.array([t for _, t in corpus()])
    whole = list(shingle_sets(texts))
    monkeypatch.setattr(shingles, "BLOCK", 64)
    assert all((a == b).all() for a, b in zip(whole, shingle_sets(texts), strict=True))
    assert [len(s) for s in whole] == [len(brute_set(t.as_py())) for t in texts]


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(1)
    for _ in range(1500):
        s = int(rng.integers(1, 400))
        t = int(rng.integers(-(-3 * s // 4), 4 * s // 3 + 1))
        common = min(-(-3 * (s + t) // 7), s, t)
        if not 4 * common >= 3 * (s + t - common) or common == s == t:
            continue
        pool = np.unique(rng.integers(0, 1 << 63, s + t).astype(np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:s]), np.sort(np.r_[pool[:common], pool[s : s + t - common]])
        assert len(np.intersect1d(signatures(a), signatures(b)))


def test_pipeline_keeps_columns_and_packs_what_it_kept(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    now = docs
    for name, work in corpus_pipeline.STAGES[:-1]:
        after = near_text.stage(work(spark, now, "/root/testdata/sf0.001"))
        assert after.columns == docs.columns, name
        assert after.exceptAll(now).count() == 0
        now = after
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "/root/testdata/sf0.001")
    assert packed.select("doc_id").distinct().count() == now.select("doc_id").distinct().count()
    assert not corpus_pipeline.STAGES[0][1](spark, docs.limit(0), "/root/testdata/sf0.001").count()


def shuffled(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_own_shingles_are_counted_at_a_few_bytes_each(spark):
    rng = np.random.default_rng(2)
    common = rng.integers(-(1 << 63), (1 << 63) - 1, 50)
    rows = [(k, [*map(int, rng.integers(-(1 << 63), (1 << 63) - 1, 400)), *map(int, common[: k % 51])]) for k in range(4090, 4600)]
    sets = near_text.stage(spark.createDataFrame(rows, "row long, features array<long>").repartition(3))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        before = shuffled(spark)
        got = {r.row: r.own for r in near_text._own(sets, 10).collect()}
        spent = shuffled(spark) - before
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    times = {}
    for _, f in rows:
        for x in f:
            times[x] = times.get(x, 0) + 1
    assert got == {k: sum(times[x] == 1 for x in f) for k, f in rows}
    assert spent < 12 * sum(len(f) for _, f in rows)


def test_features_that_fall_together_are_no_ones_own(spark):
    sets = spark.createDataFrame([(1, [5 << 16, (5 << 16) + 1, 9 << 16]), (2, [(9 << 16) + 7, 4 << 16])], "row long, features array<long>")
    assert sorted(map(tuple, near_text._own(near_text.stage(sets), 5).collect())) == [(2, 1)]


def test_a_stage_leaves_no_shuffle_files(spark, tmp_path):
    def files():
        disks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for i in range(disks.size()) if (name := disks.apply(i).getName()).startswith("shuffle_")}

    held = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    before = files()
    out = near_text.stage(spark.range(1000).repartition(3, "id").groupBy("id").count(), str(tmp_path / "out"))
    for _ in range(50):
        if not (left := files() - before):
            break
        time.sleep(0.1)
    assert not left and out.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == held
