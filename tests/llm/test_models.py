import numpy as np
import pytest

from mnemark.llm import ann, langid, toxicity
from mnemark.llm.ann import nearest
from mnemark.llm.near_embeddings import near_embeddings
from mnemark.llm.queries import op7_toxicity, op10_language_id

SF = "/root/testdata/sf0.01"


def vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(40, 12))
    rows = [(i, (base[i % 40] + 0.15 * rng.normal(size=12)).tolist()) for i in range(300)]
    rows += [(300, rows[0][1]), (301, rows[0][1]), (302, None), (303, [0.0] * 12), (304, [float("nan")] * 12), (305, [float("inf")] + [1.0] * 11), (306, [1.0])]
    return rows, spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, rep string")


def usable(rows):
    return [(i, np.array(v)) for i, v in rows if v and len(v) == 12 and np.isfinite(v).all() and np.any(v)]


def test_embedding_links_equal_brute_force(spark):
    rows, frame = vectors(spark)
    good = usable(rows)
    x = np.array([v for _, v in good])
    cosine = (x @ x.T) / np.outer(np.linalg.norm(x, axis=1), np.linalg.norm(x, axis=1))
    link = (cosine >= 0.9) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in near_embeddings(frame).collect()}
    assert len(got) == len(rows)
    assert all(got[i].n_links == link[k].sum() for k, (i, _) in enumerate(good))
    ids = np.array([i for i, _ in good])
    low = ids.copy()
    for _ in ids:
        low = np.minimum(low, np.where(link, low, 1 << 40).min(axis=1))
    assert all(got[i].component_id == low[k] and got[i].kept == (i == low[k]) for k, (i, _) in enumerate(good))
    assert all(got[i].n_links == 0 for i in range(302, 307))
    assert near_embeddings(frame.limit(0)).count() == 0


def test_vectors_of_every_length_are_compared(spark):
    rng = np.random.default_rng(3)
    rows = [(20 * i, (np.ones(d) + 0.01 * rng.normal(size=d)).tolist()) for i, d in enumerate([2] * 5 + [3] * 6 + [1])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<double>, rep string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_embeddings(frame).collect()}
    assert got == {20 * i: (4, 0) if i < 5 else (5, 100) if i < 11 else (0, 220) for i in range(12)}
    found = {}
    for r in nearest(frame, 20, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert found == {20 * i: {20 * j for j in (range(5) if i < 5 else range(5, 11)) if j != i} for i in range(11)}


@pytest.mark.parametrize("block", [16384, 3000])
def test_recall_beyond_the_least_that_is_ranked_anew(spark, monkeypatch, block):
    """Rows point evenly in all directions, the hardest case, in one block, which ranks a part anew that is above the least, and in several."""
    monkeypatch.setattr(ann, "BLOCK", block)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 64))
    assert ann.ANEW * len(x) > ann.LEAST
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest(frame, 20, 20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q in range(0, len(x), 20):
        score = x @ x[q]
        score[q] = -np.inf
        want = np.lexsort((np.arange(len(x)), -score))[:20]
        mine = sorted(found[q])
        assert [m[0] for m in mine] == list(range(1, 21)) and q not in {m[1] for m in mine}
        hits += len({m[1] for m in mine} & set(want.tolist()))
    recall = hits / (20 * len(found))
    print(f"recall {recall:.3f} in blocks of {block}")
    assert recall >= 0.9


def test_nearest_recall(spark):
    rows, frame = vectors(spark, 2)
    good = usable(rows)
    found = {}
    for r in nearest(frame, 20, 20).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = total = 0
    for q, v in good:
        if q % 20 == 0:
            want = sorted(((-float(v @ w), i) for i, w in good if i != q))[:20]
            assert [r.rank for r in sorted(found[q], key=lambda r: r.rank)] == list(range(1, 21))
            hits += len({i for _, i in want} & {r.vec_id for r in found[q]})
            total += 20
    assert hits / total >= 0.9
    assert nearest(frame.limit(0)).count() == 0


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_beats_chance_on_held_out_rows(spark, labelled):
    docs, labels = labelled
    rows = op7_toxicity(spark, SF).where("held_out").join(labels, "doc_id").collect()
    order = sorted(rows, key=lambda r: r.score)
    places = [k for k, r in enumerate(order) if r.toxic == 1]
    n, m = len(rows), len(places)
    assert (sum(places) - m * (m - 1) / 2) / (m * (n - m)) > 0.8
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y" * 100_000)], "doc_id long, text string")
    model = toxicity.learn(docs, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score_toxicity(odd, model).collect())
    assert toxicity.keep_ordinary(odd.limit(0), model).count() == 0


def test_language_of_held_out_rows(spark, labelled):
    docs, _ = labelled
    rows = op10_language_id(spark, SF).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    odd = spark.createDataFrame([(1, None), (2, "123 !!"), (3, "the")], "doc_id long, text string")
    said = {r.doc_id: r.lang_pred for r in langid.identify(odd, langid.learn(docs)).collect()}
    assert said[1] == said[2] == "und" and said[3] != "und"


def test_long_labelled_texts_teach_and_windows_are_bounded(spark):
    """Every labelled text is longer than a piece: the model is made of pieces, and tells them apart."""
    words = " ".join(f"word{k % 97}" for k in range(9000))
    docs = [(i, words + (" vilething" * 40 if i % 3 == 0 else "") + f" w{i} " + words) for i in range(40)] + [(90, None), (91, ""), (91, ""), (None, "x")]
    frame = spark.createDataFrame([(*d, "clash", 1) for d in docs], "doc_id long, text string, score string, mark int")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(40)] + [(77, 1, 1), (2, 0, None)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame, labels)
    assert model is not None
    got = sorted((str(r.doc_id), r.score) for r in toxicity.score_toxicity(frame, model).collect())
    assert len(got) == len(docs) and all(0 <= s <= 1 for _, s in got)
    score = dict(got)
    assert min(score[str(i)] for i in range(0, 40, 3)) > max(score[str(i)] for i in range(40) if i % 3)
    assert toxicity.score_toxicity(frame.limit(0), model).count() == 0
    assert toxicity.learn(frame, labels.limit(0)) is None and toxicity.keep_ordinary(frame, None).count() == len(docs)
    kept = toxicity.keep_ordinary(frame, model)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} >= {90, 91, None}
    body = ("毒" * 4000).encode()
    assert b"".join(toxicity.windows(body, 64)) == body and max(map(len, toxicity.windows(body, 64))) <= 64 + toxicity.NO_BLANK
