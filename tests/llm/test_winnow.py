import hashlib
import random
import re

import pytest

from mnemark.llm import common, winnow

DOCS, ITEMS = "doc_id long, text string, w string, n string, start string", "item_id long, text string, words string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(len(w), 10)
        for k in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (at := windows.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= at
        names = sorted(str(i) for i in found if i is not None)
        spans = [k for k in sorted(hit) if k - 1 not in hit], [k + 1 for k in sorted(hit) if k + 1 not in hit]
        out.append((d, len(w), list(zip(*spans)), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def run(spark, docs, items):
    got = winnow.decontaminate(spark.createDataFrame([(*d, "x", "y", "z") for d in docs], DOCS), spark.createDataFrame([(*i, "x") for i in items], ITEMS)).collect()
    return sorted([(r[0], r[1], [tuple(s) for s in r[2]], *r[3:]) for r in got], key=repr)


def corpus(seed, letters, short):
    rnd = random.Random(seed)
    line = lambda n: " ".join(rnd.choice(letters) for _ in range(n))
    items = [(k, line(rnd.randrange(10, 40))) for k in range(25)] + [(3, line(12)), (None, line(15)), (40, ""), (41, None), (42, " .,; "), (43, "same " * 30)]
    items += [(50 + n, line(n)) for n in range(1, 10)] if short else []
    docs = [(0, None), (1, ""), (2, "-"), (3, "A"), (4, line(9)), (5, "Same, " * 25), (6, "same " * 9)]
    for k in range(60):
        source = rnd.choice(items)[1] or ""
        w = source.split()
        a = rnd.randrange(len(w) + 1)
        piece = " ".join(w[a : a + rnd.randrange(6, 25)])
        docs.append((10 + k, rnd.choice([" ", "\n", ". "]).join([line(rnd.randrange(0, 30)), piece.upper(), line(rnd.randrange(0, 9)), piece[::1]])))
    docs += [docs[20], docs[20], (docs[20][0], docs[21][1]), (None, docs[20][1]), (None, docs[20][1]), (99, " ".join(t or "" for _, t in items) * 40)]
    return docs, items


@pytest.mark.parametrize(("letters", "short"), [([f"w{k}" for k in range(300)], False), ([f"w{k}" for k in range(300)], True), (["ab", "c", "é"], False), (["ab", "c"], True)])
def test_hits_equal_brute_force(spark, letters, short):
    docs, items = corpus(4, letters, short)
    assert run(spark, docs, items) == brute(docs, items)


def test_a_benchmark_beyond_the_bound_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(winnow, "BROADCAST", 0)
    monkeypatch.setattr(common, "HOT_SHARE", 2)
    docs, items = corpus(5, [f"w{k}" for k in range(40)], True)
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = corpus(6, ["a", "b"], False)
    assert run(spark, [], items) == []
    assert run(spark, docs, []) == brute(docs, [])


def test_a_shared_window_shares_a_fingerprint(spark):
    """The guarantee itself: a document's one least hash of a window is among an item's least hashes of it."""
    rnd = random.Random(3)
    rows = []
    for k in range(400):
        span = [rnd.choice("abc") for _ in range(10)]
        rows.append((k, [rnd.choice("abc") for _ in range(rnd.randrange(9))] + span, [rnd.choice("xyz") for _ in range(rnd.randrange(9))] + span))
    from pyspark.sql import functions as F

    def hashed(c):
        return winnow.let(F.transform(c, lambda w: F.xxhash64(w)), lambda h: winnow.grams(h, winnow.GRAM))

    frame = spark.createDataFrame(rows, "k long, doc array<string>, item array<string>")
    one, every = winnow.let(hashed(F.col("doc")), winnow.some_least), winnow.let(hashed(F.col("item")), winnow.every_least)
    met = frame.select(F.size("doc").alias("n"), one.alias("one"), F.transform(every, lambda p: p["hash"]).alias("every")).collect()
    for r in met:
        assert any(p["hash"] in r["every"] and r["n"] - 10 <= p["pos"] <= r["n"] - 5 for p in r["one"])
        assert [p["pos"] for p in r["one"]] == sorted({p["pos"] for p in r["one"]})
