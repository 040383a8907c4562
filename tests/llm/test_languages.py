"""Language identification with more languages than a word has bits, and with long documents only."""

import random

from mnemark.llm import langid

N = 70


def words_of(k, n, seed):
    """Text of an invented language: words of its own."""
    r = random.Random(k)
    own = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(30)]
    return " ".join(random.Random(seed).choices(own, k=n))


def test_every_language_is_learned():
    names = [f"l{k:02d}" for k in range(N)]
    filters = langid.fill({name: [words_of(k, 200, s) for s in range(3)] for k, name in enumerate(names)})
    assert filters.languages == tuple(names)
    assert [filters.decide(words_of(k, 40, 9))[0] for k in range(N)] == names


def test_few_languages_and_none():
    assert langid.fill({}).decide("any words") == (langid.UNKNOWN, 0.0)
    filters = langid.fill({"a": [words_of(1, 200, 1)], "b": [words_of(2, 200, 1)]})
    assert filters.masks.shape == (1, 1 << langid.SLOT_BITS)
    assert [filters.decide(words_of(k, 40, 9))[0] for k in (1, 2)] == ["a", "b"]


def test_a_language_of_long_documents_is_learned(spark):
    rows = [(i, words_of(1, 100, i), "short") for i in range(20)] + [(i, words_of(2, 14_000, i), "long") for i in range(20, 26)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert min(len(t) for i, t, _ in rows if i >= 20) > 80_000
    filters = langid.learn(docs)
    assert filters.decide(words_of(2, 40, 99))[0] == "long"
    said = {r.doc_id: r.lang_pred for r in langid.identify(docs, filters).collect()}
    assert said == {i: lang for i, _, lang in rows}
