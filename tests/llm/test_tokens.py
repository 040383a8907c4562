import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mnemark.llm.bpe import encode_digests, encode_texts
from mnemark.llm.encoding import Encoder, portions
from mnemark.llm.packing import pack, pieces_of, plan, sequences
from mnemark.llm.sharding import shard_by_bytes
from mnemark.llm.token_store import read_store, verify_store, write_store

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    (5, "Hello  World, it's 2024!"), (1, None), (2, ""), (3, "naïve café ＡＢＣ 日本語 🙂  x"), (4, "<|endoftext|> tag\n\n a\tb  c"), (7, "word " * 9000), (7, "word " * 9000), (None, "no id"), (8, "x" * 5000),
    (9, "don't we'll THEY'RE 12345 --- ***"),
]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, ids string")


def library(path):
    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


def le(ids):
    return np.array(ids, "<u4").tobytes()


def test_encoding_equals_the_library(spark):
    tool = library(WORDS)
    want = []
    for i, t in TEXTS:
        ids = tool.encode(t or "", add_special_tokens=False).ids
        said = tool.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(said.encode()).hexdigest()))
    assert sorted(map(str, map(tuple, encode_digests(frame(spark), WORDS).collect()))) == sorted(map(str, want))
    tool = library(BYTES)
    got = {r.doc_id: r.ids for r in encode_texts(frame(spark), BYTES).collect()}
    assert all(got[i] == tool.encode(t or "", add_special_tokens=False).ids for i, t in TEXTS)
    assert encode_digests(frame(spark, []), WORDS).count() == 0


def test_store_round_trip(spark, tmp_path):
    where = f"file://{tmp_path}/store"
    write_store(frame(spark), where, WORDS, end_id=2)
    tool, start, want = library(WORDS), 0, []
    for i, t in sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = tool.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((i, start, len(ids), zlib.crc32(le(ids))))
        start += len(ids)
    assert sorted(map(str, map(tuple, verify_store(spark, where).collect()))) == sorted(map(str, want))
    assert {len(r.ids) for r in read_store(spark, where).collect() if r.doc_id == 7} == {9001}
    chunks = spark.read.parquet(f"{where}/chunks")
    assert chunks.count() == chunks.select("digest").distinct().count()


def test_packing_rebuilds_every_document(spark):
    docs = frame(spark, [r for r in TEXTS if r != (7, "word " * 9000)] + [(7, "word " * 9000)])
    rows = pack(docs, BYTES, 2048, 0).collect()
    tool = library(BYTES)
    pieces = pieces_of(docs, BYTES, 2048, 0)
    packed = {r.sequence_id: np.frombuffer(bytes(r.ids), "<u4") for r in sequences(pieces, 2048).collect()}
    assert all(len(v) <= 2048 for v in packed.values())
    for i, t in TEXTS:
        ids = tool.encode(t or "", add_special_tokens=False).ids + [0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.start for r in mine] == np.cumsum([0, *[r.length for r in mine[:-1]]]).tolist()
        assert sum(r.length for r in mine) == len(ids)
        assert all(r.ids_crc32 == zlib.crc32(le(ids[r.start : r.start + r.length])) for r in mine)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by.values():
        spans.sort()
        assert [o for o, _ in spans] == np.cumsum([0, *[n for _, n in spans[:-1]]]).tolist()


def test_plan_never_overfills():
    slots = plan({1500: 3, 700: 5, 548: 4, 100: 50, 1: 7}, 2048)
    used = {}
    for s in slots:
        for k in range(s.last - s.first):
            at = s.sequence + k // s.per
            used[at] = used.get(at, 0) + s.length
    assert max(used.values()) <= 2048
    assert sum(used.values()) == 3 * 1500 + 5 * 700 + 4 * 548 + 50 * 100 + 7


def test_shards_are_even_and_slots_gapless(spark):
    rows = shard_by_bytes(frame(spark, TEXTS + [(i, f"text {i} " * (i % 17)) for i in range(100, 900)] + [(i, "copy") for i in range(1000, 1400)]), 8).collect()
    slots, sizes = {}, {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert len(rows) == len(TEXTS) + 1200
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert {r.law for r in rows} == {"bytes"}
    share = sum(sizes.values()) / 8
    widest = max(r.size for r in rows)
    assert all(abs(sizes.get(k, 0) - share) <= widest + 0.05 * share for k in range(8)), sizes


def test_rows_alike_in_all_columns_are_dealt_too(spark):
    rows = [(1, "one text")] * 500 + [(None, "one text")] * 500
    got = shard_by_bytes(frame(spark, rows), 8).groupBy("shard").count().collect()
    assert sorted(r.shard for r in got) == list(range(8))
    assert all(abs(r["count"] - 125) <= 2 for r in got), got
    assert shard_by_bytes(frame(spark, []), 8).count() == 0


@pytest.mark.parametrize("table", ["manifest", "recipes", "chunks"])
def test_a_store_that_was_tampered_with_is_refused(spark, tmp_path, table):
    where = f"file://{tmp_path}/store"
    write_store(frame(spark), where, WORDS, end_id=2)
    rows = spark.read.parquet(f"{where}/{table}").toArrow()
    if table == "manifest":  # another root
        rows = rows.set_column(rows.schema.get_field_index("root"), "root", pa.array([bytes(32)] * len(rows), pa.binary()))
    elif table == "recipes":  # one is lost
        rows = rows.slice(1)
    else:  # a chunk is lost with all that its recipe has
        rows = rows.slice(1)
    spark.createDataFrame(rows).write.mode("overwrite").parquet(f"{where}/{table}")
    with pytest.raises(Exception, match="manifest" if table != "chunks" else "does not fit its chunks"):
        verify_store(spark, where).collect()


def test_an_empty_store(spark, tmp_path):
    where = f"file://{tmp_path}/store"
    write_store(frame(spark, []), where, WORDS, end_id=2)
    assert verify_store(spark, where).count() == 0


def best_fit_count(lengths, capacity):
    """Sequences that best-fit decreasing over documents opens."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_opens_as_many_sequences_as_best_fit_over_documents():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = rng.integers(1, 2049, int(rng.integers(1, 400))).tolist() + [int(rng.integers(1, 64))] * int(rng.integers(0, 300))
        counts = {n: lengths.count(n) for n in set(lengths)}
        opened = max(s.sequence + -(-(s.last - s.first) // s.per) for s in plan(counts, 2048))
        assert opened <= best_fit_count(lengths, 2048) + 1
        assert opened >= -(-sum(lengths) // 2048)


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_words_with_signs_equal_the_library_and_are_not_made_anew(path):
    tool, made = Encoder(path), []
    merged = tool.merged
    tool.merged = lambda text: made.append(text) or merged(text)
    tool.encode(pa.array(["some words here", " here"]))
    made.clear()
    tool.encode(pa.array(["some, words. here!? some", "x here;"]))
    # words known as fragments are looked up, in whatever company; only the signs and what is new are made
    assert not {"here", " here", "words", " words"} & {t.replace("Ġ", " ") for t in made}
    words = ["a", "Word", "ÉCOLE", "ŉx", "İn", "ĳs", "ªº", "µ", "straße", "it's", "I'm", "x'", "'s", "a_b", "_", "--", "<|endoftext|>", "<|endoftext|>,", "a<b", "e.\nB", "1a", "a1,", "ſ", "Ωmega", "é", "x" * 500]
    texts = [w + s for w in words for s in ("", ",", "***", "'", "'s", "?!\"", "<", "$ ", "\n")]
    texts += [f" {t}" for t in texts] + [f"so {t} on" for t in texts]
    for _ in range(2):  # new, and remembered
        ids, at = tool.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in tool.library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_random_texts_equal_the_library(path):
    rng = np.random.default_rng(11)
    signs = list("aZ09 .,$'<_\n\t\r") + ["é", "×", "÷", "ß", "ſ", "ƀ", "Ā", "ª", "²", "日", "д", "🙂", "e\u0301", "\u00a0", "\u2028", "\x00", "  ", "<|endoftext|>", "'s", "'LL", " the", ".\nThe"]
    plain = list("aZé9.,$_") + [" ", " ", " the", ".\nÉcole", "!\t"]
    texts = ["".join(rng.choice(plain if i % 2 else signs, int(rng.integers(0, 40)))) for i in range(1500)] + ["", " ", "\n", "a ", " a", "×"]
    tool = Encoder(path, (20_000, 2_000))  # most is forgotten
    want = [e.ids for e in tool.library.encode_batch(texts, add_special_tokens=False)]
    for rows in (1, 97, len(texts)):
        got = []
        for i in range(0, len(texts), rows):
            ids, at = tool.encode(pa.array(texts)[i : i + rows])
            got += [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)]
        assert got == want


def test_plain_pieces_of_byte_level_texts_are_not_taken_one_by_one():
    tool, taken = Encoder(BYTES), []
    fragment, merged = tool.fragment, tool.merged
    tool.fragment = lambda text: taken.append(text) or fragment(text)
    tool.merged = lambda text: taken.append(text) or merged(text)
    texts = [f"so naïve w{'xy' * n}, 12 w{'xy' * n}.\nNow w{'xy' * n}!? it's" for n in range(50)]
    ids, at = tool.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [e.ids for e in tool.library.encode_batch(texts, add_special_tokens=False)]
    # a fragment with an apostrophe, the text's begin and what follows no space; the 50 words, each with three signs, go together
    assert len(taken) < 15 and not any("xy" in t for t in taken)


def test_portions_are_bounded_by_rows_and_bytes():
    texts = ["x" * 10, None, "é" * 5, "y" * 500, "", "z", "z" * 30, "z"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    cut = list(portions(iter([batch, batch.slice(2, 3), batch.slice(0, 0)]), 1, 3, 20))
    assert [t for b in cut for t in b.column(1).to_pylist()] == texts + texts[2:5]
    for b in cut:
        assert b.num_rows <= 3
        assert b.num_rows == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 20
