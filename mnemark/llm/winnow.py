"""Benchmark decontamination by winnowing, on DataFrame functions alone.

Both sides keep the least hash of ``GRAM`` words in every ``SPAN`` consecutive ones, so that texts that share a window of
``WINDOW`` words share a kept hash within it. A document's kept hash goes with the words around it, as far as a window
that holds it can reach. These fingerprints are joined with the benchmark's; what is left is extended to the windows
around it, which are compared word by word, so no text travels. Among equal least hashes of a window a document keeps
any, a benchmark item all. Items shorter than a window are sought by the hash of their first words.

Hashes that hit no slot of a table of fixed size, which the benchmark's hashes fill, are left out before rows are made of
them. No row stands for a pair of documents, nor for a document and an item: windows are distinct texts, and documents
that hit the same windows share the list of their items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, join_counted, only_first
from .license_scan import LOWER, NO_WORD, UPPER

WINDOW, GRAM = 10, 5
SPAN = WINDOW - GRAM + 1
#: Slots of the prefilter, 32 to a number: 16 KB whatever the benchmark.
SLOTS = 1 << 16
#: Benchmark rows (of about 100 bytes) that are broadcast at most; more are joined by a shuffle.
BROADCAST = 200_000
NO_PLACES = "cast(array() as array<int>)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lower-cased; none of a null one."""
    plain = F.trim(F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD, " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


def places(n: Column) -> Column:
    """0 to n - 1; none where n is 0 or less."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr(NO_PLACES))


def grams(hashes: Column, size: int) -> Column:
    """Hash of every ``size`` consecutive words from their hashes, the low three bits cleared."""
    return F.transform(places(F.size(hashes) - (size - 1)), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]).bitwiseAND(F.lit(~7)))


def _grams_of(size: int) -> Callable[[Column], Column]:
    return lambda hashes: grams(hashes, size)


def least(hashes: Column) -> Column:
    """The least of every ``SPAN`` consecutive numbers."""
    return F.transform(places(F.size(hashes) - (SPAN - 1)), lambda s: F.least(*[F.get(hashes, s + j) for j in range(SPAN)]))


def some_least(hashes: Column) -> Column:
    """(hash, pos) of one least hash of each ``SPAN`` consecutive ones, each place once.

    While they are compared, the low bits of hashes hold those of their places, which tell a place within a window. A
    place that is least in several windows is so in consecutive ones, and is taken with the first.
    """
    marked = F.transform(hashes, lambda h, i: h.bitwiseOR(i.bitwiseAND(F.lit(7)).cast("long")))

    def taken(m: Column, s: Column) -> Column:
        pos = s + F.pmod(m.bitwiseAND(F.lit(7)).cast("int") - s, F.lit(8))
        return F.struct(m.bitwiseAND(F.lit(~7)).alias("hash"), pos.alias("pos"))

    chosen = let(marked, lambda m: let(least(m), lambda a: F.transform(a, lambda m, s: F.when((s == 0) | (F.get(a, s - 1) != m), taken(m, s)))))
    return F.filter(chosen, lambda p: p.isNotNull())


def every_least(hashes: Column) -> Column:
    """(hash, pos) of every place that holds a least hash of some ``SPAN`` consecutive ones, ties included."""

    def of(lows: Column) -> Column:
        kept = F.transform(hashes, lambda h, i: F.when(F.exists(F.slice(lows, F.greatest(i - SPAN + 2, F.lit(1)), F.lit(SPAN)), lambda x: x == h), F.struct(h.alias("hash"), i.alias("pos"))))
        return F.filter(kept, lambda p: p.isNotNull())

    return let(least(hashes), of)


def slot(size: Column, hash: Column) -> Column:
    return (F.shiftright(hash, 20) + size).bitwiseAND(F.lit(SLOTS - 1)).cast("int")


def slot_test(fingerprints: DataFrame) -> Callable[[Column, Column], Column]:
    """Whether a (size, hash) hits a filled slot. The slots, ``SLOTS`` bits at most, go into the plan."""
    filled = [0] * (SLOTS // 32)
    for r in fingerprints.select(slot(F.col("size"), F.col("hash")).alias("s")).distinct().collect():
        filled[r.s >> 5] |= 1 << (r.s & 31)
    bits = F.expr(f"array({','.join(f'{x}L' for x in filled)})")

    def hit(size: Column, hash: Column) -> Column:
        at = slot(size, hash)
        return F.call_function("shiftright", F.get(bits, F.shiftright(at, 5)), at.bitwiseAND(F.lit(31))).bitwiseAND(F.lit(1)) == 1

    return hit


def item_tables(held: Stages, items: DataFrame, item_id: str, text: str) -> tuple[DataFrame, DataFrame, list[int]]:
    """Windows (w1, w2, words, item) of all items, fingerprints (size, hash), and the lengths below a window.

    ``words`` is a window's text; w1 and w2 are its hashes. ``size`` is 0 for winnowed hashes, else the number of
    first words that stand for a short item.
    """
    named = only_first(items, item_id, text).toDF("item", "text")
    worded = held.stage(named.select(F.col("item").cast("string").alias("item"), words_of(F.col("text")).alias("w")).where("size(w) > 0"))
    starts = places(F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    windows = worded.select("item", F.explode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(WINDOW)), " "))).alias("words")).distinct()
    lengths = sorted(r.n for r in worded.where(F.size("w") < WINDOW).select(F.size("w").alias("n")).distinct().collect())
    hashes = F.transform("w", lambda w: F.xxhash64(w))
    long = worded.where(F.size("w") >= WINDOW).select(F.explode(let(let(hashes, lambda h: grams(h, GRAM)), every_least)).alias("f"))
    found = long.select(F.lit(0).alias("size"), "f.hash")
    for size in sorted({min(n, GRAM) for n in lengths}):
        short = worded.where(F.least(F.size("w"), F.lit(GRAM)) == size).where(F.size("w") < WINDOW)
        found = found.union(short.select(F.lit(size), let(hashes, _grams_of(size))[0]))
    return held.stage(windows.withColumns({"w1": F.xxhash64("words"), "w2": F.xxhash64(F.lit(1), "words")})), held.stage(found.distinct()), lengths


def fingerprints(docs: DataFrame, lengths: list[int], hit: Callable[[Column, Column], Column]) -> DataFrame:
    """(doc_id, h1, h2, size, hash, pos, near): of each row the hashes that may meet the benchmark's, and one of size -1.

    ``near`` has the words from ``SPAN - 1`` before the place on, as far as windows reach; ``pos`` of a row of size -1 is
    the text's number of words.
    """

    def near(w: Column, first: Column, length: int) -> Column:
        return F.array(*[F.get(w, first + j) for j in range(length)])

    def entry(size: int, hash: Column, pos: Column, words: Column) -> Column:
        return F.struct(F.lit(size).alias("size"), hash.alias("hash"), pos.alias("pos"), words.alias("near"))

    def of(w: Column) -> Column:
        def kept(h: Column) -> Column:
            def winnowed(g: Column) -> Column:
                chosen = F.filter(some_least(g), lambda p: hit(F.lit(0), p["hash"]))
                return F.transform(chosen, lambda p: entry(0, p["hash"], p["pos"], near(w, p["pos"] - (SPAN - 1), 2 * SPAN + GRAM - 2)))

            def firsts(size: int) -> Column:
                def sought(g: Column) -> Column:
                    met = F.filter(F.transform(g, lambda x, i: F.struct(x.alias("hash"), i.alias("pos"))), lambda p: hit(F.lit(size), p["hash"]))
                    return F.transform(met, lambda p: entry(size, p["hash"], p["pos"], near(w, p["pos"], WINDOW - 1)))

                return let(grams(h, size), sought)

            own = F.array(entry(-1, F.lit(0).cast("long"), F.size(w), F.expr("cast(null as array<string>)")))
            return F.concat(own, let(grams(h, GRAM), winnowed), *[firsts(size) for size in sorted({min(n, GRAM) for n in lengths})])

        return let(F.transform(w, lambda x: F.xxhash64(x)), kept)

    plain = F.coalesce("text", F.lit(""))
    return docs.select(
        "doc_id", F.xxhash64(plain).alias("h1"), F.xxhash64(F.lit(1), plain).alias("h2"), F.explode(let(words_of(F.col("text")), of)).alias("f")
    ).select("doc_id", "h1", "h2", "f.*")


def windows_around(found: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, h1, h2, start, n, words): all windows that hold a fingerprint's words."""

    def cut(first: int, n: int, start: Column) -> Column:
        return F.struct(start.alias("start"), F.lit(n).alias("n"), F.slice("near", first + 1, n).alias("w"))

    long = F.array(*[cut(s, WINDOW, F.col("pos") - (SPAN - 1) + s) for s in range(SPAN)])
    short = [F.when(F.col("size") == min(n, GRAM), cut(0, n, F.col("pos"))) for n in lengths]
    each = F.when(F.col("size") == 0, long).otherwise(F.array(*short)) if short else long
    rows = found.select("doc_id", "h1", "h2", F.explode(each).alias("c")).where("c is not null and size(c.w) = c.n and forall(c.w, x -> x is not null)")
    return rows.select("doc_id", "h1", "h2", "c.start", "c.n", F.array_join("c.w", " ").alias("words"))


def _small(table: DataFrame) -> DataFrame:
    return F.broadcast(table) if table.count() <= BROADCAST else table


def merged(spans: Column) -> Column:
    """Sorted spans (start, end) of at most ``WINDOW`` words as those that neither overlap nor touch.

    Of equal starts the longest stays; then whatever reaches a start is among the ``WINDOW`` spans before it.
    """

    def reach(e: Column, i: Column) -> Column:
        """The furthest end before the i-th span."""
        return F.coalesce(F.greatest(*[F.get(e, i - j)["end"] for j in range(1, WINDOW + 1)]), F.lit(-1))

    def joined(e: Column) -> Column:
        heads = F.filter(F.transform(e, lambda x, i: F.when(x["start"] > reach(e, i), x["start"])), lambda x: x.isNotNull())
        tails = F.filter(
            F.transform(e, lambda x, i: F.when(F.coalesce(F.get(e, i + 1)["start"] > reach(e, i + 1), F.lit(True)), reach(e, i + 1))), lambda x: x.isNotNull()
        )
        return F.zip_with(heads, tails, lambda a, b: F.struct(a.alias("start"), b.alias("end")))

    def longest(s: Column) -> Column:
        return F.filter(s, lambda x, i: F.coalesce(F.get(s, i + 1)["start"] != x["start"], F.lit(True)))

    return let(spans, lambda s: let(longest(s), joined))


def decontaminate(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, n_words, spans, n_hit, n_items, items_sha256, contaminated of every row of ``docs``.

    ``spans`` are the hit stretches of words (start, end exclusive), in order, none touching another. A null text has no
    words, as an empty one. Rows alike in id and text give equal rows, as many as there are; null and repeated ids are
    rows like others. Items without words are found nowhere; an item without an id marks words and is not listed; of
    items of one id each text counts and the id once. Empty tables: no documents give no rows, no items no hits.
    Other columns are ignored.
    """
    key = ["doc_id", "h1", "h2"]
    with Stages(docs.sparkSession) as held:
        windows, marks, lengths = item_tables(held, items, item_id, item_text)
        rows = held.stage(fingerprints(only_first(docs, doc_id, text).toDF("doc_id", "text"), lengths, slot_test(marks)))
        met = rows.where("size >= 0").join(_small(marks), ["size", "hash"], "left_semi")
        texts = windows.select("words", "w1", "w2").distinct()
        hits = windows_around(met, lengths).join(_small(texts), "words")
        own = rows.where("size = -1").select(*key, F.col("pos").alias("n_words"), F.expr("cast(null as struct<start:int,end:int>)").alias("span"), F.expr("cast(null as struct<w1:bigint,w2:bigint>)").alias("w"))
        spans = hits.select(*key, F.lit(None).cast("int").alias("n_words"), F.struct("start", (F.col("start") + F.col("n")).alias("end")).alias("span"), F.struct("w1", "w2").alias("w"))
        by_doc = own.unionByName(spans).groupBy(*key).agg(
            F.count("n_words").alias("copies"), F.max("n_words").cast("long").alias("n_words"), F.array_sort(F.collect_set("span")).alias("spans"), F.array_sort(F.collect_set("w")).alias("w")
        )
        by_doc = by_doc.withColumns({"spans": merged(F.col("spans")), "s1": F.when(F.size("w") > 0, F.xxhash64("w")), "s2": F.when(F.size("w") > 0, F.xxhash64(F.lit(1), "w"))})
        by_doc = held.stage(by_doc.drop("h1", "h2"))
        sets = held.stage(by_doc.where("s1 is not null").groupBy("s1", "s2").agg(F.any_value("w").alias("w"), F.count(F.lit(1)).alias("sharing")))
        each = sets.select("s1", "s2", F.explode("w").alias("w")).select("s1", "s2", "w.w1", "w.w2")
        listed = each.join(_small(windows.where("item is not null").select("w1", "w2", "item")), ["w1", "w2"]).groupBy("s1", "s2").agg(F.array_sort(F.collect_set("item")).alias("items"))
        told = sets.select("s1", "s2", "sharing").join(listed, ["s1", "s2"], "left").select(
            "s1", "s2", "sharing", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
        )
        out = join_counted(by_doc.drop("w"), told, ["s1", "s2"], "sharing").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        covered = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
        return held.result(
            out.select(
                "doc_id", "n_words", "spans", covered.alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"),
            )
        )
