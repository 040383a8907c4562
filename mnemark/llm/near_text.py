"""Jaccard join of word-shingle sets by PartEnum signatures, and the groups that its links form.

1. Equal sets become one, known by the hash of the set.
2. Part of the feature domain is counted: a set with so many shingles of its own that no other set can be similar to it
   is done. What is left is counted again among itself, over the whole domain. Two sets differ by all the shingles that
   only one set has, so ``slack``, a set's size less seven times its own shingles, must not add up to less than nothing.
   Shingles are told apart by 48 bits there: those that fall together count as shared, which rules out less, never more.
3. Every set gives its PartEnum signatures; sets that share one meet in a sorted stream, which needs no room for a
   group. Each links with the first of its group, if the exact sets agree. Most groups of copies become one that way.
4. Signatures that still hold several components are compared in full, those of few sets as pairs. Signatures of many
   sets are joined to crowds, so that two sets meet once however many signatures they share; a crowd's blocks meet
   pairwise, each comparison is exact, and a task tells no more links than join its components.

Nothing is dropped but by bounds that hold for every similar pair, so no link between different sets is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages, only_first, stage
from .components import connected_components
from .partenum import NUMBER, OF, signatures
from .sampling import batches
from .shingles import set_key, shingle_sets, wide_sketch

#: Sixteenths of the feature domain in which shingles of one set alone are counted.
COUNTED = 5
#: Bytes by which counted shingles are told apart, and binary digits of the rows' number that are counted together.
HEAD, CHUNK = 6, 12
#: Rows of (key, id) that are broadcast at most; beyond that both sides are shuffled.
BROADCAST = 1_000_000
#: Groups up to this size are compared pair by pair, larger ones in blocks of so many sets.
SMALL, TILE = 64, 256
NO_CROWD = -(1 << 63)


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat.view(np.int64) if len(flat) else [], kind))


def _packed(numbers: np.ndarray, size: int) -> np.ndarray:
    """The low ``size`` bytes of each number, one after another."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).ravel()


def _unpacked(data: np.ndarray, size: int) -> np.ndarray:
    out = np.zeros((len(data) // size, 8), np.uint8)
    out[:, :size] = data.reshape(-1, size)
    return out.view("<u8").ravel()


def _cut(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """``data``, cut at ``ends`` (from 0 on), as binary values."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _joined(column: pa.Array | pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind)


def _summaries(docs: DataFrame) -> DataFrame:
    """doc_id, key (null for the empty set), n, the counted part of its shingles (heads of ``HEAD`` bytes) and row, of every row; to be staged."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 512):
            sets = list(shingle_sets(batch.column(1)))
            keys = pa.array([set_key(s) if len(s) else None for s in sets], pa.int64())
            part = [s[s & np.uint64(15) < COUNTED] >> np.uint64(16) for s in sets]
            heads = _cut(_packed(np.concatenate([np.zeros(0, np.uint64), *part]), HEAD), HEAD * np.cumsum([0, *map(len, part)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array(list(map(len, sets)), pa.int64()), heads], ["doc_id", "key", "n", "part"])

    return docs.mapInArrow(run, "doc_id long, key long, n long, part binary").withColumn("row", F.monotonically_increasing_id())


def _whole_sets(docs: DataFrame) -> DataFrame:
    """key, n and shingles of every non-empty row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            sets = [s for s in shingle_sets(batch.column(0)) if len(s)]
            columns = [pa.array(list(map(set_key, sets)), pa.int64()), pa.array(list(map(len, sets)), pa.int64()), _lists(sets, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n", "shingles"])

    return docs.select("text").mapInArrow(run, "key long, n long, shingles array<long>")


def _of_known_size(df: DataFrame) -> DataFrame:
    """``df`` (staged, rows of two numbers) marked for broadcasting if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST else df


def _own(sets: DataFrame, n: int) -> DataFrame:
    """(row, own): how many of its features no other row of staged ``sets`` (row, features; ``n`` features in all at most) has.

    Heads are dealt to buckets. For each ``CHUNK`` of rows a bucket gets one value of heads and one of the rows' places in the chunk, and
    gives back the places of those that came once, so what is shuffled is a few bytes for each feature, in few rows. A
    head that rows of a chunk share is told twice, however many have it.
    """
    bits = max(8, (n >> 20).bit_length())
    low = np.uint64(8 * HEAD - bits)

    def told(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1 << CHUNK):
            row, column = batch.column(0).to_numpy(), batch.column(1)
            if pa.types.is_binary(column.type):
                heads, sizes = _unpacked(_joined(column, np.uint8), HEAD), pc.binary_length(column).to_numpy() // HEAD
            else:
                heads, sizes = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(16), pc.list_value_length(column).to_numpy()
            at = np.repeat(row, sizes)
            for chunk in np.unique(row >> CHUNK):
                here = at >> CHUNK == chunk
                head, place = heads[here], (at[here] & ((1 << CHUNK) - 1)).astype("<u2")
                order = np.argsort(head)
                head, place = head[order], place[order]
                third = np.r_[np.zeros(2, bool), head[2:] == head[:-2]][: len(head)]
                head, place = head[~third], place[~third]
                bucket, first = np.unique(head >> low, return_index=True)
                ends = np.r_[first, len(head)]
                rest = _packed(head & ((np.uint64(1) << low) - np.uint64(1)), HEAD - 1)
                columns = [pa.array(bucket.astype(np.int64)), pa.array(np.full(len(bucket), chunk)), _cut(rest, ends * (HEAD - 1)), _cut(place.view(np.uint8), ends * 2)]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "chunk", "heads", "places"])

    def alone(table: pa.Table) -> pa.Table:
        head, place = _unpacked(_joined(table.column("heads"), np.uint8), HEAD - 1), _joined(table.column("places"), "<u2")
        chunk = np.repeat(table.column("chunk").to_numpy(), pc.binary_length(table.column("places")).to_numpy() // 2)
        order = np.argsort(head)
        new = np.r_[True, head[order][1:] != head[order][:-1], True]
        once = order[new[:-1] & new[1:]]
        once = once[np.argsort(chunk[once])]
        chunks, first = np.unique(chunk[once], return_index=True)
        return pa.table([pa.array(chunks), _cut(place[once].view(np.uint8), 2 * np.r_[first, len(once)])], ["chunk", "places"])

    def counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counts = np.bincount(_joined(table.column("places"), "<u2"))
        place = np.flatnonzero(counts)
        return pa.table([pa.array((key[0].as_py() << CHUNK) + place), pa.array(counts[place])], ["row", "own"])

    dealt = sets.mapInArrow(told, "bucket long, chunk long, heads binary, places binary")
    found = dealt.groupBy("bucket").applyInArrow(lambda table: alone(table), "chunk long, places binary")
    return found.groupBy("chunk").applyInArrow(lambda key, table: counted(key, table), "row long, own long")


def _may_link() -> Column:
    """Whether a set of n shingles, ``own`` of them its own, can be similar to any other set."""
    return F.lit(OF) * (F.col("n") - F.coalesce("own", F.lit(0))) >= F.lit(NUMBER) * F.col("n")


def _candidates(known: DataFrame, kept: Stages) -> DataFrame:
    """(key, doc_id) of the sets that the counted shingles do not rule out; doc_id is the least of the set's."""
    full = known.where("key is not null")
    sets = full.groupBy("key").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"))
    # a set's copies would share all it has; any that stay (of ids null or repeated) do no more than keep it
    copies = kept.stage(full.select("key", "doc_id").join(sets.select("key", "least"), "key").where("doc_id > least").select("key", "doc_id").distinct())
    once = full.join(_of_known_size(copies), ["key", "doc_id"], "left_anti")
    own = _own(once.select("row", "part"), known.agg(F.sum("n")).first()[0] or 0)
    own = full.select("key", "row").join(own, "row").groupBy("key").agg(F.max("own").alias("own"))
    return sets.join(own, "key", "left").where(_may_link()).select("key", F.col("least").alias("doc_id"))


def _with_slack(sets: DataFrame) -> DataFrame:
    """Of staged ``sets`` (key, n, shingles, row) those that can link among themselves, with their slack."""
    own = _own(sets.select("row", "shingles"), sets.agg(F.sum("n")).first()[0] or 0)
    counted = sets.select("key", "n", "row").join(own, "row", "left").where(_may_link())
    slack = (OF - NUMBER) * F.col("n") - (OF + NUMBER) * F.coalesce("own", F.lit(0))
    return counted.select("key", slack.alias("slack"))


def _stars(sets: DataFrame) -> DataFrame:
    """(sig, key, hub) of the sets that share a signature with others; the hub is the first of them by key."""

    def sign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [signatures(np.array(s, np.int64).view(np.uint64)) for s in batch.column(1).to_pylist()]
            keys = np.repeat(batch.column(0).to_numpy(), list(map(len, found)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *found])), pa.array(keys)], ["sig", "key"])

    def star(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[int, int, bool] | None = None  # signature and hub of the open group; was the hub's row given?
        for batch in it:
            if not batch.num_rows:
                continue
            sig, key = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            if held and not held[2]:
                sig, key = np.r_[held[0], sig], np.r_[held[1], key]
            first = np.r_[True, sig[1:] != sig[:-1]]
            at = np.maximum.accumulate(np.where(first, np.arange(len(sig)), 0))
            hub = key[at]
            given = np.zeros(len(sig), bool)
            if held and held[2] and sig[0] == held[0]:
                run = at == 0
                hub[run], given[run] = held[1], True
            alone = first & np.r_[first[1:], True]
            keep = ~alone | given
            held = (int(sig[-1]), int(hub[-1]), bool(keep[-1]))
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(key[keep]), pa.array(hub[keep])], ["sig", "key", "hub"])

    signed = sets.select("key", "shingles").mapInArrow(sign, "sig long, key long")
    return signed.repartition("sig").sortWithinPartitions("sig", "key").mapInArrow(star, "sig long, key long, hub long")


def _of_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The sets that staged ``pairs`` name, so that no others are shuffled."""
    named = stage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct())
    return sets.join(_of_known_size(named), "key", "left_semi")


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The rows of staged ``pairs`` (a, b) whose exact sets are similar."""
    sets = _of_pairs(pairs, sets)
    left = sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(left, "a").join(right, "b").withColumn("common", common)
    return met.where(OF * F.col("common") >= NUMBER * (F.col("na") + F.col("nb") - F.col("common"))).select(*pairs.columns)


def _by_sketch(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The staged pairs whose sketches, where of one length, do not differ by more than similar sets may."""

    def sketched(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 1024):
            each = [wide_sketch(np.array(s, np.int64).view(np.uint64)) for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(each, pa.int64())], ["key", "n", "sketch"])

    named = _of_pairs(pairs, sets).select("key", "n", "shingles").mapInArrow(sketched, "key long, n long, sketch array<long>")
    left = named.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("ka"))
    right = named.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("kb"))
    apart = F.aggregate(F.zip_with("ka", "kb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    may = (F.size("ka") != F.size("kb")) | (apart * (OF + NUMBER) <= (OF - NUMBER) * (F.col("na") + F.col("nb")))
    return pairs.join(left, "a").join(right, "b").where(may).select(*pairs.columns)


def _pairs_of_small(rows: DataFrame) -> DataFrame:
    """All pairs of different components within signatures of ``SMALL`` sets at most, by size and slack alone.

    Two sets of one crowd are left out: they meet there.
    """

    def pairs(block: np.ndarray) -> np.ndarray:
        sig, comp, key, n, slack, crowd = block
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        sizes = np.diff(np.r_[starts, len(sig)])
        out = [np.zeros((4, 0), np.int64)]
        for g in np.unique(sizes[sizes > 1]):
            i, j = np.triu_indices(g, 1)
            s = starts[sizes == g]
            a, b = (s[:, None] + i).ravel(), (s[:, None] + j).ravel()
            fit = (comp[a] != comp[b]) & (OF * np.minimum(n[a], n[b]) >= NUMBER * np.maximum(n[a], n[b])) & (slack[a] + slack[b] >= 0) & ((crowd[a] != crowd[b]) | (crowd[a] == NO_CROWD))
            a, b = a[fit], b[fit]
            out.append(np.array([np.minimum(key[a], key[b]), np.maximum(key[a], key[b]), np.where(key[a] < key[b], comp[a], comp[b]), np.where(key[a] < key[b], comp[b], comp[a])]))
        return np.unique(np.concatenate(out, axis=1), axis=1)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((6, 0), np.int64)
        for batch in batches(it, 4096):
            block = np.concatenate([held, np.array([c.to_numpy() for c in batch.columns])], axis=1)
            last = int(np.searchsorted(block[0], block[0, -1])) if block.shape[1] else 0
            held = block[:, last:]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, pairs(block[:, :last]))), ["a", "b", "ca", "cb"])
        yield pa.RecordBatch.from_arrays(list(map(pa.array, pairs(held) if held.shape[1] else held[:4])), ["a", "b", "ca", "cb"])

    sorted_rows = rows.select("sig", "comp", "key", "n", "slack", "crowd").repartition("sig").sortWithinPartitions("sig", "comp", "key")
    return sorted_rows.mapInArrow(run, "a long, b long, ca long, cb long")


def _compare_blocks(key, table: pa.Table) -> pa.Table:
    """(a, b): pairs of components that links between two blocks of sets join, no more than join them all."""
    side, comps, n, slack = (table.column(c).to_numpy() for c in ("side", "comp", "n", "slack"))
    lists = table.column("shingles").combine_chunks()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))])
    universe, flat = np.unique(lists.flatten().to_numpy(), return_inverse=True)
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if key[1].as_py() != key[2].as_py() else left
    names, at = np.unique(comps, return_inverse=True)
    parent = list(range(len(names)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found: list[tuple[int, int]] = []
    mine = np.concatenate([flat[ends[r] : ends[r + 1]] for r in right]) if len(right) else flat[:0]
    starts = np.concatenate([[0], np.cumsum(np.diff(ends)[right])[:-1]]) if len(right) else np.zeros(0, np.int64)
    held = np.zeros(len(universe), bool)
    for a in left if len(right) else []:
        may = (at[right] != at[a]) & (slack[right] + slack[a] >= 0) & (OF * np.minimum(n[right], n[a]) >= NUMBER * np.maximum(n[right], n[a]))
        if not may.any():
            continue
        held[flat[ends[a] : ends[a + 1]]] = True
        common = np.add.reduceat(held[mine], starts, dtype=np.int64)
        held[flat[ends[a] : ends[a + 1]]] = False
        for c in np.unique(at[right[may & (OF * common >= NUMBER * (n[right] + n[a] - common))]]).tolist():
            x, y = root(int(at[a])), root(c)
            if x != y:
                parent[max(x, y)] = min(x, y)
                found.append((int(names[at[a]]), int(names[c])))
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})


def _links_of_crowds(rows: DataFrame, crowds: DataFrame, sets: DataFrame, kept: Stages) -> DataFrame:
    """(a, b): components that links within ``crowds`` (key, crowd) join."""
    one = kept.stage(rows.select("key", "comp", "n", "slack").distinct().join(crowds, "key"))
    sizes = one.groupBy("crowd").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("blocks"))
    own = one.join(sizes, "crowd").withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    own = kept.stage(own.join(sets.select("key", "shingles"), "key"))
    row = ["comp", "n", "slack", "shingles"]
    lefts = own.select("crowd", F.col("own").alias("i"), F.explode(F.expr("sequence(own, blocks - 1)")).alias("j"), F.lit(0).alias("side"), *row)
    rights = own.where("own > 0").select("crowd", F.explode(F.expr("sequence(0, own - 1)")).alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *row)
    return lefts.union(rights).groupBy("crowd", "i", "j").applyInArrow(lambda key, t: _compare_blocks(key, t), "a long, b long")


def _unresolved(rows: DataFrame, kept: Stages) -> DataFrame:
    """The rows (sig, key, hub, n, slack, comp) of signatures that hold several components, with g, the number of their sets.

    A row goes too if its slack is too little for any other of its signature. Counts are taken in part before the
    exchange, so a signature that many sets share is not gathered.
    """
    sums = rows.groupBy("sig").agg(F.count(F.lit(1)).alias("g"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("slack").alias("most"))
    open_ = kept.stage(sums.where("lo < hi").select("sig", "g", "most"))
    return rows.join(_of_known_size(open_), "sig").where("slack + most >= 0").drop("most")


def _components(sets: DataFrame, kept: Stages) -> DataFrame:
    """(node, component) of the sets (key, n, slack, shingles) that link with others."""
    shared = kept.stage(_stars(sets))
    met = shared.where("key <> hub").groupBy("key", "hub").agg(F.count(F.lit(1)).alias("c"))
    best = met.groupBy("key").agg(F.max(F.struct("c", "hub"))["hub"].alias("most"), F.min("hub").alias("least"))
    hubs = kept.stage(best.select(F.col("key").alias("a"), F.explode(F.array_distinct(F.array("most", "least"))).alias("b")))
    first = kept.stage(connected_components(_alike(kept.stage(_by_sketch(hubs, sets)), sets)))

    comp = F.coalesce("component", "key")
    known = sets.select("key", "n", "slack").join(first.withColumnRenamed("node", "key"), "key", "left")
    known = kept.stage(known.select("key", "n", "slack", comp.alias("comp")))
    open_ = kept.stage(_unresolved(shared.join(_of_known_size(known), "key"), kept))
    kept.drop(shared)
    large = open_.where(F.col("g") > SMALL).select("key", "hub", "comp", "n", "slack").distinct()
    large = kept.stage(large)
    joined = connected_components(large.select(F.col("key").alias("a"), F.col("hub").alias("b")))
    crowds = kept.stage(joined.select(F.col("node").alias("key"), F.col("component").alias("crowd")))
    many = _links_of_crowds(large, crowds, sets, kept)
    few = open_.where(F.col("g") <= SMALL).join(_of_known_size(crowds), "key", "left").fillna(NO_CROWD, ["crowd"])
    pairs = kept.stage(_pairs_of_small(few).distinct())
    small = _alike(kept.stage(_by_sketch(pairs, sets)), sets).select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    second = kept.stage(connected_components(small.union(many)))
    joined = second.select(F.col("node").alias("component"), F.col("component").alias("upper"))
    inner = first.join(joined, "component", "left").select("node", F.coalesce("upper", "component").alias("component"))
    outer = second.join(first.select("node"), "node", "left_anti").select("node", "component")
    return inner.union(outer)


def _groups(rows: DataFrame) -> DataFrame:
    """doc_id, key, n, component (a set's key) and component_id of every row of (doc_id, text); key null: no words."""
    with Stages(rows.sparkSession) as kept:
        summaries = kept.stage(_summaries(rows))
        candidates = _of_known_size(kept.stage(_candidates(summaries, kept)))
        known = stage(summaries.select("doc_id", "key", "n"))
        kept.drop(summaries)
        picked = rows.join(candidates.select("doc_id"), "doc_id", "left_semi").union(rows.where("doc_id is null"))
        every = kept.stage(_whole_sets(picked).join(candidates.select("key"), "key", "left_semi").dropDuplicates(["key"]).withColumn("row", F.monotonically_increasing_id()))
        sets = kept.stage(every.drop("row").join(_of_known_size(kept.stage(_with_slack(every))), "key"))
        kept.drop(every)
        parts = stage(_components(sets, kept))
    keyed = known.where("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"))
    named = keyed.join(parts.withColumnRenamed("node", "key"), "key")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = named.select("key", "component").join(least, "component").select("key", "component", "component_id")
    own = keyed.join(linked, "key", "left").select("key", F.coalesce("component", "key").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    full = known.where("key is not null").select("doc_id", "key", "n").join(own, "key").select("doc_id", "key", "n", "component", "component_id")
    return full.union(known.where("key is null").select("doc_id", "key", "n", F.lit(None).cast("long"), "doc_id"))


def near_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``: the groups of linked documents.

    Rows link when their sets of shingles are similar, and equal sets link whatever their ids. A null or empty text has
    no shingles and links with nothing: its component is its own id. A component's id is the least id of its rows, null
    ids aside. Repeated rows are each kept; an empty table gives no rows; other columns are ignored.
    """
    found = _groups(only_first(docs, doc_id, text).toDF("doc_id", "text"))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any other columns) less all but one of each group of :func:`near_texts`.

    The row of the least id stays; of several rows with that id, or of rows without one, any one. Rows without words
    all stay. Columns and their order are kept; an empty table stays empty.
    """
    found = stage(_groups(only_first(docs, "doc_id", "text")))
    gone = found.where("component is not null and doc_id <> component_id").select("doc_id")
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    plain = docs.where("doc_id is not null").join(_of_known_size(stage(gone.union(repeated).distinct())), "doc_id", "left_anti")
    odd = found.where("doc_id is null").select("doc_id").limit(1).union(repeated.limit(1))
    if odd.isEmpty():
        return plain.select(*docs.columns)
    # rows that their id does not tell apart are told apart by their sets
    several = docs.join(repeated, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
    at = docs.columns.index("text")

    def with_key(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it, 256):
            keys = pa.array([set_key(s) if len(s) else None for s in shingle_sets(batch.column(at))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], [*batch.schema.names, "_set_key"])

    keyed = stage(several.mapInArrow(with_key, T.StructType([*docs.schema.fields, T.StructField("_set_key", T.LongType())])))
    owner = found.where("key is not null").select(F.col("key").alias("_set_key"), F.col("component").alias("_component"), F.col("component_id").alias("_least")).distinct()
    chosen = keyed.join(owner, "_set_key").where(F.col("doc_id").eqNullSafe(F.col("_least"))).dropDuplicates(["_component"])
    return plain.select(*docs.columns).union(chosen.select(*docs.columns)).union(keyed.where("_set_key is null").select(*docs.columns))
