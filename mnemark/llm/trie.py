"""Prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of first turns, known by a 128-bit digest: the exclusive or of hashes that tie each turn to
its place. Digests of all prefixes are running values over rows sorted by range, so that a conversation of any length is
spread over tasks. Edges lead from a node's digest to its parent's. Sums over subtrees take a number of rounds that grows
with the logarithm of the depth: after round r each node has the sum over its descendants nearer than 2^r, and a pointer to
its ancestor 2^r above.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Stages, join_counted, only_first

#: Ids joined into one string on their way to a node's hash.
CHUNK = 4096
NAMES = ["conv_id", "turn", "role", "text"]


def turns(rows: DataFrame, columns: list[str] = NAMES) -> DataFrame:
    """conv_id, turn, two hashes of (role, text) and the code points of the text; rows without a conv_id are left out."""
    named = only_first(rows, *columns).toDF(*NAMES).where("conv_id is not null")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return named.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.xxhash64(role, text).alias("d1"),
        F.xxhash64(F.lit(1), text, role).alias("d2"),
        F.length(text).alias("chars"),
    )


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Within a partition, the running count ``n`` and exclusive ors ``r1`` and ``r2`` of each conversation's rows."""
    part, last, seen, carry = TaskContext.get().partitionId(), None, 0, {"x1": np.int64(0), "x2": np.int64(0)}
    for b in batches:
        if not b.num_rows:
            continue
        conv, at = b.column("conv_id").to_numpy(), np.arange(b.num_rows)
        new = np.r_[conv[0] != last, conv[1:] != conv[:-1]]
        start = np.maximum.accumulate(np.where(new, at, -1))
        n = np.where(start < 0, at + 1 + seen, at - start + 1)
        out = [pa.array(np.full(len(at), part, np.int32)), pa.array(n)]
        for name in carry:
            x = b.column(name).to_numpy()
            through = np.bitwise_xor.accumulate(x)
            r = through ^ np.where(start < 0, carry[name], through[start] ^ x[start])
            carry[name] = r[-1]
            out.append(pa.array(r))
        last, seen = conv[-1], n[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, *out], names=[*b.schema.names, "part", "n", "r1", "r2"])


def running(held: Stages, rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (conv_id, x1, x2, ...) with n, r1 and r2: count and exclusive ors from their conversation's first row on.

    Rows are cut by ranges of (conv_id, order), also amid a conversation. At most one conversation of a part began in
    an earlier one, so what precedes is one row for each part at most: it is broadcast.
    """
    by = ["conv_id", *order]
    schema = ", ".join([*(f"{n} {t}" for n, t in rows.dtypes), "part int", "n long", "r1 long", "r2 long"])
    cut = held.stage(rows.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_run, schema))
    totals = cut.groupBy("conv_id", "part").agg(F.max("n").alias("m"), F.max_by("r1", "n").alias("t1"), F.max_by("r2", "n").alias("t2"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "part", F.sum("m").over(before).alias("m"), F.bit_xor("t1").over(before).alias("t1"), F.bit_xor("t2").over(before).alias("t2"))
    with_carry = cut.join(F.broadcast(carried.where("m is not null")), ["conv_id", "part"], "left")
    return with_carry.select(
        *rows.columns,
        (F.col("n") + F.coalesce("m", F.lit(0))).alias("n"),
        F.col("r1").bitwiseXOR(F.coalesce("t1", F.lit(0))).alias("r1"),
        F.col("r2").bitwiseXOR(F.coalesce("t2", F.lit(0))).alias("r2"),
    )


def rebuilt(held: Stages, rows: DataFrame, family: int, folds: int) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos from 1, d1, d2, chars) of the rebuilt conversations, and all conv_ids.

    Conversation c takes the first crc32(c) % folds turns of c - c % family, then its own turns after as many.
    """
    zero = F.lit(0).cast("long")
    numbered = held.stage(running(held, rows.withColumns({"x1": zero, "x2": zero}), "turn", "d1", "d2").select("conv_id", "n", "d1", "d2", "chars"))
    heads = F.crc32(F.col("conv_id").cast("string").cast("binary")) % folds
    turn = F.struct("n", "d1", "d2", "chars")
    first = numbered.where((F.col("n") < folds) & (F.col("conv_id") % family == 0)).groupBy(F.col("conv_id").alias("base"))
    first = first.agg(F.array_sort(F.collect_list(turn)).alias("head"))  # fewer than ``folds`` of each
    convs = numbered.groupBy("conv_id").agg(F.max("n").alias("turns")).withColumns({"heads": heads, "base": F.col("conv_id") - F.col("conv_id") % family})
    plan = held.stage(convs.join(first, "base", "left").withColumn("head", F.filter("head", lambda t: t["n"] <= F.col("heads"))))
    taken = plan.select("conv_id", F.explode("head").alias("t")).select("conv_id", "t.n", "t.d1", "t.d2", "t.chars")
    moved = plan.select("conv_id", "turns", (F.coalesce(F.size("head"), F.lit(0)) - F.col("heads")).alias("shift")).where("shift <> 0")
    own = join_counted(numbered.where(F.col("n") > heads), moved, ["conv_id"], "turns")
    own = own.select("conv_id", (F.col("n") + F.coalesce("shift", F.lit(0))).alias("n"), "d1", "d2", "chars")
    return taken.unionByName(own).withColumnRenamed("n", "pos"), plan.select("conv_id")


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (k1, k2, conv_id) as strings of at most ``CHUNK`` ids: (k1, k2, first, ids)."""
    key, held = None, []

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "first", "ids"])

    for b in batches:
        out = []
        for k1, k2, conv in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "conv_id")), strict=True):
            if held and ((k1, k2) != key or len(held) == CHUNK):
                out.append((*key, held[0], ",".join(map(str, held))))
                held = []
            key = (k1, k2)
            held.append(conv)
        if out:
            yield told(out)
    if held:
        yield told([(*key, held[0], ",".join(map(str, held)))])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted strings of ids as one SHA-256 for each node; a string is held at a time."""
    key, digest = None, None

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], names=["k1", "k2", "ends_sha256"])

    for b in batches:
        out = []
        for k1, k2, ids in zip(*(b.column(c).to_pylist() for c in ("k1", "k2", "ids")), strict=True):
            if (k1, k2) == key:
                digest.update(b"," + ids.encode())
                continue
            if key:
                out.append((*key, digest.hexdigest()))
            key, digest = (k1, k2), hashlib.sha256(ids.encode())
        if out:
            yield told(out)
    if key:
        yield told([(*key, digest.hexdigest())])


def ends(lasts: DataFrame) -> DataFrame:
    """k1, k2, ends_sha256 of the nodes where conversations end; ``lasts`` has k1, k2, conv_id of every conversation.

    The ids of one node, however many, are sorted by range over tasks and joined into long strings there, so that the one
    task that must read them in order has few rows.
    """
    by = ["k1", "k2", "conv_id"]
    parts = lasts.repartitionByRange(*by).sortWithinPartitions(*by).mapInArrow(_chunks, "k1 long, k2 long, first long, ids string")
    return parts.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def roll_up(held: Stages, edges: DataFrame, *values: str) -> DataFrame:
    """Sums of ``values`` over every node's subtree, itself included: (k1, k2, *values).

    ``edges`` has k1, k2, depth, u1, u2 (the parent's digest, null at the root) and the values. Each round doubles the
    pointers' reach; there are about log2(depth) rounds.
    """
    now, reach = held.stage(edges.select("k1", "k2", "depth", "u1", "u2", *values)), 1
    while not now.where("u1 is not null").isEmpty():
        sent = now.where("u1 is not null").groupBy(F.col("u1").alias("k1"), F.col("u2").alias("k2"))
        sent = sent.agg(F.count(F.lit(1)).alias("below"), *[F.sum(v).alias(f"_{v}") for v in values])
        summed = held.stage(
            now.join(sent, ["k1", "k2"], "left").select(
                "k1", "k2", "depth", "u1", "u2", "below", *[(F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values]
            )
        )
        held.drop(now)
        over = summed.where("below > 0 and u1 is not null").select(F.col("k1").alias("u1"), F.col("k2").alias("u2"), F.col("u1").alias("w1"), F.col("u2").alias("w2"), "below")
        reach *= 2
        far = join_counted(summed.where(F.col("depth") >= reach).drop("below"), over, ["u1", "u2"], "below")
        done = summed.where(F.col("depth") < reach)
        none = F.lit(None).cast("long")
        now = held.stage(
            far.select("k1", "k2", "depth", F.col("w1").alias("u1"), F.col("w2").alias("u2"), *values).unionByName(
                done.select("k1", "k2", "depth", none.alias("u1"), none.alias("u2"), *values)
            )
        )
        held.drop(summed)
    return now.select("k1", "k2", *values)


def prefix_trie(rows: DataFrame, columns: list[str] = NAMES, family: int = 100, folds: int = 6) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations, with its own and its subtree's figures.

    k1 and k2 are the node's digest, p1 and p2 its parent's (null at the root). A null role or text is empty. Rows
    without a conv_id belong to no conversation; a null turn comes first, and turns of equal number (repeated rows
    among them) come in the order of their hashes, so that the result is the same however rows are dealt. An empty
    table has no conversation and gives no rows, not even a root. Other columns are ignored.
    """
    with Stages(rows.sparkSession) as held:
        chain, convs = rebuilt(held, turns(rows, columns), family, folds)
        place = chain.withColumns({"x1": F.xxhash64("pos", "d1", "d2"), "x2": F.xxhash64(F.lit(2), "d2", "pos", "d1")})
        prefixes = held.stage(running(held, place.select("conv_id", "pos", "x1", "x2", "chars"), "pos").select("conv_id", "n", "x1", "x2", "r1", "r2", "chars"))
        found = prefixes.groupBy(F.col("r1").alias("k1"), F.col("r2").alias("k2")).agg(
            F.min("conv_id").alias("conv_id"),
            F.any_value("n").alias("depth"),
            F.any_value(F.col("r1").bitwiseXOR(F.col("x1"))).alias("p1"),
            F.any_value(F.col("r2").bitwiseXOR(F.col("x2"))).alias("p2"),
            F.count(F.lit(1)).alias("n_convs"),
            F.any_value("chars").alias("chars"),
        )
        zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
        root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
        root = root.withColumns({"k1": zero, "k2": zero, "depth": zero, "p1": none, "p2": none, "chars": F.lit(0)})
        nodes = held.stage(found.unionByName(root))
        children = nodes.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = held.stage(nodes.join(children, ["k1", "k2"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
        saved = (F.col("n_convs") - 1) * F.col("chars")
        edges = nodes.select("k1", "k2", "depth", F.col("p1").alias("u1"), F.col("p2").alias("u2"), (F.col("n_children") == 0).cast("long").alias("n_leaves"), saved.alias("saved_tokens"))
        sums = roll_up(held, edges, "n_leaves", "saved_tokens")
        parents = nodes.where("n_children > 0").select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), "n_children")
        last = prefixes.groupBy("conv_id").agg(F.max_by(F.struct("r1", "r2"), "n").alias("r"))
        at = convs.join(last, "conv_id", "left").select(F.coalesce("r.r1", zero).alias("k1"), F.coalesce("r.r2", zero).alias("k2"), "conv_id")
        placed = join_counted(nodes, parents.withColumnRenamed("n_children", "_below"), ["p1", "p2"], "_below")
        out = placed.join(sums, ["k1", "k2"]).join(ends(at), ["k1", "k2"], "left")
        no_ends = F.lit(hashlib.sha256(b"").hexdigest())
        return held.result(
            out.select(
                "k1", "k2", "p1", "p2", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                F.coalesce("ends_sha256", no_ends).alias("ends_sha256"),
            )
        )
