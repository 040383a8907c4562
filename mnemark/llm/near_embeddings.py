"""Embedding near-duplicates by PCA-ordered tiled comparison.

Unit vectors are turned so that leading dimensions carry most. A k-d tree over those cuts the rows into tiles, and
pairs of tiles whose boxes lie too far apart are never formed. Within a pair of tiles, products of the leading
dimensions come first; what the rest can add is bounded by the suffix norms, and a comparison ends as soon as the
cosine cannot reach the threshold. What is left is computed in double precision from the vectors as given.

No pairs leave a task: each tells, for every row, how many rows it links with and the least row of its part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_first, stage
from .components import connected_components
from .vectors import distinct_vectors, matrix, sample_matrix, valid_vectors

#: Vectors sampled to find the directions and the tree; results do not depend on the sample.
SAMPLE = 8192
LEAD, BOX, DEPTH = 16, 8, 9
#: Rows of a tile or block: each row is sent to about as many tasks as there are blocks, so fewer, larger ones send less.
TILE = 6144
#: Rows of a block compared at once with the other block, which bounds what a task holds: STRIP x TILE products.
STRIP = 512
CHUNK = 1 << 15


def directions(sample: np.ndarray) -> np.ndarray:
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    return np.linalg.eigh(unit.T @ unit)[1][:, ::-1].copy()


def grow_tree(lead: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """A complete k-d tree in heap order: (dimension, cut) of each inner node."""
    nodes: list[tuple[int, float]] = []
    level = [lead]
    for _ in range(depth):
        below = []
        for rows in level:
            dim = int(np.argmax(rows.var(axis=0))) if len(rows) else 0
            cut = float(np.median(rows[:, dim])) if len(rows) else 0.0
            nodes.append((dim, cut))
            below += [rows[rows[:, dim] < cut], rows[rows[:, dim] >= cut]]
        level = below
    return nodes


def leaf_of(lead: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(lead), np.int64)
    if nodes:
        dims, cuts = np.array([d for d, _ in nodes]), np.array([c for _, c in nodes])
        for _ in range(int(math.log2(len(nodes) + 1))):
            at = 2 * at + 1 + (lead[np.arange(len(lead)), dims[at]] >= cuts[at])
    return at - len(nodes)


def links(a: np.ndarray, b: np.ndarray, turn: np.ndarray, least: float, upper: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of rows of ``a`` and ``b`` whose cosine is ``least`` or more, strip by strip of ``a``; with ``upper`` only i < j."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    ya, yb = (a / na[:, None]) @ turn, (b / nb[:, None]) @ turn
    lead = min(LEAD, ya.shape[1])
    mid = min(2 * lead, ya.shape[1])

    def rest(y: np.ndarray, k: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 1.0 - (y[:, :k] ** 2).sum(axis=1)))

    # the suffix norms ride along as one more dimension: one product gives the bound
    fronts = [np.column_stack([y[:, :lead], rest(y, lead)]).astype(np.float32) for y in (ya, yb)]
    ra, rb = rest(ya, mid), rest(yb, mid)
    for start in range(0, len(a), STRIP):
        i, j = np.nonzero(fronts[0][start : start + STRIP] @ fronts[1].T >= np.float32(least - 1e-4))
        i += start
        if upper:
            i, j = i[i < j], j[i < j]
        keep_i, keep_j = [i[:0]], [j[:0]]
        for s in range(0, len(i), CHUNK):
            x, y = i[s : s + CHUNK], j[s : s + CHUNK]
            part = np.einsum("ij,ij->i", ya[x, :mid], yb[y, :mid]) + ra[x] * rb[y] >= least - 1e-9
            x, y = x[part], y[part]
            cosine = (a[x] * b[y]).sum(axis=1) / (na[x] * nb[y])
            keep_i.append(x[cosine >= least])
            keep_j.append(y[cosine >= least])
        yield np.concatenate(keep_i), np.concatenate(keep_j)


def least_linked(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least id reachable over the pairs."""
    low = ids.copy()
    if not len(i):
        return low
    ends, others = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.argsort(ends, kind="stable")
    ends, others = ends[order], others[order]
    first = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
    nodes = ends[first]
    while True:
        new = np.minimum(low[nodes], np.minimum.reduceat(low[others], first))
        if (new == low[nodes]).all():
            return low
        low[nodes] = new


def compare(key, table: pa.Table, turn: np.ndarray, least: float) -> pa.Table:
    """One pair of tiles: (a: row, b: the least row of its part here, n: rows it links with, copies counted)."""
    left = table.filter(pa.compute.equal(table.column("side"), 0))
    right = table.filter(pa.compute.equal(table.column("side"), 1))
    left_tile, lb, right_tile, rb = (k.as_py() for k in key)
    same = (left_tile, lb) == (right_tile, rb)
    ids = [t.column("rep").to_numpy() for t in (left, right)]
    copies = [t.column("copies").to_numpy() for t in (left, right)]
    a = matrix(left.column("vec"))
    if same:
        b, every, weight, shift = a, ids[0], copies[0], 0
    else:
        b, every, weight, shift = matrix(right.column("vec")), np.concatenate(ids), np.concatenate(copies), len(ids[0])
    n, root = np.zeros(len(every)), np.arange(len(every))
    for i, j in links(a, b, turn, least, same) if len(a) and len(b) else ():
        if len(i):
            j = j + shift
            n += np.bincount(i, weight[j], len(every)) + np.bincount(j, weight[i], len(every))
            before = np.flatnonzero(root != np.arange(len(every)))  # what earlier strips joined stands for their pairs
            root = least_linked(len(every), np.concatenate([i, before]), np.concatenate([j, root[before]]), np.arange(len(every)))
    seen = np.flatnonzero(n)
    low = np.full(len(every), np.iinfo(np.int64).max)
    np.minimum.at(low, root, every)
    low = low[root]
    return pa.table({"a": every[seen].astype(np.int64), "b": low[seen].astype(np.int64), "n": n[seen].astype(np.int64)})


def near_embeddings(rows: DataFrame, least: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``rows``.

    Vectors that are null, zero, or hold null or non-finite components, and rows without an id, link with nothing;
    vectors of different lengths do not link. Repeated rows of an id count as one vector. An empty table gives no rows;
    other columns are ignored.
    """
    out = only_first(rows, vec_id).toDF("vec_id")
    joined = [_linked(valid, least) for valid in valid_vectors(rows, vec_id, embedding)]
    if not joined:
        return out.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    each = reduce(DataFrame.unionByName, joined).groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id"))
    whole = out.join(each, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return whole.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _linked(valid: DataFrame, least: float) -> DataFrame:
    """vec_id, n_links and component_id of valid vectors of one length."""
    spark = valid.sparkSession
    reps, member = distinct_vectors(valid)
    count = reps.count()
    sample = sample_matrix(reps, SAMPLE)
    turn = directions(sample)
    box = min(BOX, sample.shape[1])
    depth = max(0, min(DEPTH, math.ceil(math.log2(count / TILE))))
    tree = grow_tree((sample / np.linalg.norm(sample, axis=1, keepdims=True)) @ turn[:, :box], depth)

    def place(it):
        for batch in it:
            x = matrix(batch.column(1))
            lead = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ turn[:, :box] if batch.num_rows else np.zeros((0, box))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(leaf_of(lead, tree), pa.int32()), pa.array(list(lead), pa.list_(pa.float64()))],
                names=["rep", "vec", "copies", "tile", "lead"],
            )

    placed = stage(reps.mapInArrow(place, "rep long, vec array<double>, copies long, tile int, lead array<double>"))
    ends = [f(F.col("lead")[k]).alias(f"{n}{k}") for k in range(box) for n, f in (("lo", F.min), ("hi", F.max))]
    tiles = sorted(placed.groupBy("tile").agg(F.count(F.lit(1)).alias("n"), *ends).collect())  # at most 2^DEPTH rows
    blocks = {t["tile"]: max(1, math.ceil(t["n"] / TILE)) for t in tiles}
    reach = 2 - 2 * least + 1e-9

    def near(s, t) -> bool:
        gaps = (max(0.0, s[f"lo{k}"] - t[f"hi{k}"], t[f"lo{k}"] - s[f"hi{k}"]) for k in range(box))
        return sum(g * g for g in gaps) <= reach

    pairs = [(s["tile"], t["tile"], blocks[s["tile"]], blocks[t["tile"]]) for s in tiles for t in tiles if s["tile"] <= t["tile"] and near(s, t)]
    partners = F.broadcast(spark.createDataFrame(pairs, "left int, right int, left_blocks int, right_blocks int"))  # at most 2^(2 DEPTH) small rows
    block = F.pmod(F.xxhash64("rep"), F.col("own")).cast("int")
    row = ["rep", "copies", "vec"]
    lefts = (
        placed.join(partners, F.col("tile") == F.col("left"))
        .withColumn("own", F.col("left_blocks"))
        .withColumn("lb", block)
        .withColumn("rb", F.explode(F.when(F.col("left") == F.col("right"), F.expr("sequence(lb, left_blocks - 1)")).otherwise(F.expr("sequence(0, right_blocks - 1)"))))
        .select("left", "lb", "right", "rb", F.lit(0).alias("side"), *row)
    )
    rights = (
        placed.join(partners, F.col("tile") == F.col("right"))
        .withColumn("own", F.col("right_blocks"))
        .withColumn("rb", block)
        .withColumn("lb", F.explode(F.when(F.col("left") == F.col("right"), F.expr("sequence(0, rb)")).otherwise(F.expr("sequence(0, left_blocks - 1)"))))
        .where("left <> right or lb <> rb")
        .select("left", "lb", "right", "rb", F.lit(1).alias("side"), *row)
    )
    dealt = lefts.union(rights).groupBy("left", "lb", "right", "rb")
    found = stage(dealt.applyInArrow(lambda key, t: compare(key, t, turn, least), "a long, b long, n long"))
    parts = connected_components(found.select("a", "b"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    told = member.join(counts, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    return told.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
