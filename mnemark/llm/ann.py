"""Nearest neighbours by a permutation index.

A vector is represented by its nearest pivots in order. In each block of the index the pivots have inverted files:
the vectors that hold the pivot among their nearest, with its place. A query's pivots are looked up in them; with
places weighted from the end of the list, the footrule distance of two lists is a constant less twice the sum of
the smaller weights over the pivots that they share, so the files give it for every vector that shares a pivot.
The best part of each block by footrule is then ranked anew by exact inner products.

Largest inner product becomes nearest angle by one more dimension, which brings all indexed vectors to one length.
Every row is indexed; queries meet the blocks in blocks of their own.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import only_first, stage
from .vectors import distinct_vectors, matrix, sample_matrix, valid_vectors

#: Pivots, pivots in a list, the part of a block that is ranked anew, and its least size.
PIVOTS, LISTED, ANEW, LEAST = 512, 96, 0.08, 400
#: Sampled vectors that pivots are chosen from, and the cosine from which two pivots are too much alike.
POOL, APART = 4096, 0.7
#: Vectors with this part of the greatest possible sum of shared weights are ranked anew too, however many there are.
ALIKE = 0.6
BLOCK, QUERIES = 16384, 2048


def choose_pivots(pool: np.ndarray, most: int) -> np.ndarray:
    """The first vectors of the pool that are not much alike, so that a crowd of near copies gives one pivot."""
    unit = pool / np.linalg.norm(pool, axis=1, keepdims=True)
    far = np.ones(len(pool), bool)
    chosen: list[int] = []
    while len(chosen) < most and far.any():
        chosen.append(int(np.argmax(far)))
        far &= unit @ unit[chosen[-1]] < APART
    return pool[chosen]


def lists(x: np.ndarray, pivots: np.ndarray, listed: int, longest: float) -> np.ndarray:
    """Each row's nearest pivots in order; ``longest`` 0 takes the rows for queries."""
    extra = np.sqrt(np.maximum(0.0, longest**2 - (x**2).sum(axis=1))) if longest else np.zeros(len(x))
    near = np.column_stack([x, extra]).astype(np.float32) @ pivots.T.astype(np.float32)
    return np.argsort(-near, axis=1, kind="stable")[:, :listed]


def search(key, table: pa.Table, pivots: np.ndarray, listed: int, longest: float, top: int) -> pa.Table:
    """The best ``top`` rows of one block for each query of one block, by exact inner product."""
    index = table.filter(pc.equal(table.column("asks"), False))
    asked = table.filter(pc.equal(table.column("asks"), True))
    x, q = matrix(index.column("vec")), matrix(asked.column("vec"))
    ids, who = index.column("rep").to_numpy(), asked.column("rep").to_numpy()
    order = np.argsort(ids, kind="stable")
    x, ids = x[order] if len(ids) else x, ids[order]
    n = len(ids)
    if not n or not len(who):
        return pa.table({"query": pa.array([], pa.int64()), "rep": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
    held = lists(x, pivots, listed, longest)
    by_pivot = np.argsort(held, axis=None, kind="stable")
    posted = (by_pivot // held.shape[1]).astype(np.int32)
    weight = (listed - by_pivot % held.shape[1]).astype(np.int32)
    starts = np.searchsorted(held.ravel()[by_pivot], np.arange(len(pivots) + 1))
    keep = min(n, max(LEAST, top, math.ceil(ANEW * n)))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for one, vec, mine in zip(who, q, lists(q, pivots, listed, 0.0), strict=True):
        shared = np.zeros(n, np.int32)
        for place, p in enumerate(mine):
            s, e = starts[p], starts[p + 1]
            shared[posted[s:e]] += np.minimum(weight[s:e], listed - place)
        near = np.argpartition(-shared, keep - 1)[:keep] if keep < n else np.arange(n)
        alike = np.flatnonzero(shared >= ALIKE * listed * (listed + 1) / 2)
        near = near if len(alike) < top else np.union1d(near, alike)
        exact = x[near] @ vec
        best = near[np.lexsort((ids[near], -exact))[:top]]
        found.append((np.full(len(best), one), ids[best], (x[best] * vec).sum(axis=1)))
    a, b, c = (np.concatenate(col) for col in zip(*found, strict=True))
    return pa.table({"query": a.astype(np.int64), "rep": b.astype(np.int64), "score": c})


def nearest(rows: DataFrame, every: int = 20, top: int = 20, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``top`` nearest found of each row whose id is divisible by ``every``.

    Vectors that are null, zero, or hold null or non-finite components take no part, and a query meets vectors of its
    own length; so an empty table, or a query alone, gives no rows. Equal vectors are searched once and listed each, smaller
    ids first; repeated rows of an id count once; other columns are ignored.
    """
    found = [_nearest(valid, every, top) for valid in valid_vectors(rows, vec_id, embedding)]
    schema = "query_id long, rank int, vec_id long, score double"
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], schema)


def _nearest(valid: DataFrame, every: int, top: int) -> DataFrame:
    """The same over valid vectors of one length."""
    reps, member = distinct_vectors(valid)
    queries = member.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("rep").alias("query"))
    asked = queries.select(F.col("query").alias("rep")).distinct().join(reps, "rep")
    count, asks = reps.count(), asked.count()
    if not count or not asks:
        return queries.select("query_id", F.lit(1).alias("rank"), F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, v: s + v * v))
    longest = float(reps.agg(F.max(length)).first()[0]) * (1 + 1e-9)
    chosen = choose_pivots(sample_matrix(reps, POOL), PIVOTS)
    pivots = np.column_stack([chosen, np.sqrt(np.maximum(0.0, longest**2 - (chosen**2).sum(axis=1)))])
    listed = min(LISTED, len(pivots))
    blocks, parts = math.ceil(count / BLOCK), math.ceil(asks / QUERIES)
    block = F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int")
    part = F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")
    index = reps.select(block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), F.lit(False).alias("asks"), "rep", "vec")
    probes = asked.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), part.alias("part"), F.lit(True).alias("asks"), "rep", "vec")
    hits = index.union(probes).groupBy("block", "part").applyInArrow(
        lambda key, t: search(key, t, pivots, listed, longest, top + 1), "query long, rep long, score double"
    )

    def first(df: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
        return df.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_at") <= n)

    best = stage(first(hits, ["query"], [F.desc("score"), F.col("rep")], top + 1).drop("_at"))
    # a query needs no more than its first ids of any vector; salting keeps a vector with many copies in many tasks
    salted = first(member.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(32))), ["rep", "_salt"], [F.col("vec_id")], top + 1)
    ids = first(salted.drop("_at", "_salt"), ["rep"], [F.col("vec_id")], top + 1).select("rep", "vec_id")
    listed_rows = best.join(ids, "rep").select("query", "vec_id", "score")
    short = first(listed_rows, ["query"], [F.desc("score"), F.col("vec_id")], top + 1).select("query", "vec_id", "score")
    each = queries.join(short, "query").where("vec_id <> query_id")
    return first(each, ["query_id"], [F.desc("score"), F.col("vec_id")], top).select("query_id", F.col("_at").cast("int").alias("rank"), "vec_id", "score")
