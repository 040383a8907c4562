"""Centroid clustering by weighted deduplication: Lloyd's rounds run over distinct integer vectors and their counts.

Vectors become integers, equal ones are grouped with their multiplicity, and every round reads the distinct ones alone:
tasks assign a batch by numpy and hand on, for each centroid and component, the exact weighted sum of integers. The
assignments are then joined back to the ids; what a round brings to the driver is one row for each centroid and component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stages, join_counted, only_first

#: Integers of this size or more have squared distances that a 64-bit integer need not hold.
TOO_LARGE = 1 << 27
#: Below this size all products and sums of 64 components are exact in double precision.
EXACT = 1 << 21


def integer_vectors(rows: DataFrame, width: int, scale: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, q (array of int, floor(scale * x) of each component) and key (SHA-256 of q) of the rows that take part."""
    named = only_first(rows, vec_id, embedding).toDF("vec_id", "vec").where(F.size("vec") == width)
    vec = F.col("vec").cast("array<double>")
    whole = named.where(F.forall(vec, lambda x: F.coalesce(F.abs(F.floor(x * F.lit(float(scale)))) < F.lit(TOO_LARGE), F.lit(False)) & ~F.isnan(x)))
    q = whole.select("vec_id", F.transform(vec, lambda x: F.floor(x * F.lit(float(scale))).cast("int")).alias("q"))
    return q.withColumn("key", F.unhex(F.sha2(F.array_join(F.col("q").cast("array<string>"), ","), 256)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def nearest_centroids(q: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest centroid (the least of equally near ones) and the squared distance, exactly."""
    small = max(int(np.abs(q).max(initial=0)), int(np.abs(centroids).max(initial=0))) < EXACT
    a, c = (q.astype(np.float64), centroids.astype(np.float64)) if small else (q, centroids)
    squared = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None]  # wraps back into 64 bits where it wraps
    best = squared.argmin(axis=1)
    return best, squared[np.arange(len(q)), best].astype(np.int64)


def weighted_sums(q: np.ndarray, n: np.ndarray, best: np.ndarray, k: int) -> list[list[int]]:
    """Of each centroid, the exact sums of its rows' components, each row counted ``n`` times, as Python integers."""
    exact = int(np.abs(q).max(initial=0)) * int(n.sum(dtype=object) if len(n) else 0) < 1 << 62
    weighted = q * n[:, None] if exact else q.astype(object) * n.astype(object)[:, None]
    return [[int(x) for x in weighted[best == j].sum(axis=0)] if (best == j).any() else [0] * q.shape[1] for j in range(k)]


def _round(centroids: np.ndarray):
    """Partial sums of a task: (cluster, dim, total), with the number of rows as dimension -1."""
    k, width = centroids.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = [[0] * width for _ in range(k)], [0] * k
        for b in batches:
            if not b.num_rows:
                continue
            q, n = _matrix(b.column("q"), width), b.column("n").to_numpy()
            best, _ = nearest_centroids(q, centroids)
            for j, row in enumerate(weighted_sums(q, n, best, k)):
                sums[j] = [x + y for x, y in zip(sums[j], row, strict=True)]
                counts[j] += int(n[best == j].sum(dtype=object))
        cells = [(j, d, x) for j in range(k) if counts[j] for d, x in enumerate([counts[j], *sums[j]], -1)]
        columns = list(zip(*cells, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array([str(x) for x in columns[2]], pa.string())],
            names=["cluster", "dim", "total"],
        )

    return work


def lloyd_round(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """New centroids: exact floor of the weighted mean; a centroid without rows stays."""
    parts = distinct.select("q", "n").mapInArrow(_round(centroids), "cluster int, dim int, total string")
    cells = parts.groupBy("cluster", "dim").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    total = {(r.cluster, r.dim): int(r.total) for r in cells}
    out = centroids.copy()
    for j in range(len(out)):
        if (j, -1) in total:
            out[j] = [total[j, d] // total[j, -1] for d in range(out.shape[1])]
    return out


def _assign(centroids: np.ndarray):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, distance = nearest_centroids(_matrix(b.column("q"), centroids.shape[1]), centroids)
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("n"), pa.array(best, pa.int32()), pa.array(distance)], names=["key", "n", "cluster", "distance"])

    return work


def cluster(rows: DataFrame, clusters: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1:") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia) of every row that takes part, and the final centroids.

    Vectors that are null, of another length, hold null or non-finite components, or one whose integer is 2^27 or more
    in size (whose distances need not fit a long), take no part. Repeated rows and repeated or null ids are rows like
    others; a row without an id starts no centroid. Starts of equal hash (repeated ids) come in the order of their
    vectors, each a centroid of its own. With fewer rows than ``clusters`` there are as many centroids as rows with
    ids; with none of these, and for an empty table, no rows. Other columns are ignored. Sums of distances that no
    long holds are null.
    """
    with Stages(rows.sparkSession) as held:
        kept = held.stage(integer_vectors(rows, width, scale))
        starts = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("h"), "q")
        first = starts.orderBy("h", "q").limit(clusters).collect()
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long"
        if not first:
            return rows.sparkSession.createDataFrame([], schema), np.zeros((0, width), np.int64)
        distinct = held.stage(kept.groupBy("key").agg(F.any_value("q").alias("q"), F.count(F.lit(1)).alias("n")))
        centroids = np.array([r.q for r in first], np.int64)
        for _ in range(rounds):
            centroids = lloyd_round(distinct, centroids)
        assigned = held.stage(distinct.select("key", "q", "n").mapInArrow(_assign(centroids), "key binary, n long, cluster int, distance long"))
        inertia = F.sum(F.col("distance").cast("decimal(38,0)") * F.col("n"))
        sums = {r.cluster: int(r.s) for r in assigned.groupBy("cluster").agg(inertia.alias("s")).collect()}

        def told(total: int) -> Column:
            return F.lit(total if total < 1 << 63 else None).cast("long")

        of_cluster = F.coalesce(*[F.when(F.col("cluster") == j, told(s)) for j, s in sums.items()])
        joined = join_counted(kept.select("vec_id", "key"), assigned, ["key"], "n")
        out = held.result(joined.select("vec_id", "cluster", "distance", of_cluster.alias("cluster_inertia"), told(sum(sums.values())).alias("inertia")))
    return out, centroids
