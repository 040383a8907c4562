"""Rows of vectors made ready: only valid ones, each length apart, equal vectors as one, numbers as numpy matrices in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_first, stage


def valid_vectors(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> list[DataFrame]:
    """vec_id and vec (array of double) of the rows with an id and a finite, non-zero vector: a table for each length of vectors.

    Only vectors of one length have a product. Repeated rows count once. The lengths, of which there are few, come to the driver.
    """
    named = only_first(rows, vec_id, embedding).toDF("vec_id", "vec").select("vec_id", F.col("vec").cast("array<double>").alias("vec"))
    limit = F.lit(float("inf"))
    fine = named.where(
        "vec_id is not null and size(vec) > 0"
    ).where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < limit)) & F.exists("vec", lambda v: v != 0))
    sizes = sorted(r.d for r in fine.select(F.size("vec").alias("d")).distinct().collect())
    return [fine.where(F.size("vec") == d).dropDuplicates(["vec_id", "vec"]) for d in sizes]


def distinct_vectors(valid: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Equal vectors once as (rep, vec, copies), and (vec_id, rep) of every valid row; rep is the least id.

    Copies are counted before rows meet, so a vector that a third of the rows share stays cheap. The key is two
    64-bit hashes of the vector.
    """
    keyed = stage(valid.select("vec_id", "vec", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), F.reverse("vec")).alias("h2")))
    groups = keyed.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    member = stage(keyed.select("vec_id", "h1", "h2").join(groups, ["h1", "h2"]).select("vec_id", "rep", "copies"))
    own = member.where("vec_id = rep").dropDuplicates(["rep"]).select("rep", "copies")
    reps = own.join(keyed.select(F.col("vec_id").alias("rep"), "vec"), "rep").dropDuplicates(["rep"])
    return stage(reps.select("rep", "vec", "copies")), member


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def sample_matrix(reps: DataFrame, most: int) -> np.ndarray:
    """At most ``most`` vectors, those of the least hashes, on the driver."""
    picked = reps.select("rep", "vec").orderBy(F.xxhash64("rep"), "rep").limit(most).toArrow()
    return matrix(picked.column("vec"))
