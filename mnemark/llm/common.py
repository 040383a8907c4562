"""Helpers that the training-data operators share: staging, salted numbering, hashing."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; one is set only where the session has none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        base = tempfile.mkdtemp(prefix="mnemark-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(f"file://{base}")
    elif not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/mnemark-{uuid.uuid4().hex}"


#: Where this is set, Spark removes what a job has shuffled at the job's end, not when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, where: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that outlives executors.

    The written table takes the place of the shuffles that it was made by, so their files go at once.
    """
    spark = df.sparkSession
    where = where or work_dir(spark)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(where)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(where)


def drop_stage(spark: SparkSession, where: str) -> None:
    """Remove a staged table that no later plan reads."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Stages:
    """Staged tables that are removed once they have been read: by :meth:`drop`, the rest at the end of the block."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.held = spark, {}, []

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        for where in self.paths.values():
            drop_stage(self.spark, where)

    def stage(self, df: DataFrame) -> DataFrame:
        where = work_dir(self.spark)
        out = stage(df, where)
        self.paths[id(out)] = where
        self.held.append(out)  # so that no id is used twice
        return out

    def result(self, df: DataFrame) -> DataFrame:
        """``df`` staged where it outlasts the block, so that what it was made from may go."""
        return stage(df, work_dir(self.spark))

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            drop_stage(self.spark, self.paths.pop(id(df)))


def only_first(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone, so that clashing extra columns never meet the operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])


#: A key is hot beyond this share of all rows, so there are fewer hot keys than this.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, found: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Left join of ``rows`` with ``found`` (one row a key, no null keys), whose column ``count`` tells how many rows have the key.

    Hot keys, those of more than one in ``HOT_SHARE`` of all counted rows, are broadcast: there cannot be more than
    ``HOT_SHARE`` of them. The other rows are shuffled to theirs; those with a null key meet nothing and are not shuffled.
    The column ``count`` is not kept.
    """
    total = found.agg(F.sum(count)).first()[0] or 0
    hot = found.where(F.col(count) * HOT_SHARE > total).drop(count)
    rest = found.where(F.col(count) * HOT_SHARE <= total).drop(count)
    names = [c for c in hot.columns if c not in keys]
    keyed = " and ".join(f"{k} is not null" for k in keys)
    with_hot = rows.where(keyed).join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    is_hot = with_hot.where("_hot").drop("_hot")
    others = with_hot.where("_hot is null").drop("_hot", *names).join(rest, keys, "left")
    # rows without a key would all be dealt to one task
    return is_hot.unionByName(others).unionByName(rows.where(f"not ({keyed})"), allowMissingColumns=True)


def number_within(df: DataFrame, groups: list[str], order: list[Column], salt_of: list[Column], out: str, salts: int = 64) -> DataFrame:
    """Gapless numbers from 0 within each group, none of which is gathered in one task.

    A group is dealt over ``salts`` parts; each part numbers its own rows after the rows of the parts
    before it. The counts have one row for each group and part.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt_of), F.lit(salts)).cast("int"))
    counts = salted.groupBy(*groups, "_salt").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*groups).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*groups, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*groups, "_salt").orderBy(*order)
    numbered = salted.withColumn("_row", F.row_number().over(within))
    return (
        numbered.join(offsets, [*groups, "_salt"])
        .withColumn(out, (F.col("_before") + F.col("_row") - 1).cast("long"))
        .drop("_salt", "_before", "_row")
    )
