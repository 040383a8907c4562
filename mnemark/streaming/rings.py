"""The newest records of each key as bounded state of a stream, and the same over a table.

A ring holds at most ``most`` records of a key, none older than ``age`` seconds before its newest. What it
holds does not depend on the order in which records come nor on how they are cut into batches, so a stream that was stopped and started again
ends where a table does. Each task first thins its own records to a ring's size, so a key with most of all records sends
few of them to the one task that keeps its ring.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..operators.ranking import newest
from ..operators.sessions import numbered

FIELDS = "key string, at timestamp, id long, value double"
RING = ["key", "at", "id", "value"]
#: Rows that a task gathers, beyond those that it keeps, before it thins them.
THIN = 50_000


def _rings(rows: pd.DataFrame, most: int, age: float | None) -> pd.DataFrame:
    """The newest rows of each key; rows alike count once, as a batch that is tried again may bring them twice."""
    rows = rows.drop_duplicates(["key", "at", "id"]).sort_values(["at", "id"], ascending=False)
    of_key = rows.groupby("key", sort=False)
    keep = of_key.cumcount() < most
    if age is not None:
        keep &= rows["at"] >= of_key["at"].transform("max") - pd.Timedelta(seconds=age)
    return rows[keep]


def ring_of_table(records: DataFrame, most: int, age: float | None = None) -> DataFrame:
    """``records`` (key, at, id, value) that the rings hold once all have come."""
    fine = records.where("key is not null and at is not null")
    kept = newest(fine, ["key"], [F.desc("at"), F.desc("id")], most)
    if age is None:
        return kept
    last = F.max("at").over(Window.partitionBy("key"))  # ``most`` rows of a key
    return kept.withColumn("_last", last).where(F.col("at") >= F.col("_last") - F.make_dt_interval(secs=F.lit(float(age)))).drop("_last")


def ring_of_stream(records: DataFrame, most: int, age: float | None = None, buckets: int = 512) -> DataFrame:
    """The rings of the keys that a batch touches, as rows (key, at, id, value); a later batch's ring takes an earlier one's place.

    The state holds the rings of a bucket of keys together, so that a batch calls Python once for each bucket and not for each key.
    """

    def thinned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, rows, held = [], 0, 0
        for b in batches:
            parts.append(b)
            rows += len(b)
            if rows > 2 * held + THIN:  # each time after as many new rows as were kept, so that a row is looked at a few times
                parts = [_rings(pd.concat(parts), most, age)]
                rows = held = len(parts[0])
        if rows:
            yield _rings(pd.concat(parts), most, age)

    def keep(bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts = [b[RING] for b in batches]  # thinned: at most ``most`` rows of a key and task
        touched = pd.concat([b["key"] for b in parts]).unique()
        if state.exists:
            keys, at, ids, values = state.get
            parts.append(pd.DataFrame({"key": keys, "at": pd.to_datetime(pd.Series(at, dtype="int64"), unit="us"), "id": ids, "value": values}))
        rings = _rings(pd.concat(parts), most, age)
        micros = rings["at"].astype("datetime64[us]").astype("int64")
        state.update((rings["key"].tolist(), micros.tolist(), rings["id"].tolist(), rings["value"].tolist()))
        yield rings[rings["key"].isin(touched)]

    fine = records.where("key is not null and at is not null").select(*RING)
    spread = fine.mapInPandas(thinned, FIELDS).withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    return spread.groupBy("bucket").applyInPandasWithState(
        keep, FIELDS, "key array<string>, at array<long>, id array<long>, value array<double>", "update", GroupStateTimeout.NoTimeout
    )


def run_rings(spark: SparkSession, stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """All that a stream of rings has to give just now: each batch is written under its number, and each key's last ring read back.

    A batch that is tried again writes its own folder anew; the offsets of ``checkpoint`` tell where a stopped run goes on.
    """

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={batch}")

    query = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    rows = spark.read.schema(f"{FIELDS}, batch long").option("basePath", out).parquet(out)
    last = rows.groupBy(F.col("key").alias("_key")).agg(F.max("batch").alias("_batch"))
    return rows.join(last, (F.col("key") == F.col("_key")) & (F.col("batch") == F.col("_batch"))).select("key", "at", "id", "value")


def _place(n: Column, p: float) -> Column:
    return F.floor((n - 1) * p).cast("int")


def ring_metrics(ring: DataFrame, target: float, least: int) -> DataFrame:
    """n, p50, p95, mean, largest and latest value of each key's ring, and whether the target is met; below ``least`` records it is warming."""
    values = F.array_sort(F.collect_list("value"))  # a ring's size
    told = ring.groupBy("key").agg(values.alias("v"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("value", F.struct("at", "id")).alias("latest"))
    n = F.size("v")
    p95 = F.get("v", _place(n, 0.95))
    return told.select(
        "key", n.cast("long").alias("n"), F.get("v", _place(n, 0.5)).alias("p50"), p95.alias("p95"), "mean", F.array_max("v").alias("most"), "latest",
        F.when(n < least, "warming").when(p95 <= target, "met").otherwise("missed").alias("target"),
    )


def ring_stats(records: DataFrame, most: int, age: float) -> DataFrame:
    """key, recorded, stored, evicted and expired: how each record of a ring left it, had they come in order of time.

    A record is evicted by the ``most``-th after it, unless it was too old by then; records too old at a later one's time
    are expired. Records are numbered over ranges of time, and each meets the one ``most`` places on by a join.
    """
    fine = records.where("key is not null and at is not null").withColumn("_t", F.unix_micros("at"))
    placed = numbered(fine.select("key", "_t", "id"), "key", "_t", width=86_400_000_000)
    later = placed.select("key", (F.col("position") - most).alias("position"), F.col("_t").alias("_then"))
    last = fine.groupBy("key").agg(F.max("_t").alias("_last"))
    span = int(age * 1_000_000)
    met = placed.join(later, ["key", "position"], "left").join(last, "key")
    evicted = F.coalesce(F.col("_then") - span <= F.col("_t"), F.lit(False))
    expired = ~evicted & (F.coalesce("_then", "_last") - span > F.col("_t"))
    return met.groupBy("key").agg(
        F.count(F.lit(1)).alias("recorded"), F.count_if(~evicted & ~expired).alias("stored"), F.count_if(evicted).alias("evicted"), F.count_if(expired).alias("expired")
    )
