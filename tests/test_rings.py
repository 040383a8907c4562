"""Rings of streams against rings of tables and a reader, over stops, repeats and late records."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from mnemark.streaming import rings

T0 = dt.datetime(2024, 1, 1)
AGE = 4 * 3600.0


def rows(seed=1, n=400):
    rnd = random.Random(seed)
    hot = ["a"] * 6 + ["b", "c", None]
    return [(rnd.choice(hot), T0 + dt.timedelta(minutes=rnd.randrange(5000)) if rnd.random() > 0.01 else None, k, rnd.random()) for k in range(n)]


def reader(records, most, age):
    out = []
    for key in {r[0] for r in records if r[0] is not None}:
        mine = sorted(((r[1], r[2], r[3]) for r in records if r[0] == key and r[1] is not None), reverse=True)
        out += [(key, *r) for r in mine if age is None or r[0] >= mine[0][0] - dt.timedelta(seconds=age)][:most]
    return sorted(out)


@pytest.mark.parametrize(("most", "age"), [(7, None), (7, AGE), (1, AGE), (1000, None)])
def test_rings_of_tables(spark, most, age):
    records = rows()
    assert sorted(map(tuple, rings.ring_of_table(spark.createDataFrame(records, rings.FIELDS), most, age).collect())) == reader(records, most, age)


@pytest.mark.parametrize("age", [None, AGE])
def test_a_stream_that_is_stopped_ends_where_a_table_does(spark, tmp_path, monkeypatch, age):
    records = rows(2)
    where = str(tmp_path)

    def add(part, name):
        spark.createDataFrame(part, rings.FIELDS).repartition(2).write.parquet(f"{where}/in/{name}")

    def run(fail=False):
        stream = spark.readStream.schema(rings.FIELDS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{where}/in")
        ring = rings.ring_of_stream(stream, 7, age)
        if not fail:
            return rings.run_rings(spark, ring, f"{where}/out", f"{where}/state")

        def dies(batch_rows, batch):
            batch_rows.write.mode("overwrite").parquet(f"{where}/out/batch={batch}")
            if batch == 1:
                raise RuntimeError("lost")  # after its folder is written, before its offsets are

        with pytest.raises(Exception, match="lost"):
            ring.writeStream.outputMode("update").foreachBatch(dies).option("checkpointLocation", f"{where}/state").trigger(availableNow=True).start().awaitTermination()
        return None

    add(records[200:], "late")
    run(fail=True)
    got = run()
    assert sorted(map(tuple, got.collect())) == reader(records[200:], 7, age)
    add(records[:200], "more")
    assert sorted(map(tuple, run().collect())) == reader(records, 7, age)
    assert sorted(map(tuple, run().collect())) == reader(records, 7, age)  # nothing new


def test_a_stream_of_many_keys_takes_seconds(spark, tmp_path):
    where, keys, n = str(tmp_path), 60_000, 180_000
    i = F.col("id")
    spark.range(n).select((i % keys).cast("string").alias("key"), F.timestamp_seconds(i).alias("at"), "id", F.lit(0.5).alias("value")).repartition(4, "id").write.parquet(f"{where}/in")
    stream = spark.readStream.schema(rings.FIELDS).option("maxFilesPerTrigger", 2).parquet(f"{where}/in")
    began = time.perf_counter()
    got = rings.run_rings(spark, rings.ring_of_stream(stream, 2), f"{where}/out", f"{where}/state")
    assert got.select(F.count("key"), F.min("id"), F.sum("id")).first() == (2 * keys, keys, sum(range(keys, n)))
    assert time.perf_counter() - began < 60


def test_stats_equal_a_reader(spark):
    records = rows(3)
    want = {}
    for key in ("a", "b", "c"):
        held, stored, evicted, expired = [], 0, 0, 0
        for at in sorted(r[1] for r in records if r[0] == key and r[1] is not None):
            while held and held[0] < at - dt.timedelta(seconds=AGE):
                held.pop(0)
                expired += 1
            held.append(at)
            stored += 1
            if len(held) > 7:
                held.pop(0)
                evicted += 1
        want[key] = (stored, len(held), evicted, expired)
    got = {r.key: tuple(r)[1:] for r in rings.ring_stats(spark.createDataFrame(records, rings.FIELDS), 7, AGE).collect()}
    assert got == want
    assert rings.ring_stats(spark.createDataFrame([], rings.FIELDS), 7, AGE).count() == 0


def test_metrics_of_a_ring(spark):
    ring = spark.createDataFrame([("a", T0 + dt.timedelta(minutes=k), k, float(v)) for k, v in enumerate((5, 1, 3, 2))] + [("b", T0, 1, 9.0)], rings.FIELDS)
    got = {r.key: tuple(r)[1:] for r in rings.ring_metrics(ring, 3.0, 2).collect()}
    assert got == {"a": (4, 2.0, 3.0, 2.75, 5.0, 2.0, "met"), "b": (1, 9.0, 9.0, 9.0, 9.0, 9.0, "warming")}
