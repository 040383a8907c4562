"""Views of the driver's tables as the tables of the memory model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = ("user_preference", "rejected_approach", "interaction_style", "assistant_goal", "recurring_mistake", "open_loop", "blocker", "commitment", "directive", "fact")
SCOPES = ("global", "transferable", "repo")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    quality = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    return table(spark, sf_dir, "documents").join(quality, "doc_id", "left").select(
        d.alias("id"),
        F.col("text").alias("content"),
        F.when(d % 5 != 0, F.col("source")).alias("repository"),
        F.array(*map(F.lit, TYPES))[(d % 10).cast("int")].alias("type"),
        F.array(*map(F.lit, SCOPES))[(d % 3).cast("int")].alias("scope"),
        (F.coalesce("quality", F.lit(0)) * 4 + d % 4).cast("long").alias("confidence"),
        F.col("lang").alias("tags"),
        F.when(d % 7 == 0, d).alias("superseded_by"),
        (d % 5 + 1).alias("reinforcement"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast(doc_id as int), 0)").alias("updated_at"),
    )


def episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("session_id"),
        F.col("text").alias("summary"),
        (d % 10).alias("significance"),
        F.when(d % 5 != 0, F.col("source")).alias("repository"),
        F.array(*map(F.lit, SCOPES))[(d % 3).cast("int")].alias("scope"),
        F.date_add(F.lit("2024-01-01").cast("date"), (d % 30).cast("int")).alias("date_key"),
        d.alias("updated"),
    )


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "pending").otherwise("running")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("session_id"),
        F.col("o_custkey").alias("repository"),
        F.when(F.col("o_orderkey") % 11 == 0, "failed").otherwise(status).alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        F.col("o_orderdate").alias("available_at"),
    )


def backfill_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = F.col("l_returnflag")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.when(f == "A", "completed").when(f == "R", "failed").otherwise("pending").alias("status"),
        F.when(F.col("l_linestatus") == "O", "create").otherwise("refresh").alias("planned"),
        F.col("l_shipdate").alias("updated_at"),
    )


def trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("hook"), F.col("user_id").alias("repository"),
        F.col("value").alias("latency_ms"), F.col("ts").alias("recorded_at"), F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


def outlined(text):
    """Prose as an outline: clauses become headings and indented lines, sentences items of a list."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\. ", ".\n  - "), ", ", ":\n    ")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    ids = table(spark, sf_dir, "conversations").where("conv_id is not null").select("conv_id").distinct()
    return ids.select(
        c.alias("session_id"),
        F.when(c % 3 != 0, F.concat(F.lit("org/repo-"), (c % 7).cast("string"))).alias("repository"),
        F.when(c % 2 == 0, F.concat(F.lit("/home/u"), (c % 4).cast("string"))).alias("cwd"),
        F.when(c % 5 < 2, F.lit("main")).alias("branch"),
        F.when(c % 4 == 0, F.concat(F.lit("Session "), F.lpad(c.cast("string"), 8, "0"))).when(c % 4 == 1, F.concat(F.lit("please review change "), c.cast("string"))).alias("summary"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, cast(conv_id % 700 as int), 0, 0)").alias("updated_at"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents in a row are the checkpoints of one session."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    full = outlined(text)
    title = F.when(d % 4 == 0, F.lit("Session 0a1b2c3d")).when(d % 4 == 2, F.concat(F.lit("Planning: "), F.substring(text, 1, 60)))
    return table(spark, sf_dir, "documents").where("doc_id is not null").select(
        F.floor(d / 10).alias("session_id"), (d % 10).alias("checkpoint_number"), title.alias("title"),
        F.when(d % 7 < 3, text).alias("overview"), F.when(d % 3 == 0, full).alias("history"), F.when(d % 5 != 2, full).alias("work_done"),
        F.when(d % 2 == 1, F.concat(F.lit("Prompt scope audit:\n  1. error in "), full)).alias("technical_details"),
        F.when(d % 3 != 1, F.concat(F.lit("- build failed: "), full)).alias("next_steps"),
    )


def session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages are the files of the sessions, four a session, with their paths from the site on."""
    return table(spark, sf_dir, "pages").where("page_id is not null").select(
        F.floor(F.col("page_id") / 4).alias("session_id"), F.regexp_replace("url", "^[a-z]+://", "").alias("file_path"), (F.col("page_id") % 97).alias("first_seen_at")
    )


def session_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (e % 211).alias("session_id"), F.col("event_type").alias("ref_type"), F.col("user_id").cast("string").alias("ref_value"), F.col("ts").alias("created_at")
    )


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns and documents as entries of the raw log; documents are checkpoints' overviews, pages' addresses other entries."""
    talk = table(spark, sf_dir, "conversations").where("conv_id is not null").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("entry_id"), F.col("conv_id").alias("session_id"), F.col("text").alias("content"), F.lit("turn").alias("source_type")
    )
    docs = table(spark, sf_dir, "documents").select(
        (-1 - 2 * F.col("doc_id")).alias("entry_id"), F.floor(F.col("doc_id") / 10).alias("session_id"), F.col("text").alias("content"), F.lit("checkpoint_overview").alias("source_type")
    )
    pages = table(spark, sf_dir, "pages").select(
        (-2 - 2 * F.col("page_id")).alias("entry_id"), F.floor(F.col("page_id") / 4).alias("session_id"), F.col("url").alias("content"), F.lit("file").alias("source_type")
    )
    return talk.unionByName(docs).unionByName(pages)


def raw_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that users said, and all items of the benchmark, as questions to the raw log."""
    said = table(spark, sf_dir, "conversations").where("role = 'user' and conv_id is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    return said.unionByName(table(spark, sf_dir, "benchmark").select((-1 - F.col("item_id")).alias("query_id"), "text"))


def told_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Episodes of which two thirds have summaries that say nothing, or nearly."""
    said = ("Session 0a1b2c3d", "Worked in src  (0a1b2c3d-99)", " ", "Call the tool now", "Using only local repo files: x", "Worked in src")
    place = (F.col("session_id") % 9).cast("int")
    return episode(spark, sf_dir).withColumn("summary", F.when(place < len(said), F.get(F.array(*map(F.lit, said)), place)).otherwise(F.col("summary")))


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, none = F.col("o_orderkey"), F.lit(None).cast("timestamp")
    status = F.when(k % 11 == 0, "failed").when(F.col("o_orderstatus") == "F", "completed").when(k % 3 == 0, "pending").otherwise("running")
    return table(spark, sf_dir, "orders").where("o_orderstatus <> 'P'").select(
        k.alias("session_id"), F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("repository"), status.alias("status"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").cast("timestamp").alias("queued_at"),
        F.col("o_orderdate").cast("timestamp").alias("available_at"), F.lit(1).cast("long").alias("attempts"), none.alias("started_at"), none.alias("completed_at"), F.lit("old").alias("last_error"),
    )


def line_place():
    """The place of a line among those of one day."""
    return F.expr("l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey")


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag, n, s = F.col("l_returnflag"), F.col("l_quantity").cast("int"), F.col("l_suppkey") % 5
    event = F.when(flag == "A", "completed").when((flag == "R") & (F.col("l_quantity") > 25), "failed").when((F.col("l_partkey") + F.col("l_linenumber")) % 2 == 0, "started").otherwise("enqueued")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("session_id"), event.alias("event"), F.col("l_shipdate").cast("timestamp").alias("at"), line_place().alias("seq"),
        F.when(s > 0, F.concat(F.lit("n"), s.cast("string"))).alias("repository"), (n % 9).alias("priority"), F.col("l_linestatus").alias("reason"), n.alias("delay_minutes"),
        F.concat(F.lit("e"), (F.col("l_partkey") % 7).cast("string")).alias("error"),
    )


def backfill(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Runs, their items, updates of the items, and refreshes: a customer is a run, its orders the items, their lines the updates."""
    orders, k, c = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("c_custkey")
    runs = table(spark, sf_dir, "customer").select(c.alias("run_id"), F.lit("running").alias("status"), (c % 30).cast("long").alias("total"), F.lit(10).cast("long").alias("batch"), F.when(c % 2 == 0, "before").alias("last_error"))
    items = orders.select(F.col("o_custkey").alias("run_id"), k.alias("session_id"), F.when(k % 3 == 0, "create").otherwise("refresh").alias("planned"))
    flag = F.col("l_returnflag")
    status = (
        F.when(flag == "A", "completed").when((flag == "R") & (F.col("l_quantity") > 40), "failed").when(flag == "R", "completed")
        .when((F.col("l_linestatus") == "F") | (F.col("l_linenumber") > 1), "skipped").otherwise("pending")
    )
    lines = table(spark, sf_dir, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    updates = lines.select(
        F.col("o_custkey").alias("run_id"), F.col("l_orderkey").alias("session_id"), status.alias("status"), F.col("l_shipdate").cast("timestamp").alias("at"),
        line_place().alias("seq"), F.concat(F.lit("e"), (F.col("l_partkey") % 7).cast("string")).alias("error"),
    )
    refreshes = orders.select(F.col("o_custkey").alias("run_id"), (F.col("o_orderdate").cast("timestamp") + F.expr("interval 60 days")).alias("at"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("x"), "o_orderpriority")).alias("error"))
    return runs, items, updates, refreshes
