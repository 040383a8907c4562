"""Documents made into training sequences: toxic ones go, then those of no language, then near copies; the rest is packed.

Each stage works on what the one before kept, and writes it to the shared folder. Texts are read whole and kept as they
are; null texts go with the language stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from mnemark.llm import langid, toxicity
from mnemark.llm.common import stage, table
from mnemark.llm.near_text import one_of_each_group
from mnemark.llm.packing import pack


#: Rows that Spark hands to Python at a time: rows hold whole texts, and Spark's own 10,000 of them would fill tens of MB in each task.
ROWS_AT_A_TIME = 1000


def hand_over_few(spark: SparkSession) -> None:
    """Bound Arrow's batches for this session, unless it has a smaller bound already."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if not 0 < now <= ROWS_AT_A_TIME:
        spark.conf.set(name, str(ROWS_AT_A_TIME))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on the labelled ones among ``docs``; those that score ``toxicity.THRESHOLD`` or more go.

    Null and empty texts stay unless the curve's value at 0 is that high; repeated rows are judged alike, ties at the
    threshold go, other columns, whatever their names, are kept, and an empty table gives an empty one.
    """
    hand_over_few(spark)
    return toxicity.keep_ordinary(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fit on ``docs`` themselves; those that show no language go, null and empty texts among them.

    Repeated rows are judged alike, other columns, whatever their names, are kept, and an empty table gives an empty one.
    """
    hand_over_few(spark)
    return langid.keep_identified(docs, langid.learn(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones stays, the one of the least id; of several rows of that id any one.

    Null, empty and wordless texts link with nothing and stay; other columns, whatever their names, are kept, and an
    empty table gives an empty one.
    """
    hand_over_few(spark)
    return one_of_each_group(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 2048 tokens at most.

    Null and empty texts are their end id alone; rows alike in id and text are packed each; other columns are left out,
    and an empty table gives no pieces.
    """
    hand_over_few(spark)
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


STAGES = [
    ("toxicity", drop_toxic),
    ("language_id", drop_unidentified),
    ("jaccard_join", drop_near_copies),
    ("best_fit_packing", pack_sequences),
]

#: Models fitted in the first two stages are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, work in STAGES:
        docs = stage(work(spark, docs, sf_dir))
    return docs
