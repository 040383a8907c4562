"""The registered queries of the training-data operators."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, toxicity
from .ann import nearest
from .bpe import encode_digests
from .centroids import cluster
from .common import table, work_dir
from .license_scan import license_digest, scan_licenses
from .near_embeddings import near_embeddings
from .near_text import near_texts
from .oracles import TRIE_SQL, WINDOW_SQL, centroid_sql
from .packing import pack
from .sampling import fold_of
from .sharding import shard_by_bytes
from .token_store import verify_store, write_store
from .trie import prefix_trie
from .winnow import decontaminate


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    where = work_dir(spark)
    write_store(table(spark, sf_dir, "documents"), where, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return verify_store(spark, where)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=20, top=20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score_toxicity(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        (fold_of("doc_id", 4) == 2).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"), least=0.9)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_texts(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    said = langid.identify(docs, langid.learn(docs))
    return said.select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(table(spark, sf_dir, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    names = F.array(*[F.lit(d) for d in digests]).cast("array<string>")
    return rows.withColumn("centroid_sha256", F.get(names, F.col("cluster")))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations")).drop("k1", "k2", "p1", "p2")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scans": op1_license_scans,
        "op2_token_store": op2_token_store,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_nearest_neighbours": op4_nearest_neighbours,
        "op5_bpe": op5_bpe,
        "op6_sharding": op6_sharding,
        "op7_toxicity": op7_toxicity,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_jaccard_join": op9_jaccard_join,
        "op10_language_id": op10_language_id,
        "op11_centroid_clustering": op11_centroid_clustering,
        "op12_decontamination": op12_decontamination,
        "op13_conversation_trie": op13_conversation_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op11_centroid_clustering": centroid_sql(), "op12_decontamination": WINDOW_SQL, "op13_conversation_trie": TRIE_SQL}
