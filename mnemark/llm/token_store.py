"""Token ids in a content-addressed store.

A rolling hash over the ids of a document cuts them into chunks, so equal passages give equal chunks wherever they
stand. A store is a folder of three Parquet tables:

- ``chunks``: digest, n, payload. Each distinct chunk once; the payload is its ids as little-endian numbers of
  ``width`` bytes, compressed; the digest is BLAKE2b over the ids as little-endian 32-bit numbers.
- ``recipes``: in ascending doc_id order, start (ids of all documents before), n_tokens, the chunks' digests, and the
  Merkle root over these.
- ``manifest``: the Merkle tree over the recipes in that order, nodes of ``FAN`` children, up to one root. A leaf is
  the hash of a recipe's id, start, length and root.

Reading verifies every chunk against its digest, every recipe against its root and its length, and every node of the
manifest, built anew from the recipes read back, against the one that was written.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import drop_stage, only_first, stage, work_dir
from .encoding import ROWS, encoder, texts_of
from .sampling import batches

#: Chunk lengths in ids: least, most, and bits of the rolling hash that must be 0 at a cut.
LEAST, MOST, BITS = 128, 2048, 9
FAN = 1024


def rolling(ids: np.ndarray) -> np.ndarray:
    """A hash of the 32 ids up to each place, by doubling the window five times."""
    h = (ids.astype(np.uint32) + np.uint32(1)) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    for step in (1, 2, 4, 8, 16):
        h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    return h


def cuts(marks: np.ndarray, start: int, end: int) -> list[int]:
    """Ends of the chunks of ids ``start`` to ``end``, at marks where lengths allow."""
    out, at = [], start
    for m in marks[np.searchsorted(marks, start) : np.searchsorted(marks, end)].tolist():
        while m + 1 - at > MOST:
            at += MOST
            out.append(at)
        if m + 1 - at >= LEAST and m + 1 < end:
            at = m + 1
            out.append(at)
    while end - at > MOST:
        at += MOST
        out.append(at)
    return [*out, end]


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary tree over the digests; an odd last one rises as it is."""
    level = digests
    while len(level) > 1:
        level = [hashlib.sha256(b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else b""


def digest_of(ids: bytes) -> bytes:
    return hashlib.blake2b(ids, digest_size=16).digest()


@lru_cache(maxsize=4096)
def _shift(length: int) -> tuple[int, ...]:
    """What ``length`` zero bytes do to each bit of a crc32."""
    zeros = bytes(length)
    base = zlib.crc32(zeros)
    return tuple(zlib.crc32(zeros, 1 << bit) ^ base for bit in range(32))


def crc_joined(first: int, second: int, length: int) -> int:
    """crc32 of two strings joined, from their own and the second's length."""
    for bit, moved in enumerate(_shift(length)):
        if first >> bit & 1:
            second ^= moved
    return second


def _chunked(docs: DataFrame, path: str, end_id: int, width: int) -> DataFrame:
    schema = "row long, doc_id long, place int, n int, digest binary, payload binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, press = encoder(path), zstandard.ZstdCompressor(level=1, write_content_size=True, write_checksum=False)
        for batch in batches(it, ROWS):
            ids, offsets = tool.encode(texts_of(batch.column(2)))
            ids = np.insert(ids, offsets[1:], end_id)
            offsets = offsets + np.arange(len(offsets))
            marks = np.flatnonzero(rolling(ids) & np.uint32(((1 << BITS) - 1) << 16) == 0) if len(ids) else np.zeros(0, np.int64)
            raw, short = ids.astype("<u4").tobytes(), ids.astype(f"<u{width}").tobytes()
            out: list[tuple] = []
            for row, doc, s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                at = s
                for place, end in enumerate(cuts(marks, s, e)):
                    out.append((row, doc, place, end - at, digest_of(raw[4 * at : 4 * end]), press.compress(short[width * at : width * end])))
                    at = end
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["row", "doc_id", "place", "n", "digest", "payload"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)


def _ranked(recipes: DataFrame) -> DataFrame:
    """Adds start and rank in (doc_id, row) order: ranges of it are summed first, then run through each apart.

    Spark draws the ranges over both columns, so rows of one id, or without one, are dealt over several too.
    """
    dealt = stage(recipes.repartitionByRange(F.col("doc_id").asc_nulls_first(), "row").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("c"))
    offsets = sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    within = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("n1", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
        .withColumn("c1", F.count(F.lit(1)).over(within))
        .join(F.broadcast(offsets), "part")  # one row for each of Spark's shuffle partitions
        .select("doc_id", "row", (F.col("n0") + F.col("n1")).alias("start"), (F.col("c0") + F.col("c1")).alias("rank"), "n_tokens", "digests", "root")
    )


def _leaves(recipes: DataFrame) -> DataFrame:
    """Level 0 of the manifest: node and hash of every recipe."""
    said = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in ("doc_id", "start", "n_tokens")], F.hex("root"))
    return recipes.select(F.col("rank").alias("node"), F.unhex(F.sha2(said, 256)).alias("root"))


def _above(level: DataFrame) -> DataFrame:
    """The next level: each node is the hash of its children's, ``FAN`` at most, in order."""
    children = F.array_sort(F.collect_list(F.struct("node", "root")))
    joined = F.aggregate(children, F.lit(b""), lambda s, c: F.concat(s, c["root"]))
    return level.groupBy(F.floor(F.col("node") / FAN).alias("up")).agg(F.unhex(F.sha2(joined, 256)).alias("root")).select(F.col("up").alias("node"), "root")


def _levels(count: int) -> int:
    """Levels above the leaves of so many recipes."""
    height = 1
    while count > FAN:
        count, height = -(-count // FAN), height + 1
    return height


def _check_manifest(spark: SparkSession, where: str) -> None:
    """Builds every level anew from the recipes and compares it with the manifest as written; any difference raises."""
    recipes = spark.read.parquet(f"{where}/recipes")
    written = spark.read.parquet(f"{where}/manifest")
    facts = recipes.agg(F.count(F.lit(1)).alias("c"), F.max("rank").alias("last"), F.count_distinct("rank").alias("ranks")).first()
    tallest = written.agg(F.max("level")).first()[0] or 0
    fits = (facts.last is None or facts.last + 1 == facts.c) and facts.ranks == facts.c and tallest == (_levels(facts.c) if facts.c else 0)
    level = _leaves(recipes)
    for height in range(1, tallest + 1):
        level = stage(_above(level))
        mine = level.withColumnRenamed("root", "mine")
        told = written.where(F.col("level") == height).select("node", "root")
        fits = fits and told.join(mine, "node", "full").where(~F.col("root").eqNullSafe(F.col("mine"))).isEmpty()
    if not fits:
        raise ValueError("the recipes do not fit the manifest")


def write_store(docs: DataFrame, where: str, path: str, end_id: int = 2, width: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every row and write the store's three tables; a null text counts as empty.

    Every document ends with ``end_id``. Repeated rows and null ids (which come first) each have a recipe; an
    empty table gives empty tables; other columns are ignored.
    """
    spark = docs.sparkSession
    at = work_dir(spark)
    chunked = stage(_chunked(only_first(docs, doc_id, text).toDF("doc_id", "text"), path, end_id, width), at)
    chunked.select("digest", "n", "payload").dropDuplicates(["digest"]).write.mode("overwrite").option("compression", "none").parquet(f"{where}/chunks")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), lambda p: p["digest"])

    def rooted(it):
        for batch in it:
            roots = [merkle(d) for d in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(roots, pa.binary())], names=["doc_id", "row", "n_tokens", "digests", "root"])

    recipes = chunked.groupBy("row", "doc_id").agg(F.sum("n").alias("n_tokens"), listed.alias("digests")).select("doc_id", "row", "n_tokens", "digests")
    kept = stage(recipes.mapInArrow(rooted, "doc_id long, row long, n_tokens long, digests array<binary>, root binary"))
    drop_stage(spark, at)
    _ranked(kept).repartitionByRange("rank").sortWithinPartitions("rank").write.mode("overwrite").parquet(f"{where}/recipes")
    recipes = spark.read.parquet(f"{where}/recipes")
    level, count = _leaves(recipes), recipes.count()
    for height in range(1, _levels(count) + 1):
        _above(level).select(F.lit(height).alias("level"), "node", "root").write.mode("overwrite" if height == 1 else "append").parquet(f"{where}/manifest")
        level = spark.read.parquet(f"{where}/manifest").where(F.col("level") == height).select("node", "root")


def _chunk_facts(spark: SparkSession, where: str, width: int) -> DataFrame:
    """Of every stored chunk its digest, length and crc32, after its content is found to be what its digest says."""

    def run(it):
        press = zstandard.ZstdDecompressor()
        for batch in it:
            crcs = []
            for digest, n, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = np.frombuffer(press.decompress(payload), f"<u{width}").astype("<u4").tobytes()
                if digest_of(ids) != digest or len(ids) != 4 * n:
                    raise ValueError(f"chunk {digest.hex()} does not hold what its digest says")
                crcs.append(zlib.crc32(ids))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    return spark.read.parquet(f"{where}/chunks").select("digest", "n", "payload").mapInArrow(run, "digest binary, n int, crc long")


def verify_store(spark: SparkSession, where: str, width: int = 2) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files, once these fit the manifest.

    Chunks are read once each and checked; a document's crc32 is joined from its chunks', so ids need not meet in
    one place. A recipe whose root or length does not fit its chunks raises.
    """
    _check_manifest(spark, where)
    recipes = spark.read.parquet(f"{where}/recipes")
    parts = recipes.select("row", F.posexplode("digests").alias("place", "digest")).join(_chunk_facts(spark, where, width), "digest")
    listed = parts.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "n", "crc", "digest"))).alias("parts"))

    def run(it):
        for batch in it:
            crcs = []
            for doc, n, root, chunks in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4)), strict=True):
                if chunks is None or sum(c["n"] for c in chunks) != n or merkle([c["digest"] for c in chunks]) != root:
                    raise ValueError(f"the recipe of document {doc} does not fit its chunks")
                crc = chunks[0]["crc"]
                for c in chunks[1:]:
                    crc = crc_joined(crc, c["crc"], 4 * c["n"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    whole = recipes.join(listed, "row", "left").select("doc_id", "start", "n_tokens", "root", "parts")
    return whole.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_store(spark: SparkSession, where: str, width: int = 2) -> DataFrame:
    """doc_id and ids (array of int) of every document, put together from its chunks."""

    def unpack(it):
        press = zstandard.ZstdDecompressor()
        for batch in it:
            ids = [np.frombuffer(press.decompress(p), f"<u{width}").astype(np.int32) for p in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["digest", "ids"])

    chunks = spark.read.parquet(f"{where}/chunks").select("digest", "payload").mapInArrow(unpack, "digest binary, ids array<int>")
    recipes = spark.read.parquet(f"{where}/recipes").select("row", "doc_id", F.posexplode("digests").alias("place", "digest"))
    ordered = F.array_sort(F.collect_list(F.struct("place", "ids")))
    return recipes.join(chunks, "digest").groupBy("row", "doc_id").agg(F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids")).drop("row")
