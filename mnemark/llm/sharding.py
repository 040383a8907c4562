"""Shards of near-equal bytes by histogram sort.

Rows are ordered by (hash of the text, hash of the row's number). Candidate boundaries of that key are probed: each
round counts, exactly and over all partitions, the bytes below every probe, and narrows each splitter's
interval until its bytes are within the tolerance of its share. Only then are rows exchanged, once.

Equal texts are neighbours in the key, so they stay in one shard, except where a group of copies is so large
that keeping it whole would miss the tolerance; such a group is cut between rows, by the second hash.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import number_within, only_first, stage

LOW, HIGH = -(1 << 63), (1 << 63) - 1


@dataclass
class Splitter:
    """One boundary under refinement: bytes below ``low`` and ``high`` are known."""

    target: int
    low: int
    high: int
    below_low: int
    below_high: int
    best: int = LOW
    off: int = 1 << 62

    def see(self, key: int, below: int) -> None:
        if abs(below - self.target) < self.off:
            self.best, self.off = key, abs(below - self.target)
        if below <= self.target and key > self.low:
            self.low, self.below_low = key, below
        elif below > self.target and key < self.high:
            self.high, self.below_high = key, below

    def probes(self, count: int) -> list[int]:
        width = self.high - self.low
        return sorted({self.low + width * i // (count + 1) for i in range(1, count + 1)} - {self.low, self.high})


def _bytes_below(keyed: DataFrame, key: str, probes: list[int]) -> dict[int, int]:
    """Exact bytes of the rows whose key is below each probe: one pass, one small row for each bin and task."""
    bin_of = F.size(F.filter(F.array(*[F.lit(p) for p in probes]), lambda p: p <= F.col(key)))
    rows = keyed.groupBy(bin_of.alias("bin")).agg(F.sum("size").alias("bytes")).collect()
    bins = {r["bin"]: r["bytes"] for r in rows}
    out, below = {}, 0
    for i, p in enumerate(probes):
        below += bins.get(i, 0)
        out[p] = below
    return out


def _refine(keyed: DataFrame, key: str, splitters: list[Splitter], slack: float, probes: int) -> None:
    while open_ := [s for s in splitters if s.off > slack and s.high - s.low > 1 and s.below_high > s.below_low]:
        points = sorted({p for s in open_ for p in s.probes(probes)})
        below = _bytes_below(keyed, key, points)
        for s in open_:
            for p in points:
                s.see(p, below[p])


def splitters_of(keyed: DataFrame, shards: int, tolerance: float = 0.01, probes: int = 16) -> list[tuple[int, int]]:
    """``shards - 1`` boundaries (text hash, row hash); a row is right of one if its key is not below it.

    ``tolerance``: bytes that a boundary may be off its share, as a part of a shard's share.
    """
    total = keyed.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    wanted = [Splitter(total * j // shards, LOW, HIGH, 0, total) for j in range(1, shards)]
    _refine(keyed, "text_key", wanted, slack, probes)
    found = []
    for s in wanted:
        boundary = (s.best, LOW)
        if s.off > slack and s.below_high > s.below_low:  # one text's copies lie across the boundary: cut between them
            rows = keyed.where(F.col("text_key") == s.low)
            inner = Splitter(s.target - s.below_low, LOW, HIGH, 0, s.below_high - s.below_low)
            _refine(rows, "row_key", [inner], slack, probes)
            if inner.off < s.off:
                boundary = (s.low, inner.best)
        found.append(boundary)
    return found


def shard_by_bytes(docs: DataFrame, shards: int = 8, tolerance: float = 0.01, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``.

    A null text counts as empty (size 1); a null doc_id is a row like others; repeated rows are each kept; an
    empty table gives no rows. Columns other than the two named are ignored, whatever their names.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = only_first(docs, doc_id, text).toDF("doc_id", "text")
    keyed = stage(
        rows.select(
            "doc_id",
            (F.octet_length(body) + 1).cast("long").alias("size"),
            F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
            F.xxhash64(body).alias("text_key"),
            F.monotonically_increasing_id().alias("row"),
        )
    ).withColumn("row_key", F.xxhash64("row"))  # of the staged number: rows alike in all columns are told apart, and stay so
    at_or_right: list[Column] = [
        ((F.col("text_key") > k) | ((F.col("text_key") == k) & (F.col("row_key") >= r))).cast("int")
        for k, r in splitters_of(keyed, shards, tolerance)
    ]
    placed = keyed.withColumn("shard", sum(at_or_right, F.lit(0)).cast("int"))
    slotted = number_within(placed, ["shard"], [F.col("text_key"), F.col("row_key")], [F.col("row_key")], "slot")
    return slotted.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
