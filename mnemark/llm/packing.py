"""Best-fit packing planned over a histogram of lengths.

The plan looks at counts of lengths alone, of which there are at most as many as a sequence has tokens. Best-fit
decreasing runs over groups of alike sequences, and leaves slots: for a length, which ranks go to which sequences at
which offset. Documents then take their slots by joining on rank within length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import number_within, only_first, stage
from .encoding import ROWS, encoder, portions, texts_of


#: Bytes, about, that a worker remembers of plain pieces and whole fragments, and of the pieces of fragments that are not plain.
KEPT = (32 << 20, 4 << 20)
#: Texts and their bytes at most that are encoded at once, which lists equal pieces once; their pieces with ids are held besides.
AT_ONCE = (2 * ROWS, 4 << 20)


@dataclass(frozen=True)
class Slot:
    """Ranks ``first`` to ``last`` (exclusive) of a length: ``per`` in each sequence from ``sequence`` on."""

    length: int
    first: int
    last: int
    sequence: int
    per: int
    offset: int


def plan(counts: dict[int, int], capacity: int) -> list[Slot]:
    """Best-fit decreasing over counts: each length goes where the least room that holds it is left."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, int]]] = {}
    slots: list[Slot] = []
    opened = 0

    def put(room: int, sequence: int, number: int) -> None:
        if room and number:
            if room not in groups:
                groups[room] = []
                bisect.insort(rooms, room)
            groups[room].append((sequence, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                sequence, number = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(at)
            else:
                room, sequence = capacity, opened
                number = -(-left // (capacity // length))
                opened += number
            per = room // length
            full = min(number, left // per)
            if full:
                slots.append(Slot(length, rank, rank + full * per, sequence, per, capacity - room))
                put(room - per * length, sequence, full)
                rank, left = rank + full * per, left - full * per
            if left and full < number:  # the rest of this length fills one sequence in part
                slots.append(Slot(length, rank, rank + left, sequence + full, left, capacity - room))
                put(room - left * length, sequence + full, 1)
                full, left = full + 1, 0
            put(room, sequence + full, number - full)
    return slots


def pieces_of(docs: DataFrame, path: str, capacity: int, end_id: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each piece: row, doc_id, piece, start, length, ids_crc32, ids (little-endian, 32 bits).

    A document's ids, with the end id, are cut only if they exceed ``capacity``; then all pieces but the first are
    full. The result is staged, so that no text is encoded twice.
    """
    schema = "row long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(path, KEPT)
        for batch in portions(it, 2, *AT_ONCE):
            ids, offsets = tool.encode(texts_of(batch.column(2)))
            raw, end = ids.astype("<u4").tobytes(), int(end_id).to_bytes(4, "little")
            out: list[tuple] = []
            for row, doc, s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                body = raw[4 * s : 4 * e] + end
                n = len(body) // 4
                first = n if n <= capacity else n % capacity or capacity
                at = 0
                for piece, stop in enumerate(range(first, n + 1, capacity)):
                    part = body[4 * at : 4 * stop]
                    out.append((row, doc, piece, at, stop - at, zlib.crc32(part), part))
                    at = stop
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds)], ["row", "doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            )

    rows = only_first(docs, doc_id, text).toDF("doc_id", "text").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return stage(rows.mapInArrow(run, schema))


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and offset of every piece (row, doc_id, piece, start, length, ids_crc32); ids are not moved."""
    spark = pieces.sparkSession
    light = pieces.select("row", "doc_id", "piece", "start", "length", "ids_crc32")
    counts = {r["length"]: r["count"] for r in light.groupBy("length").count().collect()}  # at most ``capacity`` rows
    slots = [astuple(s) for s in plan(counts, capacity)]
    # the plan's size follows the number of lengths, not of documents
    table = F.broadcast(spark.createDataFrame(slots, "slot_length long, first long, last long, sequence long, per long, at long"))
    ranked = number_within(light, ["length"], [F.col("row"), F.col("piece")], [F.col("row"), F.col("piece")], "rank")
    placed = ranked.join(table, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("last")))
    index = F.col("rank") - F.col("first")
    return placed.select(
        "row", "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.floor(index / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + index % F.col("per") * F.col("length")).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every row.

    A null or empty text is its end id alone. Repeated rows and null ids are rows like others; an empty table
    gives no rows; other columns are ignored.
    """
    return place(pieces_of(docs, path, capacity, end_id, text, doc_id), capacity).drop("row")


def sequences(pieces: DataFrame, capacity: int) -> DataFrame:
    """sequence_id and its whole ids, from staged :func:`pieces_of`; a sequence holds ``capacity`` ids at most."""
    placed = place(pieces, capacity).select("row", "piece", "sequence_id", "offset")
    parts = placed.join(pieces.select("row", "piece", "ids"), ["row", "piece"])
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return parts.groupBy("sequence_id").agg(F.aggregate(ordered, F.lit(b""), lambda s, p: F.concat(s, p["ids"])).alias("ids"))
