"""Bounded training samples, drawn by hash so that they are the same however rows are dealt."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAIN = 1 << 30
#: Most characters of a training text: longer ones are cut into pieces.
LONGEST = 40_000


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id belongs to no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds, F.lit(-1))


def hashed_share(rows: DataFrame, label: str, doc_id: str, counts: dict, most: int) -> DataFrame:
    """About ``most`` rows of each label (all where ``counts`` has fewer), chosen by the hash of their ids."""
    shares = [F.when(F.col(label) == F.lit(k), F.lit(min(GRAIN, GRAIN * most // n))) for k, n in counts.items()]
    return rows.where(F.pmod(F.xxhash64(F.col(doc_id)), F.lit(GRAIN)) < (F.coalesce(*shares) if shares else F.lit(0)))


def collect_texts(rows: DataFrame, label: str, doc_id: str, text: str, labels) -> dict[object, list[str]]:
    """Texts of each label on the driver, in the order of their ids; only for bounded samples of pieces."""
    out: dict[object, list[str]] = {k: [] for k in labels}
    for r in sorted(rows.select(label, doc_id, text).collect(), key=lambda r: (str(r[1]), r[2])):
        out[r[0]].append(r[2])
    return out


def bounded_sample(rows: DataFrame, label: str, doc_id: str, text: str, most: int) -> dict[object, list[str]]:
    """About ``most`` texts of each label at most, collected to the driver; a long text counts as its pieces.

    The first piece has its document's hash, so a sample of texts of one piece is a sample of documents.
    """
    pieces = F.greatest(F.ceil(F.length(text) / LONGEST), F.lit(1)).cast("int")
    counts = {r[0]: r[1] for r in rows.groupBy(label).agg(F.sum(pieces)).collect()}
    shares = [F.when(F.col(label) == F.lit(k), F.lit(min(GRAIN, GRAIN * most // n))) for k, n in counts.items()]
    each = rows.select(label, doc_id, text, F.explode(F.sequence(F.lit(0), pieces - 1)).alias("_piece"))
    drawn = F.when(F.col("_piece") == 0, F.xxhash64(doc_id)).otherwise(F.xxhash64(doc_id, "_piece"))
    kept = each.where(F.pmod(drawn, F.lit(GRAIN)) < (F.coalesce(*shares) if shares else F.lit(0)))
    cut = kept.select(label, doc_id, F.substring(F.col(text), F.col("_piece") * LONGEST + 1, F.lit(LONGEST)).alias(text))
    return collect_texts(cut, label, doc_id, text, counts)


def batches(it: Iterator, rows: int = 256) -> Iterator:
    """Arrow batches cut to so many rows, which bounds what a task's Python holds at once."""
    for batch in it:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def keep_rows(docs: DataFrame, text: str, judge: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows whose text is kept, with all their columns; ``judge`` is called once a task and gives the decision."""
    at = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = judge()
        for batch in batches(it):
            yield batch.filter(pa.array([kept(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
