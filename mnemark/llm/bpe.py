"""BPE encoding by forced-boundary splitting, and decoding.

No merge can span two neighbouring bytes that stand side by side in no vocabulary token. Such pairs are certain
cuts: the fragments between them are encoded independently and their ids joined, which bounds the length of what is
ever merged. Spaces are such cuts in whole texts; within a word the table of pairs finds the rest.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from tokenizers import models

from .common import only_first
from .encoding import KEPT_FRAGMENTS, ROWS, Encoder, texts_of
from .sampling import batches

END = "</w>"


class BoundaryEncoder(Encoder):
    """An encoder whose pieces are cut wherever no token could join two bytes."""

    def __init__(self, path: str):
        super().__init__(path)
        model = json.loads(self.library.to_str())["model"]
        suffix = model.get("end_of_word_suffix") or ""
        tokens = [t[: -len(suffix)] if suffix and t.endswith(suffix) else t for t in model["vocab"]]
        self.joined = {t[i : i + 2] for t in tokens for i in range(len(t) - 1)}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        #: Merges a fragment that does not end its word.
        self.inner = models.BPE(vocab=model["vocab"], merges=merges)
        self.told: dict[str, tuple[int, str, str]] = {}
        self.room_told = KEPT_FRAGMENTS

    def merged(self, text: str) -> list[int]:
        signs = text if self.words and text.isascii() else text.encode().decode("latin-1").translate(self.signs)
        cuts = [i + 1 for i in range(len(signs) - 1) if signs[i : i + 2] not in self.joined]
        edges = [0, *cuts, len(signs)]
        found = [t.id for s, e in zip(edges[:-2], edges[1:-1], strict=True) for t in self.inner.tokenize(signs[s:e])]
        return found + [t.id for t in self.model.tokenize(signs[edges[-2] :])]

    def merged_after_spaces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [self.merged(p) for p in pieces]
        return np.array([i for each in ids for i in each], np.int32), np.array([len(each) for each in ids], np.int32)

    def tell(self, fragment: str) -> tuple[int, str, str]:
        """Of a fragment: number of ids, ids in decimals, and tokens, both parted by spaces."""
        found = self.told.get(fragment)
        if found is None:
            ids = self.fragment(fragment)
            found = (len(ids), " ".join(map(str, ids)), " ".join(map(self.library.id_to_token, ids)))
            size = 330 + 2 * len(fragment) + len(found[1]) + len(found[2])
            if size <= self.room_told:
                self.room_told -= size
                self.told[fragment] = found
        return found

    def digests(self, texts: pa.Array) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, sha256 of the ids in decimals, sha256 of the decoded text."""
        if self.words:
            at, starts, distinct = self.fragments(texts)
            told = [self.tell(d) for d in distinct]
            counts, ids, said = [[t[k] for t in told] for k in range(3)]
            totals = np.concatenate([[0], np.cumsum(np.array(counts, np.int64)[at])])
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                own = at[s:e].tolist()
                numbers = " ".join(filter(None, map(ids.__getitem__, own)))
                words = " ".join(filter(None, map(said.__getitem__, own)))
                yield int(totals[e] - totals[s]), hashlib.sha256(numbers.encode()).hexdigest(), hashlib.sha256(words.encode()).hexdigest()
            return
        every, offsets = self.encode(texts)
        for s, e in zip(offsets[:-1], offsets[1:], strict=True):
            own = every[s:e].tolist()
            text = self.library.decode(own, skip_special_tokens=False)
            yield len(own), hashlib.sha256(" ".join(map(str, own)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


_encoders: dict[str, BoundaryEncoder] = {}


def _encoder(path: str) -> BoundaryEncoder:
    if path not in _encoders:
        _encoders[path] = BoundaryEncoder(path)
    return _encoders[path]


def encode_texts(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, ids and decoded text of every row; a null text counts as empty and has no ids.

    Repeated rows and null ids are rows like others; an empty table gives no rows; other columns are ignored.
    """

    def run(it):
        tool = _encoder(path)
        for batch in batches(it, ROWS):
            ids, offsets = tool.encode(texts_of(batch.column(1)))
            each = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            said = [tool.library.decode(x, skip_special_tokens=False) for x in each.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), each, pa.array(said, pa.string())], ["doc_id", "ids", "decoded"])

    return only_first(docs, doc_id, text).toDF("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what :func:`encode_texts` gives, as digests."""

    def run(it):
        tool = _encoder(path)
        for batch in batches(it, ROWS):
            told = list(tool.digests(texts_of(batch.column(1))))
            columns = [pa.array([t[k] for t in told], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return only_first(docs, doc_id, text).toDF("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
