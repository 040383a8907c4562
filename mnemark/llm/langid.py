"""Language identification by language-bitmask n-gram filters.

Each language has a Bloom filter of its n-grams. The filters are bit-sliced: one table holds at each slot a mask
with a bit for each language, in as many 64-bit words as the languages need, so looking an n-gram up once returns all
the languages that contain it. A text's
n-grams are counted for each language, the hits that chance alone would give are taken off, and the language with
the largest share, against what its own texts reach, is the answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import only_first
from .sampling import batches, bounded_sample, fold_of, keep_rows

#: Documents of each language that are sampled to fill its filter, and n-grams kept of them.
SAMPLE, KEPT = 2000, 30_000
GRAM, SLOT_BITS = 5, 21
#: Odd multipliers of the filter's two hashes.
HASHES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
NO_LETTER = re.compile(r"[\W\d_]+")
UNKNOWN = "und"
#: Languages of one word of a mask; each word of all slots takes 16 MB.
WORD = 64


def letters(text: str | None) -> str:
    """Lower-cased letters, runs of all else as one space; empty where there is no letter."""
    out = NO_LETTER.sub(" ", (text or "").lower()).strip()
    return out if out.isascii() or any(map(str.isalpha, out)) else ""


def grams(body: str) -> np.ndarray:
    """The text's n-grams of bytes as numbers, spaces at both ends included."""
    b = np.frombuffer(f" {body} ".encode("utf-8", "replace").ljust(GRAM), np.uint8).astype(np.uint64)
    n = len(b) - GRAM + 1
    out = b[:n].copy()
    for i in range(1, GRAM):
        out |= b[i : i + n] << np.uint64(8 * i)
    return out


def slots(g: np.ndarray) -> list[np.ndarray]:
    return [(g * m) >> np.uint64(64 - SLOT_BITS) for m in HASHES]


def bit(k: int) -> np.uint64:
    """The place of language ``k`` in its word of a mask."""
    return np.uint64(1 << k % WORD)


@dataclass(frozen=True)
class Filters:
    languages: tuple[str, ...]
    masks: np.ndarray
    chance: np.ndarray
    usual: np.ndarray
    fallback: int

    def shares(self, body: str) -> np.ndarray:
        """For each language the part of the text's n-grams that it contains, corrected for false positives."""
        first, second = slots(grams(body))
        found = [m[first] & m[second] for m in self.masks]
        hits = np.array([np.count_nonzero(found[k // WORD] & bit(k)) for k in range(len(self.languages))], float)
        part = (hits / len(first) - self.chance) / np.maximum(1 - self.chance, 1e-9)
        return np.maximum(part, 0) / self.usual

    def decide(self, text: str | None) -> tuple[str, float]:
        body = letters(text)
        if not body or not self.languages:
            return UNKNOWN, 0.0
        s = self.shares(body)
        total = s.sum()
        best = int(np.argmax(s)) if total > 0 else self.fallback
        return self.languages[best], float(s[best] / total) if total > 0 else 0.0


def fill(texts: dict[str, list[str]]) -> Filters:
    languages = tuple(sorted(texts))
    masks = np.zeros((-(-len(languages) // WORD), 1 << SLOT_BITS), np.uint64)
    bodies = {k: [b for b in map(letters, texts[k]) if b] for k in languages}
    for k, name in enumerate(languages):
        if not bodies[name]:
            continue
        g, n = np.unique(np.concatenate([grams(b) for b in bodies[name]]), return_counts=True)
        kept = g[np.lexsort((g, -n))[:KEPT]]
        for at in slots(kept):
            np.bitwise_or.at(masks[k // WORD], at, bit(k))
    full = np.array([np.count_nonzero(masks[k // WORD] & bit(k)) / (1 << SLOT_BITS) for k in range(len(languages))])
    bare = Filters(languages, masks, full ** len(HASHES), np.ones(len(languages)), 0)
    usual = [np.mean([bare.shares(b)[k] for b in bodies[name][:200]]) if bodies[name] else 1.0 for k, name in enumerate(languages)]
    most = max(range(len(languages)), key=lambda k: len(texts[languages[k]]), default=0)
    return Filters(languages, masks, bare.chance, np.maximum(usual, 1e-3), most)


def learn(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", lang: str = "lang", sample: int = SAMPLE) -> Filters:
    """Fill the filters from documents whose crc32(id) mod 5 is not 0 and whose language is known."""
    rows = only_first(docs, doc_id, text, lang).toDF("doc_id", "text", "lang").where("text is not null and lang is not null").where(fold_of("doc_id", 5) != 0)
    return fill(bounded_sample(rows, "lang", "doc_id", "text", sample))


def identify(docs: DataFrame, filters: Filters, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, lang_pred and score (the language's part of all evidence) of every row, from its whole text alone.

    A text that is null or has no letter is ``und`` with score 0. Equal evidence goes to the language first by
    name, none to the language seen most. Repeated rows and null ids are rows like others; an empty table gives
    no rows; other columns are ignored.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            said = [filters.decide(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in said], pa.string()), pa.array([x for _, x in said], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return only_first(docs, doc_id, text).toDF("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep_identified(docs: DataFrame, filters: Filters, text: str = "text") -> DataFrame:
    """The rows of ``docs`` for whose language there is evidence, with all their columns.

    A text goes if it is null, has no letter, or shares no n-gram with any language beyond what chance gives.
    """

    def judge():
        def kept(t: str | None) -> bool:
            said, score = filters.decide(t)
            return said != UNKNOWN and score > 0

        return kept

    return keep_rows(docs, text, judge)
