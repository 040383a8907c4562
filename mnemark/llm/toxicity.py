"""Toxicity by compression distance.

Two zstandard dictionaries are made of labelled documents: one of the words that ordinary documents share, and one of the
same words followed by what sets toxic documents apart. A text is cut into windows of whole words, and each window is
compressed with either dictionary: the bytes that the toxic one saves are its distance. The largest distance, the
mean of the three largest and the sum of all that are no chance, over the root
of their number, decide by a logistic curve. Its threshold, and the sizes of windows and dictionaries, are chosen on folds of documents that the dictionaries have not seen; the final ones are made of all.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import only_first
from .sampling import batches, bounded_sample, fold_of, hashed_share, keep_rows

#: Labelled texts of each kind that are sampled to fit; of one longer than ``sampling.LONGEST`` each piece counts.
SAMPLE = 2000
LEVEL, FOLDS = 6, 3
#: (bytes of a window, terms that set toxic text apart, shared words): the folds choose among them.
SIZES = tuple((window, *sizes) for window in (64, 80, 96) for sizes in ((24, 1500), (48, 4000)))
#: A window without a blank is cut after so many bytes more than it should have.
NO_BLANK = 64
#: Lengths, in bytes, of the beginnings of words that may set a kind apart.
BEGINNINGS = (5, 6, 7, 8)
#: Documents of this score or more are predicted to be toxic.
THRESHOLD = 0.3
NO_WORD = re.compile(rb"[\x00-\x20!-/:-@\[-`{-\x7f]+")


def plain(text: str | None) -> bytes:
    return NO_WORD.sub(b" ", (text or "").lower().encode("utf-8", "replace"))


def windows(body: bytes, size: int) -> list[bytes]:
    """Pieces of at least ``size`` bytes that end with a word, or after ``NO_BLANK`` more where none ends; together the whole text."""
    out, at = [], 0
    while at < len(body):
        end = body.find(b" ", at + size, at + size + NO_BLANK)
        end = min(len(body), at + size + NO_BLANK if end < 0 else end + 1)
        out.append(body[at:end])
        at = end
    return out


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    window: int
    weights: tuple[float, ...]

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        params = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, min_match=3, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
        )
        out = []
        for content in (self.ordinary, self.toxic):
            held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            held.precompute_compress(compression_params=params)
            out.append(zstandard.ZstdCompressor(dict_data=held, compression_params=params))
        return out


def distances(body: bytes, size: int, tools: list[zstandard.ZstdCompressor]) -> tuple[float, float, float]:
    """Bytes saved by the toxic dictionary: most in a window, the mean of the best three, and the sum above one byte over the root of the windows."""
    ordinary, toxic = tools
    saved = sorted((len(ordinary.compress(w)) - len(toxic.compress(w)) for w in windows(body, size)), reverse=True)
    if not saved:
        return 0.0, 0.0, 0.0
    return float(saved[0]), sum(saved[:3]) / len(saved[:3]), sum(x for x in saved if x > 1) / math.sqrt(len(saved))


def score(body: bytes, model: Model, tools: list[zstandard.ZstdCompressor]) -> float:
    z = model.weights[0] + sum(a * x for a, x in zip(model.weights[1:], distances(body, model.window, tools), strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms(body: bytes) -> set[bytes]:
    """The words of a text and their beginnings: coined words of one stem are rarely seen twice, their stem is."""
    out = set(body.split())
    return out | {w[:k] for w in out for k in BEGINNINGS if len(w) > k}


class Counted:
    """Terms of documents as hashes, so that the counts of millions of them stay small; strings are sought for the few in use."""

    def __init__(self, bodies: list[bytes]):
        self.bodies = bodies
        self.hashes = [np.unique(np.fromiter(map(xxh3_64_intdigest, terms(b)), np.uint64)) for b in bodies]
        self.words = [np.unique(np.fromiter(map(xxh3_64_intdigest, set(b.split())), np.uint64)) for b in bodies]

    @staticmethod
    def seen(of: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parts = [of[i] for i in chosen]
        return np.unique(np.concatenate(parts) if parts else np.zeros(0, np.uint64), return_counts=True)

    def named(self, wanted: np.ndarray) -> dict[int, bytes]:
        """The strings of the wanted hashes."""
        out, sought = {}, set(wanted.tolist())
        for body, own in zip(self.bodies, self.hashes, strict=True):
            if sought and len(np.intersect1d(own, wanted, assume_unique=True)):
                out |= {h: t for t in terms(body) if (h := xxh3_64_intdigest(t)) in sought}
        return out


def apart(of: Counted, truth: np.ndarray, chosen: np.ndarray, most: int = 800) -> tuple[list[tuple[int, float, int]], np.ndarray]:
    """Of the chosen documents: (hash, how far it sets toxic ones apart, toxic documents with it) of the ``most`` best terms, and the shared words, the most frequent first."""
    toxic, ordinary = chosen[truth[chosen] == 1], chosen[truth[chosen] == 0]
    n, m = max(1, len(ordinary)), max(1, len(toxic))
    (a, in_toxic), (b, in_ordinary) = of.seen(of.hashes, toxic), of.seen(of.hashes, ordinary)
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    other = np.where(b[at] == a, in_ordinary[at], 0) if len(b) else np.zeros(len(a), np.int64)
    p, q, both = other / n, in_toxic / m, (in_toxic + other) / (n + m)
    z = (q - p) / np.sqrt(both * (1 - both) * (1 / n + 1 / m) + 1e-9)
    z[in_toxic + other < max(2, (n + m) // 1000)] = -1  # too rare to tell
    best = np.lexsort((a, -z))[:most]
    best = best[z[best] > 0]
    words, often = of.seen(of.words, ordinary)
    shared = words[np.lexsort((words, -often))][: max(s for *_, s in SIZES)]
    return [(int(a[k]), float(z[k]), int(in_toxic[k])) for k in best], shared


def dictionaries(found: tuple[list, np.ndarray], names: dict[int, bytes], own: int, shared: int) -> tuple[bytes, bytes]:
    """Contents of the ordinary and the toxic dictionary; what sets toxic text apart lies last, where matches cost least.

    A term that is hardly seen without a longer chosen one that it begins is left out.
    """
    ranked, common = found
    out: list[tuple[bytes, int]] = []
    for h, _, seen in sorted(ranked, key=lambda x: (-x[1], -len(names[x[0]]), names[x[0]])):
        if len(out) == own:
            break
        if not any(c.startswith(names[h]) and seen <= 1.2 * k for c, k in out):
            out.append((names[h], seen))
    terms = [t for t, _ in out]
    words = [names[h] for h in common[:shared].tolist() if names[h] not in terms][::-1]
    return b" " + b" ".join(words) + b" ", b" " + b" ".join(words + terms[::-1]) + b" "


def calibrate(points: np.ndarray, truth: np.ndarray, weight: np.ndarray) -> tuple[float, tuple[float, ...]]:
    """How well a logistic curve by Newton's steps tells these points, by likelihood, and the curve, moved so that ``THRESHOLD`` is where F1 is best."""
    x = np.column_stack([np.ones(len(points)), points])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (truth - p)) - 1e-2 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        w = w + np.linalg.solve(hess, grad)
    z = x @ w
    p = np.clip(1 / (1 + np.exp(-np.clip(z, -30, 30))), 1e-6, 1 - 1e-6)
    fit = float((weight * (truth * np.log(p) + (1 - truth) * np.log(1 - p))).sum() / weight.sum())
    best, cut = -1.0, 0.0
    for t in np.unique(np.round(z, 3)):
        hit = (weight * truth * (z >= t)).sum()
        f1 = 2 * hit / ((weight * (z >= t)).sum() + (weight * truth).sum())
        if f1 > best:
            best, cut = f1, t
    w[0] += math.log(THRESHOLD / (1 - THRESHOLD)) - cut + 1e-6
    return fit, tuple(float(v) for v in w)


def fit_model(ordinary: list[bytes], toxic: list[bytes], sizes: tuple[int, int]) -> Model:
    """The model of these bodies; ``sizes`` are the numbers of labelled documents of either kind, of which these are a sample."""
    bodies = [*ordinary, *toxic]
    truth = np.r_[np.zeros(len(ordinary), int), np.ones(len(toxic), int)]
    weight = np.where(truth == 1, sizes[1] / len(toxic), sizes[0] / len(ordinary))
    weight /= weight.mean()
    fold = np.r_[np.arange(len(ordinary)), np.arange(len(toxic))] % FOLDS
    every, of = np.arange(len(bodies)), Counted(bodies)
    found = [apart(of, truth, every[fold != f] if f < FOLDS else every) for f in range(FOLDS + 1)]
    names = of.named(np.unique(np.concatenate([np.r_[np.array([h for h, *_ in r], np.uint64), c] for r, c in found])))
    best: tuple[float, Model] | None = None
    for window, own, shared in SIZES:
        points = np.zeros((len(bodies), 3))
        for f in range(FOLDS):
            tools = Model(*dictionaries(found[f], names, own, shared), window, ()).compressors()
            for i in np.flatnonzero(fold == f):
                points[i] = distances(bodies[i], window, tools)
        fit, weights = calibrate(points, truth, weight)
        if best is None or fit > best[0]:
            best = fit, Model(*dictionaries(found[FOLDS], names, own, shared), window, weights)
    return best[1]


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model | None:
    """Fit on documents whose crc32(id) mod 4 is not 2; None where these lack one of the labels."""
    marks = labels.select(F.col("doc_id").alias("doc_id"), F.col("toxic").alias("mark")).where("mark in (0, 1)").where(fold_of("doc_id", 4) != 2)
    counts = {r[0]: r[1] for r in marks.groupBy("mark").count().collect()}
    picked = F.broadcast(hashed_share(marks, "mark", "doc_id", counts, sample))  # about 2 * ``sample`` rows, whatever the input
    rows = only_first(docs, doc_id, text).toDF("doc_id", "text").where("text is not null").join(picked, "doc_id")
    texts = bounded_sample(rows, "mark", "doc_id", "text", sample)
    if not texts.get(0) or not texts.get(1):
        return None
    return fit_model(*[[plain(t) for t in texts.pop(k)] for k in (0, 1)], (counts[0], counts[1]))


def score_toxicity(docs: DataFrame, model: Model | None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id and score of every row, from its whole text alone.

    Null and empty texts have no window and get the curve's value at 0; without a model every score is 0. Repeated
    rows and null ids are scored like others; an empty table gives no rows; other columns are ignored.
    """
    rows = only_first(docs, doc_id, text).toDF("doc_id", "text")
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = model.compressors()
        for batch in batches(it):
            scores = [score(plain(t.as_py()), model, tools) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, "doc_id long, score double")


def keep_ordinary(docs: DataFrame, model: Model | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns; without a model all of them."""

    def judge():
        tools = model.compressors()
        return lambda t: score(plain(t), model, tools) < threshold

    return docs if model is None else keep_rows(docs, text, judge)
