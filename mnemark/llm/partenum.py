"""PartEnum signatures: similar sets of nearby sizes share at least one.

Sizes fall into bands whose ends grow by 1 / similarity, so two similar sets lie in one band or in neighbouring ones;
each pair of neighbouring bands is a window. Within a window similar sets differ by at most ``differ(s, t)`` features.
The domain of features is dealt by hash to ``first`` partitions of ``second`` parts each. Some partition holds no more
differences than its part of them, ``spared`` at most; so some choice of ``second - spared`` of its parts holds none, and
the features in these parts, hashed, are a signature that both sets have. All choices are enumerated.

A choice without features would be shared by sets that have nothing in common. A set leaves such choices out where its
other partitions alone keep the promise, and gives them too where they do not.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np

from .shingles import mix

#: The similarity as a fraction: 100 * common >= 75 * all.
NUMBER, OF = 3, 4


def similar(common: int, all_: int) -> bool:
    return OF * common >= NUMBER * all_


def differ(s: int, t: int) -> int:
    """Most features by which similar sets of these sizes can differ."""
    return (OF - NUMBER) * (s + t) // (OF + NUMBER)


@lru_cache(maxsize=1)
def _ends() -> list[int]:
    """First sizes of the bands; no set has 2^40 features."""
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(ends[-1] * OF // NUMBER + 1)
    return ends


@dataclass(frozen=True)
class Window:
    number: int
    last: int  # largest size
    first: int
    second: int
    spared: int
    choices: np.ndarray


@lru_cache(maxsize=512)
def window(number: int) -> Window:
    last = _ends()[number + 2] - 1
    most = differ(last, last)
    if most <= 3:  # small sets: one partition, so that no choice is likely to be empty
        first, second, spared = 1, (1, 6, 6, 7)[most], most
    else:
        spared, second = 1, 3
        first = most // (spared + 1) + 1
        first += 1 + first // 16
    parts = list(combinations(range(second), second - spared))
    choices = np.zeros((len(parts), second), np.uint64)
    for i, p in enumerate(parts):
        choices[i, list(p)] = 1
    return Window(number, last, first, second, spared, choices)


def windows_of(size: int) -> list[Window]:
    band = int(np.searchsorted(_ends(), size, side="right")) - 1
    return [w for w in (window(band), *([window(band - 1)] if band else [])) if differ(size, _partner(size, w))]


def _partner(size: int, w: Window) -> int:
    return min(size * OF // NUMBER, w.last)


def signatures(features: np.ndarray) -> np.ndarray:
    """All signatures of a set of 64-bit features, as signed numbers."""
    out = [np.zeros(0, np.uint64)]
    placed, content = mix(features ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(16), mix(features + np.uint64(7))
    for w in windows_of(len(features)) if len(features) else []:
        cells = w.first * w.second
        cell = (placed % np.uint64(cells)).astype(np.int64)
        sums = np.zeros(cells, np.uint64)
        np.add.at(sums, cell, content)
        counts = np.bincount(cell, minlength=cells).astype(np.uint64)
        held = counts.reshape(w.first, w.second) @ w.choices.T
        body = sums.reshape(w.first, w.second) @ w.choices.T
        name = np.arange(body.size, dtype=np.uint64).reshape(body.shape) + (np.uint64(w.number) << np.uint64(40))
        found = mix(mix(body + held) ^ mix(name + np.uint64(1)))
        empty = held == 0
        sound = w.first - int(empty.any(axis=1).sum())
        kept = found[~empty] if sound > differ(len(features), _partner(len(features), w)) // (w.spared + 1) else found.ravel()
        out.append(kept)
    return np.unique(np.concatenate(out)).view(np.int64)
