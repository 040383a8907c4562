"""Sets of word shingles as sorted 64-bit hashes, computed over the bytes of Arrow string columns.

A-Z are lower-cased; words are runs of anything but space and the control signs 9 to 13, all of them single bytes in
UTF-8. Shingles and sets are known by their 64-bit hashes; a set's key is the hash of all of its shingles' hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORDS = 5
#: Bytes that are hashed at a time, whatever the length of a text.
BLOCK = 1 << 20
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, k, 1 << 64) for k in range(1, WORDS + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SIGN = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_SIGN[ord("A") : ord("Z") + 1] = _SIGN[ord("a") : ord("z") + 1]
_UP = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK - 1, _BASE, np.uint64))])
_DOWN = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(BLOCK - 1, _BASE_INVERSE, np.uint64))])


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of the bytes from each start to its end: differences of one running polynomial, block by block."""
    low, high, shift = np.zeros(len(starts), np.uint64), np.zeros(len(ends), np.uint64), np.zeros(len(starts), np.uint64)
    carry = np.uint64(0)
    for x in range(0, len(data), BLOCK):
        y = min(x + BLOCK, len(data))
        scale = np.uint64(pow(_BASE, x, 1 << 64))
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_SIGN[data[x:y]] * _UP[: y - x])]) * scale + carry
        s = slice(*np.searchsorted(starts, [x, y]))
        e = slice(*np.searchsorted(ends, [x + 1, y + 1]))
        low[s] = run[starts[s] - x]
        shift[s] = _DOWN[starts[s] - x] * np.uint64(pow(_BASE_INVERSE, x, 1 << 64))
        high[e] = run[ends[e] - x]
        carry = run[-1]
    return mix((high - low) * shift + (ends - starts).astype(np.uint64))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each text the sorted distinct hashes of its shingles; null counts as empty.

    Fewer than ``WORDS`` words give one shingle, none give the empty set.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    first, last = (int(offsets[0]), int(offsets[-1])) if len(offsets) else (0, 0)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[first:last] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - first
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[True], space])[: len(data)] | edge[:-1]
    after = np.concatenate([space[1:], [True]])[: len(data)] | edge[1:]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(~space & after) + 1
    words = _word_hashes(data, starts, ends)
    cuts = np.searchsorted(starts, offsets)
    n = max(0, len(words) - WORDS + 1)
    whole = np.zeros(n, np.uint64)
    for k in range(WORDS):
        whole += words[k : k + n] * _WEIGHTS[k]
    whole = mix(whole)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b - a >= WORDS:
            yield np.unique(whole[a : b - WORDS + 1])
        elif b > a:
            yield mix((words[a:b] * _WEIGHTS[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def set_key(shingles: np.ndarray) -> int:
    """The set's hash as a signed 64-bit number."""
    total = (int(mix(shingles + np.uint64(1)).sum(dtype=np.uint64)) + len(shingles) * _BASE) & _MASK
    return total - (1 << 64) if total >> 63 else total


#: Bits of a set's parity sketch, and of the wide sketch that sets of more shingles than ``BITS`` have besides.
BITS, WIDE = 1024, 16384


def parity_sketch(shingles: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Parities of the numbers of shingles that fall to each of ``bits`` places, as ``bits`` / 64 numbers.

    Two sets differ by at least as many shingles as their sketches differ by bits.
    """
    odd = (np.bincount((shingles >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64)


def wide_sketch(shingles: np.ndarray) -> np.ndarray:
    return parity_sketch(shingles, WIDE if len(shingles) > BITS else BITS)
