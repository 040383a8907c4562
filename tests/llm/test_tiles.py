"""Embedding tiles: many tiles, several strips and crowds of unlike vectors against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from mnemark.llm import near_embeddings as N


def brute(x, least):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= least
    np.fill_diagonal(near, False)
    low = np.arange(len(x))
    while True:
        new = np.minimum(low, np.where(near, low[None], len(x)).min(axis=1))
        if (new == low).all():
            return near.sum(axis=1), low
        low = new


def crowded(seed, rows=900, width=12):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(rows, width))
    x[: rows // 3] = x[0] + 0.2 * rng.normal(size=(rows // 3, width))  # a third of all rows in one crowd, none alike
    return x[rng.permutation(rows)]


@pytest.mark.parametrize(("tile", "strip"), [(6144, 512), (100, 512), (250, 17), (6144, 7)])
def test_tiles_and_strips_equal_brute_force(spark, monkeypatch, tile, strip):
    monkeypatch.setattr(N, "TILE", tile)
    monkeypatch.setattr(N, "STRIP", strip)
    x = crowded(3)
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in N.near_embeddings(rows, 0.9).collect())
    count, low = brute(x, 0.9)
    assert count.max() > 100
    assert got == [(k, int(count[k]), int(low[k]), k == low[k]) for k in range(len(x))]


@pytest.mark.parametrize("strip", [1, 5, 512])
def test_strips_of_one_block_join_as_one(monkeypatch, strip):
    monkeypatch.setattr(N, "STRIP", strip)
    x = crowded(4, 200)
    key = tuple(pa.scalar(0) for _ in range(4))
    table = pa.table({"side": pa.array([0] * 200, pa.int32()), "rep": np.arange(200), "copies": np.ones(200, np.int64), "vec": pa.array(x.tolist(), pa.list_(pa.float64()))})
    got = N.compare(key, table, N.directions(x), 0.9).to_pydict()
    count, low = brute(x, 0.9)
    seen = np.flatnonzero(count)
    assert got == {"a": seen.tolist(), "b": low[seen].tolist(), "n": count[seen].tolist()}
