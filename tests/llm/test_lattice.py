from __future__ import annotations

import math

import numpy as np
import pytest

from reviewlytics.llm import lattice


def brute(rows, threshold=0.9):
    fine = {}
    for k, (i, v) in enumerate(rows):
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v) or not any(v):
            continue
        fine[k] = np.array(v) / np.linalg.norm(v)
    up = {k: k for k in range(len(rows))}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for a in fine:
        for b in fine:
            if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= threshold:
                links[a] += 1
                links[b] += 1
                up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(least.get(root(k), i), i)
    return sorted((i, links[k], least[root(k)] if i is not None else None) for k, (i, _) in enumerate(rows) if i is not None)


def near(rng, x, cos):
    u = rng.standard_normal(len(x))
    u -= (u @ x) * x / (x @ x)
    u *= np.linalg.norm(x) / np.linalg.norm(u)
    return cos * x + math.sqrt(1 - cos * cos) * u


@pytest.mark.parametrize("tile", [lattice.TILE, 16])
def test_groups_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(lattice, "TILE", tile)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((6, 32))
    rows = [(k, rng.standard_normal(32)) for k in range(100)]
    rows += [(200 + k, near(rng, base[0], 0.99)) for k in range(70)]
    rows += [(300 + k, base[1] * (k + 1)) for k in range(10)] + [(320, base[2])] * 4 + [(321, base[2])]
    rows += [(400 + k, near(rng, base[3], 0.985)) for k in range(10)]
    rows = [(i, v.tolist()) for i, v in rows]
    rows += [(500, None), (501, [0.0] * 32), (502, [None] + [1.0] * 31), (503, [math.inf] * 32), (504, []), (505, base[4][:8].tolist()), (506, base[4][:8].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS c", "2 AS raw")
    got = lattice.near_vectors(df.repartition(3)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_empty_and_null_id(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0]), (1, [1.0, 2.0])], "vec_id bigint, embedding array<float>")
    got = sorted(((r["vec_id"] or -1, r["n_links"], r["component_id"], r["kept"]) for r in lattice.near_vectors(df).collect()))
    assert got == [(-1, 0, None, True), (1, 0, 1, True)]
    assert lattice.near_vectors(df.where("false")).count() == 0


def test_lattice_points():
    rng = np.random.default_rng(1)
    steps = lattice.minimal_vectors()
    assert len(steps) == 240 and np.allclose((steps**2).sum(axis=1), 2)
    x = rng.standard_normal((500, 8)) * 2
    p = lattice.nearest_e8(x)
    far = ((x - p) ** 2).sum(axis=1)
    assert (far <= 1 + 1e-9).all()
    for s in steps:
        assert (((x - p - s) ** 2).sum(axis=1) >= far - 1e-9).all()


def test_recall_at_the_threshold():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((2000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = np.array([near(rng, v, 0.9) for v in x])
    shown = (lattice.cells(x) == lattice.cells(y)[:, :, :1]).any(axis=(1, 2))
    assert shown.mean() >= 0.95
