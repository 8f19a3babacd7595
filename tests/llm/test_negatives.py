from __future__ import annotations

import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlytics.llm import negatives


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 20), st.integers(0, 45), st.integers(0, 2**32))
def test_planes_and_scores(dim, bits, seed):
    rng = np.random.default_rng(seed)
    q = rng.integers(-(1 << bits), (1 << bits) + 1, (7, dim))
    a = rng.integers(-9, 10, (3, dim))
    packed, need = negatives.planes(q)
    assert (negatives.numbers(packed)[:, :dim] == q).all()
    for row, b in zip(packed, need.tolist()):
        assert (row[b:] == row[b - 1]).all()
    wide = np.zeros((3, -(-dim // 8) * 8), np.int64)
    wide[:, :dim] = a
    got = negatives.scores(negatives.subset_sums(wide), np.ascontiguousarray(packed.transpose(1, 2, 0)))
    assert (got == q @ a.T).all()


def test_planes_of_border_values():
    for value, planes in ((0, 1), (-1, 1), (1, 2), (-2, 2), (127, 8), (-128, 8), (128, 9), (-129, 9)):
        assert negatives.planes(np.array([[value]]))[1].tolist() == [planes]


def plain(rows, first=5):
    """Every row against every anchor, by Python's integers."""
    part = []
    for k, (i, label, v) in enumerate(rows):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        q = [math.floor(256 * x) for x in v]
        if sum(x * x for x in q) < 1 << 60:
            part.append((k, i, (label + 1) % 10 if i % 7 == 0 else label, q))
    out = []
    for k, i, label, q in part:
        if i % 100:
            continue
        met = [(-sum(x * y for x, y in zip(q, p)), j, same == label) for r, j, same, p in part if r != k and len(p) == len(q)]
        for score, j, _ in sorted(x for x in met if x[2])[:first]:
            near = sorted(x for x in met if not x[2] and 80 * -score <= 100 * -x[0] <= 100 * -score)[:first]
            out += [(i, j, n + 1, other, -score, -s) for n, (s, other, _) in enumerate(near)]
    return sorted(out)


def run(df):
    return sorted(tuple(r) for r in negatives.hard_negatives(negatives.relabelled(df)).collect())


@pytest.mark.parametrize("tile,block", [(negatives.TILE, negatives.BLOCK), (150, 3)])
def test_against_plain_version(spark, monkeypatch, tile, block):
    monkeypatch.setattr(negatives, "TILE", tile)
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "_ANCHORS", 2)
    rng = random.Random(2)
    base = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = []
    for k in range(1200):
        b = base[rng.randrange(6)]
        rows.append((k, rng.randrange(10), [x + rng.gauss(0, 0.3) for x in b]))
    rows += [(2000 + k, 3, base[0]) for k in range(300)]  # many ties
    rows += [(2400 + k, 4, base[0]) for k in range(200)]
    rows += [(5000, 1, [0.5] * 12), (5000, 1, [0.5] * 12), (5001, 2, [0.5] * 12), (5100, 1, [0.5] * 12)]  # repeated rows
    rows += [(6000, 1, [1.0, 2.0]), (6001, 1, [1.5, 2.0]), (6002, 2, [1.0, 2.0]), (6100, 3, []), (6101, 3, []), (6102, 4, [])]
    rows += [(7000, 1, [1e6] * 12), (7001, 2, [1e6 - 1] * 12), (7002, 1, [-1e6, 1e6] * 6)]
    rows += [(None, 1, base[0]), (8000, None, base[0]), (8100, 1, None), (8200, 1, [None] + base[0][1:])]
    rows += [(8300, 1, [math.inf] * 12), (8400, 1, [math.nan] * 12), (8500, 1, [1e300] * 12), (-100, 5, [-x for x in base[1]])]
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>")
    df = df.selectExpr("*", "1 AS row", "2 AS tile", "3 AS q", "4 AS wanted", "5 AS score").repartition(3)
    assert run(df) == plain(rows)


def test_few_and_no_rows(spark):
    schema = "vec_id bigint, label int, embedding array<float>"
    assert run(spark.createDataFrame([], schema)) == []
    assert run(spark.createDataFrame([(100, 1, [1.0])], schema)) == []
    assert run(spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], schema)) == []
    assert run(spark.createDataFrame([(100, 1, [1.0]), (101, 1, [1.0]), (102, 2, [0.9])], schema)) == [(100, 101, 1, 102, 65536, 58880)]


def test_supplied_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in df.collect()]
    got = run(df)
    assert got == plain(rows) and got
