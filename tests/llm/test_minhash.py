from __future__ import annotations

import re

import numpy as np
import pytest

from reviewlytics.llm import minhash


def brute(docs, width, threshold=80):
    """doc_id -> (set size, component) by comparing all pairs."""
    sets = {}
    for d, text in docs:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        n = max(len(words) - width + 1, 1) if words else 0
        sets[d] = {tuple(words[i : i + width]) for i in range(n)}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= threshold * len(x | y):
                p, q = sorted((root(a), root(b)))
                up[q] = p
    return {d: (len(sets[d]), root(d)) for d in ids}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def text(seed, n):
    return " ".join(f"w{(seed * 7919 + k * k * 31 + k) % 4999}" for k in range(n))


def edited(base, k):
    words = base.split()
    words[(k * 13) % len(words)] = f"new{k}"
    return " ".join(words)


def sets_of(texts):
    raw = [t.encode() for t in texts]
    data = np.frombuffer(b"".join(raw), np.uint8)
    return minhash.row_sets(data, np.cumsum([0, *map(len, raw)]), minhash.WIDTH)


def test_edges(spark):
    rows = [
        (1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "ONE  two"), (6, "one two three"),
        (7, text(1, 30_000)), (8, edited(text(1, 30_000), 5)), (9, "É é É é é"), (10, "é é é é é"),
        (None, "one two"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr(
        "*", "text AS print", "doc_id AS rep", "1 AS key"
    )
    out = minhash.near_duplicates(docs, width=4)
    got = found(out.where("doc_id is not null"))
    assert got == brute(rows[:-1], 4)
    assert got[5][1] == 4 and got[8][1] == 7 and got[2] == (0, 2)
    none = out.where("doc_id is null").collect()
    assert [(r["n_shingles"], r["component_id"], r["kept"]) for r in none] == [(1, None, True)]
    assert minhash.near_duplicates(docs.where("false")).count() == 0


def test_repeated_rows_stay(spark):
    docs = spark.createDataFrame([(3, "a b c d e f")] * 3 + [(1, "a b c d e f")], "doc_id bigint, text string")
    out = minhash.near_duplicates(docs).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in out) == [(1, 1, True)] + [(3, 1, False)] * 3


@pytest.mark.parametrize("small, few", [(minhash.SMALL, minhash.FEW), (3, minhash.FEW), (3, 2)])
def test_groups_against_brute_force(spark, monkeypatch, small, few):
    monkeypatch.setattr(minhash, "SMALL", small)
    monkeypatch.setattr(minhash, "FEW", few)
    monkeypatch.setattr(minhash, "SHARE", 16 if few == 2 else minhash.SHARE)
    rows = [(1000 + k, text(k, 60)) for k in range(30)]
    rows += [(k, edited(text(5, 120), k)) for k in range(60)]  # a group of near copies, edits far apart
    rows += [(200 + k, text(900, 40) + " " + text(100 + k, 60)) for k in range(40)]  # a common passage
    rows += [(400 + k, " ".join(text(77, 100).split()[k:])) for k in range(0, 60, 4)]  # a chain
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    assert found(minhash.near_duplicates(docs)) == brute(rows, minhash.WIDTH)


def test_a_pair_with_one_band_in_common_meets_in_a_large_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 3)
    monkeypatch.setattr(minhash, "FEW", 2)
    n, keys = minhash.BANDS * minhash.ROWS, {}
    base = text(5, 60)
    one = minhash.signatures(sets_of([base]), n)
    for k in range(4000):
        # A near copy that shares one band with the base: edits of several words in turn.
        words = base.split()
        for t in range(4):
            words[(k * 7 + t * (k % 11 + 1)) % len(words)] = f"x{k}y{t}"
        keys[k] = " ".join(words)
    sets = sets_of(list(keys.values()))
    sig = minhash.signatures(sets, n)
    same = minhash.band_keys(sig, minhash.BANDS) == minhash.band_keys(one, minhash.BANDS)
    first = sets_of([base])[0]
    share = np.array([len(np.intersect1d(first, x)) / len(np.union1d(first, x)) for x in sets])
    least = minhash.least_matches(n, 0.5, minhash.MISS)
    steps = np.cumsum((sig == one).reshape(len(sig), -1, minhash.BATCH).sum(axis=2), axis=1)
    fit = np.flatnonzero((same.sum(axis=1) == 1) & (share >= 0.5) & (steps >= least).all(axis=1))
    assert len(fit)
    near = int(fit[0])
    band = int(same[near].argmax())
    pair = [(0, base), (1, keys[near])]
    # Unlike members of that bucket: rows with its minima and others of their own.
    reps, rows = [(d, x) for d, x in pair], []
    key = int(minhash.band_keys(one, minhash.BANDS)[0, band])
    signed = {0: one[0], 1: sig[near]}
    for d in range(2, 40):
        reps.append((d, text(100 + d, 60)))
        signed[d] = minhash.signatures(sets_of([text(100 + d, 60)]), n)[0]
        signed[d][band * minhash.ROWS : (band + 1) * minhash.ROWS] = one[0][band * minhash.ROWS : (band + 1) * minhash.ROWS]
    for d in range(40):
        rows.append((key, d, 40))
    large = spark.createDataFrame(rows, "key bigint, rep bigint, n bigint")
    groups = spark.createDataFrame([], "id bigint, component_id bigint")
    table = spark.createDataFrame([(d, bytearray(x.tobytes())) for d, x in signed.items()], "rep bigint, sig binary")
    docs = spark.createDataFrame(reps, "doc_id bigint, text string")
    open_ = minhash._open_members(large, groups)
    late = minhash._late_links(docs, open_, table, minhash.WIDTH, n, 50, minhash.MISS)
    assert {(r["a"], r["b"]) for r in late.collect()} == {(0, 1)}


def test_pruning_bound():
    least = minhash.least_matches(120, 0.8, 1e-3)
    assert len(least) == 6 and all(0 < m < k for m, k in zip(least, range(20, 121, 20)))
    assert least[-1] / 120 > 0.6
