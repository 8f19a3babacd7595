from __future__ import annotations

import random
import re

from reviewlytics.llm import tiling


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(doc, item, width):
    """Tiles by trying all pairs of places, longest first."""
    d, t = words(doc), words(item)
    least = min(width, len(t))
    free_d, free_t = [True] * len(d), [True] * len(t)
    covered = 0
    while t:
        best = (0, 0, 0)
        for i in range(len(d)):
            for j in range(len(t)):
                n = 0
                while i + n < len(d) and j + n < len(t) and free_d[i + n] and free_t[j + n] and d[i + n] == t[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least or not n:
            break
        free_d[i : i + n] = free_t[j : j + n] = [False] * n
        covered += n
    return covered / len(t) if t else 0.0


def found(df):
    return {(r["doc_id"], r["item_id"]): round(r["coverage"], 9) for r in df.collect()}


def test_against_brute_force(spark):
    rnd = random.Random(3)
    some = lambda n, k=500: " ".join(f"w{rnd.randrange(k)}" for _ in range(n))
    items = [(k, some(rnd.randrange(12, 40))) for k in range(12)] + [(90, "one two three"), (91, ""), (92, None), (93, "?!")]
    docs = []
    for k in range(60):
        test = items[k % 12][1].split()
        kind = k % 6
        if kind == 0:
            text = some(30)
        elif kind == 1:
            text = some(10) + " " + " ".join(test) + ", " + some(10)
        elif kind == 2:  # halves exchanged
            text = some(5) + " " + " ".join(test[8:]) + " " + some(5) + " " + " ".join(test[:8]) + "."
        elif kind == 3:  # half of it
            text = " ".join(test[: len(test) // 2]) + " " + some(20)
        elif kind == 4:  # twice, with an edit
            text = " ".join(test[:7] + ["x"] + test[8:]).upper() + "\n" + " ".join(test)
        else:
            text = some(60, 4)
        docs.append((k, text))
    docs += [(100, "and one, two THREE more"), (101, None), (102, ""), (103, "one two"), (100, "one two three"), (None, items[0][1])]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id")
    b = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    want = {}
    for i, text in docs:
        for j, item in items:
            share = brute(text, item, tiling.WIDTH)
            if share >= tiling.COVERAGE:
                want[i, j] = round(share, 9)
    out = tiling.leaks(d.repartition(3), b)
    assert found(out) == want and (100, 90) in want and (None, 0) in want
    assert out.where("doc_id = 100").count() == 2
    assert found(tiling.leaks(d, b, block_bytes=300)) == want  # many blocks of items
    assert tiling.leaks(d.where("false"), b).count() == 0 == tiling.leaks(d, b.where("false")).count()


def test_tiles_point_into_both_texts(spark):
    item = " ".join(f"t{k}" for k in range(30))
    doc = "a b " + " ".join(f"t{k}" for k in range(15, 30)) + " c " + " ".join(f"t{k}" for k in range(15))
    d = spark.createDataFrame([(1, doc)], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    (row,) = tiling.leaks(d, b).collect()
    assert row["coverage"] == 1 and row["n_tiles"] == 2
    for t in row["tiles"]:
        n = t["length"]
        assert words(doc)[t["doc_start"] : t["doc_start"] + n] == words(item)[t["item_start"] : t["item_start"] + n]


def test_long_and_monotonous_texts(spark):
    d = spark.createDataFrame([(1, "of " * 300_000), (2, "x " * 200_000 + "a b c d e f g")], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "of " * 12), (2, "a b c d e f g")], "item_id bigint, text string")
    assert set(found(tiling.leaks(d, b))) == {(1, 1), (2, 2)}
