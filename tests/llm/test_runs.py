from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reviewlytics.llm import runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(words, least=6, times=4):
    """All maximal repetitions: the stretches of every period, kept where no smaller one holds."""
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            start, length = i, j - i + q
            if length >= max(least, times * q):
                smaller = any(
                    all(words[k] == words[k + p] for k in range(start, start + length - p)) for p in range(1, q)
                )
                if not smaller:
                    out.append((start, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("words,times", [(6, 4), (2, 2), (9, 3)])
def test_random_sequences(words, times):
    rng = random.Random(words)
    texts = []
    for k in range(300):
        n = rng.randint(0, 60)
        t = [rng.choice(["a", "b", "c"][: 1 + k % 3]).encode() for _ in range(n)]
        if n and k % 2:
            p = rng.randint(1, 1 + n // 4)
            a = rng.randint(0, n - 1)
            t = [t[i] if i < a else t[min(a + (i - a) % p, n - 1)] for i in range(n)]
        texts.append(t)
    assert runs.runs_of(texts, words, times) == [brute(t, words, times) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=40), max_size=4))
def test_any_sequences(texts):
    assert runs.runs_of(texts) == [brute(t) for t in texts]
    assert runs.runs_of(texts, 2, 2) == [brute(t, 2, 2) for t in texts]


def test_long_texts_and_blocks(monkeypatch):
    monkeypatch.setattr(runs, "_BLOCK", 4)
    one = [b"a"] * 3000
    turning = [b"x%d" % (k % 37) for k in range(5000)]
    nested = ([b"a"] * 8 + [b"b"]) * 30
    assert runs.runs_of([one, turning, [], nested]) == [[(0, 3000, 1)], [(0, 5000, 37)], [], brute(nested)]


def test_places():
    rng = random.Random(1)
    values = rng.sample(range(10_000), 3000)
    p = runs.Places(values[0])
    for x in values[1:]:
        p.add(x)
    order = sorted(values)
    assert list(p) == order and p.size == 3000
    for k in (0, 1, 1500, 2999):
        assert p.around(order[k]) == (order[k - 1] if k else -1, order[k + 1] if k < 2999 else -1)


def turned(doc_id, text):
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def plain(doc_id, text):
    words = turned(doc_id, text)
    found = brute(words)
    dropped = {k for s, n, q in found for k in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (
        doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        sha("".join(f"{s},{n},{q}\n" for s, n, q in found)),
        sha(" ".join(w for k, w in enumerate(words) if k not in dropped)),
    )


def test_digests_against_plain_version(spark):
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 80)))) for k in range(200)]
    rows += [(7, "x x x x x x"), (7, "x x x x x x"), (7, "é é " * 9), (None, "b c " * 6), (8, None), (9, ""), (10, " \t\n"), (11, "a\x0bb\x0c" * 12)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df = df.selectExpr("*", "1 AS runs", "2 AS kept", "3 AS h", "CAST(NULL AS int) AS collapsed").repartition(3)
    got = [tuple(r) for r in runs.run_digests(runs.periodic_runs(runs.with_stutter(df))).collect()]
    assert sorted(got, key=str) == sorted((plain(*r) for r in rows), key=str)
    empty = runs.run_digests(runs.periodic_runs(runs.with_stutter(df.where("false"))))
    assert empty.count() == 0
    assert dict(empty.dtypes) == {
        "doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint",
        "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string",
    }


def test_supplied_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 20000")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in runs.run_digests(runs.periodic_runs(runs.with_stutter(docs))).collect()]
    assert sorted(got, key=str) == sorted((plain(*r) for r in rows), key=str)
