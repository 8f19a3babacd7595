from __future__ import annotations

import hashlib
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewlytics.llm import repeats

LENGTH, GRAM = 24, 8


def brute(rows, length):
    texts = [(d, (x or "").encode()) for d, x in rows]
    starts = Counter(x[i : i + length] for _, x in texts for i in range(len(x) - length + 1))
    out = []
    for d, x in texts:
        gone = [False] * len(x)
        for i in range(len(x) - length + 1):
            if starts[x[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def made_up(seed):
    rnd = random.Random(seed)
    some = lambda n, letters="abcdé ": "".join(rnd.choice(letters) for _ in range(n))
    passages = [some(40, "abcdefghij ") for _ in range(6)]
    rows = []
    for i in range(120):
        kind = rnd.random()
        old = (rnd.choice(rows)[1] or "") if rows else ""
        if kind < 0.1:
            x = None
        elif kind < 0.15:
            x = ""
        elif kind < 0.3:
            x = some(rnd.randrange(5, 30), "ab") * rnd.randrange(1, 6)
        elif kind < 0.5:
            x = some(rnd.randrange(60)) + rnd.choice(passages)[rnd.randrange(12) : rnd.randrange(28, 41)] + some(rnd.randrange(60))
        elif kind < 0.6:
            x = "a" * rnd.randrange(20, 80) + some(3)
        elif kind < 0.7:
            x = old
        elif kind < 0.8:
            at = rnd.randrange(len(old) + 1)
            x = old[:at] + "Z" + old[at:]
        else:
            x = some(rnd.randrange(150), "abcdefghijklmnop")
        rows.append((i if rnd.random() < 0.95 else None, x))
    return rows + rows[:4]


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_removed_bytes_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rows = made_up(hot)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS h", "2 AS spans")
    out = repeats.remove_repeats(docs.repartition(3), LENGTH, GRAM)
    got = sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in out.collect()), key=str)
    assert got == brute(rows, LENGTH)
    assert repeats.remove_repeats(docs.where("false"), LENGTH, GRAM).count() == 0


def test_groups_are_repeats_with_all_occurrences(spark):
    rows = [r for r in made_up(5) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = {d: (x or "").encode() for d, x in rows}
    groups = defaultdict(set)
    for r in repeats.repeat_groups(docs, LENGTH, GRAM).collect():
        groups[r["repeat"]].add((r["doc_id"], r["start"], r["n_bytes"]))
    for places in groups.values():
        strings = {texts[d][a : a + n] for d, a, n in places}
        assert len(strings) == 1
        (string,) = strings
        assert len(string) >= LENGTH
        every = {(d, i) for d, x in texts.items() for i in range(len(x)) if x.startswith(string, i)}
        assert len(every) > 1 or len(rows) > len(texts)
        assert {(d, a) for d, a, _ in places} <= every


def all_groups(rows, length, gram):
    """Each maximal repeat around an anchor with all its places, by trying every pair of ends."""
    texts = [(d, (x or "").encode()) for d, x in rows]
    places, expected = defaultdict(list), {}
    for d, x in texts:
        data = np.frombuffer(x, np.uint8)
        row, lo, span, back, _, _ = repeats.anchors(data, np.array([0, len(x)]), length, gram)
        for a, s, b in zip(lo.tolist(), span.tolist(), back.tolist()):
            places[x[a + b : a + b + gram]].append((d, a + b, x[a : a + b][::-1], x[a + b : a + s + length]))
    for found in places.values():
        for e, l in {(e, l) for p in found for e in range(len(p[2]) + 1) for l in range(gram, len(p[3]) + 1) if e + l >= length}:
            same = defaultdict(list)
            for p in found:
                if len(p[2]) >= e and len(p[3]) >= l:
                    same[p[2][:e][::-1] + p[3][:l]].append(p)
            for string, members in same.items():
                ends = [len(os.path.commonprefix([p[k] for p in members])) for k in (2, 3)]
                if len(members) > 1 and ends == [e, l]:
                    assert string not in expected
                    expected[string] = Counter((p[0], p[1] - e) for p in members)
    return expected


@pytest.mark.parametrize("hot", [repeats.HOT, 3])
def test_groups_hold_every_occurrence(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    rnd = random.Random(7)
    some = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    shared = some(30)
    sides = [(some(30), some(30)) for _ in range(2)]
    # Each context of ``shared`` occurs twice, in two surroundings.
    rows = [(1000 + i, p + shared + q) for i, (p, q) in enumerate(s for s in sides for _ in range(2))]
    rows += [(2000 + i, some(9) + shared + "xy"[i % 2] + some(i)) for i in range(12)]
    rows += [(3000 + i, shared) for i in range(2)]
    rows += [r for r in made_up(5) if r[0] is not None]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    texts = {d: (x or "").encode() for d, x in rows}
    groups = defaultdict(list)
    for r in repeats.repeat_groups(docs.repartition(3), LENGTH, GRAM).collect():
        groups[r["repeat"]].append((r["doc_id"], r["start"], r["n_bytes"]))
    got = {}
    for places in groups.values():
        (string,) = {texts[d][a : a + n] for d, a, n in places}
        assert string not in got
        got[string] = Counter((d, a) for d, a, _ in places)
    expected = all_groups(rows, LENGTH, GRAM)
    assert got == expected
    for string, places in got.items():
        assert set(places) == {(d, i) for d, x in texts.items() for i in range(len(x)) if x.startswith(string, i)}
    surroundings = [s for s, places in got.items() if s in shared.encode() and set(range(1000, 1004)) <= {d for d, _ in places}]
    assert surroundings


def test_long_text(spark):
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcdefgh ") for _ in range(3_000_000))
    rows = [(1, base), (2, "x" * 50 + base[1_000_000:1_000_500])]
    out = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), with_text=False).collect()}
    assert (out[1]["n_removed"], out[2]["n_removed"], out[1]["n_spans"]) == (500, 500, 1)
