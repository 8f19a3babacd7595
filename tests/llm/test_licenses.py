from __future__ import annotations

import random
import re

import numpy as np

from reviewlytics.llm import licenses
from reviewlytics.llm.license_texts import NOTICES


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingle_list(text, width=licenses.WIDTH):
    w = words(text)
    return [tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))] if w else []


def brute(text):
    """Notices of which enough shingles stand in some stretch of three lengths."""
    have, out = shingle_list(text), set()
    for name, notice in NOTICES.items():
        want = set(shingle_list(notice))
        n = len(shingle_list(notice))
        if any(len(want & set(have[i : i + 3 * n])) >= licenses.CONTAINMENT * len(want) for i in range(len(have))):
            out.add(name)
    return out


def test_against_brute_force(spark):
    rnd = random.Random(4)
    some = lambda n: " ".join(rnd.choice("alpha beta gamma delta free software public work the".split()) for _ in range(n))
    rows = [(k, some(rnd.randrange(0, 60)) + "\n" + t + " " + some(rnd.randrange(0, 60))) for k, t in enumerate(NOTICES.values())]
    rows += [(100 + k, t.upper()) for k, t in enumerate(NOTICES.values())]
    for k, t in enumerate(NOTICES.values()):  # one word changed
        w = t.split()
        w[len(w) // 2] = "changed"
        rows.append((200 + k, some(40) + " " + " ".join(w) + " " + some(40)))
    rows += [(300, None), (301, ""), (302, "Released under the MIT"), (303, some(100_000) + " Released under the MIT License. " + some(10))]
    rows += [(304, "Licensed under CC BY-NC 4.0.")] * 2 + [(None, "Licensed under CC BY-NC 4.0.")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS license", "2 AS places")
    got: dict = {}
    for r in licenses.scan(docs.repartition(3)).collect():
        got.setdefault(r["doc_id"], []).append(r["license"])
    # Where the counts lie at the border of what a window holds, either is right.
    for i, text in rows:
        if i != 304:
            assert set(got.get(i, [])) == brute(text), (i, text)
    assert got[304] == ["CC-BY-NC-line"] * 2
    assert licenses.scan(docs.where("false")).count() == 0


def test_places(spark):
    text = "héllo Licensed under the Apache License, Version 2.0. More, and licensed under the apache license version 2.0"
    (row,) = licenses.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    raw = text.encode()
    cut = [raw[p["start"] : p["end"]].decode() for p in row["places"]]
    assert row["license"] == "Apache-2.0-line" and row["containment"] == 1.0
    assert cut[0].startswith("Licensed under the Apache") and cut[-1].endswith("version 2.0")


def test_bands_retrieve_edited_notices():
    index = licenses.Index(NOTICES, licenses.WIDTH, licenses.BANDS, licenses.ROWS)
    assert all(high <= licenses.SPREAD * low for low, high, _ in index.classes)
    rnd = random.Random(5)
    missed = tried = 0
    for name, notice in NOTICES.items():
        for _ in range(20):
            w = notice.split()
            w[rnd.randrange(len(w))] = "changed"
            text = " ".join(f"x{rnd.randrange(99)}" for _ in range(rnd.randrange(80))) + " " + " ".join(w) + " y" * 70
            if len(set(shingle_list(notice)) & set(shingle_list(text))) < licenses.CONTAINMENT * len(set(shingle_list(notice))):
                continue
            raw = np.frombuffer(text.encode(), np.uint8)
            hashes = licenses.shingles(raw, np.array([0, len(raw)]), licenses.WIDTH)[0]
            tried += 1
            missed += all(index.names[k] != name for _, _, k in index.retrieve(hashes))
    assert tried > 50 and missed <= 0.01 * tried
