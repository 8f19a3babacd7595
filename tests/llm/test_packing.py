from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from reviewlytics.llm import encoding, packing
from reviewlytics.llm.queries import vocabulary

PATH = vocabulary("word_bpe_49k.json")


def plain(histogram, limit):
    """Best-two-fit bin by bin, on a list of pieces."""
    left = sorted(Counter(histogram).elements())
    bins = []
    while left:
        bin_, gap = [], limit
        for x in reversed(list(left)):
            if x <= gap:
                bin_.append(x)
                left.remove(x)
                gap -= x
        if gap and len(bin_) > 1:
            small = bin_[-1]
            pairs = [(a + b, a, b) for i, a in enumerate(left) for b in left[:i] if small < a + b <= gap + small]
            if pairs:
                total, a, b = max(pairs)
                bin_[-1:] = [a, b]
                left.remove(a)
                left.remove(b)
                left = sorted([*left, small])
        bins.append(bin_)
    return bins


@pytest.mark.parametrize("seed", range(6))
def test_plan_uses_every_piece_once_and_as_few_bins(seed):
    rng = np.random.default_rng(seed)
    pieces = rng.integers(1, 101, 150) if seed % 2 else rng.geometric(0.05, 200).clip(1, 100)
    histogram = Counter(pieces.tolist())
    plan = packing.best_two_fit(histogram, 100)
    used = Counter()
    for bin_, times in plan:
        assert sum(bin_) <= 100 and times > 0
        for x in bin_:
            used[x] += times
    assert used == histogram
    bins = sum(times for _, times in plan)
    assert abs(bins - len(plain(histogram, 100))) <= 1
    assert bins <= 1.1 * max(-(-int(pieces.sum()) // 100), int((pieces > 50).sum())) + 1


def test_two_take_the_place_of_the_smallest():
    # 60 + 30 leaves 10; without the 30, 22 + 18 fill the bin.
    assert [60, 22, 18] in [b for b, _ in packing.best_two_fit({60: 1, 30: 1, 22: 1, 18: 1}, 100)]


def test_pack(spark):
    rng = np.random.default_rng(1)
    rows = [(k, "word " * int(n)) for k, n in enumerate(rng.integers(0, 60, 300))]
    rows += [(400, None), (401, ""), (402, "many words. " * 30_000), (403, "same"), (403, "same"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS length", "2 AS rank", "3 AS task")
    got = packing.pack(docs.repartition(4), PATH, limit=100, with_ids=True).collect()
    tokenizer = encoding.encoder(PATH).tokenizer
    want = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 100):
            part = ids[k : k + 100]
            want[d, k // 100, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), tuple(part)] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], tuple(r["ids"])) for r in got) == want
    places = defaultdict(list)
    for r in got:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for place in places.values():
        at = 0
        for offset, length in sorted(place):
            assert offset == at
            at += length
        assert at <= 100
    tokens = sum(r["length"] for r in got)
    assert len(places) <= 1.03 * tokens / 100 + 1
    assert packing.pack(docs.where("false"), PATH).count() == 0
