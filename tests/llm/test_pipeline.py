from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from tests.llm.test_minhash import brute as near
from tests.llm.test_repeats import brute as repeated
from tests.llm.test_tiling import brute as covered

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returned, written and read again."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, out[-1], SF_DIR).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_columns_and_order_of_stages(stages):
    assert [len(x) for x in corpus_pipeline.STAGES] == [2] * 5
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns and df.dtypes == stages[0].dtypes


def test_language_keeps_texts_with_letters(stages):
    before, after = rows(stages[0]), rows(stages[1])
    assert set(after) == {d for d, r in before.items() if re.search(r"[^\W\d_]", r["text"] or "")}
    assert all(after[d] == before[d] for d in after)


def test_near_duplicates_leave_one_of_each_group(stages):
    before, after = rows(stages[1]), rows(stages[2])
    groups = near([(d, r["text"]) for d, r in before.items()], 5)
    assert set(after) == {d for d, (_, c) in groups.items() if c == d}


def test_repeats_are_cut(stages):
    before, after = rows(stages[2]), rows(stages[3])
    want = {d: n - gone for d, n, gone, _, _ in repeated([(d, r["text"]) for d, r in before.items()], 200)}
    assert set(after) == set(before)
    for d, r in after.items():
        assert want[d] - 6 <= len(r["text"].encode()) <= want[d] and r["n_chars"] == len(r["text"])


def test_leaks_go(spark, stages):
    before, after = rows(stages[3]), rows(stages[4])
    items = [r["text"] for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    fives = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", t.lower())] for i in range(len(w) - 4)}
    seeds = [fives(t) for t in items]
    leaking = set()
    for d, r in before.items():
        mine = fives(r["text"])
        words = r["text"].split()
        for t, s in zip(items, seeds):
            if mine & s and len(words) < 3000 and covered(r["text"], t, 5) >= 0.5:
                leaking.add(d)
    assert leaking == set(before) - set(after) and leaking


def test_sequences(stages):
    pieces = stages[5].collect()
    assert {p["doc_id"] for p in pieces} == set(rows(stages[4]))
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append((p["offset"], p["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert max(Counter((p["doc_id"], p["piece"]) for p in pieces).values()) == 1


def test_run_is_the_stages_in_turn(spark, stages):
    want = Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in stages[5].collect())
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF_DIR).collect()) == want


def test_odd_rows_and_clashing_columns(spark):
    long = "word%d " * 60
    rows = [(k, (long % tuple(range(k * 7, k * 7 + 60))), "en") for k in range(1, 9)]
    rows += [(20, None, None), (21, "", "en"), (22, "12 34", "en"), (None, "a text without an id", None), (23, "one text of an id", "en"), (23, "quite another text here", None), (1, rows[0][1], "en")]
    names = ("lang_pred", "score", "lang_set", "kept_text", "n_bytes", "n_removed", "h", "row", "kept", "spans", "gram", "c", "key", "a b")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr(
        "*", "'s' AS source", "CAST(length(text) AS bigint) AS n_chars", *[f"{k} AS `{n}`" for k, n in enumerate(names)]
    )
    for df in (docs, docs.where("false")):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
            got = stage(spark, df, SF_DIR)
            assert got.columns == docs.columns and got.dtypes == docs.dtypes
            kept = got.collect()
            assert all([r[n] for n in names] == list(range(len(names))) for r in kept)
            if df is docs and k == 0:
                assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(d) for d, t, _ in rows if re.search("[a-z]", t or ""))
            if df is docs and k == 1:  # equal rows are one document, other texts of an id are not lost
                assert len(kept) == len(rows) - 1
        assert corpus_pipeline.pack_sequences(spark, df, SF_DIR).count() == df.count()
