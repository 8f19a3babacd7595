from __future__ import annotations

import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest

from reviewlytics.llm import encoding, tokenfile
from reviewlytics.llm.common import settings
from reviewlytics.llm.queries import vocabulary

PATH = vocabulary("byte_bpe_50k.json")
TEXTS = [
    "", "  a  b\n\n c ", "it's <|endoftext|> ok", " lead", "trail \n", "a\tb \t c", "ÀÉ  ß　 x  y", "12 345\n\n\n",
    "\x1c a \x1f b", "日本 語  テ", "don't  we'll\r\n x", "Mixed.Case,and:points!! (x) ", "é́ combining", "İstanbul ŞŞ",
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(spark, name):
    more = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    encoder = encoding.Encoder(vocabulary(name), remembered=500)
    texts = TEXTS + more
    for begin in range(0, len(texts), 40):
        part = [t.encode() for t in texts[begin : begin + 40]]
        ids, before = encoder.encode(np.frombuffer(b"".join(part), np.uint8), np.cumsum([0, *map(len, part)]))
        for k, text in enumerate(texts[begin : begin + 40]):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert ids[before[k] : before[k + 1]].tolist() == want


def blocks():
    rng = np.random.default_rng(0)
    out = [
        rng.integers(0, 1 << 28, 300, dtype=np.uint32), np.zeros(0, np.uint32), np.array([0, 1, (1 << 28) - 1, 5], np.uint32),
        np.repeat(np.uint32(7), 5000), rng.integers(0, 1 << 16, 2000, dtype=np.uint32),
        np.tile(rng.integers(0, 50_000, 200, dtype=np.uint32), 20),
    ]
    return out + [(rng.zipf(1.3, int(n)) % 50_000).astype(np.uint32) for n in rng.integers(1, 1500, 40)]


def test_coder_round_trip():
    ids = blocks()
    payloads = tokenfile.encode_blocks(ids)
    for a, b in zip(ids, tokenfile.decode_blocks(payloads, [len(x) for x in ids])):
        assert np.array_equal(a, b)
    assert len(payloads[3]) < 600 and len(payloads[5]) < 3000  # what repeats is predicted
    alone = tokenfile.encode_blocks([ids[6]])[0]
    assert alone == payloads[6]  # blocks do not depend on their neighbours


def test_damage_is_noticed():
    ids = blocks()
    (record,) = tokenfile.make_records([ids[6]], [[(3, 10), (None, 20)]])
    ((back, ends),) = tokenfile.read_records([record])
    assert np.array_equal(back, ids[6]) and ends == [(3, 10), (None, 20)]
    for at in (0, 5, len(record) // 2, len(record) - 1):
        bad = bytearray(record)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            tokenfile.read_records([bytes(bad)])


@pytest.mark.parametrize("block_ids", [tokenfile.BLOCK_IDS, 7])
def test_files(spark, tmp_path, block_ids):
    rows = [(9 - k, t) for k, t in enumerate(TEXTS[:9])] + [(50, None), (None, "no id"), (20, "same"), (20, "same"), (21, "long text. " * 20_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS part", "2 AS record")
    tokenfile.write_tokens(docs.repartition(3), str(tmp_path / "x"), PATH, block_ids=block_ids)
    got = tokenfile.read_tokens(spark, str(tmp_path / "x"), with_ids=True).collect()
    tokenizer = encoding.encoder(PATH).tokenizer
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted((tuple(r[c] for c in ("doc_id", "start", "n_tokens", "ids_crc32", "ids")) for r in got), key=key) == want


def test_no_documents(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    tokenfile.write_tokens(docs, str(tmp_path / "x"), PATH)
    assert tokenfile.read_tokens(spark, str(tmp_path / "x")).count() == 0


def test_memory_of_the_coder_is_a_few_times_its_lanes():
    rng = np.random.default_rng(1)
    ids = [(rng.zipf(1.3, tokenfile.BLOCK_IDS) % 50_000).astype(np.uint32) for _ in range(2048)]
    tracemalloc.start()
    payloads = tokenfile.encode_blocks(ids)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20  # 8 MB of ids
    assert np.array_equal(tokenfile.decode_blocks(payloads[-1:], [len(ids[-1])])[0], ids[-1])


def test_tasks_get_whole_texts_in_small_batches(spark, tmp_path, monkeypatch):
    def sizes(path, end_id, block_ids):
        def run(batches):
            for k, batch in enumerate(batches):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x], t) for x, t in ((0, pa.int32()), (k, pa.int32()), (batch.nbytes, pa.int32()), (b"", pa.binary()))],
                    names=["part", "block", "n_ids", "record"],
                )

        return run

    monkeypatch.setattr(tokenfile, "_records", sizes)
    spark.range(1500).selectExpr("id AS doc_id", "repeat('word ', 2000) AS text").write.parquet(str(tmp_path / "docs"))
    before = [spark.conf.get(key, None) for key in tokenfile.SMALL_BATCHES]
    tokenfile.write_tokens(spark.read.parquet(str(tmp_path / "docs")), str(tmp_path / "x"), PATH)
    got = [r["n_ids"] for r in spark.read.parquet(str(tmp_path / "x")).collect()]
    assert sum(got) > 15_000_000 and max(got) < 2 * tokenfile.TEXT_BYTES
    assert [spark.conf.get(key, None) for key in tokenfile.SMALL_BATCHES] == before


def test_settings_come_back(spark):
    one, two = "spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize"
    spark.conf.set(two, "2048")
    try:
        with pytest.raises(ZeroDivisionError), settings(spark, {one: "1000", two: "64"}):
            assert [spark.conf.get(key) for key in (one, two)] == ["1000", "64"]
            1 / 0
        assert spark.conf.get(one, None) is None and spark.conf.get(two) == "2048"
    finally:
        spark.conf.unset(two)


@pytest.fixture
def few_renewals(monkeypatch):
    """Fails a coder whose intervals are renewed without end."""
    left, real = [20_000], tokenfile._renewed

    def counted(low, size):
        left[0] -= 1
        assert left[0] > 0, "an interval is renewed without end"
        return real(low, size)

    monkeypatch.setattr(tokenfile, "_renewed", counted)


def test_interval_of_one_whole_word_is_renewed_once(few_renewals):
    word = 1 << 48
    # Cut at the word's end the second to fourth become 2^48 values of one word; the first and the last have them at once.
    lows = [word, 2 * word - (1 << 32), 2 * word - (1 << 16), 2 * word - 1, 0xFFFF * word]
    coder = tokenfile._Coder(len(lows), 16)
    coder.low[:], coder.size[:] = lows, [word, word - 1, word - 1, word - 1, word]
    coder.renew(len(lows))
    assert (coder.size > word).all() and coder.at.tolist() == [1, 2, 3, 4, 1]


def test_blocks_whose_interval_fills_a_word_survive(few_renewals):
    for seed, phrases, length, lane in ((92, 8, 40, 930), (538, 20, 20, 296)):
        rng = np.random.default_rng(seed)
        known = rng.integers(0, 50_000, (phrases, length)).astype(np.uint32)
        blocks = [known[rng.integers(0, phrases, 1024 // length + 1)].ravel()[:1024] for _ in range(lane + 1)]
        payloads = tokenfile.encode_blocks(blocks[-2:])
        for got, ids in zip(tokenfile.decode_blocks(payloads, [1024, 1024]), blocks[-2:]):
            assert np.array_equal(got, ids)
