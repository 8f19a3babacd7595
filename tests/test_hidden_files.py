"""Review files with names that Spark does not list."""

from __future__ import annotations

import io
import random

import pytest

from reviewlytics.sources import hidden_files, review_files


@pytest.mark.parametrize("step", [1, 3, 1 << 20])
def test_ranges_give_every_line_once(monkeypatch, step):
    monkeypatch.setattr(hidden_files, "_STEP", step)
    rng = random.Random(step)
    for _ in range(60):
        text = "".join(rng.choice("ab\n") for _ in range(rng.randint(0, 40))).encode()
        want = text.split(b"\n")
        want = want[:-1] if not want[-1] else want
        for size in (1, 2, 5, 64):
            got = [
                line for start in range(0, len(text), size)
                for line in hidden_files._lines(io.BytesIO(text), start, min(start + size, len(text)))
            ]
            assert got == want, (text, size)


def test_hidden_files_are_read_like_others(spark, tmp_path):
    (tmp_path / "rome").mkdir()
    (tmp_path / "_rome").mkdir()
    (tmp_path / "rome" / "deep").mkdir()
    for name in ("a.txt", "_inn é%.txt", "rome/.inn.txt", "rome/b.txt", "_rome/c.txt"):
        (tmp_path / name).write_text(f"d\ts\tin {name}\r\nd\ts\tmore")
    for name in ("_SUCCESS", ".a.txt.crc", "_old.zip", "rome/deep/_x.txt", "_empty.txt"):
        (tmp_path / name).write_text("" if "empty" in name else "d\ts\tb")
    got = review_files.read_reviews(spark, str(tmp_path), read_hidden=True).collect()
    assert sorted({r.file for r in got}) == ["_inn é%.txt", "_rome/c.txt", "a.txt", "rome/.inn.txt", "rome/b.txt"]
    assert sorted(r.review for r in got) == sorted([f"in {r}" for r in {r.file for r in got}] + ["more"] * 5)
    assert {(r.hotel, r.city) for r in got if r.file.startswith("_")} == {(" Inn É%", ""), ("C", " Rome")}


def test_a_big_file_is_split(spark, tmp_path):
    (tmp_path / "_big.txt").write_text("".join(f"d\ts\tr{k}\n" for k in range(5000)))
    size = (tmp_path / "_big.txt").stat().st_size
    lines = hidden_files.hidden_lines(spark, [((tmp_path / "_big.txt").as_uri(), "_big.txt", size)], size=9_000)
    assert lines.rdd.getNumPartitions() >= 5 and lines.distinct().count() == lines.count() == 5000
