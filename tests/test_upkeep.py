"""Stored tables under change: stored totals give what a full scoring gives, and read what is new."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from reviewlytics.operators import maintenance
from reviewlytics.operators.lineage import Scratch
from reviewlytics.plans import scoring, stored_totals, upkeep
from reviewlytics.sources import tables

DAY = datetime.date(2025, 1, 1)
NEW = "hotel_name string, review_text string, reviewer_name string, review_date date, overall_rating decimal(2,1)"


@pytest.fixture
def root(make_model, tmp_path):
    m = make_model(
        [(1, "A", "X"), (2, "B", "X"), (3, "C", "Y"), (4, "D", "Y")],
        [(1, "F", "Y"), (2, "G", "Y"), (3, "Off", "N")],
        [(1, 1, "good", 1), (2, 1, "bad", -1), (3, 2, "noise", -1), (4, 3, "good", 1)],
        [(k, 1 + k % 3, ["good room", "bad noise", "good bad", "nothing"][k % 4], None, None) for k in range(40)],
    )
    root = str(tmp_path / "tables")
    tables.write_tables(m, root)
    return root


def scores(rating):
    return sorted((r.hotel_id, r.feature_id, r.score, r.total_mentions, r.positive_mentions, r.negative_mentions) for r in rating.collect())


def full(spark, root):
    return scores(scoring.calc_ratings(tables.read_tables(spark, root), updated=DAY))


@pytest.fixture
def matched(monkeypatch):
    """Numbers of reviews that were matched, call by call."""
    seen = []
    real = stored_totals.mention_totals

    def counting(review, *rest, **options):
        seen.append(review.count())
        return real(review, *rest, **options)

    monkeypatch.setattr(stored_totals, "mention_totals", counting)
    monkeypatch.setattr(upkeep, "mention_totals", counting)
    return seen


def test_stored_scores_follow_every_change(spark, root, rows, matched):
    m = upkeep.score_tables(spark, root, updated=DAY)
    assert scores(m.rating) == full(spark, root) and matched == [40]
    new = rows([("B", "good good", None, DAY, None), ("D", "noise", None, DAY, None), ("?", "x", None, DAY, None)], NEW)
    added = upkeep.add_reviews(spark, root, new, DAY, updated=DAY)
    assert scores(added.model.rating) == full(spark, root) and matched == [40, 2]
    assert [r.reason for r in added.rejected.collect()] == ["unknown hotel"]
    hotels = rows([("E", "Z", "bad bad", None)], "hotel_name string, city string, review_text string, reviewer_name string")
    hotels = hotels.withColumns({c: F.lit(None).cast("string") for c in ("address", "country")})
    hotels = hotels.withColumn("star_rating", F.lit(None).cast("decimal(2,1)"))
    more = upkeep.add_hotels(spark, root, hotels, DAY, updated=DAY).model
    assert scores(more.rating) == full(spark, root) and matched == [40, 2, 1] and more.rating.count() == 10
    gone = more.review.filter("review_id % 4 = 0").select("review_id")
    n = gone.count()
    left = upkeep.delete_reviews(spark, root, gone, updated=DAY)
    assert scores(left.rating) == full(spark, root) and matched == [40, 2, 1, n] and left.review.count() == 43 - n
    left = upkeep.delete_hotels(spark, root, left.hotel.filter("hotel_id = 2").select("hotel_id"))
    assert scores(left.rating) == full(spark, root) and left.review.filter("hotel_id = 2").count() == 0
    again = upkeep.score_tables(spark, root, updated=DAY)
    assert scores(again.rating) == full(spark, root) and matched == [40, 2, 1, n]  # nothing is matched again
    assert sorted(os.listdir(root)) == ["feature", "hotel", "rating", "review", "seed", "totals"]
    assert not [f for f in os.listdir(os.path.dirname(root)) if f != "tables"]


def test_new_seeds_match_for_their_features_only(spark, root, rows, matched):
    upkeep.score_tables(spark, root, updated=DAY)
    m = tables.read_tables(spark, root)
    new = rows([("G", "room", 1)], "feature_name string, seed_phrase string, weight int")
    with Scratch(spark) as scratch:
        tables.append_rows(maintenance.append_seeds(m, new).accepted, root, "seed", scratch)
    before = scores(tables.read_tables(spark, root).rating)
    m = upkeep.score_tables(spark, root, updated=DAY)
    assert scores(m.rating) == full(spark, root) != before
    prints = {r.feature_id for r in stored_totals.read_state(spark, root).seeds.collect()}
    assert prints == {1, 2} and matched == [40, 40]


def test_a_stop_before_the_totals_are_kept_is_made_good(spark, root, rows, monkeypatch):
    upkeep.score_tables(spark, root, updated=DAY)
    new = rows([("C", "bad", None, DAY, None)], NEW)
    monkeypatch.setattr(tables, "write_ratings", lambda *_: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError):
        upkeep.add_reviews(spark, root, new, DAY, updated=DAY)
    monkeypatch.undo()
    m = upkeep.score_tables(spark, root, updated=DAY)
    assert scores(m.rating) == full(spark, root)


def test_files_that_went_another_way_make_totals_anew(spark, root, matched):
    upkeep.score_tables(spark, root, updated=DAY)
    left = tables.read_tables(spark, root).review.filter("review_id > 20")
    tables._replace(left, f"{root}/review")
    m = upkeep.score_tables(spark, root, updated=DAY)
    assert scores(m.rating) == full(spark, root) and matched == [40, 19]


def test_another_way_of_matching_makes_totals_anew(spark, root):
    upkeep.score_tables(spark, root, updated=DAY)
    m = upkeep.score_tables(spark, root, updated=DAY, whole_word=True)
    want = scores(scoring.calc_ratings(tables.read_tables(spark, root), updated=DAY, whole_word=True))
    assert scores(m.rating) == want


def test_without_totals_the_touched_hotels_are_matched(spark, root, rows):
    m = tables.read_tables(spark, root)
    tables.write_ratings(scoring.calc_ratings(m, updated=DAY), root)
    new = rows([("B", "good", None, DAY, None)], NEW)
    assert scores(upkeep.add_reviews(spark, root, new, DAY, updated=DAY).model.rating) == full(spark, root)
    left = upkeep.delete_reviews(spark, root, m.review.filter("review_id < 5").select("review_id"), updated=DAY)
    assert scores(left.rating) == full(spark, root) and "totals" not in os.listdir(root)


def test_totals_add_up_and_cascades_keep_them(spark, root):
    m = tables.read_tables(spark, root)
    seed = m.seed.join(scoring.active_features(m.feature), "feature_id", "left_semi")
    parts = [scoring.mention_totals(m.review.filter(f"review_id % 3 = {k}"), seed) for k in range(3)]
    whole = scoring.mention_totals(m.review, seed)
    assert sorted(scoring.merge_totals(*parts).collect()) == sorted(whole.collect())
    less = scoring.merge_totals(whole, scoring.taken_away(parts[1]))
    assert sorted(less.collect()) == sorted(scoring.merge_totals(parts[0], parts[2]).collect())
    left = maintenance.cascade_delete(m, hotels=m.hotel.filter("hotel_id = 1"), features=m.feature.filter("feature_id = 2"))
    got = scoring.ratings_from_totals(left.hotel, left.feature, whole, updated=DAY)
    assert scores(got) == scores(scoring.calc_ratings(left, updated=DAY))


def test_stored_columns(spark, root):
    m = upkeep.score_tables(spark, root, updated=DAY)
    for name in ("hotel", "feature", "seed", "review"):
        assert getattr(m, name).filter("created_date is null").count() == 0
    assert m.rating.select("rating_id").distinct().count() == m.rating.count() == 8
    assert maintenance.validate(m).collect() == []
    broken = m.with_(rating=m.rating.withColumn("rating_id", F.when(F.col("feature_id") == 1, 5)))
    got = {(r.rule, r.key): r.rows for r in maintenance.validate(broken).collect()}
    assert got[("rating_id unique", "5")] == 4 and got[("rating_id not null", "1|2")] == 1


def test_a_search_skips_row_groups_of_stored_tables(spark, rows, tmp_path):
    import pyarrow.parquet as pq

    review = spark.range(60_000).select(
        F.col("id").alias("review_id"), (F.col("id") * 7919 % 600).alias("hotel_id"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("review_text"),
        F.lit(None).cast("string").alias("reviewer_name"), F.lit(None).cast("date").alias("review_date"),
        F.lit(None).cast("decimal(2,1)").alias("overall_rating"),
    )
    spark.conf.set("parquet.block.size", str(256 << 10))
    try:
        stored = tables.write_table(review.coalesce(2), str(tmp_path), "review")
    finally:
        spark.conf.unset("parquet.block.size")
    met = groups = 0
    for file in stored.inputFiles():
        meta = pq.ParquetFile(file.removeprefix("file://")).metadata
        at = [meta.schema.names.index("hotel_id")] * meta.num_row_groups
        bounds = [meta.row_group(k).column(c).statistics for k, c in enumerate(at)]
        met += sum(b.min <= 77 <= b.max for b in bounds)
        groups += len(bounds)
    assert groups >= 8 and met <= 2 * len(stored.inputFiles())
    assert stored.filter("hotel_id = 77").count() == 100


def test_a_failed_switch_moves_everything_back(spark, tmp_path):
    def table(name, n):
        spark.range(n).write.parquet(str(tmp_path / name))

    table("t/a", 1), table("t/b", 2), table("new/a", 3)
    moves = [(str(tmp_path / "new" / n), str(tmp_path / "t" / n)) for n in ("a", "b")]
    with pytest.raises(Exception, match="could not be moved|does not exist"):
        tables.switch(spark, moves)  # there is no new/b
    assert sorted(os.listdir(tmp_path / "t")) == ["a", "b"] and os.listdir(tmp_path / "new") == ["a"]
    assert [spark.read.parquet(str(tmp_path / p)).count() for p in ("t/a", "t/b", "new/a")] == [1, 2, 3]
    tables.switch(spark, moves[:1])
    assert spark.read.parquet(str(tmp_path / "t" / "a")).count() == 3 and os.listdir(tmp_path) == ["t"]
