"""Stored tables kept up to date: rows are added or deleted, and their hotels scored again.

With stored totals (``score_tables`` makes them, see ``stored_totals``) only added texts are matched, and the texts of deleted
reviews once more to subtract them. Without totals all reviews of the touched hotels are matched.
"""

from __future__ import annotations

import datetime
import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from reviewlytics.operators import maintenance
from reviewlytics.operators.bounded import restrict_to_keys
from reviewlytics.operators.lineage import Scratch
from reviewlytics.plans import stored_totals
from reviewlytics.plans.scoring import (
    mention_totals, merge_totals, ratings_from_totals, refresh_hotels, taken_away,
)
from reviewlytics.schema import Model
from reviewlytics.sources import tables


class Added(NamedTuple):
    """The stored tables after the change; ``rejected``: key, reason, rows."""

    model: Model
    rejected: DataFrame


def _matching(scoring: dict) -> dict:
    """The options of a scoring that the totals depend on."""
    return {k: scoring[k] for k in ("limits", "whole_word") if k in scoring}


def _valuing(scoring: dict) -> dict:
    return {k: v for k, v in scoring.items() if k not in ("limits", "whole_word")}


def score_tables(spark: SparkSession, root: str, **scoring) -> Model:
    """Score the tables under ``root`` (options as ``calc_ratings``) and store ratings and totals.

    What has been counted before is not matched again: new files of reviews are, and the seeds of features whose
    seeds have changed. Rating rows of hotels that nothing has changed for stay as they are.
    """
    state = stored_totals.bring_up_to_date(spark, root, **_matching(scoring))
    m = tables.read_tables(spark, root)
    touched = state.touched
    if touched is None:
        rating = ratings_from_totals(m.hotel, m.feature, state.totals, **_valuing(scoring))
    else:
        unrated = m.hotel.join(m.rating.select("hotel_id").distinct(), "hotel_id", "left_anti")
        touched = touched.unionByName(unrated.select("hotel_id"))
        if touched.isEmpty():
            return m
        rating = refresh_hotels(m, touched, state.totals, **scoring)
    tables.write_ratings(rating, root)
    state.keep()
    return tables.read_tables(spark, root)


def add_reviews(
    spark: SparkSession, root: str, new: DataFrame, today: datetime.date | None = None, **scoring
) -> Added:
    """Add reviews (see ``maintenance.append_reviews``) to the tables under ``root`` and score their
    hotels again. Ids are written before anything refers to them."""
    result = maintenance.append_reviews(tables.read_tables(spark, root), new, today)
    with Scratch(spark) as scratch:
        added = tables.append_rows(result.accepted, root, "review", scratch)
        return _rescored(spark, root, added, result.rejected, scoring)


def add_hotels(
    spark: SparkSession, root: str, new: DataFrame, today: datetime.date | None = None, **scoring
) -> Added:
    """Add hotels, each with its first review (see ``maintenance.append_hotels_with_review``), to
    the tables under ``root`` and score them."""
    before = tables.read_tables(spark, root)
    result = maintenance.append_hotels_with_review(before, new, today)
    with Scratch(spark) as scratch:
        # Both are numbered from the same tables, so both are computed before either is appended.
        reviews = scratch.store(result.accepted_reviews, "reviews")
        hotels = tables.append_rows(result.accepted, root, "hotel", scratch)
        tables.append_rows(reviews, root, "review", scratch)
        return _rescored(spark, root, hotels, result.rejected, scoring)


def _rescored(spark, root, touched: DataFrame, rejected: DataFrame, scoring) -> Added:
    if stored_totals.read_state(spark, root) is not None:
        return Added(score_tables(spark, root, **scoring), rejected)
    m = tables.read_tables(spark, root)
    tables.write_ratings(refresh_hotels(m, touched.select("hotel_id"), **scoring), root)
    return Added(tables.read_tables(spark, root), rejected)


def delete_reviews(spark: SparkSession, root: str, deleted: DataFrame, **scoring) -> Model:
    """Delete reviews (review_id) from the tables under ``root`` and score their hotels again.

    The review table is written anew without them. With stored totals, up to date, only the deleted
    reviews are matched, to be subtracted.
    """
    counted = stored_totals.read_state(spark, root) is not None
    m = score_tables(spark, root, **scoring) if counted else tables.read_tables(spark, root)
    [gone] = restrict_to_keys([m.review], "review_id", deleted)
    [review] = restrict_to_keys([m.review], "review_id", deleted, exclude=True)
    touched = gone.select("hotel_id").distinct()
    left = m.with_(review=review)
    if not counted:
        return _replaced(spark, root, left.with_(rating=refresh_hotels(left, touched, **scoring)), ["review", "rating"])
    state = stored_totals.read_state(spark, root)
    seed = m.seed.join(state.seeds.select("feature_id"), "feature_id", "left_semi")
    lost = mention_totals(gone, seed, **_matching(scoring))
    totals = merge_totals(state.pairs, taken_away(lost))
    rating = refresh_hotels(left, touched, totals, **scoring)
    return _replaced(spark, root, left.with_(rating=rating), ["review", "rating"], (totals, state.seeds))


def delete_hotels(spark: SparkSession, root: str, deleted: DataFrame) -> Model:
    """Delete hotels (hotel_id) with their reviews and ratings from the tables under ``root``.

    No other hotel's score depends on them, so nothing is matched or scored.
    """
    m = tables.read_tables(spark, root)
    left = maintenance.cascade_delete(m, hotels=deleted)
    state, counted = stored_totals.read_state(spark, root), None
    # Totals that do not count every file would be taken for whole: they are left out and made anew.
    if state is not None and {r.file for r in state.files.toLocalIterator()} == stored_totals.file_names(m.review).keys():
        [pairs] = restrict_to_keys([state.pairs], "hotel_id", deleted, exclude=True)
        counted = (pairs, state.seeds)
    return _replaced(spark, root, left, ["hotel", "review", "rating"], counted)


def _replaced(spark, root: str, m: Model, names: list[str], counted: tuple[DataFrame, DataFrame] | None = None) -> Model:
    """Store the named tables of ``m`` in place of the old ones, and the totals that count its
    reviews (pairs, prints of the seeds) after them."""
    fresh = f"{root.rstrip('/')}-new-{uuid.uuid4().hex}"
    for name in names:
        tables.write_table(getattr(m, name), fresh, name)
    keep = None
    if counted is not None:
        files = stored_totals.file_names(spark.read.parquet(f"{fresh}/review"))
        _, keep = stored_totals.write_state(spark, root, counted[0], files, counted[1])
    tables.switch(spark, [(f"{fresh}/{name}", f"{root.rstrip('/')}/{name}") for name in names])
    if keep:
        keep()
    return tables.read_tables(spark, root)
