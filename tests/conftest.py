from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from reviewlytics.operators.bounded import local_rows  # noqa: E402
from reviewlytics.schema import Model  # noqa: E402
from reviewlytics.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, app="tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """rows([...], "a bigint, b string") -> DataFrame"""

    def make(values, schema):
        if not values:
            return spark.createDataFrame([], schema)
        if any(v is None for row in values for v in row) or "decimal" in schema or "date" in schema:
            return spark.createDataFrame(values, schema).coalesce(2)
        return local_rows(spark, values, schema)

    return make


@pytest.fixture(scope="session")
def make_model(rows):
    """A model from plain tuples; ratings are given as (hotel, feature, score)."""
    from decimal import Decimal

    def make(hotels, features, seeds, reviews, ratings=None) -> Model:
        number = lambda v: None if v is None else Decimal(str(v))
        m = Model(
            hotel=rows(
                [(i, n, None, c, "X", None) for i, n, c in hotels],
                "hotel_id bigint, hotel_name string, address string, city string,"
                " country string, star_rating decimal(2,1)",
            ),
            feature=rows(
                [(i, n, None, a) for i, n, a in features],
                "feature_id bigint, feature_name string, description string, is_active string",
            ),
            seed=rows(
                [(i, f, p, number(w)) for i, f, p, w in seeds],
                "seed_id bigint, feature_id bigint, seed_phrase string, weight decimal(2,0)",
            ),
            review=rows(
                [(i, h, t, None, d, number(r)) for i, h, t, d, r in reviews],
                "review_id bigint, hotel_id bigint, review_text string, reviewer_name string,"
                " review_date date, overall_rating decimal(2,1)",
            ),
        )
        if ratings is not None:
            m = m.with_(
                rating=rows(
                    [(h, f, number(s), 0, None, None, None) for h, f, s in ratings],
                    "hotel_id bigint, feature_id bigint, score decimal(5,2),"
                    " total_mentions bigint, positive_mentions bigint,"
                    " negative_mentions bigint, last_updated date",
                )
            )
        return m

    return make


@pytest.fixture(scope="session")
def plan_of():
    """Executed plan as text (before adaptive changes)."""

    def text(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    return text
