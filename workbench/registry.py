"""Registered queries: key -> (Spark callable, SQL twin)."""

from __future__ import annotations

import datetime
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlytics.functions import clean
from reviewlytics.functions.numbers import exact_mean, round_half_even, round_half_up
from reviewlytics.functions.text import phrase_count, sentences, words
from reviewlytics.operators import maintenance
from reviewlytics.operators.bounded import join_dimension
from reviewlytics.operators.ids import assign_ids
from reviewlytics.operators.lineage import scratch_folder, written
from reviewlytics.plans import mining, scoring, search, sentiment, upkeep, views
from reviewlytics.plans.aspects import ASPECTS, WordLookups, keyword_lemmas
from reviewlytics.schema import RATING_TYPE, Model
from reviewlytics.sources import exports, review_files, tables
from workbench import oracle as O
from workbench.binding import UPDATED, Binding, one_line, per_type, review_file

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}


def register(key: str, sql: str | None = None):
    """Register ``f(b: Binding) -> DataFrame`` under ``key``."""

    def add(f: Callable[[Binding], DataFrame]):
        REGISTRY[key] = Registered(lambda spark, sf_dir: f(Binding(spark, sf_dir)), sql)
        return f

    return add


def double(column: str):
    return F.col(column).cast("double").alias(column)


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd").alias(column)


SQL_DAY = "strftime({0}, '%Y-%m-%d') AS {0}"
RATING_SQL = """SELECT hotel_id, feature_id, CAST(score AS DOUBLE) AS score, total_mentions,
    positive_mentions, negative_mentions FROM rating"""
RATING_COLUMNS = (
    "hotel_id", "feature_id", "score", "total_mentions", "positive_mentions", "negative_mentions"
)


def rating_rows(rating: DataFrame) -> DataFrame:
    return rating.select(*[double(c) if c == "score" else c for c in RATING_COLUMNS])


# --- scoring ---------------------------------------------------------------------------------


@register("calc_ratings", O.query(RATING_SQL))
def calc_ratings(b: Binding) -> DataFrame:
    return rating_rows(scoring.calc_ratings(b.model(rating=False), updated=UPDATED))


@register(
    "seed_review_match",
    O.query("SELECT review_id, hotel_id, seed_id, feature_id, weight, mentions FROM hit"),
)
def seed_review_match(b: Binding) -> DataFrame:
    return scoring.seed_review_match(b.review(), b.seed())


@register(
    "seed_matches_review",
    O.query("SELECT review_id, count(*) AS matching_seeds FROM hit GROUP BY review_id"),
)
def seed_matches_review(b: Binding) -> DataFrame:
    hits = scoring.seed_review_match(b.review(), b.seed())
    return hits.groupBy("review_id").agg(F.count(F.lit(1)).alias("matching_seeds"))


@register(
    "seed_review_cross",
    O.query(
        """SELECT seed_phrase, feature_id, coalesce(mentions, 0) AS total_mentions
        FROM seed LEFT JOIN seed_total USING (seed_id)"""
    ),
)
def seed_review_cross(b: Binding) -> DataFrame:
    totals = views.seed_mentions(b.model(rating=False))
    return b.seed().join(totals, "seed_id", "left").select(
        "seed_phrase", "feature_id", F.coalesce("mentions", F.lit(0)).alias("total_mentions")
    )


@register("review_feature_sentiment", O.query("SELECT * FROM sentiment"))
def review_feature_sentiment(b: Binding) -> DataFrame:
    return scoring.review_feature_sentiment(b.review(), b.seed())


@register(
    "hotel_feature_mentions",
    O.query(
        f"""SELECT hotel_id, feature_id, total_mentions, positive_mentions, negative_mentions,
        {O.up('avg_sentiment', 6)} AS avg_sentiment FROM mention"""
    ),
)
def hotel_feature_mentions(b: Binding) -> DataFrame:
    found = scoring.hotel_feature_mentions(scoring.review_feature_sentiment(b.review(), b.seed()))
    return found.withColumn("avg_sentiment", round_half_up(F.col("avg_sentiment"), 6))


# Phrases as whole words: where a text has a phrase's first word, the following words are compared.
WHOLE_WORD_HIT = r"""
    WITH text_words AS MATERIALIZED (
        SELECT review_id, hotel_id, overall_rating, regexp_extract_all(lower(review_text), '[\p{L}\p{N}_]+') AS w
        FROM review),
    phrase_words AS MATERIALIZED (
        SELECT seed_id, feature_id, weight, regexp_extract_all(lower(seed_phrase), '[\p{L}\p{N}_]+') AS p FROM seed),
    begun AS MATERIALIZED (
        SELECT review_id, i, seed_id, feature_id, weight, p
        FROM (SELECT review_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM text_words) AS t
        JOIN phrase_words ON x = p[1])
    SELECT t.review_id, t.hotel_id, t.overall_rating, seed_id, feature_id, weight, count(*) AS mentions
    FROM begun AS b JOIN text_words AS t ON t.review_id = b.review_id
    WHERE len(p) = 1 OR w[i : i + len(p) - 1] = p GROUP BY ALL"""


@register("whole_word_ratings", O.query(RATING_SQL, hit=WHOLE_WORD_HIT))
def whole_word_ratings(b: Binding) -> DataFrame:
    return rating_rows(scoring.calc_ratings(b.model(rating=False), updated=UPDATED, whole_word=True))


@register(
    "whole_word_match",
    O.query("SELECT review_id, hotel_id, seed_id, feature_id, weight, mentions FROM hit", hit=WHOLE_WORD_HIT),
)
def whole_word_match(b: Binding) -> DataFrame:
    return scoring.seed_review_match(b.review(), b.seed(), whole_word=True)


@register("hotel_feature_grid", O.query("SELECT hotel_id, feature_id FROM grid"))
def hotel_feature_grid(b: Binding) -> DataFrame:
    return scoring.hotel_feature_grid(b.hotel(), b.feature())


@register("score_tables", O.query(RATING_SQL))
def score_tables(b: Binding) -> DataFrame:
    """Tables stored, scored, and their ratings and totals stored beside them."""
    root = scratch_folder(b.spark, "scored")
    tables.write_tables(b.model(rating=False), root)
    return rating_rows(upkeep.score_tables(b.spark, root, updated=UPDATED).rating)


# Reviews to add: all turns of all conversations, spread over the hotels' names.
NEW_REVIEW_SQL = """
    SELECT 'Supplier#' || lpad(CAST(conv_id % 7 * 3 AS VARCHAR), 9, '0') AS hotel_name,
           text AS review_text, CAST(NULL AS VARCHAR) AS reviewer_name,
           CASE WHEN turn > 0 THEN DATE '2025-02-01' + CAST(turn AS INTEGER) END AS review_date,
           CAST((conv_id % 12) * 0.5 AS DECIMAL(2,1)) AS overall_rating
    FROM conversations"""


def new_reviews(b: Binding) -> DataFrame:
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("conv_id") % 7 * 3).cast("string"), 9, "0"))
    later = F.date_add(F.lit(datetime.date(2025, 2, 1)), F.col("turn").cast("int"))
    return b.table("conversations").select(
        name.alias("hotel_name"), F.col("text").alias("review_text"),
        F.lit(None).cast("string").alias("reviewer_name"),
        F.when(F.col("turn") > 0, later).alias("review_date"),
        ((F.col("conv_id") % 12) * 0.5).cast(RATING_TYPE).alias("overall_rating"),
    )


REVIEW_WITH_NEW = f"""{O.CTES['review']}
    UNION ALL
    SELECT 1000000000 + row_number() OVER () AS review_id, hotel_id, review_text, reviewer_name,
           coalesce(review_date, DATE '2025-01-01') AS review_date,
           overall_rating
    FROM ({NEW_REVIEW_SQL}) AS n JOIN hotel USING (hotel_name)
    WHERE overall_rating BETWEEN 1 AND 5"""


@register("refresh_hotels", O.query(RATING_SQL, review=REVIEW_WITH_NEW))
def refresh_hotels(b: Binding) -> DataFrame:
    """Totals of the reviews there were, stored; of the added ones alone the texts are matched."""
    m = b.model(rating=False)
    added = maintenance.append_reviews(m, new_reviews(b), UPDATED).accepted
    seed = m.seed.join(scoring.active_features(m.feature).select("feature_id"), "feature_id", "left_semi")
    before = written(scoring.mention_totals(m.review, seed), "totals")
    m = m.with_(rating=scoring.ratings_from_totals(m.hotel, m.feature, before, updated=UPDATED))
    now = scoring.merge_totals(before, scoring.mention_totals(added, seed))
    return rating_rows(scoring.refresh_hotels(m, added.select("hotel_id"), now, updated=UPDATED))


# --- views -----------------------------------------------------------------------------------


@register(
    "v_hotel_ratings",
    O.query(
        """SELECT hotel_id, hotel_name, city, country, feature_name, CAST(score AS DOUBLE) AS score,
        total_mentions, positive_mentions, negative_mentions, '2025-01-01' AS last_updated
        FROM rating JOIN feature USING (feature_id) JOIN hotel USING (hotel_id)"""
    ),
)
def v_hotel_ratings(b: Binding) -> DataFrame:
    return views.hotel_ratings(b.stored()).withColumn("last_updated", day("last_updated"))


@register(
    "hotel_ratings",
    O.query(
        """SELECT hotel_name, feature_name, CAST(score AS DOUBLE) AS score
        FROM rating JOIN feature USING (feature_id) JOIN hotel USING (hotel_id)"""
    ),
)
def hotel_ratings(b: Binding) -> DataFrame:
    return views.rating_with_names(b.stored()).select("hotel_name", "feature_name", double("score"))


@register(
    "v_hotel_overall",
    O.query(
        f"""SELECT hotel_id, hotel_name, city, country, {O.up('mean_score')} AS avg_score,
        features_rated, total_reviews FROM hotel_stat"""
    ),
)
def v_hotel_overall(b: Binding) -> DataFrame:
    return views.hotel_overall(b.stored())


# The fan-out form of the same numbers, computed as the joined rows stand.
@register(
    "hotel_overall",
    O.query(
        f"""SELECT hotel_id, hotel_name, {O.up(O.mean('score', 2))} AS avg_score,
        count(DISTINCT feature_id) AS features_rated, count(DISTINCT review_id) AS total_reviews
        FROM hotel LEFT JOIN rating USING (hotel_id) LEFT JOIN review USING (hotel_id)
        GROUP BY hotel_id, hotel_name"""
    ),
)
def hotel_overall(b: Binding) -> DataFrame:
    return views.hotel_overall(b.stored()).drop("city", "country")


@register(
    "hotel_left_chain",
    O.query(
        f"""SELECT hotel_id, {O.up('mean_score', 6)} AS mean_score,
        {O.up('mean_review', 6)} AS mean_review, features_rated, total_reviews FROM hotel_stat"""
    ),
)
def hotel_left_chain(b: Binding) -> DataFrame:
    means = [round_half_up(F.col(c), 6).alias(c) for c in ("mean_score", "mean_review")]
    stats = views.with_hotel_stats(b.stored())
    return stats.select("hotel_id", *means, "features_rated", "total_reviews")


@register(
    "v_feature_seeds",
    O.query(
        """SELECT feature_name, seed_phrase, weight,
        CASE weight WHEN 1 THEN 'Positive' WHEN -1 THEN 'Negative' END AS sentiment
        FROM seed JOIN feature USING (feature_id)"""
    ),
)
def v_feature_seeds(b: Binding) -> DataFrame:
    return views.feature_seeds(b.model(rating=False))


@register(
    "ordered_views",
    O.query(
        """SELECT feature_name, list(seed_phrase || ':' || weight ORDER BY weight DESC, seed_phrase)
        [1] AS strongest FROM seed JOIN feature USING (feature_id) GROUP BY feature_name"""
    ),
)
def ordered_views(b: Binding) -> DataFrame:
    """Head of every feature's seed list in the view's order."""
    seeds = views.feature_seeds(b.model(rating=False))
    first = F.min_by(
        F.concat("seed_phrase", F.lit(":"), F.col("weight").cast("string")),
        F.struct(-F.col("weight"), F.col("seed_phrase")),
    )
    return seeds.groupBy("feature_name").agg(first.alias("strongest"))


SEED_ANALYSIS_SQL = f"""SELECT seed_id, feature_name, seed_phrase, weight AS assigned_weight,
    coalesce(mentions, 0) AS total_mentions, {O.up('mean_rating', 6)} AS avg_user_rating_when_present,
    coalesce(mentions, 0) * weight AS total_impact_score
    FROM seed JOIN feature USING (feature_id) LEFT JOIN seed_total USING (seed_id)"""


@register("v_seed_word_analysis", O.query(SEED_ANALYSIS_SQL))
def v_seed_word_analysis(b: Binding) -> DataFrame:
    return views.seed_word_analysis(b.model(rating=False))


@register(
    "seed_word_analysis",
    O.query(
        f"""SELECT seed_phrase, feature_id, mentions, {O.up('mean_rating', 6)} AS mean_rating
        FROM seed_total JOIN seed USING (seed_id)"""
    ),
)
def seed_word_analysis(b: Binding) -> DataFrame:
    m = b.model(rating=False)
    return views.seed_mentions(m).join(m.seed, "seed_id").select(
        "seed_phrase", "feature_id", "mentions",
        round_half_up(F.col("mean_rating"), 6).alias("mean_rating"),
    )


@register(
    "seed_rating_subquery",
    O.query(
        f"""SELECT seed_phrase, feature_id, (SELECT {O.up('mean_rating', 6)} FROM seed_total AS t
        WHERE t.seed_id = s.seed_id) AS avg_rating FROM seed AS s"""
    ),
)
def seed_rating_subquery(b: Binding) -> DataFrame:
    analysis = views.seed_word_analysis(b.model(rating=False))
    return analysis.join(b.seed().select("seed_id", "feature_id"), "seed_id").select(
        "seed_phrase", "feature_id", F.col("avg_user_rating_when_present").alias("avg_rating")
    )


@register(
    "seed_totals_left",
    O.query(
        """SELECT feature_name, seed_phrase, coalesce(mentions, 0) AS total_mentions,
        coalesce(mentions, 0) * weight AS total_impact_score
        FROM seed JOIN feature USING (feature_id) LEFT JOIN seed_total USING (seed_id)"""
    ),
)
def seed_totals_left(b: Binding) -> DataFrame:
    return views.seed_word_analysis(b.model(rating=False)).select(
        "feature_name", "seed_phrase", "total_mentions", "total_impact_score"
    )


@register(
    "phrase_count",
    O.query(
        r"""SELECT review_id, CAST(len(regexp_extract_all(review_text, '(?i)fr[eo]')) AS BIGINT)
        AS mentions FROM review"""
    ),
)
def count_phrase(b: Binding) -> DataFrame:
    count = phrase_count(F.col("review_text"), F.lit("fr[eo]")).cast("bigint")
    return b.review().select("review_id", count.alias("mentions"))


# --- search ----------------------------------------------------------------------------------


CARD_COLUMNS = "hotel_id, hotel_name, city, country, overall_rating, cleanliness_score, " \
    "service_score, location_score, comfort_score, price_score, total_reviews"


@register(
    "q_hotel_rating_card",
    O.query(
        f"""SELECT {CARD_COLUMNS}, {O.band('overall_rating')} AS band,
        {O.stars('overall_rating')} AS stars FROM card
        WHERE upper(hotel_name) LIKE upper('%{O.CARD_NAME}%') ORDER BY hotel_id LIMIT 1"""
    ),
)
def q_hotel_rating_card(b: Binding) -> DataFrame:
    return search.hotel_rating_card(b.stored(), O.CARD_NAME)


@register("rating_card_scores", O.query(f"SELECT {CARD_COLUMNS} FROM card"))
def rating_card_scores(b: Binding) -> DataFrame:
    return search.rating_cards(b.stored())


RECENT_SQL = f"""SELECT coalesce(reviewer_name, 'Anonymous') AS reviewer_name, review_text,
    coalesce(strftime(review_date, '%Y-%m-%d'), '0001-01-01') AS review_date,
    coalesce(CAST(overall_rating AS DOUBLE), 0.0) AS rating
    FROM review JOIN hotel USING (hotel_id)
    WHERE upper(hotel_name) = upper('{O.REVIEWED_HOTEL}')
    ORDER BY review.review_date DESC NULLS FIRST, review_id LIMIT 50"""


@register("q_recent_reviews", O.query(RECENT_SQL))
def q_recent_reviews(b: Binding) -> DataFrame:
    found = search.recent_reviews(b.stored(), O.REVIEWED_HOTEL)
    return found.withColumn("review_date", F.col("review_date").cast("string"))


@register(
    "recent_reviews",
    O.query(
        f"""SELECT review_id, row_number() OVER (ORDER BY review_date DESC NULLS FIRST, review_id)
        AS place FROM review JOIN hotel USING (hotel_id)
        WHERE upper(hotel_name) = upper('{O.REVIEWED_HOTEL}')
        ORDER BY place LIMIT 50"""
    ),
)
def recent_review_ids(b: Binding) -> DataFrame:
    """The order made visible: places of the newest fifty (a window over 50 rows)."""
    hotel = b.hotel().filter(search.name_equals(F.col("hotel_name"), O.REVIEWED_HOTEL))
    newest = search.newest_reviews(b.review(), hotel)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_first("review_date"), "review_id"))
    return newest.select("review_id", place.cast("bigint").alias("place"))


@register("q_cities", O.query("SELECT DISTINCT city FROM hotel WHERE city IS NOT NULL"))
def q_cities(b: Binding) -> DataFrame:
    return search.cities(b.model(rating=False))


@register("distinct_cities", O.query("SELECT DISTINCT city FROM hotel"))
def distinct_cities(b: Binding) -> DataFrame:
    return b.hotel().select("city").distinct()


@register(
    "drop_null_cities", O.query("SELECT hotel_id, city FROM hotel WHERE city IS NOT NULL")
)
def drop_null_cities(b: Binding) -> DataFrame:
    return b.hotel().filter(F.col("city").isNotNull()).select("hotel_id", "city")


@register(
    "q_active_features", O.query("SELECT feature_name FROM feature WHERE is_active = 'Y'")
)
def q_active_features(b: Binding) -> DataFrame:
    return search.active_features(b.model(rating=False))


@register(
    "active_features",
    O.query("SELECT feature_id, feature_name, description FROM feature WHERE is_active = 'Y'"),
)
def active_features(b: Binding) -> DataFrame:
    return scoring.active_features(b.feature()).select("feature_id", "feature_name", "description")


LIST_SCORE = "coalesce(mean_score, mean_review, 0)"


@register(
    "q_hotels_by_city",
    O.query(
        f"""SELECT hotel_name AS name, {O.up(LIST_SCORE, 6)} AS rating,
        total_reviews AS review_count, {O.band(LIST_SCORE)} AS band
        FROM hotel_stat WHERE city = '{O.CITY}'"""
    ),
)
def q_hotels_by_city(b: Binding) -> DataFrame:
    return search.hotels_by_city(b.stored(), O.CITY)


@register(
    "hotel_list_score",
    O.query(
        f"""SELECT hotel_id, {O.up(LIST_SCORE, 6)} AS score, total_reviews FROM hotel_stat"""
    ),
)
def hotel_list_score(b: Binding) -> DataFrame:
    score = F.coalesce("mean_score", "mean_review", F.lit(0.0))
    return views.with_hotel_stats(b.stored()).select(
        "hotel_id", round_half_up(score, 6).alias("score"), "total_reviews"
    )


@register("in_city", O.query(f"SELECT hotel_id, hotel_name FROM hotel WHERE city = '{O.CITY}'"))
def in_city(b: Binding) -> DataFrame:
    return search.in_city(b.hotel(), O.CITY).select("hotel_id", "hotel_name")


REACHED = " AND ".join(f"{m} >= {v}" for m, v in O.MIN_SCORES.items())


@register(
    "q_advanced_search",
    O.query(
        f"""SELECT hotel_name, city, country, total_reviews, {O.even('overall')} AS overall_rating,
        {", ".join(f"coalesce({O.even(a)}, 0.0::DOUBLE) AS {a}_score" for a in ASPECTS)},
        {O.stars(O.even('overall'))} AS stars
        FROM pivoted JOIN hotel_stat USING (hotel_id) WHERE city = '{O.CITY}' AND {REACHED}"""
    ),
)
def q_advanced_search(b: Binding) -> DataFrame:
    return search.advanced_search(b.stored(), O.CITY, O.MIN_SCORES)


PIVOT_COLUMNS = ", ".join(ASPECTS)


@register(
    "feature_pivot",
    O.query(f"SELECT hotel_id, {O.up('overall', 6)} AS overall, {PIVOT_COLUMNS} FROM pivoted"),
)
def feature_pivot(b: Binding) -> DataFrame:
    pivoted = search.feature_pivot(b.stored())
    return pivoted.withColumn("overall", round_half_up(F.col("overall"), 6))


@register(
    "threshold_having", O.query(f"SELECT hotel_id, {PIVOT_COLUMNS} FROM pivoted WHERE {REACHED}")
)
def threshold_having(b: Binding) -> DataFrame:
    return search.at_least(search.feature_pivot(b.stored()), O.MIN_SCORES).drop("overall")


@register(
    "rank_by_score",
    O.query(
        f"""SELECT overall_rank, count(*) AS hotels, min({O.up('overall', 6)}) AS overall FROM
        (SELECT overall, rank() OVER (ORDER BY overall DESC) AS overall_rank FROM pivoted) AS r
        GROUP BY overall_rank"""
    ),
)
def rank_by_score(b: Binding) -> DataFrame:
    """Ranks of the unrounded means, over one row per distinct mean (at most a few thousand)."""
    levels = search.feature_pivot(b.stored()).groupBy("overall").agg(F.count(F.lit(1)).alias("hotels"))
    before = Window.orderBy(F.desc("overall")).rowsBetween(Window.unboundedPreceding, -1)
    better = F.coalesce(F.sum("hotels").over(before), F.lit(0))
    return levels.select(
        (better + 1).alias("overall_rank"), "hotels",
        round_half_up(F.col("overall"), 6).alias("overall"),
    )


@register(
    "name_contains",
    O.query(
        f"""SELECT hotel_id, hotel_name FROM hotel
        WHERE upper(hotel_name) LIKE upper('%{O.CARD_NAME}%')"""
    ),
)
def name_contains(b: Binding) -> DataFrame:
    return b.hotel().filter(search.name_contains(F.col("hotel_name"), O.CARD_NAME)).select(
        "hotel_id", "hotel_name"
    )


@register(
    "name_equals_ci",
    O.query(
        f"SELECT hotel_id FROM hotel WHERE upper(hotel_name) = upper('{O.REVIEWED_HOTEL}')"
    ),
)
def name_equals_ci(b: Binding) -> DataFrame:
    return b.hotel().filter(search.name_equals(F.col("hotel_name"), O.REVIEWED_HOTEL)).select(
        "hotel_id"
    )


@register(
    "first_match",
    O.query(
        f"""SELECT hotel_id, hotel_name FROM hotel
        WHERE upper(hotel_name) LIKE upper('%{O.CARD_NAME}%') ORDER BY hotel_id LIMIT 1"""
    ),
)
def first_match(b: Binding) -> DataFrame:
    return search.first_match(b.hotel(), O.CARD_NAME).select("hotel_id", "hotel_name")


@register(
    "rating_feature_join",
    O.query(
        """SELECT hotel_id, feature_name, CAST(score AS DOUBLE) AS score
        FROM rating JOIN feature USING (feature_id)"""
    ),
)
def rating_feature_join(b: Binding) -> DataFrame:
    return search.rating_feature_scores(b.stored()).select("hotel_id", "feature_name", double("score"))


@register(
    "review_hotel_join",
    O.query(
        """SELECT review_id, hotel_name, reviewer_name,
        CAST(overall_rating AS DOUBLE) AS overall_rating FROM review JOIN hotel USING (hotel_id)"""
    ),
)
def review_hotel_join(b: Binding) -> DataFrame:
    names = b.hotel().select("hotel_id", "hotel_name")
    return join_dimension(b.review(), names, "hotel_id").select(
        "review_id", "hotel_name", "reviewer_name", double("overall_rating")
    )


@register(
    "scalar_subquery_counts",
    O.query(
        f"""SELECT hotel_id, (SELECT count(*) FROM review AS r WHERE r.hotel_id = h.hotel_id)
        AS total_reviews, (SELECT {O.up(O.mean('overall_rating', 1), 6)} FROM review AS r
        WHERE r.hotel_id = h.hotel_id) AS avg_user_rating FROM hotel AS h"""
    ),
)
def scalar_subquery_counts(b: Binding) -> DataFrame:
    stats = views.review_stats(b.review())
    return b.hotel().join(stats, "hotel_id", "left").select(
        "hotel_id", F.coalesce("total_reviews", F.lit(0)).alias("total_reviews"),
        round_half_up(F.col("mean_review"), 6).alias("avg_user_rating"),
    )


# --- cleaning --------------------------------------------------------------------------------


@register(
    "na_to_number",
    O.query(
        f"""SELECT hotel_name, CAST({O.na_number('star_rating')} AS DOUBLE) AS star_rating
        FROM raw_hotel"""
    ),
)
def na_to_number(b: Binding) -> DataFrame:
    star = clean.na_to_number(F.col("star_rating")).cast("double")
    return b.raw_hotels().select("hotel_name", star.alias("star_rating"))


@register(
    "parse_review_date",
    O.query(
        f"""SELECT hotel_name, review_date AS raw_date,
        strftime({O.PARSED_DATE}, '%Y-%m-%d') AS review_date FROM raw_review"""
    ),
)
def parse_review_date(b: Binding) -> DataFrame:
    parsed = clean.parse_review_date(F.col("review_date"))
    return b.raw_reviews().select(
        "hotel_name", F.col("review_date").alias("raw_date"),
        F.date_format(parsed, "yyyy-MM-dd").alias("review_date"),
    )


@register(
    "assign_ids",
    O.query(
        f"""SELECT CAST(row_number() OVER (ORDER BY {O.id_group('hotel_name', 'city')}, hotel_name,
        city) AS BIGINT) AS hotel_id, hotel_name, city FROM raw_hotel"""
    ),
)
def assigned_ids(b: Binding) -> DataFrame:
    return assign_ids(b.raw_hotels().select("hotel_name", "city"), "hotel_id", ["hotel_name", "city"])


@register(
    "seed_weight",
    O.query(
        """SELECT feature_id, seed_phrase, weight AS raw_weight,
        CAST(CAST(weight AS DECIMAL(2,0)) AS BIGINT) AS weight FROM seed_row"""
    ),
)
def seed_weight(b: Binding) -> DataFrame:
    return b.seed_rows().select(
        "feature_id", "seed_phrase", F.col("weight").alias("raw_weight"),
        clean.seed_weight(F.col("weight")).cast("bigint").alias("weight"),
    )


@register(
    "weight_label",
    O.query(
        """SELECT seed_phrase, feature_id, CASE weight WHEN 1 THEN 'Positive' WHEN -1 THEN 'Negative'
        END AS label FROM seed"""
    ),
)
def weight_label(b: Binding) -> DataFrame:
    return b.seed().select(
        "seed_phrase", "feature_id", clean.weight_label(F.col("weight")).alias("label")
    )


@register(
    "rating_band",
    O.query(
        f"SELECT review_id, {O.band('overall_rating')} AS band FROM review"
    ),
)
def rating_band(b: Binding) -> DataFrame:
    return b.review().select("review_id", clean.rating_band(F.col("overall_rating")).alias("band"))


@register(
    "star_string", O.query(f"SELECT review_id, {O.stars('overall_rating')} AS stars FROM review")
)
def star_string(b: Binding) -> DataFrame:
    return b.review().select("review_id", clean.star_string(F.col("overall_rating")).alias("stars"))


# Search choices as typed: '>2.5', 'Any', an empty one and an unreadable one.
CHOICE_SQL = """CASE WHEN overall_rating IS NULL THEN 'Any' WHEN overall_rating = 1 THEN ''
    WHEN overall_rating = 2 THEN '>high' ELSE '>' || CAST(overall_rating AS VARCHAR) END"""


@register(
    "parse_threshold",
    O.query(
        f"""SELECT review_id, TRY_CAST(trim(replace({CHOICE_SQL}, '>', '')) AS DOUBLE) AS threshold
        FROM review"""
    ),
)
def parse_threshold(b: Binding) -> DataFrame:
    rating = F.col("overall_rating")
    choice = (
        F.when(rating.isNull(), "Any").when(rating == 1, "").when(rating == 2, ">high")
        .otherwise(F.concat(F.lit(">"), rating.cast("string")))
    )
    return b.review().select("review_id", clean.parse_threshold(choice).alias("threshold"))


@register(
    "review_defaults",
    O.query(
        """SELECT review_id, coalesce(reviewer_name, 'Anonymous') AS reviewer_name,
        coalesce(strftime(review_date, '%Y-%m-%d'), '0001-01-01') AS review_date,
        coalesce(CAST(overall_rating AS DOUBLE), 0.0) AS rating FROM review"""
    ),
)
def review_defaults(b: Binding) -> DataFrame:
    filled = clean.review_defaults()
    return b.review().select(
        "review_id", filled["reviewer_name"].alias("reviewer_name"),
        filled["review_date"].cast("string").alias("review_date"), filled["rating"].alias("rating"),
    )


@register(
    "round_2",
    O.query(
        f"""SELECT l_orderkey, l_linenumber, {O.up('l_extendedprice * l_discount')} AS half_up,
        {O.even('l_extendedprice * l_discount')} AS half_even FROM lineitem"""
    ),
)
def round_2(b: Binding) -> DataFrame:
    value = F.col("l_extendedprice") * F.col("l_discount")
    return b.table("lineitem").select(
        "l_orderkey", "l_linenumber", round_half_up(value).alias("half_up"),
        round_half_even(value).alias("half_even"),
    )


# --- loading ---------------------------------------------------------------------------------


LOADED_HOTEL_SQL = f"""SELECT hotel_name, address, city, country,
    CAST({O.na_number('star_rating')} AS DOUBLE) AS star_rating FROM raw_hotel"""


@register("load_hotels", O.query(LOADED_HOTEL_SQL))
def load_hotels(b: Binding) -> DataFrame:
    return tables.load_hotels(b.raw_hotels()).drop("hotel_id").withColumn(
        "star_rating", double("star_rating")
    )


@register("load_features", O.query("SELECT feature_name, description, is_active FROM feature"))
def load_features(b: Binding) -> DataFrame:
    return tables.load_features(b.raw_features()).drop("feature_id")


LOADED_SEED_SQL = """SELECT feature_name, seed_phrase,
    CAST(CAST(weight AS DECIMAL(2,0)) AS BIGINT) AS weight FROM raw_seed"""


@register("load_seeds", O.query(LOADED_SEED_SQL))
def load_seeds(b: Binding) -> DataFrame:
    feature = b.feature()
    loaded = tables.load_seeds(b.raw_seeds(), feature)
    return loaded.join(feature.select("feature_id", "feature_name"), "feature_id").select(
        "feature_name", "seed_phrase", F.col("weight").cast("bigint").alias("weight")
    )


LOADED_REVIEW_SQL = f"""SELECT hotel_id, hotel_name, review_text, reviewer_name,
    strftime({O.PARSED_DATE}, '%Y-%m-%d') AS review_date,
    CAST({O.na_number('overall_rating')} AS DOUBLE) AS overall_rating
    FROM (SELECT * FROM raw_review) AS r JOIN (SELECT hotel_id, hotel_name FROM hotel) AS h
    USING (hotel_name)"""


def loaded_review_rows(review: DataFrame, hotel: DataFrame, *ids: str) -> DataFrame:
    return join_dimension(review, hotel.select("hotel_id", "hotel_name"), "hotel_id").select(
        *ids, "hotel_name", "review_text", "reviewer_name", day("review_date"),
        double("overall_rating"),
    )


@register("load_reviews", O.query(LOADED_REVIEW_SQL))
def load_reviews(b: Binding) -> DataFrame:
    hotel = b.hotel()
    return loaded_review_rows(tables.load_reviews(b.raw_reviews(), hotel), hotel, "hotel_id")


@register(
    "lookup_by_name",
    O.query("SELECT hotel_id, count(*) AS reviews FROM raw_review JOIN hotel USING (hotel_name) GROUP BY 1"),
)
def lookup_by_name(b: Binding) -> DataFrame:
    found = tables.typed_reviews(b.raw_reviews(), b.hotel())
    return found.groupBy("hotel_id").agg(F.count(F.lit(1)).alias("reviews"))


def raw_tables(b: Binding) -> dict[str, DataFrame]:
    return {
        "hotels": b.raw_hotels(), "features": b.raw_features(), "seeds": b.raw_seeds(),
        "reviews": b.raw_reviews(),
    }


@register("load_tables", O.query(LOADED_REVIEW_SQL.replace("SELECT hotel_id, ", "SELECT ", 1)))
def load_tables(b: Binding) -> DataFrame:
    """Raw rows to CSV files, the files to tables, and the stored reviews back."""
    root = scratch_folder(b.spark, "load")
    for name, rows in raw_tables(b).items():
        tables.write_csv(rows, f"{root}/csv/{name}")
    m = tables.load_tables(b.spark, f"{root}/csv", f"{root}/tables", multi_line=True)
    return loaded_review_rows(m.review, m.hotel)


@register(
    "reload_tables",
    O.query(
        """SELECT 'hotel' AS table_name, count(*) AS n FROM hotel
        UNION ALL SELECT 'feature', count(*) FROM feature
        UNION ALL SELECT 'seed', count(*) FROM seed
        UNION ALL SELECT 'review', count(*) FROM review
        UNION ALL SELECT 'rating', 0"""
    ),
)
def reload_tables(b: Binding) -> DataFrame:
    m = tables.reload_tables(b.spark, scratch_folder(b.spark, "reload"), **raw_tables(b))
    frames = {name: getattr(m, name) for name in ("hotel", "feature", "seed", "review", "rating")}
    counts = None
    for name, frame in frames.items():
        one = frame.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts


@register("write_ratings", O.query(RATING_SQL))
def write_ratings(b: Binding) -> DataFrame:
    return rating_rows(tables.write_ratings(b.model().rating, scratch_folder(b.spark, "rating")))


# --- review files ----------------------------------------------------------------------------


def file_lines(b: Binding) -> DataFrame:
    """(dir, value): one tab-separated line per document; every third has a fourth field."""
    extra = F.when(F.col("doc_id") % 3 == 0, "\tmore").otherwise("")
    return b.documents().select(
        F.concat(F.lit("region_"), F.length("source").cast("string")).alias("dir"),
        F.concat(
            F.lit("2024-05-01\t"), F.col("lang"), F.lit("\t"), one_line(F.col("text")), extra
        ).alias("value"),
    )


def stored_files(b: Binding) -> str:
    root = scratch_folder(b.spark, "files")
    file_lines(b).write.partitionBy("dir").text(root)
    return root


FILE_LINE_SQL = r"""
    SELECT 'dir=region_' || length(source) AS dir,
           '2024-05-01' || chr(9) || lang || chr(9)
           || trim(regexp_replace(text, '\s+', ' ', 'g'))
           || CASE WHEN doc_id % 3 = 0 THEN chr(9) || 'more' ELSE '' END AS value,
           lang, trim(regexp_replace(text, '\s+', ' ', 'g')) AS review
    FROM documents"""


@register("review_lines", f"SELECT dir, value FROM ({FILE_LINE_SQL}) AS l")
def review_lines(b: Binding) -> DataFrame:
    lines = review_files.review_lines(b.spark, stored_files(b))
    return lines.select(F.split("file", "/")[0].alias("dir"), "value")


@register(
    "parse_reviews",
    f"""SELECT dir, '2024-05-01' AS date, lang AS subject, review FROM ({FILE_LINE_SQL}) AS l""",
)
def parse_reviews(b: Binding) -> DataFrame:
    lines = file_lines(b).withColumn("dir", F.concat(F.lit("dir="), F.col("dir")))
    return review_files.parse_reviews(lines, ["dir"])


@register("file_to_hotel", O.query("SELECT doc_id, hotel, city FROM file"))
def file_to_hotel(b: Binding) -> DataFrame:
    return b.documents().select("doc_id", review_file().alias("file")).select(
        "doc_id", review_files.file_to_hotel(F.col("file")).alias("hotel"),
        review_files.file_to_city(F.col("file")).alias("city"),
    )


@register(
    "read_reviews",
    f"""SELECT 'Dir=Region ' || substr(dir, 12) AS city, '2024-05-01' AS date, lang AS subject,
    review FROM ({FILE_LINE_SQL}) AS l""",
)
def read_reviews(b: Binding) -> DataFrame:
    return review_files.read_reviews(b.spark, stored_files(b)).select(
        "city", "date", "subject", "review"
    )


# --- text and mining -------------------------------------------------------------------------


@register(
    "sentences",
    f"""SELECT doc_id, CAST(len(string_split_regex(text, {O.SENTENCE})) AS BIGINT) AS sentences
    FROM documents""",
)
def count_sentences(b: Binding) -> DataFrame:
    parts = F.size(sentences(F.col("review"))).cast("bigint")
    return b.mined_reviews().select("doc_id", parts.alias("sentences"))


@register(
    "tokens",
    f"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), {O.WORD}))
    AS token FROM documents) AS t GROUP BY token""",
)
def count_tokens(b: Binding) -> DataFrame:
    token = b.mined_reviews().select(F.explode(words(F.col("review"))).alias("token"))
    return token.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@register(
    "clean_tokens",
    O.query(
        """SELECT doc_id, sentence_no, array_to_string(words, ' ') AS words FROM clean_sentence"""
    ),
)
def clean_tokens(b: Binding) -> DataFrame:
    look = WordLookups(b.word_tables())
    rows = mining.sentence_words(b.mined_reviews(), look, ["doc_id"])
    return rows.select(
        "doc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"),
        F.array_join("clean", " ").alias("words"),
    )


@register(
    "normalize_tokens",
    O.query(
        """SELECT t.token, t.lemma, coalesce(tag.tag, 'NN') AS tag, count(*) AS n
        FROM token AS t LEFT JOIN tag ON tag.token = t.token GROUP BY ALL"""
    ),
)
def normalize_tokens(b: Binding) -> DataFrame:
    look = WordLookups(b.word_tables())
    token = b.mined_reviews().select(F.explode(words(F.col("review"))).alias("token"))
    counted = token.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    word = F.col("token")
    return counted.select("token", look.lemma(word).alias("lemma"), look.tag(word).alias("tag"), "n")


@register(
    "aspect_keywords",
    O.query(
        """SELECT aspect, keyword, lemma, coalesce(n, 0) AS n FROM keyword LEFT JOIN
        (SELECT lemma, count(*) AS n FROM token GROUP BY lemma) AS c USING (lemma)"""
    ),
)
def aspect_keywords(b: Binding) -> DataFrame:
    """Keywords as lemmas, with the number of their occurrences in all texts."""
    t = b.word_tables()
    look = WordLookups(t)
    token = b.mined_reviews().select(F.explode(words(F.col("review"))).alias("token"))
    counted = token.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    per_lemma = counted.groupBy(look.lemma(F.col("token")).alias("lemma")).agg(F.sum("n").alias("n"))
    keywords = keyword_lemmas(t.aspect_keyword, t.token_lemma)
    return keywords.join(per_lemma, "lemma", "left").select(
        "aspect", "keyword", "lemma", F.coalesce("n", F.lit(0)).alias("n")
    )


@register("lexicon_polarity", O.query("SELECT doc_id, compound FROM whole"))
def lexicon_polarity(b: Binding) -> DataFrame:
    scored = sentiment.lexicon_polarity(b.mined_reviews(), b.word_tables())
    return scored.select("doc_id", "compound")


@register(
    "sentiment_label",
    O.query(f"SELECT doc_id, {O.label('compound')} AS sentiment FROM whole"),
)
def sentiment_label(b: Binding) -> DataFrame:
    scored = sentiment.lexicon_polarity(b.mined_reviews(), b.word_tables())
    return scored.select("doc_id", clean.sentiment_label(F.col("compound")).alias("sentiment"))


@register(
    "aspect_keyword_overlap",
    O.query(
        "SELECT doc_id, sentence_no, aspect, scaled / 10000.0::DOUBLE AS polarity FROM overlap"
    ),
)
def aspect_keyword_overlap(b: Binding) -> DataFrame:
    found = sentiment.aspect_mentions(b.mined_reviews(), b.word_tables(), ["doc_id"])
    return found.withColumn("sentence_no", F.col("sentence_no").cast("bigint"))


@register(
    "aspect_scores",
    O.query(f"SELECT doc_id, aspect, score, {O.label_of_mean('total', 'n')} AS label FROM aspect_score"),
)
def aspect_scores(b: Binding) -> DataFrame:
    return sentiment.aspect_scores(b.mined_reviews(), b.word_tables(), ["doc_id"])


def _aspect_columns(number: str) -> str:
    parts = []
    for a in ASPECTS:
        score = f"max(CASE WHEN aspect = '{a}' THEN score END)"
        total, n = (f"max(CASE WHEN aspect = '{a}' THEN aspect_score.{c} END)" for c in ("total", "n"))
        shown = number.format(score)
        parts.append(
            f"{shown} AS {a}_score, CASE WHEN {score} IS NOT NULL THEN {O.label_of_mean(total, n)} END"
            f" AS {a}_label"
        )
    return ", ".join(parts)


def _sentiment_sql(review: str, number: str) -> str:
    return O.query(
        f"""SELECT file.hotel, file.city, '2024-05-01' AS date, lang AS subject, {review} AS review,
        {O.label('compound')} AS sentiment, {number.format('compound')} AS compound, {_aspect_columns(number)}
        FROM file JOIN whole USING (doc_id) LEFT JOIN aspect_score USING (doc_id)
        GROUP BY doc_id, file.hotel, file.city, lang, text, compound"""
    )


@register("review_sentiment", _sentiment_sql("text", "{}"))
def review_sentiment(b: Binding) -> DataFrame:
    reviews = b.mined_reviews().drop("doc_id", "file")
    return sentiment.review_sentiment(reviews, b.word_tables())


# In the file every text stands on one line, which makes it a single run of sentences without
# line breaks; the twin below therefore works on such texts as well.
ONE_LINE_FILE = O.CTES["file"].replace(
    "SELECT *, 'region-'",
    r"SELECT doc_id, lang, source, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, 'region-'",
)


@register(
    "write_review_sentiment",
    _sentiment_sql("text", "printf('%.4f', {})").replace(O.CTES["file"], ONE_LINE_FILE),
)
def write_review_sentiment(b: Binding) -> DataFrame:
    reviews = b.mined_reviews().drop("doc_id", "file").withColumn("review", one_line(F.col("review")))
    path = scratch_folder(b.spark, "sentiment")
    exports.write_review_sentiment(sentiment.review_sentiment(reviews, b.word_tables()), path)
    return tables.read_csv(b.spark, path, exports.SENTIMENT_SCHEMA)


@register(
    "aspect_phrases",
    O.query(
        """SELECT doc_id, sentence_no, pos, aspect, phrase, scaled AS polarity FROM phrase"""
    ),
)
def aspect_phrases(b: Binding) -> DataFrame:
    found = mining.aspect_phrases(b.mined_reviews(), b.word_tables(), ["doc_id"])
    return found.withColumns({c: F.col(c).cast("bigint") for c in ("sentence_no", "pos")})


@register(
    "keyword_is_noun",
    O.query(
        """SELECT aspect, count(*) AS phrases, count(DISTINCT phrase) AS distinct_phrases
        FROM phrase GROUP BY aspect"""
    ),
)
def keyword_is_noun(b: Binding) -> DataFrame:
    found = mining.aspect_phrases(b.mined_reviews(), b.word_tables(), [])
    per_phrase = found.groupBy("aspect", "phrase").agg(F.count(F.lit(1)).alias("n"))
    return per_phrase.groupBy("aspect").agg(
        F.sum("n").alias("phrases"), F.count(F.lit(1)).alias("distinct_phrases")
    )


FILE_KEYS = ["file", "hotel", "city"]


@register(
    "support_filter", O.query("SELECT file, aspect, phrase, support, scaled AS weight_scaled FROM by_file")
)
def support_filter(b: Binding) -> DataFrame:
    found = mining.phrase_scores_by_file(b.mined_reviews(), b.word_tables(), FILE_KEYS)
    return found.drop("hotel", "city")


BY_HOTEL_SQL = """SELECT hotel, city, upper(aspect[1]) || aspect[2:] AS feature_name,
    phrase AS seed_phrase, scaled / 10000.0::DOUBLE AS weight FROM by_file"""


@register("phrase_scores_by_hotel", O.query(BY_HOTEL_SQL))
def phrase_scores_by_hotel(b: Binding) -> DataFrame:
    return mining.seed_terms(b.mined_reviews(), b.word_tables(), by_hotel=True)


@register("seed_terms", O.query("SELECT * FROM merged"))
def seed_terms(b: Binding) -> DataFrame:
    return mining.seed_terms(b.mined_reviews(), b.word_tables())


@register(
    "write_seeds",
    O.query(
        f"""SELECT '' AS hotel, '' AS city, feature_name, seed_phrase, printf('%.4f', weight) AS weight
        FROM merged UNION ALL SELECT hotel, city, feature_name, seed_phrase, printf('%.4f', weight)
        FROM ({BY_HOTEL_SQL}) AS h"""
    ),
)
def write_seeds(b: Binding) -> DataFrame:
    root = scratch_folder(b.spark, "seeds")
    by_file = mining.phrase_scores_by_file(b.mined_reviews(), b.word_tables(), FILE_KEYS)
    exports.write_mined_seeds(by_file, f"{root}/seeds", f"{root}/by_hotel")
    merged = tables.read_csv(b.spark, f"{root}/seeds", exports.SEED_SCHEMA)
    by_hotel = tables.read_csv(b.spark, f"{root}/by_hotel", exports.SEED_BY_HOTEL_SCHEMA)
    blank = F.lit("")
    return merged.select(blank.alias("hotel"), blank.alias("city"), *merged.columns).unionByName(by_hotel)


# Mined seeds, loaded and scored: the whole way from texts to ratings.
MINED_SEED = """
    SELECT row_number() OVER (ORDER BY feature_name, seed_phrase) AS seed_id, feature_id,
           seed_phrase, CAST(CAST(CAST(weight AS DECIMAL(9,4)) AS DECIMAL(2,0)) AS BIGINT) AS weight
    FROM merged JOIN feature USING (feature_name)"""


def _late(sql_tables: dict[str, str], **late: str) -> dict[str, str]:
    """Table expressions with some moved to the end (they use later ones)."""
    kept = {n: s for n, s in sql_tables.items() if n not in late}
    return {**kept, **late}


MINED_TABLES = _late(
    O.CTES,
    seed=MINED_SEED,
    **{n: O.CTES[n] for n in ("hit", "sentiment", "mention", "rating")},
)


@register("mined_seed_ratings", O.query_over(MINED_TABLES, RATING_SQL))
def mined_seed_ratings(b: Binding) -> DataFrame:
    """The mined seeds are handed over as a file, as the exporter writes it."""
    m = b.model(rating=False)
    path = scratch_folder(b.spark, "mined")
    exports.write_seeds(mining.seed_terms(b.mined_reviews(), b.word_tables()), path)
    raw = tables.read_csv(b.spark, path, exports.SEED_SCHEMA)
    seed = tables.load_seeds(raw, m.feature)
    return rating_rows(scoring.calc_ratings(m.with_(seed=seed), updated=UPDATED))


# --- table maintenance -----------------------------------------------------------------------


NEW_FEATURE_SQL = f"""
    SELECT c_mktsegment AS feature_name FROM customer
    UNION ALL SELECT {O.per_type(1)} FROM part"""


@register(
    "append_features",
    O.query(
        f"""SELECT 'accepted' AS outcome, feature_name AS key, 1 AS n FROM
        (SELECT DISTINCT feature_name FROM ({NEW_FEATURE_SQL}) AS n) AS d
        WHERE feature_name NOT IN (SELECT feature_name FROM feature)
        UNION ALL
        SELECT 'duplicate', feature_name, n FROM (SELECT feature_name, count(*) - CASE WHEN
            feature_name IN (SELECT feature_name FROM feature) THEN 0 ELSE 1 END AS n
            FROM ({NEW_FEATURE_SQL}) AS n GROUP BY feature_name) AS g WHERE n > 0"""
    ),
)
def append_features(b: Binding) -> DataFrame:
    m = b.model(rating=False)
    new = b.table("customer").select(F.col("c_mktsegment").alias("feature_name")).unionByName(
        b.table("part").select(per_type(1).alias("feature_name"))
    )
    return outcome(maintenance.append_features(m, new), ["feature_name"])


def outcome(result, keys: list[str]) -> DataFrame:
    """(outcome, key, n) of an append: accepted keys and rejections with their reason."""
    key = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    accepted = result.accepted.groupBy(F.lit("accepted").alias("outcome"), key.alias("key")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return accepted.unionByName(
        result.rejected.select(
            F.col("reason").alias("outcome"), F.array_join("key", "|").alias("key"), F.col("rows").alias("n")
        )
    )


# Seeds to add: brands per part type, some under a feature that does not exist.
NEW_SEED_SQL = f"""
    SELECT CASE WHEN p_size = 50 THEN 'Nowhere' ELSE {O.per_type(1)} END AS feature_name,
           lower(p_brand) AS seed_phrase, CAST(p_size % 3 - 1 AS INTEGER) AS weight FROM part
    UNION ALL SELECT feature_name, seed_phrase, 1 FROM raw_seed"""


def new_seeds(b: Binding) -> DataFrame:
    size = F.col("p_size")
    return b.table("part").select(
        F.when(size == 50, "Nowhere").otherwise(per_type(1)).alias("feature_name"),
        F.lower("p_brand").alias("seed_phrase"), (size % 3 - 1).cast("int").alias("weight"),
    ).unionByName(b.raw_seeds().withColumn("weight", F.lit(1)))


@register(
    "append_seeds",
    O.query(
        f"""SELECT outcome, key, CAST(sum(n) AS BIGINT) AS n FROM (
        SELECT 'unknown feature' AS outcome, feature_name || '|' || seed_phrase AS key, 1 AS n
        FROM new_seed LEFT JOIN feature USING (feature_name) WHERE feature_id IS NULL
        UNION ALL SELECT 'weight must be -1 or 1', feature_name || '|' || seed_phrase, 1
        FROM new_seed JOIN feature USING (feature_name) WHERE weight = 0
        UNION ALL SELECT CASE WHEN s.seed_id IS NULL THEN 'accepted' ELSE 'duplicate' END,
            f.feature_id || '|' || n.seed_phrase, CASE WHEN s.seed_id IS NULL THEN 1 ELSE count(*) END
        FROM new_seed AS n JOIN feature AS f USING (feature_name) LEFT JOIN seed AS s
        ON s.feature_id = f.feature_id AND s.seed_phrase = n.seed_phrase
        WHERE n.weight <> 0 GROUP BY f.feature_id, n.seed_phrase, s.seed_id
        UNION ALL SELECT 'duplicate', f.feature_id || '|' || n.seed_phrase, count(*) - 1
        FROM new_seed AS n JOIN feature AS f USING (feature_name) LEFT JOIN seed AS s
        ON s.feature_id = f.feature_id AND s.seed_phrase = n.seed_phrase
        WHERE n.weight <> 0 AND s.seed_id IS NULL
        GROUP BY f.feature_id, n.seed_phrase HAVING count(*) > 1) AS o GROUP BY outcome, key""",
        new_seed=NEW_SEED_SQL,
    ),
)
def append_seeds(b: Binding) -> DataFrame:
    return outcome(
        maintenance.append_seeds(b.model(rating=False), new_seeds(b)), ["feature_id", "seed_phrase"]
    )


@register(
    "append_reviews",
    O.query(
        """SELECT coalesce(reason, 'accepted') AS outcome, hotel_name AS key, count(*) AS n,
        strftime(min(CASE WHEN reason IS NULL THEN coalesce(review_date, DATE '2025-01-01') END),
                 '%Y-%m-%d') AS first_date
        FROM (SELECT hotel_name, review_date, CASE WHEN hotel_id IS NULL THEN 'unknown hotel'
              WHEN overall_rating NOT BETWEEN 1 AND 5 THEN 'rating out of range' END AS reason
              FROM new_review LEFT JOIN hotel USING (hotel_name)) AS r
        GROUP BY reason, hotel_name""",
        new_review=NEW_REVIEW_SQL,
    ),
)
def append_reviews(b: Binding) -> DataFrame:
    result = maintenance.append_reviews(b.model(rating=False), new_reviews(b), UPDATED)
    names = b.hotel().select("hotel_id", "hotel_name")
    accepted = result.accepted.join(names, "hotel_id").groupBy(
        F.lit("accepted").alias("outcome"), F.col("hotel_name").alias("key")
    ).agg(F.count(F.lit(1)).alias("n"), F.date_format(F.min("review_date"), "yyyy-MM-dd").alias("first_date"))
    rejected = result.rejected.select(
        F.col("reason").alias("outcome"), F.get("key", F.lit(0)).alias("key"), F.col("rows").alias("n"),
        F.lit(None).cast("string").alias("first_date"),
    )
    return accepted.unionByName(rejected)


# Hotels to add: customers (the segment is the review, one segment gives none) and all suppliers.
NEW_HOTEL_SQL = """
    SELECT c_name AS hotel_name, n_name AS city, CAST(c_custkey % 6 AS DECIMAL(2,1)) AS star_rating,
           CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS review_text
    FROM customer JOIN nation ON c_nationkey = n_nationkey
    UNION ALL
    SELECT s_name, n_name, CAST(3 AS DECIMAL(2,1)), NULL
    FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def new_hotels(b: Binding) -> DataFrame:
    nation = b.table("nation")
    customers = b.table("customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_name").alias("hotel_name"), F.col("n_name").alias("city"),
        (F.col("c_custkey") % 6).cast(RATING_TYPE).alias("star_rating"),
        F.when(F.col("c_mktsegment") == "BUILDING", "").otherwise(F.col("c_mktsegment")).alias("review_text"),
    )
    suppliers = b.hotel().select(
        "hotel_name", "city", F.lit(3).cast(RATING_TYPE).alias("star_rating"),
        F.lit(None).cast("string").alias("review_text"),
    )
    nothing = F.lit(None).cast("string")
    return customers.unionByName(suppliers).withColumns(
        {"address": nothing, "country": nothing, "reviewer_name": nothing}
    )


@register(
    "append_hotels_with_review",
    O.query(
        """SELECT CASE WHEN star_rating NOT BETWEEN 1 AND 5 THEN 'star rating out of range'
        WHEN hotel_id IS NOT NULL THEN 'duplicate' ELSE 'accepted' END AS outcome, n.city AS key,
        count(*) AS n, count(CASE WHEN hotel_id IS NULL AND star_rating BETWEEN 1 AND 5
                                  AND review_text <> '' THEN 1 END) AS reviews
        FROM new_hotel AS n LEFT JOIN (SELECT hotel_id, hotel_name, city FROM hotel) AS h
        ON h.hotel_name = n.hotel_name AND h.city = n.city GROUP BY 1, 2""",
        new_hotel=NEW_HOTEL_SQL,
    ),
)
def append_hotels_with_review(b: Binding) -> DataFrame:
    m = b.model(rating=False)
    result = maintenance.append_hotels_with_review(m, new_hotels(b), UPDATED)
    before = m.review.select("review_id")
    added = result.review.join(before, "review_id", "left_anti").groupBy("hotel_id").agg(
        F.count(F.lit(1)).alias("reviews")
    )
    accepted = result.accepted.join(added, "hotel_id", "left").groupBy(
        F.lit("accepted").alias("outcome"), F.col("city").alias("key")
    ).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"))
    rejected = result.rejected.groupBy(
        F.col("reason").alias("outcome"), F.get("key", F.lit(1)).alias("key")
    ).agg(F.sum("rows").alias("n"), F.lit(0).cast("bigint").alias("reviews"))
    return accepted.unionByName(rejected)


@register("add_reviews_and_rescore", O.query(RATING_SQL, review=REVIEW_WITH_NEW))
def add_reviews_and_rescore(b: Binding) -> DataFrame:
    """Stored tables, stored ratings: only the touched hotels' reviews are matched."""
    root = scratch_folder(b.spark, "upkeep")
    tables.write_tables(b.model(rating=False), root)
    upkeep.score_tables(b.spark, root, updated=UPDATED)
    return rating_rows(upkeep.add_reviews(b.spark, root, new_reviews(b), UPDATED, updated=UPDATED).model.rating)


# Every thirteenth review goes, whoever wrote it.
@register(
    "delete_reviews_and_rescore",
    O.query(RATING_SQL, review=f"SELECT * FROM ({O.CTES['review']}) AS r WHERE review_id % 13 <> 0"),
)
def delete_reviews_and_rescore(b: Binding) -> DataFrame:
    root = scratch_folder(b.spark, "upkeep")
    tables.write_tables(b.model(rating=False), root)
    m = upkeep.score_tables(b.spark, root, updated=UPDATED)
    gone = m.review.filter("review_id % 13 = 0").select("review_id")
    return rating_rows(upkeep.delete_reviews(b.spark, root, gone, updated=UPDATED).rating)


# Hotels of one region go with all that refers to them; nothing is scored again.
@register(
    "delete_hotels",
    O.query(
        """SELECT hotel_id, total_reviews, mean_score FROM hotel_stat WHERE country <> 'AFRICA'"""
    ),
)
def delete_hotels(b: Binding) -> DataFrame:
    root = scratch_folder(b.spark, "upkeep")
    tables.write_tables(b.model(rating=False), root)
    m = upkeep.score_tables(b.spark, root, updated=UPDATED)
    left = upkeep.delete_hotels(b.spark, root, m.hotel.filter("country = 'AFRICA'").select("hotel_id"))
    stats = views.with_hotel_stats(left)
    return stats.select("hotel_id", "total_reviews", "mean_score")


@register(
    "load_rejections",
    O.query(
        """SELECT 'review' AS table_name, hotel_name AS key, count(*) AS n FROM new_review
        WHERE hotel_name NOT IN (SELECT hotel_name FROM hotel) GROUP BY hotel_name
        UNION ALL
        SELECT 'seed', feature_name || '|' || seed_phrase, count(*) FROM new_seed
        WHERE feature_name = 'Nowhere' GROUP BY feature_name, seed_phrase
        UNION ALL
        SELECT 'seed', feature_id || '|' || seed_phrase, count(*) - 1 FROM new_seed JOIN feature USING (feature_name)
        GROUP BY feature_id, seed_phrase HAVING count(*) > 1""",
        new_review=NEW_REVIEW_SQL,
        new_seed=f"""SELECT CASE WHEN p_size = 50 THEN 'Nowhere' ELSE {O.per_type(1)} END AS feature_name,
            lower(p_brand) AS seed_phrase FROM part""",
    ),
)
def load_rejections(b: Binding) -> DataFrame:
    """Rows that a load would leave out: reviews under names of no hotel, brands as seeds."""
    size = F.col("p_size")
    seeds = b.table("part").select(
        F.when(size == 50, "Nowhere").otherwise(per_type(1)).alias("feature_name"), F.lower("p_brand").alias("seed_phrase"),
        F.lit("1").alias("weight"),
    )
    reviews = new_reviews(b).withColumn("overall_rating", F.lit("NA")).withColumn("review_date", F.lit(None).cast("string"))
    located = tables.located_reviews(reviews, b.hotel())
    found = tables.load_rejections(b.raw_hotels(), b.raw_features(), seeds, b.feature(), located)
    return found.select(F.col("table").alias("table_name"), F.array_join("key", "|").alias("key"), F.col("rows").alias("n"))


# The ids of added hotels are no part of the result; any unused numbers do.
HOTEL_WITH_NEW = f"""
    SELECT hotel_id, hotel_name, address, city, country, star_rating FROM ({O.CTES["hotel"]}) AS h
    UNION ALL
    SELECT 1000000000 + row_number() OVER (ORDER BY n.hotel_name, n.city), n.hotel_name, NULL, n.city,
           NULL, n.star_rating
    FROM ({NEW_HOTEL_SQL}) AS n LEFT JOIN raw_hotel AS r
    ON r.hotel_name = n.hotel_name AND r.city = n.city
    WHERE r.hotel_name IS NULL AND n.star_rating BETWEEN 1 AND 5"""
REVIEW_OF_NEW = f"""
    SELECT review_id, hotel_id, review_text, reviewer_name, review_date, overall_rating
    FROM ({O.CTES["review"]}) AS r
    UNION ALL
    SELECT 1000000000 + h.hotel_id, h.hotel_id, n.review_text, NULL, DATE '2025-01-01', NULL
    FROM ({NEW_HOTEL_SQL}) AS n JOIN hotel AS h USING (hotel_name)
    WHERE h.hotel_id > 1000000000 AND h.city = n.city AND n.review_text <> ''"""


@register(
    "add_hotels_and_rescore",
    O.query(
        """SELECT hotel_name, city, feature_id, CAST(score AS DOUBLE) AS score, total_mentions,
        positive_mentions, negative_mentions FROM rating JOIN hotel USING (hotel_id)""",
        hotel=HOTEL_WITH_NEW, review=REVIEW_OF_NEW,
    ),
)
def add_hotels_and_rescore(b: Binding) -> DataFrame:
    root = scratch_folder(b.spark, "upkeep")
    tables.write_tables(b.model(), root)
    m = upkeep.add_hotels(b.spark, root, new_hotels(b), UPDATED, updated=UPDATED).model
    named = join_dimension(rating_rows(m.rating), m.hotel.select("hotel_id", "hotel_name", "city"), "hotel_id")
    return named.drop("hotel_id")


# A broken copy of the tables: the added hotels and reviews go in unchecked.
@register(
    "validate_constraints",
    O.query(
        """SELECT 'hotel' AS table, 'hotel_name, city unique' AS rule,
            hotel_name || '|' || city AS key, count(*) AS rows
        FROM (SELECT hotel_name, city FROM hotel UNION ALL SELECT hotel_name, city FROM new_hotel)
        AS h GROUP BY hotel_name, city HAVING count(*) > 1
        UNION ALL SELECT 'hotel', 'hotel_id unique', CAST(hotel_id AS VARCHAR), count(*)
        FROM (SELECT hotel_id FROM hotel UNION ALL SELECT h.hotel_id FROM new_hotel
              JOIN hotel AS h USING (hotel_name)) AS i
        GROUP BY hotel_id HAVING count(*) > 1
        UNION ALL SELECT 'hotel', 'hotel_id not null', '', count(*)
        FROM new_hotel LEFT JOIN hotel AS h USING (hotel_name) WHERE h.hotel_id IS NULL
        UNION ALL SELECT 'hotel', 'star_rating between 1 and 5', '', count(*)
        FROM new_hotel WHERE star_rating NOT BETWEEN 1 AND 5
        UNION ALL SELECT 'review', 'hotel_id exists', CAST(hotel_id AS VARCHAR), count(*)
        FROM (SELECT doc_id AS hotel_id FROM documents) AS d
        WHERE hotel_id NOT IN (SELECT hotel_id FROM hotel) GROUP BY hotel_id""",
        new_hotel=NEW_HOTEL_SQL,
    ),
)
def validate_constraints(b: Binding) -> DataFrame:
    m = b.model(rating=False)
    known = m.hotel.select("hotel_name", "hotel_id")
    unchecked = new_hotels(b).drop("review_text", "reviewer_name").join(known, "hotel_name", "left")
    stray = m.review.withColumn("hotel_id", F.col("review_id"))
    broken = m.with_(hotel=m.hotel.unionByName(unchecked), review=stray)
    return maintenance.validate(broken)


@register(
    "cascade_delete",
    O.query(
        f"""SELECT 'hotel' AS table_name, hotel_id AS parent, 1 AS n FROM hotel
        WHERE country <> '{O.DELETED_REGION}'
        UNION ALL SELECT 'review', hotel_id, count(*) FROM review JOIN hotel USING (hotel_id)
        WHERE country <> '{O.DELETED_REGION}' GROUP BY hotel_id
        UNION ALL SELECT 'rating', hotel_id, count(*) FROM rating JOIN hotel USING (hotel_id)
        JOIN feature USING (feature_id)
        WHERE country <> '{O.DELETED_REGION}' AND feature_name <> 'Service' GROUP BY hotel_id
        UNION ALL SELECT 'seed', feature_id, count(*) FROM seed JOIN feature USING (feature_id)
        WHERE feature_name <> 'Service' GROUP BY feature_id"""
    ),
)
def cascade_delete(b: Binding) -> DataFrame:
    m = b.model()
    left: Model = maintenance.cascade_delete(
        m,
        hotels=m.hotel.filter(F.col("country") == O.DELETED_REGION),
        features=m.feature.filter(F.col("feature_name") == "Service"),
    )
    counts = None
    for name in ("hotel", "review", "rating", "seed"):
        parent = F.col("feature_id" if name == "seed" else "hotel_id").alias("parent")
        one = getattr(left, name).groupBy(parent).agg(F.count(F.lit(1)).alias("n"))
        one = one.select(F.lit(name).alias("table_name"), "parent", "n")
        counts = one if counts is None else counts.unionByName(one)
    return counts
