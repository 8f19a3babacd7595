"""CSV exports of the miner: review sentiment, seeds, seeds by hotel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlytics.operators.lineage import cut_lineage
from reviewlytics.plans.aspects import ASPECTS
from reviewlytics.plans.mining import by_hotel_rows, merge_files
from reviewlytics.plans.sentiment import as_text
from reviewlytics.schema import raw_schema
from reviewlytics.sources.tables import write_csv

# The column order of the files.
SENTIMENT_COLUMNS = ("hotel", "city", "date", "subject", "review", "sentiment", "compound") + tuple(
    f"{a}_{part}" for a in ASPECTS for part in ("score", "label")
)
SEED_COLUMNS = ("feature_name", "seed_phrase", "weight")
SEED_BY_HOTEL_COLUMNS = ("hotel", "city") + SEED_COLUMNS

SENTIMENT_SCHEMA = raw_schema(*SENTIMENT_COLUMNS)
SEED_SCHEMA = raw_schema(*SEED_COLUMNS)
SEED_BY_HOTEL_SCHEMA = raw_schema(*SEED_BY_HOTEL_COLUMNS)


def write_review_sentiment(sentiment: DataFrame, path: str) -> None:
    numbers = {"compound", *(f"{a}_score" for a in ASPECTS)}
    columns = [as_text(F.col(c)).alias(c) if c in numbers else F.col(c) for c in SENTIMENT_COLUMNS]
    write_csv(sentiment.select(*columns), path)


def write_seeds(
    seeds: DataFrame, path: str, by_hotel: DataFrame | None = None, by_hotel_path: str = ""
) -> None:
    """Merged seeds and, if a second path is given, the seeds of every file."""
    write_csv(_seed_rows(seeds, SEED_COLUMNS), path)
    if by_hotel is not None and by_hotel_path:
        write_csv(_seed_rows(by_hotel, SEED_BY_HOTEL_COLUMNS), by_hotel_path)


def write_mined_seeds(by_file: DataFrame, path: str, by_hotel_path: str) -> None:
    """Both seed files from one mining pass: ``mining.phrase_scores_by_file`` is stored first."""
    stored = cut_lineage(by_file)
    write_seeds(merge_files(stored), path, by_hotel_rows(stored), by_hotel_path)


def _seed_rows(seeds: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    return seeds.withColumn("weight", as_text(F.col("weight"))).select(*columns)
