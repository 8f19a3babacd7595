"""The supplied tables as hotels, features, seeds and reviews.

Suppliers are hotels, documents are their reviews (all of them, whole), part types are features
and the words of part names, with the phrases of ``words``, are seeds. Every tenth hotel gets
no review: its share goes to the hotel before it.
"""

from __future__ import annotations

import datetime
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from reviewlytics.functions.clean import seed_weight
from reviewlytics.operators.bounded import join_dimension, local_rows
from reviewlytics.operators.ids import assign_ids
from reviewlytics.operators.lineage import scratch_folder
from reviewlytics.plans import upkeep
from reviewlytics.plans.aspects import WordTables
from reviewlytics.plans.scoring import calc_ratings
from reviewlytics.schema import RATING_TYPE, Model
from reviewlytics.sources import tables
from reviewlytics.sources.review_files import file_to_city, file_to_hotel
from workbench import words as W

UPDATED = datetime.date(2025, 1, 1)

# Schemas already read from footers, as a catalog would hold them.
_SCHEMAS: dict[str, StructType] = {}

# (application, folder) -> place of the stored tables.
_STORED: dict[tuple[str, str], str] = {}

# part type -> (feature_id, feature_name, is_active)
FEATURES = {
    "SMALL": (1, "Cleanliness", "Y"),
    "MEDIUM": (2, "Service", "Y"),
    "STANDARD": (3, "Location", "Y"),
    "LARGE": (4, "Comfort", "Y"),
    "ECONOMY": (5, "Price Value", "Y"),
    "PROMO": (6, "Parking", "N"),
}


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows over all cores if the input is one small file; large inputs are left as they lie."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, key)


def per_type(position: int) -> Column:
    choice = F.when(F.lit(False), F.lit(FEATURES["SMALL"][position]))
    for part_type, values in FEATURES.items():
        choice = choice.when(F.col("p_type") == part_type, F.lit(values[position]))
    return choice


class Binding:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            path = os.path.join(self.sf_dir, f"{name}.parquet")
            reader = self.spark.read
            if path in _SCHEMAS:
                reader = reader.schema(_SCHEMAS[path])
            self._tables[name] = reader.parquet(path)
            _SCHEMAS[path] = self._tables[name].schema
        return self._tables[name]

    # hotels -------------------------------------------------------------------------------

    def supplier_places(self) -> DataFrame:
        nation = self.table("nation").join(
            self.table("region"), F.col("n_regionkey") == F.col("r_regionkey")
        )
        return self.table("supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))

    def hotel(self) -> DataFrame:
        return self.supplier_places().select(
            (F.col("s_suppkey") + 1).alias("hotel_id"), F.col("s_name").alias("hotel_name"),
            F.concat(F.lit("Street "), F.col("s_suppkey").cast("string")).alias("address"),
            F.col("n_name").alias("city"), F.col("r_name").alias("country"),
            self._raw_star().try_cast(RATING_TYPE).alias("star_rating"),
        )

    @staticmethod
    def _raw_star() -> Column:
        number = ((F.col("s_suppkey") % 9 + 2) / 2).cast(RATING_TYPE).cast("string")
        return F.when(F.col("s_suppkey") % 5 == 0, "NA").otherwise(number)

    def raw_hotels(self) -> DataFrame:
        return self.supplier_places().select(
            F.col("s_name").alias("hotel_name"),
            F.concat(F.lit("Street "), F.col("s_suppkey").cast("string")).alias("address"),
            F.col("n_name").alias("city"), F.col("r_name").alias("country"),
            self._raw_star().alias("star_rating"),
        )

    # features and seeds -------------------------------------------------------------------

    def feature(self) -> DataFrame:
        parts = F.concat(F.count(F.lit(1)).cast("string"), F.lit(" parts"))
        return (
            self.table("part").groupBy("p_type").agg(parts.alias("description"))
            .select(
                per_type(0).cast("bigint").alias("feature_id"),
                per_type(1).alias("feature_name"), "description",
                per_type(2).alias("is_active"),
            )
        )

    def raw_features(self) -> DataFrame:
        return self.feature().select("feature_name", "description", "is_active")

    def seed_rows(self) -> DataFrame:
        """(feature_id, seed_phrase, raw weight): words of part names plus given phrases."""
        tenths = F.sum("p_size") % 21 - 10
        size = F.abs(tenths)
        text = F.concat(
            F.when(tenths < 0, "-").otherwise(""),
            F.floor(size / 10).cast("string"), F.lit("."), (size % 10).cast("string"),
        )
        from_parts = (
            self.table("part")
            .select(
                per_type(0).cast("bigint").alias("feature_id"),
                F.explode(F.split("p_name", " ")).alias("seed_phrase"), "p_size",
            )
            .groupBy("feature_id", "seed_phrase")
            .agg(text.alias("weight"))
        )
        given = local_rows(
            self.spark, W.SEED_PHRASES, "feature_id bigint, seed_phrase string, weight string"
        )
        return from_parts.unionByName(given)

    def raw_seeds(self) -> DataFrame:
        names = self.feature().select("feature_id", "feature_name")
        return self.seed_rows().join(names, "feature_id").select(
            "feature_name", "seed_phrase", "weight"
        )

    def seed(self) -> DataFrame:
        rows = self.seed_rows().withColumn("weight", seed_weight(F.col("weight")))
        return assign_ids(rows, "seed_id", ["feature_id", "seed_phrase"])

    # reviews ------------------------------------------------------------------------------

    def documents(self) -> DataFrame:
        return self.table("documents")

    def _hotel_id(self) -> Column:
        # A literal, so that a filter on the hotel can go down to the documents.
        nth = F.col("doc_id") % F.lit(self.table("supplier").count())
        return nth - F.when(nth % 10 == 9, 1).otherwise(0) + 1

    def review(self) -> DataFrame:
        rating = (F.lit(1) + (F.col("n_chars") % 9) * F.lit(0.5)).cast(RATING_TYPE)
        day = F.date_add(F.lit(datetime.date(2024, 1, 1)), (F.col("doc_id") % 700).cast("int"))
        return spread(self.documents(), "doc_id").select(
            F.col("doc_id").alias("review_id"),
            self._hotel_id().alias("hotel_id"),
            F.col("text").alias("review_text"),
            F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("reviewer_name"),
            F.when(F.col("doc_id") % 11 != 0, day).alias("review_date"),
            F.when(F.col("n_chars") % 11 != 0, rating).alias("overall_rating"),
        )

    def raw_reviews(self) -> DataFrame:
        """All strings, dates in three shapes, one of them unreadable; texts keep their line breaks."""
        date = F.col("review_date")
        shape = F.col("review_id") % 3
        raw_date = (
            F.when(shape == 0, F.date_format(date, "M/d/yy"))
            .when(shape == 1, F.date_format(date, "yyyy-MM-dd"))
            .otherwise(F.date_format(date, "dd.MM.yyyy"))
        )
        hotels = self.hotel().select("hotel_id", "hotel_name")
        return join_dimension(self.review(), hotels, "hotel_id").select(
            "hotel_name",
            "review_text",
            "reviewer_name",
            raw_date.alias("review_date"),
            F.coalesce(F.col("overall_rating").cast("string"), F.lit("NA")).alias("overall_rating"),
        )

    # model --------------------------------------------------------------------------------

    def model(self, rating: bool = True) -> Model:
        m = Model(self.hotel(), self.feature(), self.seed(), self.review())
        return m.with_(rating=calc_ratings(m, updated=UPDATED)) if rating else m

    def stored(self) -> Model:
        """The tables stored and scored, as searches and views find them: once per application and folder."""
        key = (self.spark.sparkContext.applicationId, self.sf_dir)
        if key not in _STORED:
            root = scratch_folder(self.spark, "stored")
            tables.write_tables(self.model(rating=False), root)
            upkeep.score_tables(self.spark, root, updated=UPDATED)
            _STORED[key] = root
        return tables.read_tables(self.spark, _STORED[key])

    # mining -------------------------------------------------------------------------------

    def mined_reviews(self) -> DataFrame:
        """Documents as review files: one file per source, in a directory per name length."""
        located = spread(self.documents(), "doc_id").withColumn("file", review_file())
        return located.select(
            "doc_id", "file", file_to_hotel(F.col("file")).alias("hotel"),
            file_to_city(F.col("file")).alias("city"), F.lit("2024-05-01").alias("date"),
            F.col("lang").alias("subject"), F.col("text").alias("review"),
        )

    def word_tables(self) -> WordTables:
        def rows(values, schema: str) -> DataFrame:
            return local_rows(self.spark, values, schema)

        return WordTables(
            aspect_keyword=rows(W.ASPECT_KEYWORDS, "aspect string, keyword string"),
            lexicon=rows(W.LEXICON, "token string, valence string").withColumn(
                "valence", F.col("valence").cast("decimal(9,4)")
            ),
            stop_word=rows([(w,) for w in W.STOP_WORDS], "token string"),
            token_lemma=rows(W.LEMMAS, "token string, lemma string"),
            token_tag=rows(W.TAGS, "token string, tag string"),
        )


def one_line(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def review_file() -> Column:
    return F.concat(
        F.lit("region-"), F.length("source").cast("string"), F.lit("/"), F.col("source"),
        F.lit(".txt"),
    )
