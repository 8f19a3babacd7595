"""Cleaning of a corpus in five stages, from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of ``documents``. Stages are applied to what their predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.llm import language, minhash, packing, repeats, tiling
from reviewlytics.llm.common import stored, table
from reviewlytics.llm.queries import vocabulary

#: Word shingles and minhashing, learned languages and packing have no counterpart in SQL; the
#: tests compare the stages with plain versions.
ORACLE_SQL = None


def _rows(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns``, and every row as a struct, so that no name of the table meets one of an operator."""
    return docs.select(*columns, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without text or letters go. The model learns from the
    labelled documents."""
    model = language.fit(docs.where("doc_id is not null"))
    found = language.predict(_rows(docs, "text"), model, ("row",))
    return found.where(F.col("lang_pred") != language.UNKNOWN).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; repeated
    rows of one doc_id and text are one document, rows without doc_id stay. Of a doc_id with several texts, of
    which one is looked at, all stay or go."""
    kept = minhash.near_duplicates(docs).where("kept and doc_id is not null").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return named.select(*docs.columns).unionByName(docs.where("doc_id is null"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the strings of 200 bytes and more that occur elsewhere too."""
    cut = repeats.remove_repeats(_rows(docs, "doc_id", "text"), keep=("row",))
    new = {"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("bigint")}
    return cut.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark."""
    return tiling.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of at most 2048 ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("near-duplicate removal", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("best-fit packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
