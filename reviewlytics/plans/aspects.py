"""Fixed word lists of the miner and the dictionaries built from word tables.

Lemmas, tags and valences come from tables the caller supplies: the library has no language
model of its own. With empty lemma and tag tables a word is its own lemma and a noun.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlytics.functions.text import VALENCE_PLACES, sentences, words
from reviewlytics.operators.bounded import local_rows
from reviewlytics.operators.dictionary import (
    MAX_DICTIONARY_ROWS,
    RowDictionary,
    collect_dictionary,
    empty_dictionary,
)

# The five aspects and the words that name them.
ASPECT_KEYWORDS = {
    "cleanliness": ("clean", "dirty", "filthy", "spotless", "tidy", "stain", "grimy", "dusty", "fresh"),
    "service": (
        "service", "staff", "reception", "manager", "rude", "helpful", "check", "checkin", "checkout",
        "housekeeping", "front desk",
    ),
    "location": (
        "location", "walk", "near", "close", "distance", "station", "tube", "area", "convenient",
        "central", "neighborhood",
    ),
    "comfort": (
        "bed", "room", "comfortable", "noise", "noisy", "quiet", "hot", "cold", "air", "ac", "heating",
        "pillow", "mattress", "sleep",
    ),
    "price": ("price", "cost", "expensive", "cheap", "value", "worth", "deal", "rate", "charge", "fee"),
}
ASPECTS = tuple(ASPECT_KEYWORDS)


def default_aspect_keywords(spark: SparkSession) -> DataFrame:
    """(aspect, keyword)"""
    rows = [(a, k) for a, names in ASPECT_KEYWORDS.items() for k in names]
    return local_rows(spark, rows, "aspect string, keyword string")


def keyword_lemmas(aspect_keyword: DataFrame, token_lemma: DataFrame | None = None) -> DataFrame:
    """(aspect, keyword, lemma): multi-word keywords split, every word lemmatised."""
    split = aspect_keyword.select(
        "aspect", "keyword", F.explode(F.split(F.lower("keyword"), " +")).alias("token")
    ).filter("token <> ''")
    if token_lemma is None:
        return split.select("aspect", "keyword", F.col("token").alias("lemma"))
    return split.join(token_lemma.select("token", "lemma"), "token", "left").select(
        "aspect", "keyword", F.coalesce("lemma", "token").alias("lemma")
    )


@dataclass(frozen=True)
class WordTables:
    """Word tables of one run. Only ``aspect_keyword`` and ``lexicon`` are required.

    aspect_keyword(aspect, keyword), lexicon(token, valence), stop_word(token),
    token_lemma(token, lemma), token_tag(token, tag)
    """

    aspect_keyword: DataFrame
    lexicon: DataFrame
    stop_word: DataFrame | None = None
    token_lemma: DataFrame | None = None
    token_tag: DataFrame | None = None
    #: Tables of more rows are joined instead of becoming literals; the results are the same.
    bound: int = MAX_DICTIONARY_ROWS


class WordLookups:
    """The word tables as in-row lookups. Tables beyond ``bound`` rows are looked up in columns that
    ``attach`` adds to the texts; ``columns`` names them, and selections have to carry them along."""

    def __init__(self, tables: WordTables, bound: int | None = None):
        self.bound = tables.bound if bound is None else bound
        valence = F.round(F.col("valence") * 10**VALENCE_PLACES, 0).cast("bigint")
        self.valences = collect_dictionary(
            tables.lexicon, "token", valence, "bigint", bound=self.bound, name="_valences"
        )
        self.keywords = collect_dictionary(
            keyword_lemmas(tables.aspect_keyword, tables.token_lemma),
            "lemma", F.col("aspect"), "string", many=True, bound=self.bound, name="_keywords",
        )
        self.stop_words = self._optional(tables.stop_word, "token", "string", "_stop_words")
        self.lemmas = self._optional(tables.token_lemma, "lemma", "string", "_lemmas")
        self.tags = self._optional(tables.token_tag, "tag", "string", "_tags")
        every = (self.valences, self.lemmas, self.stop_words, self.tags, self.keywords)
        self.large = [d for d in every if isinstance(d, RowDictionary)]
        self.columns = [d.name for d in self.large]

    def _optional(self, table: DataFrame | None, value: str, value_type: str, name: str):
        if table is None:
            return empty_dictionary(value_type)
        return collect_dictionary(table, "token", F.col(value), value_type, bound=self.bound, name=name)

    def attach(self, texts: DataFrame, text: str) -> DataFrame:
        """``texts`` with the entries of the large tables that each text needs."""
        tokens = F.flatten(F.transform(sentences(F.coalesce(F.col(text), F.lit(""))), words))
        for dictionary in self.large:
            # Keywords come last: they are looked up by lemma.
            found = F.transform(tokens, self.lemma) if dictionary is self.keywords else tokens
            texts = dictionary.attach(texts, text, found)
        return texts

    def valence(self, word: Column) -> Column:
        return self.valences.value_of(word)

    def lemma(self, word: Column) -> Column:
        return F.coalesce(self.lemmas.value_of(word), word) if len(self.lemmas) else word

    def tag(self, word: Column) -> Column:
        """An unlisted word is a noun."""
        return F.coalesce(self.tags.value_of(word), F.lit("NN"))

    def aspects(self, word: Column) -> Column:
        """Aspects the word's lemma is a keyword of; NULL for most words."""
        return self.keywords.value_of(self.lemma(word))

    def is_keyword(self, word: Column) -> Column:
        return self.keywords.contains(self.lemma(word))

    def is_stop_word(self, word: Column) -> Column:
        return self.stop_words.contains(word)
