"""Sentiment of every review, overall and per aspect.

Everything about a review is computed inside its row: its sentences are an array of
(scaled valence sum, aspects mentioned). Nothing is shuffled, so a long or hot hotel file is
just more rows. Polarity is the published x / sqrt(x^2 + 15) of the summed word valences,
without negation or booster rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlytics.functions.clean import NEGATIVE_TO, POSITIVE_FROM, sentiment_label
from reviewlytics.functions.text import (
    POLARITY_PLACES,
    polarity,
    sentences,
    unscale,
    valence_sum,
    words,
)
from reviewlytics.plans.aspects import ASPECTS, WordLookups, WordTables


def _sentence_facts(text: Column, look: WordLookups) -> Column:
    """array<struct<valence, aspects>>; a sentence counts an aspect once."""

    def facts(tokens: Column) -> Column:
        keywords = F.filter(tokens, look.is_keyword)
        aspects = F.array_distinct(F.flatten(F.transform(keywords, look.aspects)))
        return F.struct(
            valence_sum(tokens, look.valence).alias("valence"), aspects.alias("aspects")
        )

    return F.transform(F.transform(sentences(text), words), facts)


def _annotated(reviews: DataFrame, look: WordLookups, text: str) -> DataFrame:
    # explode of a one-element array evaluates the expression once, however often the
    # aggregates below refer to it.
    facts = F.array(_sentence_facts(F.coalesce(F.col(text), F.lit("")), look))
    return look.attach(reviews, text).withColumn("_facts", F.explode(facts)).drop(*look.columns)


def _mean_polarity(aspect: str) -> Column:
    """Scaled mean sentence polarity of an aspect, not rounded; NULL if no sentence mentions it."""
    about = F.filter("_facts", lambda s: F.array_contains(s["aspects"], aspect))
    total = F.aggregate(
        about, F.lit(0).cast("bigint"), lambda t, s: t + polarity(s["valence"])
    )
    return total.cast("double") / F.nullif(F.size(about), F.lit(0))


def _shown(mean: Column) -> Column:
    """A scaled mean to four places."""
    return unscale(F.round(mean, 0))


def _label(mean: Column) -> Column:
    """Label of a scaled mean. Thresholds are whole numbers at this scale, and a quotient of whole
    numbers reaches a whole number only if it is one: rounding for display plays no part."""
    scale = 10**POLARITY_PLACES
    return sentiment_label(mean, round(POSITIVE_FROM * scale), round(NEGATIVE_TO * scale))


def _overall_polarity() -> Column:
    return unscale(
        polarity(
            F.aggregate("_facts", F.lit(0).cast("bigint"), lambda t, s: t + s["valence"])
        )
    )


def lexicon_polarity(reviews: DataFrame, tables: WordTables, text: str = "review") -> DataFrame:
    """``reviews`` plus the polarity of the whole text."""
    annotated = _annotated(reviews, WordLookups(tables), text)
    return annotated.withColumn("compound", _overall_polarity()).drop("_facts")


def aspect_mentions(
    reviews: DataFrame, tables: WordTables, keys: list[str], text: str = "review"
) -> DataFrame:
    """Per review, sentence and aspect mentioned: ``keys`` + sentence_no, aspect, polarity."""
    look = WordLookups(tables)
    return (
        _annotated(reviews, look, text)
        .select(*keys, F.posexplode("_facts").alias("sentence_no", "s"))
        .select(
            *keys, "sentence_no", F.explode("s.aspects").alias("aspect"),
            unscale(polarity(F.col("s.valence"))).alias("polarity"),
        )
    )


def aspect_scores(
    reviews: DataFrame, tables: WordTables, keys: list[str], text: str = "review"
) -> DataFrame:
    """Per review and aspect mentioned: ``keys`` + aspect, score, label."""
    annotated = _annotated(reviews, WordLookups(tables), text)
    scores = F.array(
        *[
            F.struct(F.lit(a).alias("aspect"), _mean_polarity(a).alias("_mean"))
            for a in ASPECTS
        ]
    )
    return (
        annotated.select(*keys, F.inline(scores))
        .filter(F.col("_mean").isNotNull())
        .select(*keys, "aspect", _shown(F.col("_mean")).alias("score"), _label(F.col("_mean")).alias("label"))
    )


def review_sentiment(reviews: DataFrame, tables: WordTables, text: str = "review") -> DataFrame:
    """Every review with its sentiment, compound, and a score and label per aspect.

    An aspect no sentence mentions has neither score nor label.
    """
    annotated = _annotated(reviews, WordLookups(tables), text).withColumn(
        "compound", _overall_polarity()
    )
    scored = annotated.select(
        *[c for c in annotated.columns if c not in ("_facts", "compound")],
        "compound",
        *[_mean_polarity(a).alias(f"_{a}") for a in ASPECTS],
    )
    ordered = []
    for aspect in ASPECTS:
        mean = F.col(f"_{aspect}")
        label = F.when(mean.isNotNull(), _label(mean))
        ordered += [_shown(mean).alias(f"{aspect}_score"), label.alias(f"{aspect}_label")]
    return scored.select(
        *reviews.columns,
        sentiment_label(F.col("compound")).alias("sentiment"),
        "compound",
        *ordered,
    )


def as_text(value: Column) -> Column:
    """Four fixed decimals, as the exported files have them; NULL stays NULL."""
    return F.when(value.isNotNull(), F.format_string(f"%.{POLARITY_PLACES}f", value))
