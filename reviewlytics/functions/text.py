"""Text expressions: folding, sentences, words, polarity."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where a sentence ends, what a word is, which words never matter.
SENTENCE_END = r"[.!?]+\s+|\n+"
WORD = r"[\p{L}\p{N}_]+(?:-[\p{L}\p{N}_]+)*"
PLAIN_WORD = r"^[a-z]+$"
JUNK_WORDS = ("quot",)
FILLER_WORDS = ("just", "even", "still", "get", "got")
# Normaliser of the published rule-based polarity score x / sqrt(x^2 + 15).
POLARITY_ALPHA = 15.0
VALENCE_PLACES = 4
POLARITY_PLACES = 4

# Letters outside ASCII that match an ASCII letter when case is ignored.
_FOLDS_TO_ASCII = ("ſKİı", "skii")


def fold_text(text: Column) -> Column:
    """Lower case such that an ASCII phrase occurs in the result exactly where a
    case-insensitive Unicode regex would find it in ``text``."""
    return F.lower(F.translate(text, *_FOLDS_TO_ASCII))


def ignore_case(pattern: str) -> str:
    """Java's plain ``(?i)`` folds ASCII only; ``u`` adds the rest."""
    return f"(?iu){pattern}"


def phrase_count(text: Column, phrase: Column) -> Column:
    """Non-overlapping, case-insensitive regex matches; an empty phrase matches nothing."""
    pattern = F.concat(F.lit("(?iu)"), F.nullif(phrase, F.lit("")))
    return F.coalesce(F.regexp_count(text, pattern), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(text, SENTENCE_END)


def words(sentence: Column) -> Column:
    """Lower-case words; a hyphenated compound is one word."""
    return F.regexp_extract_all(F.lower(sentence), F.lit(WORD), F.lit(0))


def clean_words(tokens: Column, is_stop_word) -> Column:
    """Plain a-z words that are no stop, junk or filler words.

    ``is_stop_word`` maps a word column to a boolean column.
    """
    noise = [*JUNK_WORDS, *FILLER_WORDS]
    return F.filter(
        tokens, lambda w: w.rlike(PLAIN_WORD) & ~w.isin(noise) & ~is_stop_word(w)
    )


def valence_sum(tokens: Column, valence_of) -> Column:
    """Sum of scaled valences (a long) over the words of a token array."""
    return F.aggregate(
        tokens,
        F.lit(0).cast("bigint"),
        lambda total, w: total + F.coalesce(valence_of(w), F.lit(0).cast("bigint")),
    )


def polarity(scaled_sum: Column) -> Column:
    """Scaled polarity in [-10000, 10000], a long: s / sqrt(s^2 + 15) to four places."""
    s = scaled_sum.cast("double") / F.lit(float(10**VALENCE_PLACES))
    value = s / F.sqrt(s * s + F.lit(POLARITY_ALPHA))
    rounded = F.round(value.cast("decimal(18,8)"), POLARITY_PLACES)
    return (rounded * 10**POLARITY_PLACES).cast("bigint")


def unscale(value: Column, places: int = POLARITY_PLACES) -> Column:
    return value.cast("double") / F.lit(float(10**places))
