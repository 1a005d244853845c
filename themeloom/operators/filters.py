"""Row filters on reviews, quotes and themes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.schema import MIN_TEXT_LENGTH


def long_enough(text: Column, minimum: int = MIN_TEXT_LENGTH) -> Column:
    return F.length(text) >= minimum


def min_length(reviews: DataFrame, minimum: int = MIN_TEXT_LENGTH) -> DataFrame:
    """Reviews whose cleaned text has at least ``minimum`` characters."""
    return reviews.where(long_enough(F.col("text"), minimum))


def in_window(
    reviews: DataFrame, start: Column | str = "window_start", end: Column | str = "window_end"
) -> DataFrame:
    """Reviews dated within the window, both ends included."""
    low = F.col(start) if isinstance(start, str) else start
    high = F.col(end) if isinstance(end, str) else end
    return reviews.where(F.col("review_date").between(low, high))


def filter_language(
    reviews: DataFrame, wanted: str = "en", threshold: float = 0.9,
    lang: str = "lang", prob: str = "lang_prob",
) -> DataFrame:
    """Drop only rows confidently in another language; unknown or doubtful ones stay."""
    keep = (F.col(lang) == wanted) | (F.col(prob) < threshold)
    return reviews.where(F.coalesce(keep, F.lit(True)))


def quote_in_window(quotes: DataFrame) -> DataFrame:
    """Quotes whose matched review lies in the run's window."""
    return in_window(quotes)


def labelled_themes(themes: DataFrame) -> DataFrame:
    return themes.where(F.coalesce("label", F.lit("")) != "")
