"""Look-back windows and the counts taken over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.weeks import report_weeks_of, week_end_of, week_of, window_start_of
from themeloom.schema import APP_STORE, GOOGLE_PLAY, WINDOW_WEEKS


def lookback_windows(reviews: DataFrame, weeks: int = WINDOW_WEEKS) -> DataFrame:
    """Every review once per report week whose window contains it."""
    spread = reviews.withColumn("week_start", F.explode(report_weeks_of(F.col("review_date"), weeks)))
    return spread.withColumns(
        {
            "week_end": week_end_of(F.col("week_start")),
            "window_start": window_start_of(F.col("week_start"), weeks),
            "window_end": week_end_of(F.col("week_start")),
        }
    )


def lookback_summary(
    reviews: DataFrame, group_cols: tuple[str, ...] = (), weeks: int = WINDOW_WEEKS
) -> DataFrame:
    """Review count, mean rating and date range of every report week's window.

    Rows are summed per calendar week first; only those sums are spread over the report weeks they
    count for, so the tenfold overlap of windows is never paid in reviews.
    """
    per_week = (
        reviews.withColumn("_week", week_of(F.col("review_date")))
        .groupBy(*group_cols, "_week")
        .agg(
            F.count("*").alias("_n"),
            F.sum("rating").alias("_ratings"),
            F.min("review_date").alias("_first"),
            F.max("review_date").alias("_last"),
        )
    )
    spread = per_week.withColumn("week_start", F.explode(report_weeks_of(F.col("_week"), weeks)))
    return spread.groupBy(*group_cols, "week_start").agg(
        F.sum("_n").alias("review_count"),
        F.round(F.sum("_ratings") / F.sum("_n"), 2).alias("avg_rating"),
        F.min("_first").alias("first_date"),
        F.max("_last").alias("last_date"),
    )


def source_counts(reviews: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Total and per-store row counts."""
    return reviews.groupBy(*group_cols).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("source") == GOOGLE_PLAY).alias("google_play"),
        F.count_if(F.col("source") == APP_STORE).alias("app_store"),
    )


def batch_date_bounds(
    reviews: DataFrame, start: Column, end: Column, batch_cols: tuple[str, ...] = ("batch",)
) -> DataFrame:
    """Per fetched batch: date range, size, and whether rows lie after, in or before the window.

    ``past_window`` is the stop rule of a newest-first fetch: only older rows seen.
    """
    day = F.col("review_date")
    newer, inside, older = day > end, day.between(start, end), day < start
    bounds = reviews.groupBy(*batch_cols).agg(
        F.max(day).alias("newest"),
        F.min(day).alias("oldest"),
        F.count("*").alias("batch_size"),
        F.bool_or(newer).alias("has_newer"),
        F.bool_or(inside).alias("has_inside"),
        F.bool_or(older).alias("has_older"),
    )
    return bounds.withColumn("past_window", F.expr("has_older AND NOT has_newer AND NOT has_inside"))


def window_counts(
    fetched: DataFrame,
    processed: DataFrame,
    group_cols: tuple[str, ...] = ("product",),
    weeks: int = WINDOW_WEEKS,
) -> DataFrame:
    """Fetched and processed rows in every report week's window."""
    both = fetched.select(*group_cols, "review_date", F.lit(1).alias("_f"), F.lit(0).alias("_p"))
    both = both.unionByName(
        processed.select(*group_cols, "review_date", F.lit(0).alias("_f"), F.lit(1).alias("_p"))
    )
    per_week = (
        both.withColumn("_week", week_of(F.col("review_date")))
        .groupBy(*group_cols, "_week")
        .agg(F.sum("_f").alias("_f"), F.sum("_p").alias("_p"))
    )
    spread = per_week.withColumn("week_start", F.explode(report_weeks_of(F.col("_week"), weeks)))
    return spread.groupBy(*group_cols, "week_start").agg(
        F.sum("_f").alias("reviews_fetched"), F.sum("_p").alias("reviews_processed")
    )
