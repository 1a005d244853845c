"""Copies among reviews: which row survives, and the counts of a cleaning pass.

The fingerprint contains the review date, so copies always share their windows. Deduplication is
therefore done once per review, before look-back windows multiply the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import clean_text, dedup_key
from themeloom.operators.filters import long_enough
from themeloom.schema import MIN_TEXT_LENGTH
from themeloom.session import cut_lineage


def clean_reviews(reviews: DataFrame) -> DataFrame:
    """Clean the text and add its fingerprint.

    The text passes through a one-element array on purpose: a later filter on it would otherwise be
    pushed below the cleaning by repeating the whole of it, Python included.
    """
    once = F.explode_outer(F.array(clean_text(F.col("text"))))
    return reviews.withColumn("text", once).withColumn(
        "dedup_key", dedup_key(F.col("text"), F.col("rating"), F.col("review_date"))
    )


def dedup_reviews(
    reviews: DataFrame, group_cols: tuple[str, ...] = (), key: str = "dedup_key", order: str = "ord"
) -> DataFrame:
    """Keep the first row per fingerprint.

    The rank filter also runs before the shuffle, so every map task sends at most one row of a
    group of copies, however large the group.
    """
    first = Window.partitionBy(*group_cols, key).orderBy(order)
    return reviews.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def _rejection(start: Column, end: Column, minimum: int) -> Column:
    return F.when(~long_enough(F.col("text"), minimum), "short").when(
        ~F.col("review_date").between(start, end), "out_of_window"
    )


def drop_reason(
    cleaned: DataFrame,
    start: Column,
    end: Column,
    group_cols: tuple[str, ...] = (),
    minimum: int = MIN_TEXT_LENGTH,
) -> DataFrame:
    """Label every row ``short``, ``out_of_window``, ``duplicate`` or ``kept``; first hit wins.

    Survivors are found by a partial minimum per fingerprint and joined back on the unique order
    key, so no task ever holds all copies of one text. The cleaned rows are written first: source and
    cleaning are passed once, and survivors are found from three narrow columns of the table.
    """
    rows = cut_lineage(cleaned.withColumn("_rejected", _rejection(start, end, minimum)))
    survivors = (
        rows.groupBy(*group_cols, "dedup_key")
        .agg(F.min(F.when(F.col("_rejected").isNull(), F.col("ord"))).alias("ord"))
        .where("ord IS NOT NULL")
        .select(*group_cols, "ord", F.lit(True).alias("_first"))
    )
    marked = rows.join(survivors, [*group_cols, "ord"], "left")
    reason = F.coalesce(
        "_rejected", F.when(F.col("_first"), F.lit("kept")).otherwise(F.lit("duplicate"))
    )
    return marked.withColumn("drop_reason", reason).drop("_rejected", "_first")


def cleaning_stats(
    cleaned: DataFrame,
    start: Column,
    end: Column,
    group_cols: tuple[str, ...] = (),
    minimum: int = MIN_TEXT_LENGTH,
) -> DataFrame:
    """Kept, short, out-of-window and duplicate counts with the kept date range.

    Counts copies per fingerprint first, then sums: two partial aggregations, no row is ranked.
    """
    rejected = _rejection(start, end, minimum)
    per_key = (
        cleaned.select(
            *group_cols,
            rejected.alias("_rejected"),
            F.when(rejected.isNull(), F.col("dedup_key")).alias("_key"),
            "review_date",
        )
        .groupBy(*group_cols, "_rejected", "_key")
        .agg(F.count("*").alias("_n"), F.min("review_date").alias("_day"))
    )
    passed = F.col("_rejected").isNull()

    def rows_of(reason: str) -> Column:
        counted = F.sum(F.when(F.col("_rejected") == reason, F.col("_n")))
        return F.coalesce(counted, F.lit(0)).alias(reason)

    kept = F.count_if(passed)
    copies = F.coalesce(F.sum(F.when(passed, F.col("_n") - 1)), F.lit(0))
    return per_key.groupBy(*group_cols).agg(
        kept.alias("kept"),
        rows_of("short"),
        rows_of("out_of_window"),
        copies.alias("duplicate"),
        F.min(F.when(passed, F.col("_day"))).alias("earliest"),
        F.max(F.when(passed, F.col("_day"))).alias("latest"),
    )
