"""Per-theme statistics and the bounded samples that go into a prompt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.text import truncate_text
from themeloom.functions.weeks import report_weeks_of, week_of
from themeloom.schema import CONFIG_DEFAULTS, WINDOW_WEEKS

SAMPLE_IDS = 3


def first_rows(rows: DataFrame, keys: tuple[str, ...], n: int, *order: Column | str) -> DataFrame:
    """First ``n`` rows per key, with their number in ``rank``. Spark cuts before the shuffle too."""
    ranked = rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    )
    return ranked.where(F.col("rank") <= n)


def theme_stats(
    reviews: DataFrame, group_cols: tuple[str, ...] = ("run_id",), ks: DataFrame | None = None
) -> DataFrame:
    """Review count, mean rating and the first three review ids of every cluster.

    ``ks`` (group columns and ``k``) adds the clusters nothing was assigned to.
    """
    keys = (*group_cols, "cluster_id")
    totals = reviews.groupBy(*keys).agg(
        F.count("*").alias("review_count"), F.round(F.avg("rating"), 2).alias("avg_rating")
    )
    samples = (
        first_rows(reviews.select(*keys, "ord", "review_id"), keys, SAMPLE_IDS, "ord")
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("rank", "review_id"))).alias("_ids"))
    )
    stats = totals.join(samples, list(keys), "left")
    if ks is not None:
        slots = ks.select(
            *group_cols, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("cluster_id")
        )
        stats = slots.join(stats, list(keys), "left")
    no_ids = F.array().cast("array<string>")
    return stats.select(
        *keys,
        F.coalesce("review_count", F.lit(0)).alias("review_count"),
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce(F.col("_ids.review_id"), no_ids).alias("sample_review_ids"),
    )


def window_theme_stats(
    reviews: DataFrame,
    named: Callable[[DataFrame], DataFrame],
    group_cols: tuple[str, ...] = ("product",),
    run_cols: tuple[str, ...] = ("run_id",),
    weeks: int = WINDOW_WEEKS,
) -> DataFrame:
    """``theme_stats`` of every report week's window, keyed by ``run_cols`` and ``cluster_id``.

    ``reviews`` has each review once. Counts, ratings and first ids are taken per calendar week; only those
    are spread over the report weeks they count for. ``named`` adds ``run_cols`` to rows with ``group_cols``
    and ``week_start``.
    """
    dated = reviews.withColumn("_week", week_of(F.col("review_date")))
    keys, place = (*run_cols, "cluster_id"), (*group_cols, "_week", "cluster_id")

    def spread(rows: DataFrame) -> DataFrame:
        return named(rows.withColumn("week_start", F.explode(report_weeks_of(F.col("_week"), weeks))))

    per_week = dated.groupBy(*place).agg(F.count("*").alias("_n"), F.sum("rating").alias("_ratings"), F.count("rating").alias("_rated"))
    totals = spread(per_week).groupBy(*keys).agg(
        F.sum("_n").alias("review_count"), F.round(F.sum("_ratings") / F.sum("_rated"), 2).alias("avg_rating")
    )
    first = first_rows(dated.select(*place, "ord", "review_id"), place, SAMPLE_IDS, "ord").drop("rank")
    samples = first_rows(spread(first), keys, SAMPLE_IDS, "ord").groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("rank", "review_id"))).alias("_ids")
    )
    return totals.join(samples, list(keys), "left").select(
        *keys,
        "review_count",
        F.coalesce("avg_rating", F.lit(0.0)).alias("avg_rating"),
        F.coalesce(F.col("_ids.review_id"), F.array().cast("array<string>")).alias("sample_review_ids"),
    )


def placeholder_themes(stats: DataFrame) -> DataFrame:
    """Themes before a model has named them."""
    return stats.withColumn(
        "label", F.concat(F.lit("Theme "), (F.col("cluster_id") + 1).cast("string"))
    ).withColumn("description", F.lit(""))


def sample_for_prompt(
    reviews: DataFrame,
    group_cols: tuple[str, ...] = ("run_id",),
    per_cluster: int = CONFIG_DEFAULTS["max_reviews_per_cluster"],
    max_chars: Column | int = CONFIG_DEFAULTS["max_review_chars"],
) -> DataFrame:
    """The longest reviews of each cluster, truncated.

    ``rank`` is a review's place in its cluster, ``cluster_first`` the order key of the cluster's
    first review: clusters enter the prompt in order of appearance.
    """
    keys = (*group_cols, "cluster_id")
    rows = reviews.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(0)))
    appearance = rows.groupBy(*keys).agg(F.min("ord").alias("cluster_first"))
    # ranked by the whole text's length, but only what is shown of it moves
    short = rows.withColumns({"_chars": F.length("text"), "text": truncate_text(F.col("text"), max_chars)})
    sampled = first_rows(short, keys, per_cluster, F.col("_chars").desc(), F.col("ord")).drop("_chars")
    return sampled.join(appearance, list(keys))


def prompt_ordinal(sampled: DataFrame, group_cols: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Number the sampled reviews of a run in prompt order."""
    order = Window.partitionBy(*group_cols).orderBy("cluster_first", "rank")
    return sampled.withColumn("ordinal", F.row_number().over(order))


def cluster_context(
    sampled: DataFrame, group_cols: tuple[str, ...] = ("run_id",), n: int = 3
) -> DataFrame:
    """The first ``n`` sampled reviews of each cluster."""
    return sampled.where(F.col("rank") <= n)
