"""Linking model-written theme labels and quotes to clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.labels import parse_cluster_ref
from themeloom.functions.text import strip_space


def label_key(label: Column) -> Column:
    return F.lower(strip_space(F.coalesce(label, F.lit(""))))


def _last_wins(rows: DataFrame, *keys: str) -> DataFrame:
    """Last row per key in the model's order, a later attempt after an earlier one; responses have few rows."""
    order = [name for name in ("attempt", "pos") if name in rows.columns]
    last = Window.partitionBy(*keys).orderBy(*[F.col(name).desc() for name in order])
    return rows.withColumn("_rn", F.row_number().over(last)).where("_rn = 1").drop("_rn")


def label_themes(themes: DataFrame, named: DataFrame) -> DataFrame:
    """Replace label and description of the clusters that responses name; others keep theirs.

    ``named`` may hold several responses of a run, told apart by ``attempt``: a cluster has the label that
    the last of them gave it, whether or not that response was chosen.
    """
    refs = named.select(
        "run_id",
        *[name for name in ("attempt",) if name in named.columns],
        "pos",
        parse_cluster_ref(F.col("cluster_ref")).alias("cluster_id"),
        strip_space(F.col("label")).alias("_label"),
        strip_space(F.col("description")).alias("_description"),
    ).where("cluster_id IS NOT NULL")
    labels = _last_wins(refs, "run_id", "cluster_id").drop("pos", "attempt")
    return (
        themes.join(labels, ["run_id", "cluster_id"], "left")
        .withColumn("label", F.coalesce("_label", "label"))
        .withColumn("description", F.coalesce("_description", "description"))
        .drop("_label", "_description")
    )


def named_so_far(named: DataFrame, chosen: DataFrame) -> DataFrame:
    """Themes of a run's responses up to the chosen attempt: what labels are remembered from."""
    upto = chosen.select("run_id", F.col("attempt").alias("_upto"))
    return named.join(upto, "run_id").where(F.col("attempt") <= F.col("_upto")).drop("_upto")


def quote_cluster(quotes: DataFrame, named: DataFrame) -> DataFrame:
    """Resolve each quote's theme label to a cluster id, null where no theme carries it."""
    labels = named.select(
        "run_id",
        "pos",
        label_key(F.col("label")).alias("_key"),
        parse_cluster_ref(F.col("cluster_ref")).alias("cluster_id"),
    ).where("cluster_id IS NOT NULL AND _key <> ''")
    ids = _last_wins(labels, "run_id", "_key").drop("pos")
    keyed = quotes.withColumn("_key", label_key(F.col("theme_label")))
    return keyed.join(ids, ["run_id", "_key"], "left").drop("_key")


def top_themes(themes: DataFrame, max_themes: Column | int = 5) -> DataFrame:
    """First themes of a run in cluster order, numbered in ``theme_no``."""
    limit = F.lit(max_themes) if isinstance(max_themes, int) else max_themes
    order = Window.partitionBy("run_id").orderBy("cluster_id")
    numbered = themes.withColumn("theme_no", F.row_number().over(order))
    return numbered.where(F.col("theme_no") <= limit)


def themes_by_count(themes: DataFrame, run_id: str | None = None) -> DataFrame:
    """Themes with the most reviews first, of one run or run by run."""
    rows = themes if run_id is None else themes.where(F.col("run_id") == run_id)
    return rows.orderBy("run_id", F.col("review_count").desc(), "label")


def _theme_ids(shown: DataFrame, all_themes: DataFrame) -> DataFrame:
    """Cluster id a shown theme stands for: the first of the run's themes with the same label."""
    first = all_themes.groupBy("run_id", "label").agg(F.min("cluster_id").alias("_theme_cluster"))
    return shown.join(first, ["run_id", "label"], "left")


def _limit_quotes(rows: DataFrame, max_quotes: Column | int) -> DataFrame:
    limit = F.lit(max_quotes) if isinstance(max_quotes, int) else max_quotes
    order = Window.partitionBy("run_id", "theme_no").orderBy("pos")
    return rows.withColumn("quote_no", F.row_number().over(order)).where(F.col("quote_no") <= limit)


def top_quotes(rows: DataFrame, max_quotes: Column | int = 1) -> DataFrame:
    """First quotes of every theme in the model's order."""
    return _limit_quotes(rows, max_quotes)


_QUOTE = ("pos", "text", "rating", "source", "review_date")
# Kept where a run brings its own limit.
_LIMIT = "max_quotes_per_theme"


def _pair(shown: DataFrame, quotes: DataFrame, on: Column) -> DataFrame:
    themes, q = shown.alias("t"), quotes.alias("q")
    same_run = F.col("t.run_id") == F.col("q.run_id")
    limit = [F.col(f"t.{_LIMIT}")] if _LIMIT in shown.columns else []
    return themes.join(q, same_run & on).select(
        "t.run_id", "t.theme_no", "t.label", *limit, *[F.col(f"q.{name}") for name in _QUOTE]
    )


def theme_quotes(
    shown: DataFrame,
    all_themes: DataFrame | None,
    quotes: DataFrame,
    max_quotes: Column | int | None = 1,
    dedupe_unresolved: bool = False,
) -> DataFrame:
    """Quotes of each shown theme by cluster id, where null matches null.

    Without cluster ids on the themes (``all_themes`` None) every unresolved quote is listed under
    every theme; ``dedupe_unresolved`` lists it under the first theme only.
    """
    if all_themes is None:
        themes = shown.withColumn("_theme_cluster", F.lit(None).cast("int"))
    else:
        themes = _theme_ids(shown, all_themes)
    rows = _pair(themes, quotes, F.col("t._theme_cluster").eqNullSafe(F.col("q.cluster_id")))
    if dedupe_unresolved:
        first = Window.partitionBy("run_id", "pos").orderBy("theme_no")
        rows = rows.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")
    return rows if max_quotes is None else _limit_quotes(rows, max_quotes)


def theme_quotes_by_label(
    shown: DataFrame, quotes: DataFrame, max_quotes: Column | int | None = 1
) -> DataFrame:
    """Quotes of each shown theme by its label alone."""
    keyed = quotes.where(F.coalesce("theme_label", F.lit("")) != "")
    rows = _pair(shown, keyed, label_key(F.col("t.label")) == label_key(F.col("q.theme_label")))
    return rows if max_quotes is None else _limit_quotes(rows, max_quotes)


def report_quote_rows(
    shown: DataFrame,
    all_themes: DataFrame | None,
    quotes: DataFrame,
    max_quotes: Column | int = 1,
    dedupe_unresolved: bool = False,
) -> DataFrame:
    """Quotes as printed: by cluster, or by label for runs where that lists none."""
    by_cluster = theme_quotes(shown, all_themes, quotes, max_quotes, dedupe_unresolved)
    by_label = theme_quotes_by_label(shown, quotes, max_quotes).join(
        by_cluster.select("run_id").distinct(), "run_id", "left_anti"
    )
    return by_cluster.withColumn("by_label", F.lit(False)).unionByName(
        by_label.withColumn("by_label", F.lit(True))
    )


def top_actions(actions: Column, n: Column | int = 5) -> Column:
    """First ``n`` entries of the action array."""
    return F.slice(actions, 1, n)


def theme_history(themes: DataFrame, runs: DataFrame, limit: int = 20) -> DataFrame:
    """Themes of the newest runs, most reviewed first."""
    started = runs.select("run_id", "product", "week_start", "started_at")
    return (
        themes.join(started, "run_id")
        .orderBy(F.col("started_at").desc(), F.col("review_count").desc(), "run_id", "label")
        .limit(limit)
    )


def attach_clusters(cache: DataFrame, clustered: DataFrame) -> DataFrame:
    """Set cluster ids on a run's cached reviews; rows without a new id keep theirs."""
    keys = ["review_id", "source", "run_id"]
    fresh = (
        clustered.where("cluster_id IS NOT NULL")
        .groupBy(*keys)
        .agg(F.max_by("cluster_id", "ord").alias("_new"))
    )
    return (
        cache.join(fresh, keys, "left")
        .withColumn("cluster_id", F.coalesce("_new", "cluster_id"))
        .drop("_new")
    )
