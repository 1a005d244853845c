"""Parquet tables the jobs keep: review cache, themes and reports.

A table is dealt out by week and by a hash of its key into buckets. A merge reads only the partitions its
rows fall into, drops from them what it replaces and rewrites just these; all other files stay as they are.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.functions.labels import iso_date
from themeloom.functions.weeks import week_of
from themeloom.session import COMPRESSION, cut_lineage, drop_step, shuffles_dropped, step_path

#: Buckets of a week, fixed when a table is first written.
BUCKETS = 16
_PLACE = ["week", "bucket"]


def _stored(spark: SparkSession, path: str, schema) -> DataFrame | None:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _place() -> Column:
    return F.concat_ws("/", F.col("week").cast("string"), F.col("bucket").cast("string"))


def merge_rows(path: str, fresh: DataFrame, week: Column, keys: list[str], buckets: int = BUCKETS) -> None:
    """Put ``fresh`` into the table at ``path``; stored rows of the same week and ``keys`` give way to it.

    ``week`` is a Monday and must not be null; rows of one key are expected in one week. The partitions
    touched are replaced together when all of them are written, so a lost executor costs its tasks only.
    Not for two writers at a time.
    """
    spark, steps = fresh.sparkSession, []

    def kept(rows: DataFrame) -> DataFrame:
        steps.append(step_path(spark))
        return cut_lineage(rows, steps[-1])

    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")
    try:
        placed = kept(fresh.withColumns({"week": week, "bucket": bucket}))
        rows, stored = placed, _stored(spark, path, placed.schema)
        if stored is not None:
            # Whole rows move once to meet the keys, and what is left of them is written before it moves on.
            places = [row[0] for row in placed.select(_place()).distinct().collect()]  # calendar weeks and buckets: few
            touched = stored.where(_place().isin(places))
            left = touched.join(placed.select(*_PLACE, *keys).distinct(), [*_PLACE, *keys], "left_anti")
            rows = kept(left).unionByName(placed)
        with shuffles_dropped(spark):
            (
                rows.repartition(*_PLACE)
                .write.mode("overwrite")
                .option("partitionOverwriteMode", "dynamic")
                .option("compression", COMPRESSION)
                .partitionBy(*_PLACE)
                .parquet(path)
            )
    finally:
        for step in steps:
            drop_step(spark, step)


def review_owners(saved: DataFrame) -> DataFrame:
    """Per (review_id, source) the run that owns the cached row: the last started, then the greater id.

    ``saved``: ``review_id, source, run_id, started_at, cluster_id``. Only these narrow rows are ranked, one
    per task and key leaves a task. A run without a start gives way to any other.
    """
    last = F.max(F.struct(F.col("started_at").cast("timestamp").alias("started_at"), "run_id", "cluster_id"))
    return saved.groupBy("review_id", "source").agg(last.alias("_")).select("review_id", "source", "_.run_id", "_.cluster_id")


def write_reviews(path: str, reviews: DataFrame, saved: DataFrame, buckets: int = BUCKETS) -> None:
    """Merge what runs save into the review cache at ``path``; they take over rows of earlier merges.

    ``reviews`` holds each review once, however many runs count it: ``review_id, source, text_clean, rating,
    review_date``. Reviews that share an id are one row, the least by text.
    """
    facts = reviews.groupBy("review_id", "source").agg(F.min(F.struct("text_clean", "rating", "review_date")).alias("_"))
    owned = review_owners(saved).join(facts.select("review_id", "source", "_.*"), ["review_id", "source"])
    columns = ["review_id", "source", "run_id", "text_clean", "rating", "review_date", "cluster_id"]
    merge_rows(path, owned.select(*columns), week_of(F.col("review_date")), ["review_id", "source"], buckets)


def load_reviews_for_run(cache: DataFrame, run_id: str | Column) -> DataFrame:
    """Cached reviews of one run, newest first."""
    wanted = F.lit(run_id) if isinstance(run_id, str) else run_id
    return cache.where(F.col("run_id") == wanted).orderBy(
        F.col("review_date").desc(), "source", "review_id"
    )


def write_themes(path: str, themes: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace the themes of exactly the runs in ``themes``: ``run_id, week_start`` and the themes' columns."""
    columns = ("run_id", "week_start", "label", "description", "review_count", "avg_rating")
    merge_rows(path, themes.select(*columns), week_of(F.col("week_start")), ["run_id"], buckets)


def report_name(product: Column, week_start: Column) -> Column:
    return F.concat(product, F.lit("-"), iso_date(week_start), F.lit(".md"))


def write_report(path: str, reports: DataFrame, buckets: int = BUCKETS) -> None:
    """One document per product-week, replacing an earlier one."""
    named = reports.select(
        "product",
        "week_start",
        report_name(F.col("product"), F.col("week_start")).alias("report_name"),
        "run_id",
        "content",
    )
    merge_rows(path, named, week_of(F.col("week_start")), ["product", "week_start"], buckets)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A kept table as its writer was given it."""
    return spark.read.parquet(path).drop(*_PLACE)
