"""Scans of landed store reviews (JSON files) into the common review columns."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themeloom.functions.text import review_id, strip_space
from themeloom.schema import (
    APP_STORE,
    APP_STORE_RAW,
    GOOGLE_PLAY,
    GOOGLE_PLAY_RAW,
    REVIEW,
    SOURCE_RANK,
)
from themeloom.session import cut_lineage

# `ord` puts all Google Play rows before all App Store rows, ingest sequence within each.
_RANK_SHIFT = 60
_BLOCK_BITS = 16
_NO_CAP = 2**62


def review_order(source: Column, sequence: Column) -> Column:
    rank = F.coalesce(
        *[F.when(source == name, F.lit(rank)) for name, rank in SOURCE_RANK.items()]
    ).cast("long")
    return F.shiftleft(rank, _RANK_SHIFT) + sequence.cast("long")


def written_day(at: Column) -> Column:
    """The day as a timestamp's text gives it, whatever its offset; null unless the whole text is a timestamp with a day."""
    day = F.regexp_extract(at, r"^\s*(\d{4}-\d{2}-\d{2})", 1).try_cast("date")
    return F.when(F.try_to_timestamp(at).isNotNull(), day)


def _normalize(
    raw: DataFrame,
    source: str,
    text: str,
    day: str,
    rating: str,
    title: Column,
    author: str,
    version: str,
    fetched_at: Column | None,
    sequence: Column | None,
    keep: tuple[str, ...],
) -> DataFrame:
    rows = raw.select(
        *keep,
        F.lit(source).alias("source"),
        F.col(text).alias("text"),
        F.col(rating).try_cast("int").alias("rating"),
        written_day(F.col(day)).alias("review_date"),
        title.cast("string").alias("title"),
        F.col(author).cast("string").alias("author"),
        F.col(version).cast("string").alias("app_version"),
        (fetched_at if fetched_at is not None else F.current_timestamp()).alias("fetched_at"),
        (sequence if sequence is not None else F.monotonically_increasing_id()).alias("_seq"),
    )
    valid = (
        (strip_space(F.col("text")) != "")
        & F.col("rating").isNotNull()
        & F.col("review_date").isNotNull()
    )
    return rows.where(valid).select(
        *keep,
        review_id(F.col("text"), F.col("rating"), F.col("review_date")).alias("review_id"),
        "source",
        "text",
        "rating",
        "review_date",
        "title",
        "author",
        "app_version",
        "fetched_at",
        review_order(F.col("source"), F.col("_seq")).alias("ord"),
    )


def normalize_google_play(
    raw: DataFrame,
    fetched_at: Column | None = None,
    sequence: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Raw Google Play rows → reviews; rows without text, date or rating are dropped."""
    return _normalize(
        raw, GOOGLE_PLAY, "content", "at", "score", F.lit(None), "userName",
        "reviewCreatedVersion", fetched_at, sequence, keep,
    )


def normalize_app_store(
    raw: DataFrame,
    fetched_at: Column | None = None,
    sequence: Column | None = None,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Raw App Store rows → reviews; rows without text, date or rating are dropped."""
    return _normalize(
        raw, APP_STORE, "review", "date", "rating", F.col("title"), "userName",
        "isCurrentVersion", fetched_at, sequence, keep,
    )


def _landed(spark: SparkSession, schema: T.StructType, path: str | list[str], options: dict[str, str], fetched_at: Column | None):
    """Raw rows and how to normalise them: the partition columns of the landing folder (its products) are kept."""
    raw = spark.read.schema(schema).options(mode="PERMISSIVE", **options).json(path)
    folders = tuple(name for name in raw.columns if name not in schema.fieldNames())
    return raw, fetched_at, None, folders


def read_google_play(
    spark: SparkSession, path: str | list[str], fetched_at: Column | None = None, **options: str
) -> DataFrame:
    return normalize_google_play(*_landed(spark, GOOGLE_PLAY_RAW, path, options, fetched_at))


def read_app_store(
    spark: SparkSession, path: str | list[str], fetched_at: Column | None = None, **options: str
) -> DataFrame:
    return normalize_app_store(*_landed(spark, APP_STORE_RAW, path, options, fetched_at))


def union_sources(*reviews: DataFrame) -> DataFrame:
    """Bag union of the stores."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), reviews)


def read_reviews(
    spark: SparkSession,
    google_play: str | list[str] | None = None,
    app_store: str | list[str] | None = None,
    fetched_at: Column | None = None,
    **options: str,
) -> DataFrame:
    """All sources together; a missing path leaves the other source as it is."""
    parts = [spark.createDataFrame([], REVIEW)]
    for reader, path in ((read_google_play, google_play), (read_app_store, app_store)):
        if path is None:
            continue
        try:
            parts.append(reader(spark, path, fetched_at, **options))
        except AnalysisException as problem:
            if problem.getCondition() != "PATH_NOT_FOUND":
                raise
    return union_sources(*parts)


def newest_capped(
    reviews: DataFrame,
    caps: dict[str, int],
    group_cols: tuple[str, ...] = ("product",),
    at: str = "at",
) -> DataFrame:
    """The newest rows of each source up to its cap, ties in ingest order; other sources stay whole.

    Ranking a source that holds most rows would end in one sort. So only counts per slot are
    ranked, by day, then by second within the one day that straddles the cap, then by block of
    ingest order within the one second. Rows are numbered in the last block alone, which holds at
    most ``2 ** _BLOCK_BITS`` of them.
    """
    keys = [*group_cols, "source"]
    limits = [F.when(F.col("source") == s, F.lit(n).cast("long")) for s, n in caps.items()]
    cap = F.coalesce(*limits, F.lit(_NO_CAP))
    open_rows = reviews.withColumn("_room", cap)
    kept = []
    for slot, newest_first in (
        (F.to_date(at), True),
        (F.date_trunc("second", F.col(at)), True),
        (F.shiftright("ord", _BLOCK_BITS), False),
    ):
        rows = open_rows.withColumn("_slot", slot)
        counts = rows.groupBy(*keys, "_slot").agg(
            F.count("*").alias("_n"), F.max("_room").alias("_cap")
        )
        order = F.col("_slot").desc() if newest_first else F.col("_slot")
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("_cap") - F.coalesce(F.sum("_n").over(before), F.lit(0))
        slots = (
            counts.withColumn("_left", left)
            .where("_left > 0")
            .select(*keys, "_slot", "_left", (F.col("_n") <= F.col("_left")).alias("_whole"))
        )
        placed = rows.join(slots, [*keys, "_slot"])
        kept.append(placed.where("_whole").drop("_room", "_slot", "_left", "_whole"))
        open_rows = placed.where("NOT _whole").drop("_room", "_slot", "_whole")
        # Written, so that the next level does not read the source again for each of its uses.
        open_rows = cut_lineage(open_rows.withColumnRenamed("_left", "_room"))
    last = Window.partitionBy(*keys).orderBy("ord")
    kept.append(
        open_rows.withColumn("_rn", F.row_number().over(last))
        .where("_rn <= _room")
        .drop("_room", "_rn")
    )
    return union_sources(*kept)
