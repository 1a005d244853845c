"""Column types and fixed domains of the review data model."""

from __future__ import annotations

from pyspark.sql import types as T

# Store names and their append order.
GOOGLE_PLAY = "google_play"
APP_STORE = "app_store"
SOURCE_RANK = {GOOGLE_PLAY: 0, APP_STORE: 1}

# Run states.
PENDING, RUNNING, COMPLETED, FAILED = "pending", "running", "completed", "failed"

# Defaults of the pipeline options.
WINDOW_WEEKS = 10
MIN_TEXT_LENGTH = 10
QUOTE_THRESHOLD = 90.0
MAX_ATTEMPTS = 3
STALE_SECONDS = 3600
ERROR_TEXT_LIMIT = 500
CONFIG_DEFAULTS = {
    "country": "in",
    "language": "en",
    "max_themes": 5,
    "max_quotes_per_theme": 1,
    "max_action_ideas": 5,
    "max_reviews_per_cluster": 4,
    "max_review_chars": 180,
}

GOOGLE_PLAY_RAW = T.StructType(
    [
        T.StructField("content", T.StringType()),
        T.StructField("at", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("userName", T.StringType()),
        T.StructField("reviewCreatedVersion", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

APP_STORE_RAW = T.StructType(
    [
        T.StructField("review", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("rating", T.DoubleType()),
        T.StructField("title", T.StringType()),
        T.StructField("userName", T.StringType()),
        T.StructField("isCurrentVersion", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

REVIEW = T.StructType(
    [
        T.StructField("review_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("rating", T.IntegerType()),
        T.StructField("review_date", T.DateType()),
        T.StructField("title", T.StringType()),
        T.StructField("author", T.StringType()),
        T.StructField("app_version", T.StringType()),
        T.StructField("fetched_at", T.TimestampType()),
        T.StructField("ord", T.LongType()),
    ]
)

# Every scalar leaf is read as text: models write numbers and strings for the same field.
REPORT_JSON = T.StructType(
    [
        T.StructField("summary", T.StringType()),
        T.StructField(
            "themes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("label", T.StringType()),
                        T.StructField("description", T.StringType()),
                        T.StructField("review_count", T.StringType()),
                        T.StructField("avg_rating", T.StringType()),
                        T.StructField("cluster_id", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField(
            "quotes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("text", T.StringType()),
                        T.StructField("rating", T.StringType()),
                        T.StructField("source", T.StringType()),
                        T.StructField("theme_label", T.StringType()),
                    ]
                )
            ),
        ),
        T.StructField("action_ideas", T.ArrayType(T.StringType())),
    ]
)

RUNS = T.StructType(
    [
        T.StructField("run_id", T.StringType()),
        T.StructField("product", T.StringType()),
        T.StructField("week_start", T.DateType()),
        T.StructField("week_end", T.DateType()),
        T.StructField("status", T.StringType()),
        T.StructField("reviews_fetched", T.IntegerType()),
        T.StructField("reviews_processed", T.IntegerType()),
        T.StructField("report_path", T.StringType()),
        T.StructField("doc_id", T.StringType()),
        T.StructField("email_sent", T.BooleanType()),
        T.StructField("tokens_used", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("started_at", T.TimestampType()),
        T.StructField("completed_at", T.TimestampType()),
    ]
)
