"""Checks of sources, deduplication, counts, windows and sampling."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.adapter import MEAN_RATING_SQL, Tables
from checks.registry import query
from themeloom.operators import dedup, sampling, windows
from themeloom.session import checkpoint_folder
from themeloom.sources import stores

_START, _END = "2024-01-08", "2024-03-17"


def _day(text: str):
    return F.lit(text).cast("date")


@query(
    "weekly_overview",
    f"""SELECT week_start, source, CAST(count(*) AS BIGINT) AS review_count, {MEAN_RATING_SQL} AS avg_rating,
              min(review_date) AS first_date, max(review_date) AS last_date
       FROM (SELECT *, CAST(date_trunc('week', review_date) AS DATE) + CAST(7 * j AS INTEGER) AS week_start
             FROM v_scrubbed, range(10) AS r(j)) GROUP BY week_start, source""",
)
def _overview(t: Tables) -> DataFrame:
    return windows.lookback_summary(t.scrubbed, ("source",))


def _raw_json(t: Tables, text: str, day: str, rating: str, **more: str) -> DataFrame:
    """Landed JSON lines composed from documents: some without text, rating or a proper date."""
    k = F.col("doc_id")
    record = F.struct(
        F.when(k % 13 == 0, F.lit(" \n ")).otherwise(F.col("text")).alias(text),
        F.when(k % 11 == 0, F.lit("soon")).otherwise(
            F.concat(F.date_add(_day("2024-01-01"), (F.col("n_chars") % 98).cast("int")).cast("string"),
                     F.lit("T10:30:00Z"))
        ).alias(day),
        F.when(k % 7 > 0, 1 + F.col("n_chars") % 5).alias(rating),
        *[F.col(column).alias(name) for name, column in more.items()],
    )
    line = F.when(k % 17 == 0, F.lit('{"cut')).otherwise(F.to_json(record))
    return t.table("documents").select("doc_id", line.alias("line"))


_LANDED_SQL = """SELECT doc_id, text, CAST(1 + n_chars % 5 AS INTEGER) AS rating, lang, source AS origin,
    DATE '2024-01-01' + CAST(n_chars % 98 AS INTEGER) AS review_date FROM documents
    WHERE doc_id % 13 > 0 AND doc_id % 11 > 0 AND doc_id % 7 > 0 AND doc_id % 17 > 0"""
_ID_SQL = r"""substr(sha256(lower(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) || '|' || rating || '|' || review_date), 1, 16)"""


def _land(t: Tables, *fields: str, **more: str) -> str:
    """Write the records as JSON lines in one folder per product, as fetchers leave them; the folder's path."""
    path = f"{checkpoint_folder(t.spark)}/landing-{uuid.uuid4().hex}"
    lines = _raw_json(t, *fields, **more).join(t.table("documents").select("doc_id", F.col("source").alias("product")), "doc_id")
    lines.select("product", F.col("line").alias("value")).write.partitionBy("product").text(path)
    return path


@query(
    "read_google_play",
    f"""SELECT origin AS product, {_ID_SQL} AS review_id, 'google_play' AS source, text, rating, review_date,
               CAST(doc_id AS VARCHAR) AS author, lang AS app_version FROM ({_LANDED_SQL})""",
)
def _google(t: Tables) -> DataFrame:
    path = _land(t, "content", "at", "score", userName="doc_id", reviewCreatedVersion="lang")
    return stores.read_google_play(t.spark, path).drop("title", "fetched_at", "ord")


@query(
    "read_app_store",
    f"""SELECT origin AS product, {_ID_SQL} AS review_id, 'app_store' AS source, text, rating, review_date,
               lang AS title, CAST(doc_id AS VARCHAR) AS author FROM ({_LANDED_SQL})""",
)
def _app_store(t: Tables) -> DataFrame:
    path = _land(t, "review", "date", "rating", title="lang", userName="doc_id")
    return stores.read_app_store(t.spark, path).drop("app_version", "fetched_at", "ord")


@query(
    "read_reviews",
    f"""SELECT s.source, origin AS product, {_ID_SQL} AS review_id, text, rating, review_date, CAST(doc_id AS VARCHAR) AS author
        FROM ({_LANDED_SQL}), (VALUES ('google_play'), ('app_store')) AS s(source)""",
)
def _read_reviews(t: Tables) -> DataFrame:
    google = _land(t, "content", "at", "score", userName="doc_id")
    apple = _land(t, "review", "date", "rating", userName="doc_id")
    rows = stores.read_reviews(t.spark, google, apple)
    return rows.select("source", "product", "review_id", "text", "rating", "review_date", "author")


@query(
    "newest_capped",
    """SELECT event_id FROM (SELECT event_id, source, row_number() OVER (PARTITION BY product, source ORDER BY seen DESC, event_id) AS rn
         FROM (SELECT event_id, event_type AS product, CASE WHEN user_id % 3 = 0 THEN 'app_store' ELSE 'google_play' END AS source,
                      date_trunc('hour', ts) AS seen FROM events))
       WHERE rn <= CASE WHEN source = 'google_play' THEN 400 ELSE 50 END""",
)
def _newest(t: Tables) -> DataFrame:
    store = F.when(F.col("user_id") % 3 == 0, "app_store").otherwise("google_play")
    rows = t.table("events").select(
        "event_id",
        F.col("event_type").alias("product"),
        store.alias("source"),
        F.date_trunc("hour", "ts").alias("at"),
        F.col("event_id").alias("ord"),
    )
    return stores.newest_capped(rows, {"google_play": 400, "app_store": 50}).select("event_id")


@query(
    "union_sources",
    "SELECT source, count(*) AS n FROM v_reviews GROUP BY source",
)
def _union(t: Tables) -> DataFrame:
    rows = t.reviews
    google = rows.where(F.col("source") == "google_play").withColumn("app_version", F.lit("1"))
    apple = rows.where(F.col("source") == "app_store").withColumn("title", F.lit("t"))
    return stores.union_sources(google, apple).groupBy("source").agg(F.count("*").alias("n"))


_REASON_SQL = f"""SELECT *, CASE WHEN short THEN 'short' WHEN outside THEN 'out_of_window'
      WHEN row_number() OVER (PARTITION BY dedup_key, short, outside ORDER BY ord) = 1 THEN 'kept' ELSE 'duplicate' END AS drop_reason
    FROM (SELECT *, length(text) < 10 AS short, review_date NOT BETWEEN DATE '{_START}' AND DATE '{_END}' AS outside FROM v_keyed)"""


@query("drop_reason", f"SELECT doc_id, drop_reason FROM ({_REASON_SQL})")
def _drop_reason(t: Tables) -> DataFrame:
    return dedup.drop_reason(t.keyed, _day(_START), _day(_END)).select("doc_id", "drop_reason")


@query("dedup_reviews", "SELECT doc_id, product, source, text, rating, review_date, lang FROM v_kept")
def _dedup(t: Tables) -> DataFrame:
    return t.kept.select("doc_id", "product", "source", "text", "rating", "review_date", "lang")


@query(
    "cleaning_stats",
    f"""SELECT count(*) FILTER (drop_reason = 'kept') AS kept, count(*) FILTER (drop_reason = 'short') AS short,
               count(*) FILTER (drop_reason = 'out_of_window') AS out_of_window,
               count(*) FILTER (drop_reason = 'duplicate') AS duplicate,
               min(review_date) FILTER (drop_reason = 'kept') AS earliest,
               max(review_date) FILTER (drop_reason = 'kept') AS latest FROM ({_REASON_SQL})""",
)
def _stats(t: Tables) -> DataFrame:
    return dedup.cleaning_stats(t.keyed, _day(_START), _day(_END))


@query(
    "source_counts",
    """SELECT product, count(*) AS total, count(*) FILTER (source = 'google_play') AS google_play,
              count(*) FILTER (source = 'app_store') AS app_store FROM v_reviews GROUP BY product""",
)
def _source_counts(t: Tables) -> DataFrame:
    return windows.source_counts(t.reviews, ("product",))


@query(
    "batch_date_bounds",
    f"""SELECT *, has_older AND NOT has_newer AND NOT has_inside AS past_window FROM (
          SELECT product, rating, max(review_date) AS newest, min(review_date) AS oldest, count(*) AS batch_size,
                 bool_or(review_date > DATE '{_END}') AS has_newer,
                 bool_or(review_date BETWEEN DATE '{_START}' AND DATE '{_END}') AS has_inside,
                 bool_or(review_date < DATE '{_START}') AS has_older FROM v_reviews GROUP BY product, rating)""",
)
def _batches(t: Tables) -> DataFrame:
    return windows.batch_date_bounds(t.reviews, _day(_START), _day(_END), ("product", "rating"))


@query(
    "window_counts",
    """SELECT product, week_start, CAST(sum(f) AS BIGINT) AS reviews_fetched, CAST(sum(p) AS BIGINT) AS reviews_processed
       FROM (SELECT product, review_date, 1 AS f, 0 AS p FROM v_reviews
             UNION ALL SELECT product, review_date, 0, 1 FROM v_kept) AS b,
            LATERAL (SELECT CAST(date_trunc('week', b.review_date) AS DATE) + CAST(7 * j AS INTEGER) AS week_start FROM range(10) AS r(j))
       GROUP BY product, week_start""",
)
def _window_counts(t: Tables) -> DataFrame:
    return windows.window_counts(t.reviews, t.kept)


@query(
    "lookback_windows",
    "SELECT run_id, doc_id, week_start, week_end, window_start, window_end FROM v_run_reviews",
)
def _lookback(t: Tables) -> DataFrame:
    return t.run_reviews.select(
        "run_id", "doc_id", "week_start", "week_end", "window_start", "window_end"
    )


@query(
    "theme_stats",
    f"""SELECT run_id, k.cluster_id, coalesce(review_count, 0) AS review_count, coalesce(avg_rating, 0.0) AS avg_rating,
              coalesce(ids, '') AS sample_ids
       FROM (SELECT DISTINCT run_id, CAST(c AS INTEGER) AS cluster_id FROM v_run_reviews, range(12) AS r(c)) k
       LEFT JOIN (SELECT run_id, cluster_id, count(*) AS review_count, {MEAN_RATING_SQL} AS avg_rating,
                         array_to_string(list(doc_id ORDER BY ord)[1:3], ',') AS ids
                  FROM v_run_reviews GROUP BY run_id, cluster_id) USING (run_id, cluster_id)""",
)
def _theme_stats(t: Tables) -> DataFrame:
    rows = t.run_reviews.withColumn("review_id", F.col("doc_id").cast("string"))
    ks = rows.select("run_id").distinct().withColumn("k", F.lit(12))
    stats = sampling.theme_stats(rows, ("run_id",), ks)
    ids = F.array_join("sample_review_ids", ",")
    return stats.select("run_id", "cluster_id", "review_count", "avg_rating", ids.alias("sample_ids"))


@query(
    "sample_for_prompt",
    "SELECT run_id, cluster_id, CAST(rank AS INTEGER) AS rank, doc_id, text FROM v_prompt_sample",
)
def _sample(t: Tables) -> DataFrame:
    return sampling.sample_for_prompt(t.run_reviews).select("run_id", "cluster_id", "rank", "doc_id", "text")


@query(
    "prompt_ordinal",
    "SELECT run_id, doc_id, CAST(ordinal AS INTEGER) AS ordinal FROM v_numbered",
)
def _ordinal(t: Tables) -> DataFrame:
    numbered = sampling.prompt_ordinal(sampling.sample_for_prompt(t.run_reviews))
    return numbered.select("run_id", "doc_id", "ordinal")


@query(
    "cluster_context",
    "SELECT run_id, cluster_id, doc_id, text FROM v_prompt_sample WHERE rank <= 3",
)
def _context(t: Tables) -> DataFrame:
    context = sampling.cluster_context(sampling.sample_for_prompt(t.run_reviews))
    return context.select("run_id", "cluster_id", "doc_id", "text")
