"""Checks of the run ledger and the kept tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.adapter import Tables
from checks.q_reports import _CHOSEN_KEYS_SQL, MARKDOWN_SQL, markdown, of_chosen
from checks.registry import query
from themeloom.operators import ledger, themes
from themeloom.session import checkpoint_folder, cut_lineage
from themeloom.sources import tables
from themeloom.sources.responses import report_quotes

_NOW = "1999-06-01 12:00:00"
_NOW_SQL = f"TIMESTAMP '{_NOW}'"


def _now() -> Column:
    return F.lit(_NOW).cast("timestamp")


def _number(run_id: str = "run_id") -> Column:
    return F.substring(run_id, 5, 20).cast("long")


_K = "CAST(substr(run_id, 5) AS BIGINT)"
_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S') AS {0}"


def _texts(df: DataFrame, *times: str) -> DataFrame:
    """Timestamps as text, so that both engines compare the same thing."""
    return df.withColumns({name: F.date_format(name, "yyyy-MM-dd HH:mm:ss") for name in times})


_LEDGER_SQL = f"""run_id, product, week_start, week_end, status, reviews_fetched, reviews_processed, report_path, doc_id,
    email_sent, tokens_used, error_message, {_TIME.format('started_at')}, {_TIME.format('completed_at')}"""


def _ledger(df: DataFrame) -> DataFrame:
    return _texts(df, "started_at", "completed_at")


# Requests: the newest known week of every run, and one week later.
def _requests(t: Tables) -> DataFrame:
    runs, k = t.runs, _number()
    known = runs.select(
        "product", "week_start", (k % 6 == 0).alias("force"),
        F.when(k % 4 == 0, F.col("run_id")).alias("run_id"),
    )
    later = runs.groupBy("product").agg(F.date_add(F.max("week_start"), 7).alias("week_start"))
    return known.unionByName(
        later.select("product", "week_start", F.lit(False).alias("force"), F.lit(None).cast("string").alias("run_id"))
    )


# Young and old running runs alike: started_at is moved next to "now" for some.
def _ledger_now(t: Tables) -> DataFrame:
    recent = _now() - F.make_dt_interval(mins=(_number() % 120).cast("int"))
    return t.runs.withColumn(
        "started_at", F.when(_number() % 3 == 0, recent).otherwise(F.col("started_at"))
    )


_RECENT_SQL = f"""SELECT * REPLACE (CASE WHEN {_K} % 3 = 0 THEN {_NOW_SQL} - to_minutes({_K} % 120) ELSE started_at END AS started_at) FROM v_runs"""
_PLAN_SQL = f"""
    SELECT q.product, q.week_start, q.force, coalesce(r.run_id, q.run_id) AS run_id,
      CASE WHEN r.run_id IS NULL THEN 'create' WHEN q.force THEN 'rerun'
           WHEN r.status = 'completed' AND r.reviews_fetched > 0 AND r.reviews_processed > 0 THEN 'skip'
           WHEN r.status = 'completed' THEN 'recover'
           WHEN r.status = 'running' AND q.run_id = r.run_id THEN 'continue'
           WHEN r.status = 'running' AND epoch({_NOW_SQL}) - epoch(r.started_at) > 3600 THEN 'recover'
           WHEN r.status = 'running' THEN 'skip' ELSE 'rerun' END AS verdict
    FROM (SELECT product, week_start, {_K} % 6 = 0 AS force, CASE WHEN {_K} % 4 = 0 THEN run_id END AS run_id FROM v_runs
          UNION ALL SELECT product, max(week_start) + 7, false, NULL FROM v_runs GROUP BY product) q
    LEFT JOIN ({_RECENT_SQL}) r USING (product, week_start)"""


@query("plan_runs", _PLAN_SQL)
def _plan(t: Tables) -> DataFrame:
    return ledger.plan_runs(_requests(t), _ledger_now(t), _now())


@query(
    "register_runs",
    f"""SELECT CASE WHEN verdict = 'create' THEN sha256(product || '|' || week_start || '|{_NOW}') ELSE run_id END AS run_id,
          product, week_start, status, error_message, started_at FROM (
      SELECT r.run_id, r.product, r.week_start, coalesce(p.verdict, 'skip') AS verdict,
             CASE WHEN coalesce(p.verdict, 'skip') <> 'skip' THEN 'running' ELSE r.status END AS status,
             CASE WHEN coalesce(p.verdict, 'skip') = 'skip' THEN r.error_message END AS error_message,
             strftime(CASE WHEN coalesce(p.verdict, 'skip') <> 'skip' THEN {_NOW_SQL} ELSE r.started_at END, '%Y-%m-%d %H:%M:%S') AS started_at
      FROM ({_RECENT_SQL}) r LEFT JOIN ({_PLAN_SQL}) p ON p.run_id = r.run_id
      UNION ALL SELECT run_id, product, week_start, verdict, 'running', NULL, '{_NOW}' FROM ({_PLAN_SQL}) WHERE verdict = 'create')""",
)
def _register(t: Tables) -> DataFrame:
    runs = _ledger_now(t)
    ledger_after = ledger.register_runs(runs, ledger.plan_runs(_requests(t), runs, _now()), _now())
    return _texts(ledger_after, "started_at").select(
        "run_id", "product", "week_start", "status", "error_message", "started_at"
    )


@query(
    "duplicate_weeks",
    """SELECT product, week_start, count(*) AS n FROM (
         SELECT 'p' || o_custkey AS product, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start FROM orders)
       GROUP BY ALL HAVING count(*) > 1""",
)
def _duplicates(t: Tables) -> DataFrame:
    orders = t.table("orders").select(
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("product"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("week_start"),
    )
    return ledger.duplicate_weeks(orders)


@query(
    "reset_runs",
    f"""SELECT {_LEDGER_SQL} FROM (SELECT * REPLACE (
          CASE WHEN hit THEN 'running' ELSE status END AS status, CASE WHEN hit THEN 0 ELSE reviews_fetched END AS reviews_fetched,
          CASE WHEN hit THEN 0 ELSE reviews_processed END AS reviews_processed, CASE WHEN hit THEN 0 ELSE tokens_used END AS tokens_used,
          CASE WHEN NOT hit THEN report_path END AS report_path, CASE WHEN NOT hit THEN doc_id END AS doc_id,
          CASE WHEN hit THEN false ELSE email_sent END AS email_sent, CASE WHEN NOT hit THEN error_message END AS error_message,
          CASE WHEN hit THEN {_NOW_SQL} ELSE started_at END AS started_at, CASE WHEN NOT hit THEN completed_at END AS completed_at)
        FROM (SELECT *, {_K} % 4 = 1 AS hit FROM v_runs))""",
)
def _reset(t: Tables) -> DataFrame:
    return _ledger(ledger.reset_runs(t.runs, t.runs.where(_number() % 4 == 1), _now()))


@query(
    "drop_run_rows",
    f"SELECT run_id, count(*) AS n FROM v_stored_themes WHERE {_K} % 4 <> 1 OR run_id NOT IN (SELECT run_id FROM v_runs) GROUP BY run_id",
)
def _drop_rows(t: Tables) -> DataFrame:
    kept = ledger.drop_run_rows(t.stored_themes, t.runs.where(_number() % 4 == 1))
    return kept.groupBy("run_id").agg(F.count("*").alias("n"))


@query(
    "finish_runs",
    f"""SELECT {_LEDGER_SQL} FROM (SELECT * REPLACE (
          CASE WHEN done THEN 'completed' WHEN broke THEN 'failed' ELSE status END AS status,
          CASE WHEN done THEN NULL WHEN broke THEN substr(repeat('error ', 100) || run_id, 1, 500) ELSE error_message END AS error_message,
          CASE WHEN done THEN {_NOW_SQL} ELSE completed_at END AS completed_at,
          CASE WHEN done THEN 42 ELSE reviews_fetched END AS reviews_fetched,
          CASE WHEN done THEN 'reports/new' ELSE report_path END AS report_path,
          CASE WHEN done THEN NULL ELSE doc_id END AS doc_id)
        FROM (SELECT *, {_K} % 4 = 1 AS done, {_K} % 4 = 2 AS broke FROM v_runs))""",
)
def _finish(t: Tables) -> DataFrame:
    k = _number()
    done = k % 4 == 1
    outcomes = t.runs.where((k % 4 == 1) | (k % 4 == 2)).select(
        "run_id",
        F.when(done, "completed").otherwise("failed").alias("status"),
        F.when(~done, F.concat(F.repeat(F.lit("error "), 100), F.col("run_id"))).alias("error_message"),
        F.when(done, _now()).alias("completed_at"),
        F.when(done, 42).alias("reviews_fetched"),
        F.when(done, "reports/new").alias("report_path"),
        F.lit(None).cast("string").alias("doc_id"),
    )
    return _ledger(ledger.finish_runs(t.runs, outcomes))


@query(
    "latest_run",
    f"""SELECT product, week_start, run_id, {_TIME.format('started_at')} FROM (
         SELECT 'run-' || o_orderkey AS run_id, 'p' || o_custkey AS product, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
                o_orderdate AS started_at FROM orders)
        QUALIFY row_number() OVER (PARTITION BY product, week_start ORDER BY started_at DESC, run_id DESC) = 1""",
)
def _latest(t: Tables) -> DataFrame:
    all_runs = t.table("orders").select(
        F.concat(F.lit("run-"), F.col("o_orderkey").cast("string")).alias("run_id"),
        F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("product"),
        F.date_trunc("week", "o_orderdate").cast("date").alias("week_start"),
        F.col("o_orderdate").cast("timestamp").alias("started_at"),
    )
    return _texts(ledger.latest_run(all_runs), "started_at")


@query("run_by_id", f"SELECT {_LEDGER_SQL} FROM v_runs WHERE run_id = 'run-77'")
def _by_id(t: Tables) -> DataFrame:
    return _ledger(ledger.run_by_id(t.runs, "run-77"))


@query(
    "list_runs",
    """SELECT product, run_id, week_start FROM v_runs
       QUALIFY row_number() OVER (PARTITION BY product ORDER BY week_start DESC, started_at DESC, run_id) <= 5""",
)
def _list(t: Tables) -> DataFrame:
    return ledger.list_runs(t.runs).select("product", "run_id", "week_start")


@query("list_all_runs", f"SELECT run_id, product, {_TIME.format('started_at')} FROM v_runs")
def _list_all(t: Tables) -> DataFrame:
    return _texts(ledger.list_all_runs(t.runs), "started_at").select("run_id", "product", "started_at")


@query(
    "stale_runs",
    f"SELECT run_id, product FROM ({_RECENT_SQL}) WHERE status = 'running' AND started_at < {_NOW_SQL} - INTERVAL 1 HOUR",
)
def _stale(t: Tables) -> DataFrame:
    return ledger.stale_runs(_ledger_now(t), _now()).select("run_id", "product")


_SETTINGS_SQL = """SELECT DISTINCT product, CASE WHEN k % 3 = 0 THEN 'shared' ELSE '' END AS doc_id,
    CASE WHEN k % 4 > 0 THEN 'a@x.org, b@x.org' ELSE ' , ' END AS recipients, k % 5 = 0 AS dry_run
    FROM (SELECT product, CAST(substr(product, 2) AS BIGINT) AS k FROM v_runs)"""


def _settings(t: Tables) -> DataFrame:
    k = F.substring("product", 2, 20).cast("long")
    return t.runs.select("product").distinct().select(
        "product",
        F.when(k % 3 == 0, "shared").otherwise("").alias("doc_id"),
        F.when(k % 4 > 0, "a@x.org, b@x.org").otherwise(" , ").alias("recipients"),
        (k % 5 == 0).alias("dry_run"),
    )


def _reports(t: Tables) -> DataFrame:
    k = _number()
    return t.runs.select(
        "run_id", "product", "week_start",
        F.when(k % 8 == 0, F.lit(" ")).otherwise(F.concat(F.lit("# "), F.col("run_id"))).alias("content"),
        F.concat(F.lit("Week "), F.col("run_id")).alias("subject"),
        F.when(k % 9 > 0, F.lit("<html>")).alias("body"),
    )


@query(
    "delivery_outbox",
    f"""SELECT run_id, product, target_doc, doc_due, mail_due, recipients, content FROM (
      SELECT r.run_id, r.product, t.target_doc, s.recipients, c.content,
             NOT s.dry_run AND coalesce(trim(t.target_doc), '') <> '' AND trim(c.content) <> '' AS doc_due,
             doc_due AND {_K} % 2 = 0 AND NOT r.email_sent AND s.recipients LIKE '%@%' AND {_K} % 9 > 0 AS mail_due
      FROM v_runs r JOIN ({_SETTINGS_SQL}) s USING (product),
           LATERAL (SELECT coalesce(nullif(s.doc_id, ''), r.doc_id) AS target_doc) t,
           LATERAL (SELECT CASE WHEN CAST(substr(r.run_id, 5) AS BIGINT) % 8 = 0 THEN ' ' ELSE '# ' || r.run_id END AS content) c)
    WHERE doc_due OR mail_due""",
)
def _outbox(t: Tables) -> DataFrame:
    sent = t.runs.where(_number() % 2 == 0)
    due = ledger.delivery_outbox(t.runs, _reports(t), _settings(t), sent)
    return due.select("run_id", "product", "target_doc", "doc_due", "mail_due", "recipients", "content")


@query(
    "report_for_run",
    f"""SELECT run_id, product, week_start, report_path, CASE WHEN {_K} % 8 = 0 THEN ' ' ELSE '# ' || run_id END AS content
        FROM v_runs WHERE status = 'completed' AND report_path IS NOT NULL""",
)
def _report(t: Tables) -> DataFrame:
    return ledger.report_for_run(t.runs, _reports(t))


@query(
    "theme_history",
    """SELECT week_start, label, review_count, avg_rating FROM v_stored_themes JOIN v_runs USING (run_id)
       ORDER BY started_at DESC, review_count DESC, run_id, label LIMIT 20""",
)
def _history(t: Tables) -> DataFrame:
    return themes.theme_history(t.stored_themes, t.runs).select("week_start", "label", "review_count", "avg_rating")


@query("themes_by_count", "SELECT run_id, label, review_count, avg_rating FROM v_stored_themes")
def _by_count(t: Tables) -> DataFrame:
    return themes.themes_by_count(t.stored_themes).select("run_id", "label", "review_count", "avg_rating")


def _kept_at(t: Tables, name: str) -> str:
    return f"{checkpoint_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query(
    "write_themes",
    """SELECT run_id, week_start, label, description, review_count, avg_rating FROM v_stored_themes JOIN v_runs USING (run_id)
       WHERE status <> 'completed'
       UNION ALL SELECT run_id, week_start, 'fresh', '', CAST(7 AS BIGINT), 1.0 FROM v_runs WHERE status = 'completed'""",
)
def _write_themes(t: Tables) -> DataFrame:
    """All themes are written, then those of completed runs anew, and the whole table is read back."""
    path = _kept_at(t, "themes")
    tables.write_themes(path, t.stored_themes.join(t.runs.select("run_id", "week_start"), "run_id"), buckets=1)
    fresh = t.runs.where("status = 'completed'").select(
        "run_id", "week_start", F.lit("fresh").alias("label"), F.lit("").alias("description"),
        F.lit(7).cast("long").alias("review_count"), F.lit(1.0).alias("avg_rating"),
    )
    tables.write_themes(path, fresh, buckets=1)  # hundreds of weeks, few rows in each
    return tables.read_table(t.spark, path)


_RID = r"""substr(sha256(lower(regexp_replace(regexp_replace(o.text, '^\s+', ''), '\s+$', '')) || '|' || o.rating || '|' || o.review_date), 1, 16)"""


@query(
    "write_reviews",
    f"""SELECT review_id, source, w.run_id, w.cluster_id, CASE WHEN w.run_id = 'old' THEN o.text ELSE n.text END AS text_clean, o.rating, o.review_date
        FROM (SELECT * FROM (SELECT {_RID} AS review_id, o.source, 'old' AS run_id, 1 AS cluster_id, NULL AS started FROM v_reviews o
              UNION ALL SELECT {_RID}, o.source, k.run_id, k.cluster_id, k.week_start FROM v_run_reviews k JOIN v_reviews o USING (doc_id))
              QUALIFY row_number() OVER (PARTITION BY review_id, source ORDER BY started DESC NULLS LAST, run_id DESC, cluster_id DESC) = 1) w
        JOIN (SELECT {_RID} AS review_id, o.source, min(k.text) AS text, any_value(o.rating) AS rating, any_value(o.review_date) AS review_date
              FROM v_keyed k JOIN v_reviews o USING (doc_id) GROUP BY ALL) o USING (review_id, source)
        LEFT JOIN (SELECT {_RID} AS review_id, o.source, min(k.text) AS text
                   FROM v_clustered k JOIN v_reviews o USING (doc_id) GROUP BY ALL) n USING (review_id, source)""",
)
def _write_reviews(t: Tables) -> DataFrame:
    """An older run saved every landed review; the runs save all they count; the whole cache is read back."""
    path = _kept_at(t, "reviews")
    facts = ["review_id", "source", F.col("text").alias("text_clean"), "rating", "review_date"]
    landed = t.keyed.select(*facts)
    # ids come from the landed text: nothing of the cleaning is needed for them
    old = t.reviews.select("review_id", "source", F.lit("old").alias("run_id"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(1).alias("cluster_id"))
    tables.write_reviews(path, landed, old)
    saved = t.run_reviews.select("review_id", "source", "run_id", F.col("week_start").alias("started_at"), "cluster_id")
    tables.write_reviews(path, t.clustered.select(*facts), saved)
    return tables.read_table(t.spark, path)


@query(
    "attach_clusters",
    f"""SELECT DISTINCT {_RID} AS review_id, o.source, k.run_id, CASE WHEN k.cluster_id <> 4 THEN k.cluster_id ELSE 99 END AS cluster_id
        FROM v_run_reviews k JOIN v_reviews o USING (doc_id)
        QUALIFY row_number() OVER (PARTITION BY k.run_id, {_RID}, o.source ORDER BY k.cluster_id = 4, k.ord DESC) = 1""",
)
def _attach(t: Tables) -> DataFrame:
    rows = t.run_reviews
    keys = ["review_id", "source", "run_id"]
    cache = rows.select(*keys).distinct().withColumn("cluster_id", F.lit(99))
    tagged = rows.withColumn("cluster_id", F.when(F.col("cluster_id") != 4, F.col("cluster_id")))
    return themes.attach_clusters(cache, tagged)


@query(
    "load_reviews_for_run",
    f"""SELECT DISTINCT {_RID} AS review_id, k.text, k.rating, k.review_date FROM v_run_reviews k JOIN v_reviews o USING (doc_id)
        WHERE k.run_id = 'src3-2024-W10'""",
)
def _load(t: Tables) -> DataFrame:
    return tables.load_reviews_for_run(t.run_reviews, "src3-2024-W10").select(
        "review_id", "text", "rating", "review_date"
    ).distinct()


@query(
    "write_report",
    f"SELECT product, week_start, product || '-' || week_start || '.md' AS report_name, run_id, content FROM ({MARKDOWN_SQL})",
)
def _write_report(t: Tables) -> DataFrame:
    """Every run's document, written twice over a first draft and read back whole."""
    path, reports = _kept_at(t, "reports"), cut_lineage(markdown(t))
    tables.write_report(path, reports.withColumn("content", F.lit("draft")))
    tables.write_report(path, reports)
    return tables.read_table(t.spark, path)


@query(
    "run_metrics",
    f"""SELECT run_id, CAST(coalesce(f, 0) AS BIGINT) AS reviews_fetched, CAST(coalesce(p, 0) AS BIGINT) AS reviews_processed,
              coalesce(themes_found, 0) AS themes_found, coalesce(ok, 0) AS quotes_validated, coalesce(bad, 0) AS quotes_dropped,
              CAST(coalesce(tokens, 0) AS BIGINT) AS tokens_used
       FROM (SELECT DISTINCT run_id FROM v_run_reviews)
       LEFT JOIN (SELECT run_id, count(*) AS f, count(*) FILTER (rating > 1) AS p FROM v_run_reviews GROUP BY run_id) USING (run_id)
       LEFT JOIN (SELECT run_id, count(*) AS themes_found FROM v_run_themes GROUP BY run_id) USING (run_id)
       LEFT JOIN (SELECT run_id, count(*) FILTER (text NOT LIKE 'zzqx%') AS ok, count(*) FILTER (text LIKE 'zzqx%') AS bad
                  FROM v_quotes WHERE (run_id, attempt) IN {_CHOSEN_KEYS_SQL} GROUP BY run_id) USING (run_id)
       LEFT JOIN (SELECT run_id, sum(tokens_used) AS tokens FROM v_parsed GROUP BY run_id) USING (run_id)""",
)
def _metrics(t: Tables) -> DataFrame:
    rows = t.run_reviews
    counts = rows.groupBy("run_id").agg(
        F.count("*").alias("reviews_fetched"), F.count_if(F.col("rating") > 1).alias("reviews_processed")
    )
    judged = of_chosen(t, report_quotes(t.parsed)).withColumn("passed", ~F.col("text").startswith("zzqx"))
    spent = t.parsed.groupBy("run_id").agg(F.sum("tokens_used").alias("tokens_used"))
    return ledger.run_metrics(rows.select("run_id").distinct(), counts, t.run_themes, judged, spent)
