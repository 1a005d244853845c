"""The run ledger: one row per product and report week."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.labels import recipient_list
from themeloom.functions.weeks import week_end_of
from themeloom.schema import (
    COMPLETED,
    ERROR_TEXT_LIMIT,
    FAILED,
    RUNNING,
    RUNS,
    STALE_SECONDS,
)

_KEY = ["product", "week_start"]


def _newest(runs: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    ranked = runs.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def latest_run(runs: DataFrame) -> DataFrame:
    """Newest run of every product-week."""
    return _newest(runs, _KEY, 1, F.col("started_at").desc_nulls_last(), F.col("run_id").desc())


def run_by_id(runs: DataFrame, run_id: str) -> DataFrame:
    return runs.where(F.col("run_id") == run_id)


def list_runs(runs: DataFrame, limit: int = 5) -> DataFrame:
    """The last ``limit`` runs of every product, newest week first."""
    newest = (F.col("week_start").desc(), F.col("started_at").desc_nulls_last(), F.col("run_id"))
    return _newest(runs, ["product"], limit, *newest)


def list_all_runs(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc_nulls_last(), "run_id")


def _age_seconds(started_at: Column, now: Column) -> Column:
    return F.unix_timestamp(now) - F.unix_timestamp(started_at)


def stale_runs(runs: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    """Runs still marked running after the limit."""
    cutoff = now - F.make_dt_interval(secs=F.lit(seconds))
    return runs.where((F.col("status") == RUNNING) & (F.col("started_at") < cutoff))


def plan_runs(
    requests: DataFrame, runs: DataFrame, now: Column, seconds: int = STALE_SECONDS
) -> DataFrame:
    """What to do with every requested product-week.

    ``requests``: ``product, week_start, force`` and optionally ``run_id`` of a run registered
    before. ``verdict`` is create, rerun, recover, continue or skip; ``run_id`` the run to use.
    """
    if "run_id" not in requests.columns:
        requests = requests.withColumn("run_id", F.lit(None).cast("string"))
    known = latest_run(runs).select(
        *_KEY,
        F.col("run_id").alias("_run"),
        F.col("status").alias("_status"),
        F.coalesce("reviews_fetched", F.lit(0)).alias("_fetched"),
        F.coalesce("reviews_processed", F.lit(0)).alias("_processed"),
        F.col("started_at").alias("_started"),
    )
    status = F.col("_status")
    has_data = (F.col("_fetched") > 0) & (F.col("_processed") > 0)
    stale = _age_seconds(F.col("_started"), now) > seconds
    verdict = (
        F.when(F.col("_run").isNull(), "create")
        .when(F.coalesce("force", F.lit(False)), "rerun")
        .when((status == COMPLETED) & has_data, "skip")
        .when(status == COMPLETED, "recover")
        .when((status == RUNNING) & (F.col("run_id") == F.col("_run")), "continue")
        .when((status == RUNNING) & stale, "recover")
        .when(status == RUNNING, "skip")
        .otherwise("rerun")
    )
    return (
        requests.join(known, _KEY, "left")
        .withColumn("verdict", verdict)
        .withColumn("run_id", F.coalesce("_run", "run_id"))
        .select(*_KEY, "force", "run_id", "verdict")
    )


def new_run_id(product: Column, week_start: Column, now: Column) -> Column:
    """A run id that a recomputed task produces again, unlike a random one."""
    return F.sha2(F.concat_ws("|", product, week_start.cast("string"), now.cast("string")), 256)


def register_runs(runs: DataFrame, planned: DataFrame, now: Column) -> DataFrame:
    """Ledger with every run that is due marked running; reruns keep their id."""
    due = planned.where("verdict <> 'skip'").select(*_KEY, "run_id", "verdict")
    fresh = due.where("verdict = 'create'").select(
        F.coalesce("run_id", new_run_id(F.col("product"), F.col("week_start"), now)).alias("run_id"),
        "product",
        "week_start",
        week_end_of(F.col("week_start")).alias("week_end"),
        F.lit(RUNNING).alias("status"),
        F.lit(0).alias("reviews_fetched"),
        F.lit(0).alias("reviews_processed"),
        F.lit(False).alias("email_sent"),
        F.lit(0).alias("tokens_used"),
        now.cast("timestamp").alias("started_at"),
    )
    again = due.where("verdict <> 'create'").select("run_id", F.lit(True).alias("_again"))
    kept = (
        runs.join(again, "run_id", "left")
        .withColumn("status", F.when(F.col("_again"), RUNNING).otherwise(F.col("status")))
        .withColumn("error_message", F.when(F.col("_again").isNull(), F.col("error_message")))
        .withColumn("started_at", F.when(F.col("_again"), now).otherwise(F.col("started_at")))
        .drop("_again")
    )
    return kept.unionByName(fresh, allowMissingColumns=True).select(*RUNS.fieldNames())


def duplicate_weeks(runs: DataFrame) -> DataFrame:
    """Product-weeks with more than one run; empty for a sound ledger."""
    return runs.groupBy(*_KEY).agg(F.count("*").alias("n")).where("n > 1")


def reset_runs(runs: DataFrame, reset: DataFrame, now: Column) -> DataFrame:
    """Ledger with the given runs emptied and running again."""
    marks = reset.select("run_id").distinct().withColumn("_reset", F.lit(True))
    rows = runs.join(marks, "run_id", "left")
    blank = {
        "status": F.lit(RUNNING),
        "reviews_fetched": F.lit(0),
        "reviews_processed": F.lit(0),
        "tokens_used": F.lit(0),
        "report_path": F.lit(None).cast("string"),
        "doc_id": F.lit(None).cast("string"),
        "email_sent": F.lit(False),
        "error_message": F.lit(None).cast("string"),
        "started_at": now,
        "completed_at": F.lit(None).cast("timestamp"),
    }
    cleared = {name: F.when(F.col("_reset"), v).otherwise(F.col(name)) for name, v in blank.items()}
    return rows.withColumns(cleared).select(*runs.columns)


def drop_run_rows(stored: DataFrame, reset: DataFrame) -> DataFrame:
    """Cached reviews or themes without those of the given runs."""
    return stored.join(reset.select("run_id").distinct(), "run_id", "left_anti")


_PATCH = (
    "status", "error_message", "completed_at", "started_at", "reviews_fetched",
    "reviews_processed", "tokens_used", "report_path", "doc_id", "email_sent",
)


def finish_runs(runs: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Ledger with outcomes applied; ``outcomes`` holds any of the run columns per ``run_id``.

    Missing times and counts keep the ledger's values. The error text is always overwritten, and
    cut. The delivery columns of a completed run are taken as they come, nulls included.
    """
    given = [name for name in _PATCH if name in outcomes.columns]
    patch = outcomes.select(
        "run_id", F.lit(True).alias("_hit"), *[F.col(n).alias(f"_{n}") for n in given]
    )
    rows = runs.join(patch, "run_id", "left")
    hit, done = F.col("_hit"), F.coalesce(F.col("_status") == COMPLETED, F.lit(False))
    updates = {}
    for name in given:
        new, old = F.col(f"_{name}"), F.col(name)
        if name in ("report_path", "doc_id", "email_sent", "tokens_used"):
            updates[name] = F.when(hit & done, new).otherwise(F.coalesce(new, old))
        elif name != "error_message":
            updates[name] = F.coalesce(new, old)
    error = F.substring("_error_message", 1, ERROR_TEXT_LIMIT) if "error_message" in given else F.lit(None)
    updates["error_message"] = F.when(hit, error).otherwise(F.col("error_message"))
    if "email_sent" in given:
        updates["email_sent"] = F.coalesce(updates["email_sent"], F.lit(False))
    return rows.withColumns(updates).select(*runs.columns)


def run_outcomes(metrics: DataFrame, reports: DataFrame, failed: DataFrame, now: Column) -> DataFrame:
    """Outcome rows for ``finish_runs``: completed for rendered runs, failed for the others.

    ``metrics`` as from ``run_metrics``; ``reports`` has ``run_id, report_path``; ``failed`` has
    ``run_id, error_message``.
    """
    completed = metrics.join(reports.select("run_id", "report_path"), "run_id").select(
        "run_id",
        F.lit(COMPLETED).alias("status"),
        F.lit(None).cast("string").alias("error_message"),
        now.alias("completed_at"),
        F.col("reviews_fetched").cast("int").alias("reviews_fetched"),
        F.col("reviews_processed").cast("int").alias("reviews_processed"),
        F.col("tokens_used").cast("int").alias("tokens_used"),
        "report_path",
    )
    broken = failed.select("run_id", F.lit(FAILED).alias("status"), "error_message")
    return completed.unionByName(broken, allowMissingColumns=True)


def run_metrics(
    runs: DataFrame, counts: DataFrame, themes: DataFrame, quotes: DataFrame, chosen: DataFrame
) -> DataFrame:
    """One row per run: reviews fetched and processed, themes, quotes kept and dropped, tokens."""
    found = themes.groupBy("run_id").agg(F.count("*").alias("themes_found"))
    checked = quotes.groupBy("run_id").agg(
        F.count_if("passed").alias("quotes_validated"),
        F.count_if(~F.col("passed")).alias("quotes_dropped"),
    )
    parts = (
        runs.select("run_id")
        .join(counts.select("run_id", "reviews_fetched", "reviews_processed"), "run_id", "left")
        .join(found, "run_id", "left")
        .join(checked, "run_id", "left")
        .join(chosen.select("run_id", "tokens_used"), "run_id", "left")
    )
    names = [name for name in parts.columns if name != "run_id"]
    return parts.select("run_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def _present(text: Column) -> Column:
    return F.coalesce(F.trim(text) != "", F.lit(False))


def delivery_outbox(
    runs: DataFrame, reports: DataFrame, settings: DataFrame, delivered: DataFrame | None = None
) -> DataFrame:
    """Documents and mails that are due; nothing is sent.

    ``settings`` per product: ``doc_id, recipients, dry_run``. ``reports`` per run: ``content,
    subject, body``. ``delivered`` lists ``run_id`` whose document went out: mail is due for those
    only, once, and only where there are recipients.
    """
    chosen = settings.select(
        "product", F.col("doc_id").alias("_configured"), "recipients", "dry_run"
    )
    sent = (
        delivered.select("run_id").distinct().withColumn("_delivered", F.lit(True))
        if delivered is not None
        else runs.select("run_id").where(F.lit(False)).withColumn("_delivered", F.lit(True))
    )
    target = F.coalesce(F.nullif("_configured", F.lit("")), F.col("doc_id"))
    live = ~F.coalesce("dry_run", F.lit(False))
    doc_due = live & _present(F.col("target_doc")) & _present(F.col("content"))
    mail_due = (
        doc_due
        & F.coalesce("_delivered", F.lit(False))
        & ~F.coalesce("email_sent", F.lit(False))
        & (F.size(recipient_list(F.coalesce("recipients", F.lit("")))) > 0)
        & _present(F.col("subject"))
        & _present(F.col("body"))
    )
    return (
        runs.select("run_id", "product", "week_start", "doc_id", "email_sent")
        .join(reports.select("run_id", "content", "subject", "body"), "run_id")
        .join(chosen, "product")
        .join(sent, "run_id", "left")
        .withColumn("target_doc", target)
        .withColumn("doc_due", doc_due)
        .withColumn("mail_due", mail_due)
        .where("doc_due OR mail_due")
        .select(
            "run_id", "product", "week_start", "target_doc", "doc_due", "mail_due",
            "recipients", "subject", "content", "body",
        )
    )


def report_for_run(runs: DataFrame, reports: DataFrame, run_id: str | None = None) -> DataFrame:
    """Report text of completed runs with a recorded path, of one run or all."""
    ready = runs.where((F.col("status") == COMPLETED) & _present(F.col("report_path")))
    if run_id is not None:
        ready = ready.where(F.col("run_id") == run_id)
    wanted = ready.select("run_id", "product", "week_start", "report_path")
    return wanted.join(reports.select("product", "week_start", "content"), _KEY)
