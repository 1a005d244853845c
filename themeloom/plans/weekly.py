"""The weekly job for many products and weeks at once: reviews to prompts, responses to reports.

The model call lies between the two stages, as files out and files in.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.functions.pii import scrub_pii
from themeloom.functions.weeks import iso_week_of, week_end_of, window_start_of
from themeloom.operators.clustering import cluster_reviews
from themeloom.operators.dedup import clean_reviews, dedup_reviews
from themeloom.operators.filters import min_length
from themeloom.operators.ledger import delivery_outbox, finish_runs, plan_runs, register_runs, reset_runs, run_metrics, run_outcomes
from themeloom.operators.quotes import match_quotes, select_attempt
from themeloom.operators.sampling import sample_for_prompt
from themeloom.operators.themes import label_themes, named_so_far
from themeloom.operators.vectors import Encoder, embed_texts, text_key, window_tfidf_vectors
from themeloom.operators.windows import lookback_windows, window_counts
from themeloom.plans.report import prompt_pack, render_html_summary, render_markdown, report_draft, verified_quotes
from themeloom.schema import MAX_ATTEMPTS, WINDOW_WEEKS
from themeloom.session import cut_lineage
from themeloom.sources.config import run_config
from themeloom.sources.responses import read_report_json, report_quotes, report_themes
from themeloom.sources.tables import report_name, write_report, write_reviews, write_themes


@dataclass(frozen=True)
class PromptStage:
    """Everything known before the model is asked. All frames but ``kept`` are keyed by ``run_id``.

    ``kept`` has each cleaned review once, ``reviews`` once per run that counts it.
    """

    due: DataFrame
    ledger: DataFrame
    kept: DataFrame
    reviews: DataFrame
    themes: DataFrame
    counts: DataFrame
    prompts: DataFrame


@dataclass(frozen=True)
class ReportStage:
    """What the model's responses lead to."""

    chosen: DataFrame
    matches: DataFrame
    themes: DataFrame
    quotes: DataFrame
    drafts: DataFrame
    reports: DataFrame
    metrics: DataFrame
    ledger: DataFrame


def due_runs(
    requests: DataFrame, ledger: DataFrame, configs: DataFrame, now: Column, weeks: int = WINDOW_WEEKS
) -> tuple[DataFrame, DataFrame]:
    """(runs to do, with window and settings; ledger with them marked running).

    A run that is done again, by request or for want of a result, is emptied first.
    """
    planned = cut_lineage(plan_runs(requests, ledger, now))
    again = planned.where("verdict IN ('rerun', 'recover')")
    after = cut_lineage(reset_runs(register_runs(ledger, planned, now), again, now))
    todo = planned.where("verdict <> 'skip'").select("product", "week_start")
    week = F.col("week_start")
    due = after.join(todo, ["product", "week_start"]).select(
        "run_id",
        "product",
        "week_start",
        week_end_of(week).alias("week_end"),
        window_start_of(week, weeks).alias("window_start"),
        week_end_of(week).alias("window_end"),
        iso_week_of(week).alias("iso_week"),
    )
    return cut_lineage(run_config(due, configs)), after


def prompt_stage(
    requests: DataFrame,
    ledger: DataFrame,
    reviews: DataFrame,
    configs: DataFrame,
    now: Column,
    weeks: int = WINDOW_WEEKS,
    encoder: Encoder | None = None,
    encoder_name: str = "encoder",
    vector_cache: DataFrame | None = None,
    stop_words: Sequence[str] | None = None,
) -> PromptStage:
    """From requests and landed reviews (with ``product``) to one prompt per run.

    Only reviews of products and dates that some due run needs are cleaned. Cleaning, dedup and
    redaction happen once per review; the result is written, then spread over the report weeks.
    """
    due, after = due_runs(requests, ledger, configs, now, weeks)
    spans = due.groupBy("product").agg(
        F.min("window_start").alias("_from"), F.max("window_end").alias("_to")
    )
    fetched = (
        reviews.join(spans, "product")
        .where(F.col("review_date").between(F.col("_from"), F.col("_to")))
        .drop("_from", "_to")
    )
    kept = dedup_reviews(min_length(clean_reviews(fetched)), ("product",))
    scrubbed = cut_lineage(kept.withColumn("text", scrub_pii(F.col("text"))))

    wanted = due.select("run_id", "product", "week_start")
    run_rows = lookback_windows(scrubbed, weeks).join(wanted, ["product", "week_start"])
    if encoder is None:
        with_vectors = window_tfidf_vectors(run_rows, scrubbed, weeks=weeks, stop_words=stop_words)
    else:
        vectors = embed_texts(scrubbed.select("text"), encoder, encoder_name, vector_cache)
        keyed = run_rows.withColumn("text_key", text_key(F.col("text")))
        with_vectors = keyed.join(vectors.select("text_key", "vector"), "text_key")
    tagged, themes = cluster_reviews(with_vectors)
    tagged, themes = cut_lineage(tagged), cut_lineage(themes)

    most = configs.agg(F.max("max_reviews_per_cluster")).first()[0] or 0
    limits = due.select("run_id", "max_reviews_per_cluster", "max_review_chars")
    sampled = (
        sample_for_prompt(tagged.join(limits, "run_id"), ("run_id",), most, F.col("max_review_chars"))
        .where(F.col("rank") <= F.col("max_reviews_per_cluster"))
        .drop("max_reviews_per_cluster", "max_review_chars")
    )
    counts = due.select("run_id", "product", "week_start").join(
        window_counts(fetched, scrubbed, ("product",), weeks), ["product", "week_start"], "left"
    )
    return PromptStage(
        due=due,
        ledger=after,
        kept=scrubbed,
        reviews=tagged,
        themes=themes,
        counts=counts,
        prompts=prompt_pack(due, themes, sampled),
    )


def report_stage(
    stage: PromptStage, responses: DataFrame, now: Column, max_attempts: int = MAX_ATTEMPTS,
    weeks: int = WINDOW_WEEKS, title: str = "Weekly Review Report", generator: str = "themeloom",
) -> ReportStage:
    """From model responses (``run_id, attempt, report_json, tokens_used``) to reports and ledger."""
    parsed = cut_lineage(read_report_json(responses))
    all_quotes = report_quotes(parsed.where(F.col("attempt_no") <= max_attempts))
    matches = cut_lineage(match_quotes(all_quotes, stage.kept, stage.reviews))
    checked = all_quotes.join(matches.select("run_id", "text", "passed"), ["run_id", "text"])
    chosen = cut_lineage(select_attempt(parsed, checked, max_attempts))

    picked = chosen.select("run_id", "attempt")
    used = parsed.join(picked, ["run_id", "attempt"], "left_semi")
    named, quotes = report_themes(used), report_quotes(used)
    themes = label_themes(stage.themes, named_so_far(report_themes(parsed), chosen))
    windows = stage.due.select("run_id", "window_start", "window_end")
    verified = cut_lineage(verified_quotes(quotes, matches, named, windows))
    drafts = report_draft(chosen, themes, verified)

    sizes = stage.reviews.groupBy("run_id").agg(F.count("*").alias("reviews_count"))
    runs = stage.due.join(sizes, "run_id", "left").withColumn("reviews_count", F.coalesce("reviews_count", F.lit(0)))
    reports = render_markdown(
        drafts, runs, themes, verified,
        F.col("max_themes"), F.col("max_quotes_per_theme"), F.col("max_action_ideas"),
        weeks, title, generator,
    )
    judged = quotes.join(matches.select("run_id", "text", "passed"), ["run_id", "text"])
    metrics = run_metrics(stage.due, stage.counts, themes, judged, chosen)
    written = reports.select(
        "run_id",
        F.concat(F.lit("reports/"), report_name(F.col("product"), F.col("week_start"))).alias("report_path"),
    )
    failed = stage.due.select("run_id").join(chosen.select("run_id"), "run_id", "left_anti").select(
        "run_id", F.lit("no parsable response").alias("error_message")
    )
    ledger = finish_runs(stage.ledger, run_outcomes(metrics, written, failed, now))
    return ReportStage(
        chosen=chosen,
        matches=matches,
        themes=themes,
        quotes=verified,
        drafts=drafts,
        reports=reports,
        metrics=metrics,
        ledger=ledger,
    )


def publish(
    stage: PromptStage, done: ReportStage, folder: str, settings: DataFrame, report_url: Column | None = None,
    delivered: DataFrame | None = None, title: str = "Weekly Review Report", generator: str = "themeloom",
) -> DataFrame:
    """Keep what the runs found in the tables under ``folder`` and return the deliveries that are due.

    The review cache takes over the runs' reviews with their clusters, themes and reports replace those of
    the same runs and weeks; writing again changes nothing. ``settings`` per product: ``doc_id, recipients,
    dry_run``; ``delivered`` lists runs whose document went out. ``report_url`` is a column over
    ``run_id, product, week_start``.
    """
    started = done.ledger.select("run_id", "started_at")
    saved = stage.reviews.select("run_id", "review_id", "source", "cluster_id").join(started, "run_id")
    write_reviews(f"{folder}/reviews", stage.kept.withColumnRenamed("text", "text_clean"), saved)
    weeks = stage.due.select("run_id", "week_start")
    write_themes(f"{folder}/themes", done.themes.join(weeks, "run_id"))
    write_report(f"{folder}/reports", done.reports)

    url = F.lit(None).cast("string") if report_url is None else report_url
    mails = render_html_summary(done.drafts, stage.due.withColumn("report_url", url), title, generator)
    reports = done.reports.select("run_id", "content").join(mails, "run_id")
    return delivery_outbox(done.ledger, reports, settings, delivered)
