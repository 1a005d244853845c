"""The whole job on a few reviews: requests to prompts, responses to reports and ledger."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from themeloom.plans import report
from themeloom.operators.themes import label_themes, named_so_far
from themeloom.plans.weekly import prompt_stage, publish, report_stage
from themeloom.schema import RUNS
from themeloom.sources import tables
from themeloom.sources.config import product_config

NOW = datetime(2026, 6, 22, 9)


@pytest.fixture(scope="module")
def result(spark):
    reviews = spark.createDataFrame(
        [("app", "gp1", "google_play", "Boarding passes show up in the wallet at once.", 5, date(2026, 6, 15), "Quiet Person", 1),
         ("app", "as1", "app_store", "Refunds crawl along for weeks. Ring 9812345670", 2, date(2026, 6, 16), "Other", 2),
         ("app", "old", "app_store", "Outside of every requested window", 2, date(2025, 6, 16), "Other", 3),
         ("else", "x", "app_store", "Of a product nobody asked for", 2, date(2026, 6, 16), "Other", 4),
         ("mute", "m", "app_store", "The model never answers for this one", 2, date(2026, 6, 16), "Other", 5)],
        "product string, review_id string, source string, text string, rating int, review_date date, author string, ord long",
    )
    configs = product_config(
        spark.createDataFrame([("app", "The App"), ("mute", "Mute"), ("calm", "Calm")], "product string, display_name string")
    )
    requests = spark.createDataFrame(
        [("app", date(2026, 6, 15), True), ("mute", date(2026, 6, 15), False), ("calm", date(2026, 6, 15), False)],
        "product string, week_start date, force boolean",
    )
    before = datetime(2026, 6, 21, 9)
    known = [("again", "app", date(2026, 6, 15), date(2026, 6, 21), "completed", 7, 7, "reports/x.md", "doc", True, 900, "old", before, before)]
    stage = prompt_stage(requests, spark.createDataFrame(known, RUNS), reviews, configs, F.lit(NOW))
    run_of = {r["product"]: r["run_id"] for r in stage.due.collect()}
    good = {
        "summary": " Good and bad. ",
        "themes": [{"label": "Boarding", "description": "Quick.", "review_count": 99, "cluster_id": "Cluster 1"}],
        "quotes": [{"text": "passes show up in the wallet", "theme_label": "boarding"}],
        "action_ideas": ["Pay refunds sooner."],
    }
    bad = dict(good, themes=[{"label": "Flying", "description": "All of it.", "cluster_id": "1"}, {"label": "No such", "cluster_id": 9}], quotes=[{"text": "Nobody ever wrote such words anywhere", "theme_label": "Boarding"}])
    responses = spark.createDataFrame(
        [(run_of["app"], 1, json.dumps(bad), 700), (run_of["app"], 2, json.dumps(good), 500), (run_of["mute"], 1, "sorry", 50),
         (run_of["calm"], 1, json.dumps({"summary": "Nothing came in.", "themes": [], "quotes": [], "action_ideas": []}), 20)],
        "run_id string, attempt int, report_json string, tokens_used int",
    )
    return run_of, stage, report_stage(stage, responses, F.lit(NOW))


def test_prompt(result):
    run_of, stage, _ = result
    prompts = {r["run_id"]: r for r in stage.prompts.collect()}
    prompt = prompts[run_of["app"]]["prompt"]
    assert "Report week: 2026-W25" in prompt
    assert "Review analysis window: 2026-04-13 to 2026-06-21" in prompt
    assert "[2★] [app_store] [2026-06-16] Refunds crawl along for weeks. Ring [REDACTED]" in prompt
    assert "Quiet Person" not in prompt and "9812345670" not in prompt
    assert prompts[run_of["app"]]["total_reviews"] == 2 and prompts[run_of["app"]]["max_quotes"] == 5
    assert stage.ledger.where("status = 'running'").count() == 3
    calm = prompts[run_of["calm"]]
    assert (calm["total_reviews"], calm["num_clusters"]) == (0, 0) and "<reviews>\n\n</reviews>" in calm["prompt"]


def test_a_run_done_again_is_emptied_first(result):
    run_of, stage, _ = result
    row = stage.ledger.where("product = 'app'").first()
    assert run_of["app"] == "again" and (row["status"], row["started_at"]) == ("running", NOW)
    assert (row["reviews_fetched"], row["tokens_used"], row["report_path"], row["doc_id"], row["email_sent"], row["error_message"], row["completed_at"]) == (0, 0, None, None, False, None, None)


def test_a_run_without_reviews_completes_with_zeros(result):
    run_of, _, done = result
    row = done.ledger.where("product = 'calm'").first()
    assert (row["status"], row["reviews_fetched"], row["reviews_processed"], row["tokens_used"]) == ("completed", 0, 0, 20)
    content = done.reports.where("product = 'calm'").first()["content"]
    assert "**Reviews Analyzed:** 0" in content and "Nothing came in." in content
    metrics = {r["run_id"]: r.asDict() for r in done.metrics.collect()}[run_of["calm"]]
    assert sum(v for k, v in metrics.items() if k not in ("run_id", "tokens_used")) == 0


def test_labels_of_an_earlier_attempt_are_remembered(spark):
    named = spark.createDataFrame(
        [("r", 1, 0, "First", "one", "1"), ("r", 1, 1, "Second", "two", "2"), ("r", 2, 0, " Later ", "three", "Cluster 1"), ("r", 3, 0, "Unused", "x", "2"), ("s", 1, 0, "Own", "", "1")],
        "run_id string, attempt int, pos int, label string, description string, cluster_ref string",
    )
    rows = spark.createDataFrame([("r", c, f"Theme {c + 1}", "") for c in range(3)], "run_id string, cluster_id int, label string, description string")
    chosen = spark.createDataFrame([("r", 2), ("s", 1)], "run_id string, attempt int")
    found = label_themes(rows, named_so_far(named, chosen)).orderBy("cluster_id").collect()
    assert [(r["label"], r["description"]) for r in found] == [("Later", "three"), ("Second", "two"), ("Theme 3", "")]


def test_publish_keeps_tables_and_lists_deliveries(spark, result, tmp_path):
    run_of, stage, done = result
    settings = spark.createDataFrame(
        [("app", "doc-1", "a@b.example", False), ("calm", "", None, False), ("mute", "doc-2", "x@y.example", False)],
        "product string, doc_id string, recipients string, dry_run boolean",
    )
    for _ in range(2):  # writing again changes nothing
        due = publish(stage, done, str(tmp_path), settings, F.concat(F.lit("https://a.example/"), F.col("run_id")), stage.due.select("run_id"))
    rows = due.collect()
    assert [(r["run_id"], r["doc_due"], r["mail_due"], r["target_doc"]) for r in rows] == [(run_of["app"], True, True, "doc-1")]
    assert "https://a.example/again" in rows[0]["body"] and rows[0]["content"].startswith("# The App")
    cache = tables.read_table(spark, f"{tmp_path}/reviews")
    owners = {(r["review_id"], r["run_id"], r["cluster_id"]) for r in cache.collect()}
    assert owners == {("gp1", "again", 0), ("as1", "again", 0), ("m", run_of["mute"], 0)}
    assert [r["text_clean"] for r in tables.load_reviews_for_run(cache, "again").collect()][0].endswith("[REDACTED]")
    assert {(r["run_id"], r["label"]) for r in tables.read_table(spark, f"{tmp_path}/themes").collect()} == {("again", "Boarding"), (run_of["mute"], "Theme 1")}
    assert {r["report_name"] for r in tables.read_table(spark, f"{tmp_path}/reports").collect()} == {"app-2026-06-15.md", "calm-2026-06-15.md"}


def test_metrics_and_ledger(result):
    run_of, _, done = result
    metrics = {r["run_id"]: r.asDict() for r in done.metrics.collect()}[run_of["app"]]
    assert metrics == {
        "run_id": run_of["app"], "reviews_fetched": 2, "reviews_processed": 2, "themes_found": 1,
        "quotes_validated": 1, "quotes_dropped": 0, "tokens_used": 1200,
    }
    ledger = {r["product"]: r for r in done.ledger.collect()}
    assert (ledger["app"]["status"], ledger["app"]["tokens_used"]) == ("completed", 1200)
    assert ledger["app"]["report_path"] == "reports/app-2026-06-15.md"
    assert ledger["app"]["completed_at"] == NOW
    assert (ledger["mute"]["status"], ledger["mute"]["error_message"]) == ("failed", "no parsable response")


def test_report(result):
    run_of, _, done = result
    content = done.reports.where("product = 'app'").first()["content"]
    assert content == "\n".join(
        [
            "# The App — Weekly Review Report",
            "",
            "**Reporting Week:** June 15, 2026 – June 21, 2026",
            "**Analysis Window:** April 13, 2026 – June 21, 2026 (10 weeks)",
            "**Sources:** Google Play, Apple App Store",
            "**Reviews Analyzed:** 2",
            "",
            "## Executive Summary",
            "Good and bad.",
            "",
            "## Top Themes",
            "1. **Boarding** — Quick. (2 reviews, avg ★3.5)",
            "",
            "## Representative Quotes",
            "_Quotes are drawn from the full analysis window and represent the most illustrative feedback for each theme._",
            "",
            '> "passes show up in the wallet" — 5★, Google Play, 2026-06-15',
            "> _Boarding · from analysis window_",
            "",
            "",
            "## Action Ideas",
            "- Pay refunds sooner.",
            "",
            "---",
            f"_Generated by themeloom · Run ID: {run_of['app']}_",
            "",
        ]
    )


def test_render_limits_and_label_fallback(spark):
    drafts = spark.createDataFrame([("r", "S", ["one", "two"])], "run_id string, summary string, action_ideas array<string>")
    runs = spark.createDataFrame(
        [("r", "app", "App", date(2026, 3, 30), date(2026, 4, 5), None, None, 100)],
        "run_id string, product string, display_name string, week_start date, week_end date, window_start date, window_end date, reviews_count int",
    )
    themes = spark.createDataFrame(
        [("r", 0, "Stock Search", "Fast.", 60, 4.5), ("r", 1, "Redeem", "Slow.", 40, 2.5)],
        "run_id string, cluster_id int, label string, description string, review_count int, avg_rating double",
    )
    quotes = spark.createDataFrame(
        [("r", 0, "Lookup is fast!", 5, "google_play", date(2026, 4, 1), "stock search ", None),
         ("r", 1, "Takes forever.", 2, "app_store", date(2026, 4, 2), "Redeem", None)],
        "run_id string, pos int, text string, rating int, source string, review_date date, theme_label string, cluster_id int",
    )
    by_label = report.render_markdown(drafts, runs, themes, quotes).first()["content"]
    assert '> "Lookup is fast!" — 5★, Google Play, 2026-04-01\n> "Takes forever." — 2★, App Store, 2026-04-02\n\n## Action' in by_label
    assert "Analysis Window" not in by_label
    every = report.render_markdown(drafts, runs, themes, quotes, max_quotes_per_theme=2, resolve_clusters=False)
    assert every.first()["content"].count("Takes forever.") == 2
    once = report.render_markdown(
        drafts, runs, themes, quotes, max_quotes_per_theme=2, resolve_clusters=False, dedupe_unresolved=True
    )
    assert once.first()["content"].count("Takes forever.") == 1
    tight = report.render_markdown(drafts, runs, themes, quotes, 1, 0, 1).first()["content"]
    assert "Redeem" not in tight and ">" not in tight and "- one" in tight and "- two" not in tight


def test_html_is_escaped(spark):
    drafts = spark.createDataFrame([("r", "<b>")], "run_id string, summary string").withColumn(
        "themes", F.array(F.struct(F.lit("A&B").alias("label"), F.lit("d").alias("description"), F.lit(3).alias("review_count"), F.lit(4.0).alias("avg_rating")))
    )
    runs = spark.createDataFrame([("r", "App", "2026-W25", None)], "run_id string, display_name string, iso_week string, report_url string")
    row = report.render_html_summary(drafts, runs).first()
    assert "<p>&lt;b&gt;</p>" in row["body"] and "<li><strong>A&amp;B</strong> — d (3 reviews, avg ★4.0)</li>" in row["body"]
    assert "href" not in row["body"] and row["subject"] == "App Weekly Review Report — Week 2026-W25"
