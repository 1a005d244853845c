"""Landing files in, tables out."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from themeloom.operators.dedup import clean_reviews, cleaning_stats, dedup_reviews, drop_reason
from themeloom.operators.ledger import plan_runs
from themeloom.sources import config, stores, tables
from themeloom.sources.responses import read_report_json

def google(text, score=4, at="2031-03-12T09:00:00Z", **more):
    return {"content": text, "score": score, "at": at, **more}


def apple(text, rating=4, date="2031-03-12T09:00:00Z", **more):
    return {"review": text, "rating": rating, "date": date, **more}


LATE = "The ferry timetable never loads on Sundays"
GOOGLE = [
    google("Maps of every harbour, even offline ones", 5, userName="Kim", at="2031-03-02T00:10:00+09:00"),
    google(LATE, 1, at="2031-03-09T23:30:00-05:00"),
    google("Tide &lt;table&gt; is right​", 5.0),
    google("meh", 2),
    google(f"  {LATE.upper()}\n", 1, at="2031-03-09"),
    google("Written long before the month began", at="2029-11-30T12:00:00Z"),
    google("\t"),
    {"content": "Somebody forgot the stars", "at": "2031-03-12T09:00:00Z"},
    google("The clock says when, nobody says which day", at="10:30"),
    google("Posted on no day of any month", at="2031-02-30T10:00:00Z"),
    google("Posted after lunch", at="yesterday"),
]
APPLE = [
    apple("Anchor alarm woke me in time, thank you", 5, title="Saved", isCurrentVersion="8.0.1"),
    apple("hm", 1, title=None),
    apple(LATE, 1, date="2031-03-09T01:00:00Z"),
    apple("", 5, title="Only a title"),
]


def window():
    return F.lit(date(2031, 3, 1)), F.lit(date(2031, 3, 31))


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("landing")
    paths = []
    for name, rows in (("google", GOOGLE), ("apple", APPLE)):
        path = folder / f"{name}.json"
        path.write_text("\n".join(json.dumps(r) for r in rows) + '\n{"content": "cut', encoding="utf-8")
        paths.append(str(path))
    return paths


def test_read_reviews(spark, landed):
    rows = stores.read_reviews(spark, *landed, fetched_at=F.lit(datetime(2026, 7, 1)))
    found = rows.orderBy("ord").collect()
    assert [r["source"] for r in found] == ["google_play"] * 6 + ["app_store"] * 3
    assert found[2]["rating"] == 5 and found[0]["author"] == "Kim" and found[0]["title"] is None
    assert found[6]["title"] == "Saved" and found[6]["app_version"] == "8.0.1"
    # days as written, whatever the offset
    assert (found[0]["review_date"], found[1]["review_date"]) == (date(2031, 3, 2), date(2031, 3, 9))
    assert all(len(r["review_id"]) == 16 for r in found)


def test_products_are_folders(spark, tmp_path):
    for product in ("boat", "train"):
        folder = tmp_path / "land" / f"product={product}"
        folder.mkdir(parents=True)
        (folder / "rows.json").write_text(json.dumps(google(f"A long enough word on the {product}")), encoding="utf-8")
    rows = stores.read_reviews(spark, str(tmp_path / "land"))
    assert {(r["product"], r["text"][-4:]) for r in rows.collect()} == {("boat", "boat"), ("train", "rain")}


def test_a_missing_source_leaves_the_other(spark, landed, tmp_path):
    rows = stores.read_reviews(spark, str(tmp_path / "nothing"), landed[1])
    assert rows.count() == 3
    assert stores.read_reviews(spark).count() == 0


def test_cleaning(spark, landed):
    cleaned = clean_reviews(stores.read_reviews(spark, *landed))
    stats = cleaning_stats(cleaned, *window()).first()
    assert stats.asDict() == {
        "kept": 4, "short": 2, "out_of_window": 1, "duplicate": 2,
        "earliest": date(2031, 3, 2), "latest": date(2031, 3, 12),
    }
    reasons = drop_reason(cleaned, *window())
    kept = reasons.where("drop_reason = 'kept'").orderBy("ord").collect()
    assert [r["text"] for r in kept][2] == "Tide <table> is right"
    assert {r["source"] for r in kept if r["rating"] == 1} == {"google_play"}
    once = dedup_reviews(cleaned)
    assert dedup_reviews(once).count() == once.count()


def test_stats_of_nothing_kept(spark):
    rows = spark.createDataFrame([("ok", date(2026, 6, 2), "k", 1)], "text string, review_date date, dedup_key string, ord long")
    stats = cleaning_stats(rows, *window()).first()
    assert (stats["kept"], stats["short"], stats["earliest"]) == (0, 1, None)


def test_newest_capped_with_one_hot_second(spark):
    rows = spark.range(5000).select(
        F.lit("p").alias("product"), F.lit("google_play").alias("source"), F.col("id").alias("ord"),
        F.when(F.col("id") < 10, F.lit("2026-01-02 00:00:00")).otherwise("2026-01-01 00:00:00").cast("timestamp").alias("at"),
    )
    kept = stores.newest_capped(rows, {"google_play": 700, "app_store": 5})
    assert sorted(r["ord"] for r in kept.collect()) == list(range(700))
    assert stores.newest_capped(rows, {"app_store": 5}).count() == 5000


def test_config_defaults_and_unknown_product(spark):
    configs = config.product_config(
        spark.createDataFrame([("a", "App A", 2)], "product string, display_name string, max_quotes_per_theme int")
    )
    row = configs.first()
    assert (row["max_themes"], row["max_quotes_per_theme"], row["max_review_chars"]) == (5, 2, 180)
    runs = spark.createDataFrame([("a",), ("b",)], "product string")
    with pytest.raises(Exception, match="no configuration for product b"):
        config.run_config(runs, configs).collect()
    assert config.run_config(runs, configs, strict=False).count() == 1


def test_report_json_numbers_parsable_attempts(spark):
    responses = spark.createDataFrame(
        [("r", 1, "not json", 5), ("r", 2, '{"summary": "s", "themes": [{"label": "a", "cluster_id": 1}]}', 7),
         ("r", 3, '{"themes": [', 1), ("r", 4, '{"quotes": []}', 2), ("r", 5, " {} ", 1), ("r", 6, '{"quotes": [}', 1)],
        "run_id string, attempt int, report_json string, tokens_used int",
    )
    rows = read_report_json(responses).orderBy("attempt").collect()
    assert [(r["parsed"], r["attempt_no"]) for r in rows] == [(False, None), (True, 1), (False, None), (True, 2), (True, 3), (False, None)]
    assert rows[1]["report"]["themes"][0]["cluster_id"] == "1"


def files(path):
    return {str(file): file.stat().st_mtime_ns for file in path.rglob("*.parquet")}


def test_reviews_change_owners_in_place(spark, tmp_path):
    path = tmp_path / "reviews"
    days = [(f"id{i}", "google_play", f"text {i}", 5, date(2026, 1, 5 + i % 20)) for i in range(200)] + [("id1", "app_store", "other", 1, date(2026, 1, 6))]
    reviews = spark.createDataFrame(days, "review_id string, source string, text_clean string, rating int, review_date date")
    owned = lambda run, start, cluster: reviews.select(
        "review_id", "source", F.lit(run).alias("run_id"), F.lit(start).cast("timestamp").alias("started_at"), F.lit(cluster).cast("int").alias("cluster_id")
    )
    tables.write_reviews(str(path), reviews, owned("run1", None, 3), buckets=8)
    before = files(path)
    some = F.col("review_id").isin("id1", "id21") & (F.col("source") == "google_play")
    later = owned("run2", datetime(2026, 2, 2), None).unionByName(owned("run3", datetime(2026, 2, 3), 4)).unionByName(owned("run0", None, 9))
    tables.write_reviews(str(path), reviews, later.where(some), buckets=8)
    rows = tables.read_table(spark, str(path)).collect()
    assert len(rows) == 201
    assert {(r["review_id"], r["source"]) for r in rows if r["run_id"] == "run3" and r["cluster_id"] == 4} == {("id1", "google_play"), ("id21", "google_play")}
    assert sum(r["run_id"] == "run1" for r in rows) == 199 and all(r["text_clean"] == f"text {r['review_id'][2:]}" for r in rows if r["source"] == "google_play")
    after = files(path)
    assert 1 <= len(set(before) - set(after)) <= 2 and all(after[name] == stamp for name, stamp in before.items() if name in after)
    assert [r["review_id"] for r in tables.load_reviews_for_run(tables.read_table(spark, str(path)), "run3").collect()] in (["id1", "id21"], ["id21", "id1"])
    tables.write_reviews(str(path), reviews.limit(0), later.limit(0), buckets=8)
    assert files(path) == after


def test_themes_and_reports_give_way_by_run_and_week(spark, tmp_path):
    week = date(2026, 3, 30)
    themes = spark.createDataFrame(
        [("run1", week, "a", "", 2, 1.0), ("run1", week, "c", "", 1, 1.0), ("run2", week, "b", "", 1, 2.0)],
        "run_id string, week_start date, label string, description string, review_count long, avg_rating double",
    )
    path = str(tmp_path / "themes")
    tables.write_themes(path, themes, buckets=1)  # both runs share a bucket
    tables.write_themes(path, themes.where("label = 'a'").withColumn("label", F.lit("new")), buckets=1)
    assert {(r["run_id"], r["label"]) for r in tables.read_table(spark, path).collect()} == {("run1", "new"), ("run2", "b")}

    reports = spark.createDataFrame([("app", week, "r", "# text"), ("b", week, "s", "# b")], "product string, week_start date, run_id string, content string")
    tables.write_report(str(tmp_path / "reports"), reports, buckets=1)
    tables.write_report(str(tmp_path / "reports"), reports.where("product = 'b'").withColumn("content", F.lit("new")), buckets=1)
    assert {(r["report_name"], r["content"]) for r in tables.read_table(spark, str(tmp_path / "reports")).collect()} == {("app-2026-03-30.md", "# text"), ("b-2026-03-30.md", "new")}


def test_plan_runs_verdicts(spark):
    now = datetime(2026, 6, 21, 12)
    ledger = spark.createDataFrame(
        [("forced", "completed", 5, 5, now), ("full", "completed", 5, 5, now), ("empty", "completed", 5, 0, now),
         ("mine", "running", 0, 0, now), ("young", "running", 0, 0, datetime(2026, 6, 21, 11, 30)),
         ("edge", "running", 0, 0, datetime(2026, 6, 21, 11)), ("old", "running", 0, 0, datetime(2026, 6, 21, 10)),
         ("broken", "failed", 0, 0, now)],
        "product string, status string, reviews_fetched int, reviews_processed int, started_at timestamp",
    ).withColumns({"run_id": F.concat(F.lit("id-"), F.col("product")), "week_start": F.lit(date(2026, 6, 15))})
    requests = ledger.select(
        "product", "week_start", (F.col("product") == "forced").alias("force"),
        F.when(F.col("product") == "mine", F.lit("id-mine")).alias("run_id"),
    ).union(spark.createDataFrame([("absent", date(2026, 6, 15), False, None)], "a string, b date, c boolean, d string"))
    verdicts = {r["product"]: r["verdict"] for r in plan_runs(requests, ledger, F.lit(now)).collect()}
    assert verdicts == {
        "forced": "rerun", "full": "skip", "empty": "recover", "mine": "continue", "young": "skip",
        "edge": "skip", "old": "recover", "broken": "rerun", "absent": "create",
    }
