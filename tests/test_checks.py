"""Checks over the given tables read all of them."""

from checks.adapter import Tables
from checks.registry import QUERIES
import checks.q_ledger  # noqa: F401

SMALL = "/root/testdata/sf0.001"


def test_write_reviews_covers_every_landed_review(spark):
    t = Tables(spark, SMALL)
    rows = QUERIES["write_reviews"](spark, SMALL).collect()
    landed = {(r["review_id"], r["source"]) for r in t.reviews.select("review_id", "source").collect()}
    newest = {}
    for r in t.run_reviews.select("review_id", "source", "run_id", "week_start", "cluster_id").collect():
        key, run = (r["review_id"], r["source"]), (r["week_start"], r["run_id"], r["cluster_id"])
        newest[key] = max(newest.get(key, run), run)
    assert len(rows) == len(landed) and {(r["review_id"], r["source"]) for r in rows} == landed
    for r in rows:
        owner = newest.get((r["review_id"], r["source"]))
        assert (r["run_id"], r["cluster_id"]) == ((owner[1], owner[2]) if owner else ("old", 1))
