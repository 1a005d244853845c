"""Fuzzy score and quote matching against a plain version of the same definition."""

import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from themeloom.functions.fuzzy import token_set_ratio
from themeloom.operators import quotes


def plain_ratio(a, b):
    ta, tb = set(a.split()), set(b.split())
    if not ta or not tb:
        return 0.0
    both = " ".join(sorted(ta & tb))
    ab, ba = " ".join(sorted(ta - tb)), " ".join(sorted(tb - ta))
    if both and (not ab or not ba):
        return 100.0

    def similarity(x, y):
        row = [0] * (len(y) + 1)
        for cx in x:
            previous = 0
            for j, cy in enumerate(y, 1):
                previous, row[j] = row[j], previous + 1 if cx == cy else max(row[j], row[j - 1])
        total = len(x) + len(y)
        return 100.0 - 100.0 * (total - 2 * row[-1]) / total if total else 100.0

    left, right = f"{both} {ab}".strip(), f"{both} {ba}".strip()
    # the shared prefix of left and right is aligned as a block
    shared = len(both) + 1 if both else 0
    total = len(left) + len(right)
    rest = similarity(ab, ba)
    distance = (len(ab) + len(ba)) * (1 - rest / 100.0)
    scores = [100.0 - 100.0 * distance / (total if shared else len(ab) + len(ba))]
    if both:
        scores += [similarity(both, left), similarity(both, right)]
    return max(scores)


REVIEW = "Every platform change at the station was announced in the app early"


@pytest.mark.parametrize(
    "quote, passes",
    [("platform change at the station", True), ("announced early at the platform", True), ("seats were dirty and the heating broken", False)],
)
def test_known_verdicts(spark, quote, passes):
    score = spark.createDataFrame([(quote, REVIEW)], "a string, b string").select(token_set_ratio(F.col("a"), F.col("b"))).first()[0]
    assert (score >= 90) == passes


def random_text(rng, words):
    return " ".join(rng.choice(words) for _ in range(rng.randint(0, 9)))


def test_ratio_equals_plain_version(spark):
    rng = random.Random(7)
    words = ["app", "apps", "investmnt", "investment", "slow", "slower", "é", "Ü", "fee", "fees", "x", "the", "a"]
    pairs = [(random_text(rng, words), random_text(rng, words)) for _ in range(400)]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = [r["s"] for r in rows.select("i", token_set_ratio(F.col("a"), F.col("b")).alias("s")).orderBy("i").collect()]
    assert got == pytest.approx([plain_ratio(a, b) for a, b in pairs], abs=1e-9)


def test_matching_finds_the_first_best_review(spark):
    rng = random.Random(11)
    words = ["app", "apps", "investmnt", "investment", "slow", "slower", "fee", "fees", "the", "a", "crash", "crashes"]
    reviews = [(f"r{i % 3}", i, random_text(rng, words) + f" n{i % 7}", i % 5 + 1, "app_store", date(2026, 1, 1 + i % 20)) for i in range(150)]
    asked = [(f"r{i % 4}", i, random_text(rng, words)) for i in range(40)]
    review_rows = spark.createDataFrame(reviews, "run_id string, ord long, text string, rating int, source string, review_date date")
    quote_rows = spark.createDataFrame(asked, "run_id string, pos int, text string")
    found = {(r["run_id"], r["text"]): r for r in quotes.match_quotes(quote_rows, review_rows).collect()}
    assert len(found) == len({(q[0], q[2]) for q in asked})
    for run, _, text in asked:
        scores = [(-plain_ratio(text, r[2]), r[1], r) for r in reviews if r[0] == run]
        row = found[run, text]
        if not scores:
            assert (row["best_score"], row["passed"], row["ord"]) == (0.0, False, None)
            continue
        best = min(scores, key=lambda s: (round(s[0], 9), s[1]))
        assert row["best_score"] == pytest.approx(-best[0], abs=1e-9)
        assert (row["ord"], row["rating"]) == (best[1], best[2][3])
        assert row["passed"] == (row["best_score"] >= 90)


def test_matching_where_one_run_holds_most_reviews(spark):
    """Each review is given once, with the runs it counts for; quotes are spans, spellings, blanks and strangers."""
    rng = random.Random(13)
    words = ["app", "apps", "fee", "fees", "login", "logins", "crash", "crashed", "slow", "the", "a", "of", "zone", "train"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    reviews = [(i, text(rng.randint(1, 14)) if i % 9 else ["", " ", "a", "x y"][i % 4], i % 5 + 1, "app_store", date(2026, 1, 1 + i % 20)) for i in range(200)]
    members = [("hot" if i % 10 else f"r{i % 3}", i) for i in range(200)] + [("both", i) for i in range(0, 200, 7)] + [("hot", 4), ("hot", 4)]
    span = lambda t: " ".join(t.split()[1:5])
    asked = [(run, q) for run in ("hot", "r0", "r1", "both", "none") for q in
             ["", "  ", "unheard words only", "ap fe logn", "xxxx yyyy the", *[span(reviews[i][1]) for i in (3, 5, 11, 120)], *[text(4) + " qq" for _ in range(4)]]]
    rows = quotes.match_quotes(
        spark.createDataFrame(asked, "run_id string, text string"),
        spark.createDataFrame(reviews, "ord long, text string, rating int, source string, review_date date"),
        spark.createDataFrame(members, "run_id string, ord long"),
    ).collect()
    assert len(rows) == len(set(asked))
    for row in rows:
        inside = [reviews[i] for i in sorted({o for run, o in members if run == row["run_id"]})]
        if not inside:
            assert (row["best_score"], row["ord"], row["source"]) == (0.0, None, None)
            continue
        best = min((round(-plain_ratio(row["text"], r[1]), 9), r[0]) for r in inside)
        assert (round(-row["best_score"], 9), row["ord"]) == best and row["rating"] == reviews[best[1]][2]


def test_totals_and_failures(spark):
    reviews = spark.createDataFrame(
        [("r", 1, "My seat was shown on the train plan, which helps.", 5, "google_play", date(2026, 6, 15)),
         ("r", 2, "Ticket checks fail underground, every single time.", 5, "google_play", date(2026, 6, 15))],
        "run_id string, ord long, text string, rating int, source string, review_date date",
    )
    asked = spark.createDataFrame(
        [("r", 0, "seat was shown on the train"), ("r", 1, "Ticket checks fail underground, every single time"),
         ("r", 2, "the conductor sang songs all night long")], "run_id string, pos int, text string",
    )
    checked = quotes.validate_quotes(asked, reviews)
    totals = quotes.quote_totals(checked).first()
    assert (totals["total_quotes"], totals["passed_quotes"], totals["failed_quotes"], totals["valid"]) == (3, 2, 1, False)
    failed = checked.where("NOT passed").first()
    nearest = max(plain_ratio(failed["text"], r["text"]) for r in reviews.collect())
    assert failed["pos"] == 2 and failed["best_score"] == pytest.approx(nearest, abs=0.051)
    assert checked.where("passed AND best_score IS NOT NULL").count() == 0
