"""Fuzzy check that every quote occurs in a review of its run.

Reviews are tokenised once, before they are spread over the runs they count for. From then on only narrow
rows move: an inverted index of the tokens that occur in quotes, and the reviews' lengths. Best scores are
exact and come from a threshold algorithm:

1. Each quote meets the reviews that hold its rarest token; the best score that shared tokens give there is
   its floor in the run.
2. Closed-form bounds tell which pairs can still reach the floor. A score from shared tokens needs a token
   of the quote's prefix (its rarest tokens, so many that the others together fall short), or a review
   short enough; a score from similar spelling needs a review of similar length.
3. Candidates are scored, and only those whose bound exceeds what token sets give go to the Python helper.

Joins on a run deal the reviews out by a salt, so that one run may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.functions.fuzzy import common_subsequence_length, joined_length, rest_text, set_overlap, token_set
from themeloom.schema import QUOTE_THRESHOLD
from themeloom.session import cut_lineage

#: Tasks over which the reviews of one run are dealt in a join.
SALTS = 32
_FACTS = ("rating", "source", "review_date")
_SLACK = 1e-6


def _salt() -> Column:
    return F.pmod(F.xxhash64("ord"), F.lit(SALTS))


def _salted_join(reviews: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """Join on ``keys``: ``reviews`` (with ``ord``) dealt out by salt, the much smaller ``asked`` once per salt."""
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))
    return reviews.withColumn("_salt", _salt()).join(asked.withColumn("_salt", salts), [*keys, "_salt"]).drop("_salt")


def review_tokens(reviews: DataFrame) -> DataFrame:
    """(ord, tokens, size, length, rating, source, review_date): the one pass over the texts, as a table."""
    tokens = reviews.select("ord", token_set(F.col("text")).alias("tokens"), *_FACTS)
    return cut_lineage(tokens.withColumns({"size": F.size("tokens"), "length": joined_length(F.col("tokens"))}))


def _scored(pairs: DataFrame, quotes: DataFrame, quote_tokens: DataFrame, index: DataFrame, sizes: DataFrame) -> DataFrame:
    """``pairs`` (qid, ord) with lengths, the score that shared tokens decide and the bound on the rest."""
    shared = pairs.join(quote_tokens.select("qid", "token", "chars"), "qid").join(index.select("ord", "token"), ["ord", "token"])
    shared = shared.groupBy("qid", "ord").agg(F.count(F.lit(1)).alias("n"), (F.sum("chars") + F.count(F.lit(1)) - 1).alias("shared"))
    met = pairs.join(shared, ["qid", "ord"], "left").join(quotes.select("qid", "size", "length"), "qid")
    met = met.join(sizes.select("ord", F.col("size").alias("rsize"), F.col("length").alias("rlength")), "ord")
    met = met.withColumns({"n": F.coalesce("n", F.lit(0)), "shared": F.coalesce("shared", F.lit(0))})
    overlap = _overlap()
    return met.withColumns({"set_score": overlap.set_score(), "bound": overlap.rest_bound()})


def _overlap():
    return set_overlap(*(F.col(name) for name in ("size", "length", "rsize", "rlength", "n", "shared")))


def match_quotes(
    quotes: DataFrame, reviews: DataFrame, members: DataFrame | None = None, threshold: float = QUOTE_THRESHOLD
) -> DataFrame:
    """Best score of every distinct quote text of a run, with the first review reaching it.

    ``reviews`` has a row per review (``ord`` identifies it), ``members`` the ``run_id, ord`` that belong
    together. Without ``members``, ``reviews`` has a row per run and review and is brought down to one per
    ``ord`` first. Columns: ``run_id, text, best_score, passed`` and the review's ``ord, rating, source,
    review_date`` (null where the run has no reviews).
    """
    if members is None:
        members = reviews.select("run_id", "ord")
        reviews = reviews.groupBy("ord").agg(F.min(F.struct("text", *_FACTS)).alias("_")).select("ord", "_.*")
    asked = quotes.select("run_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    tokens = F.array_sort(token_set(F.col("text")))
    texts = asked.select("text").distinct().withColumn("tokens", tokens).withColumn("qid", F.monotonically_increasing_id())
    texts = cut_lineage(texts.withColumns({"size": F.size("tokens"), "length": joined_length(F.col("tokens"))}))
    asked = cut_lineage(asked.join(texts.select("qid", "text"), "text").select("run_id", "qid"))
    members = cut_lineage(members.select("run_id", "ord").join(asked.select("run_id").distinct(), "run_id", "left_semi").distinct())

    tokenised = review_tokens(reviews.join(members.select("ord").distinct(), "ord", "left_semi"))
    sizes = tokenised.select("ord", "size", "length")
    words = texts.select("qid", F.explode("tokens").alias("token"))
    postings = tokenised.select("ord", F.col("length").alias("rlength"), F.explode("tokens").alias("token"))
    index = cut_lineage(postings.join(words.select("token").distinct(), "token", "left_semi"))
    held = index.groupBy("token").agg(F.count(F.lit(1)).alias("reviews"))
    # rarest first; tail: what a review can share that holds none of the tokens before
    common_first = Window.partitionBy("qid").orderBy(F.col("reviews").desc(), F.col("token").desc())
    found = words.join(held, "token").withColumn("chars", F.length("token"))
    tail = F.sum("chars").over(common_first) + F.row_number().over(common_first) - 1
    quote_tokens = cut_lineage(
        found.withColumn("tail", tail)
        .withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("reviews", "token")))
        .select("qid", "token", "chars", "tail", "rank")
    )

    def candidates(wanted: DataFrame) -> DataFrame:
        """(run_id, qid, ord) where the review holds the token and is shorter than ``reach``."""
        most = wanted.groupBy("token").agg(F.max("reach").alias("most"))
        near = index.join(most, "token").where("rlength < most").drop("most").join(members, "ord")
        met = _salted_join(near, wanted, ["run_id", "token"]).where("rlength < reach")
        return met.select("run_id", "qid", "ord").distinct()

    anywhere = F.lit(float("inf"))
    rarest = asked.join(quote_tokens.where("rank = 1"), "qid").select("run_id", "qid", "token", anywhere.alias("reach"))
    first = cut_lineage(candidates(rarest))
    scored = _scored(first.select("qid", "ord").distinct(), texts, quote_tokens, index, sizes)
    floors = first.join(scored.select("qid", "ord", "set_score"), ["qid", "ord"]).groupBy("run_id", "qid").agg(F.max("set_score").alias("floor"))
    floors = asked.join(floors, ["run_id", "qid"], "left").join(texts.select("qid", "length"), "qid")
    floors = cut_lineage(floors.withColumn("floor", F.coalesce("floor", F.lit(0.0))))

    # 200 s / (s + length) from s shared characters on the quote's side, on the review's side likewise;
    # 200 min / (sum) of the two lengths at most from spelling
    floor = F.greatest(F.col("floor") - _SLACK, F.lit(0.0))
    least_shared = floor * F.col("length") / (200 - floor)
    low = F.when(floor > 0, least_shared).otherwise(0.0)
    high = F.when(floor > 0, F.col("length") * (200 - floor) / floor).otherwise(anywhere)
    bounds = floors.withColumns({"least": least_shared, "low": low, "high": high})
    reach = F.when(F.col("tail") >= F.col("least"), anywhere).otherwise(F.col("low") + 1)
    by_token = candidates(bounds.join(quote_tokens, "qid").select("run_id", "qid", "token", reach.alias("reach")))

    step = lambda length: F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")
    open_ones = bounds.where("floor < 100 AND length > 0")
    longest = sizes.agg(F.max("length")).first()[0] or 0
    steps = F.explode(F.sequence(step(F.col("low")), step(F.least("high", F.lit(float(longest + 1))))))
    bands = open_ones.where(F.col("low") <= longest).withColumn("band", steps).select("run_id", "qid", "low", "high", "band")
    spread = members.join(sizes.where("length > 0"), "ord").select("run_id", "ord", F.col("length").alias("rlength"), step(F.col("length")).alias("band"))
    by_length = _salted_join(spread, bands, ["run_id", "band"]).where("rlength BETWEEN low AND high").select("run_id", "qid", "ord")

    pairs = cut_lineage(by_token.unionByName(by_length).distinct())
    lowest = pairs.join(floors.select("run_id", "qid", "floor"), ["run_id", "qid"]).groupBy("qid", "ord").agg(F.min("floor").alias("floor"))
    scored = cut_lineage(_scored(lowest, texts, quote_tokens, index, sizes).where("greatest(set_score, bound) >= floor"))
    still = scored.where("bound > set_score AND floor < 100").join(texts.select("qid", F.col("tokens").alias("qtokens")), "qid")
    still = still.join(tokenised.select("ord", F.col("tokens").alias("rtokens")), "ord").withColumn("both", F.array_intersect("rtokens", "qtokens"))
    common = common_subsequence_length(rest_text(F.col("qtokens"), F.col("both")), rest_text(F.col("rtokens"), F.col("both")))
    spelled = still.withColumn("common", common).select("qid", "ord", _overlap().rest_score(F.col("common")).alias("rest_score"))
    scores = scored.join(spelled, ["qid", "ord"], "left")
    scores = scores.select("qid", "ord", F.greatest("set_score", F.coalesce("rest_score", F.lit(0.0))).alias("score"))

    order = F.struct((-F.col("score")).alias("s"), F.col("ord").alias("o"))
    best = pairs.join(scores.where("score > 0"), ["qid", "ord"]).groupBy("run_id", "qid").agg(F.min(order).alias("_"))
    best = best.select("run_id", "qid", (-F.col("_.s")).alias("score"), F.col("_.o").alias("ord"))
    start = members.groupBy("run_id").agg(F.min("ord").alias("first"))  # reaches a score of 0
    matched = asked.join(best, ["run_id", "qid"], "left").join(start, "run_id", "left")
    matched = matched.withColumn("ord", F.coalesce("ord", "first")).join(tokenised.select("ord", *_FACTS), "ord", "left")
    best_score = F.coalesce("score", F.lit(0.0))
    return matched.join(texts.select("qid", "text"), "qid").select(
        "run_id", "text", best_score.alias("best_score"), (best_score >= threshold).alias("passed"), "ord", *_FACTS
    )


def validate_quotes(
    quotes: DataFrame, reviews: DataFrame, members: DataFrame | None = None, threshold: float = QUOTE_THRESHOLD
) -> DataFrame:
    """Every quote with ``passed``; a failed one carries its best score, rounded to one decimal."""
    matches = match_quotes(quotes, reviews, members, threshold)
    checked = quotes.join(matches.select("run_id", "text", "passed", "best_score"), ["run_id", "text"])
    shown = F.when(~F.col("passed"), F.round("best_score", 1))
    return checked.withColumn("best_score", shown)


def best_match(
    quotes: DataFrame, reviews: DataFrame, members: DataFrame | None = None, threshold: float = QUOTE_THRESHOLD
) -> DataFrame:
    """Every quote with rating, source and date of its first highest-scoring review."""
    return quotes.join(match_quotes(quotes, reviews, members, threshold), ["run_id", "text"])


def drop_failed_quotes(quotes: DataFrame, failed: DataFrame) -> DataFrame:
    """Quotes whose text is not among the run's failed texts."""
    return quotes.join(failed.select("run_id", "text").distinct(), ["run_id", "text"], "left_anti")


def quote_totals(checked: DataFrame, group_cols: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Total, passed and failed quotes; valid where none failed."""
    return checked.groupBy(*group_cols).agg(
        F.count("*").alias("total_quotes"),
        F.count_if("passed").alias("passed_quotes"),
        F.count_if(~F.col("passed")).alias("failed_quotes"),
        F.bool_and("passed").alias("valid"),
    )


def select_attempt(
    responses: DataFrame, checked: DataFrame, max_attempts: int = 3
) -> DataFrame:
    """The response a run goes on with: its first fully valid one, else the last allowed.

    ``responses`` are parsed (``read_report_json``), ``checked`` their validated quotes keyed by
    ``run_id, attempt``. ``tokens_used`` sums over all calls made up to the chosen one. A run
    without any parsable response has no row.
    """
    failures = checked.where(~F.col("passed")).select("run_id", "attempt").distinct()
    candidates = (
        responses.where(F.col("parsed") & (F.col("attempt_no") <= max_attempts))
        .join(failures.withColumn("_failed", F.lit(True)), ["run_id", "attempt"], "left")
        .withColumn("valid", F.col("_failed").isNull())
    )
    # A run has a handful of responses.
    preference = Window.partitionBy("run_id").orderBy(
        F.col("valid").desc(),
        F.when(F.col("valid"), F.col("attempt_no")).otherwise(-F.col("attempt_no")),
    )
    chosen = (
        candidates.withColumn("_rn", F.row_number().over(preference))
        .where("_rn = 1")
        .select("run_id", F.col("attempt").alias("_chosen"), "attempt_no", "report", "valid")
    )
    calls = responses.join(chosen.select("run_id", "_chosen"), "run_id").where("attempt <= _chosen")
    tokens = calls.groupBy("run_id").agg(F.sum("tokens_used").alias("tokens_used"))
    return chosen.join(tokens, "run_id").withColumnRenamed("_chosen", "attempt")
