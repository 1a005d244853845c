"""What moves between tasks does not grow with the overlap of windows or the length of texts; results stay the same."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from checks.adapter import Tables, with_run_id
from themeloom.functions.pii import PATTERNS, REDACTED, pii_matches, scrub_pii
from themeloom.functions.text import WHITESPACE, ZERO_WIDTH, collapse_whitespace, strip_space, strip_zero_width
from themeloom.operators import clustering, sampling, vectors
from themeloom.operators.windows import lookback_windows
from themeloom.sources import tables


@pytest.fixture(scope="module")
def reviews(spark):
    rows = [
        (f"p{i % 2}", i, i % 3, 1 + i % 5, dt.date(2024, 1, 1) + dt.timedelta(days=i * 5 % 60), f"id{i}", " ".join(f"w{i % 4}x w{j}" for j in range(i % 7 + 1)))
        for i in range(80)
    ] + [(None, 80, 1, 2, dt.date(2024, 1, 2), "id80", "no product"), ("p0", 81, None, 2, dt.date(2024, 1, 2), "id81", "no cluster")]
    return spark.createDataFrame(rows, "product string, ord long, cluster_id int, rating int, review_date date, review_id string, text string")


def plan_of(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_window_stats_are_those_of_spread_reviews(reviews):
    plain = sampling.theme_stats(with_run_id(lookback_windows(reviews)))
    found = sampling.window_theme_stats(reviews, with_run_id)
    assert sorted(map(str, found.select(plain.columns).collect())) == sorted(map(str, plain.collect()))


def test_window_weights_are_spread_last(reviews):
    found = vectors.window_tfidf_weights(reviews, stop_words=())
    windows = lookback_windows(reviews).select("product", "week_start", "ord", "text")
    plain = vectors.tfidf_weights(windows, ("product", "week_start"), stop_words=())
    rows = [{(r["product"], r["week_start"], r["ord"], r["term"]): (r["term_index"], r["weight"]) for r in df.collect()} for df in (found, plain)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) > 1000
    assert all(rows[0][key] == pytest.approx(rows[1][key]) for key in rows[0])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.index("Generate") < plan.index("Exchange")


@pytest.mark.parametrize("most", [1, 2, 5])
def test_rare_terms_go_before_sums_are_spread(spark, reviews, most):
    rare = reviews.withColumn("text", F.concat_ws(" ", "text", F.concat(F.lit("only"), F.col("ord").cast("string"))))
    found = vectors.window_tfidf_weights(rare, stop_words=(), max_features=most)
    plain = vectors.tfidf_weights(lookback_windows(rare).select("product", "week_start", "ord", "text"), ("product", "week_start"), max_features=most, stop_words=())
    rows = [{(r["product"], r["week_start"], r["ord"], r["term"]): (r["term_index"], r["weight"]) for r in df.collect()} for df in (found, plain)]
    assert rows[0].keys() == rows[1].keys() and len(rows[0]) > 100
    assert all(rows[0][key] == pytest.approx(rows[1][key]) for key in rows[0])
    weekly = spark.createDataFrame(
        [("p", dt.date(2024, 1, 1) + dt.timedelta(days=7 * w), f"t{i:02d}", 9 - min(i, 8), 1) for w in range(3) for i in range(40)], "product string, _week date, term string, tf long, df long"
    )
    left = vectors._possibly_frequent(weekly, ["product"], most, 10)
    assert {r["term"] for r in left.collect()} == {f"t{i:02d}" for i in range(40) if 3 * (9 - min(i, 8)) >= 10 - most}


def test_prompt_sample_is_shortened_before_it_moves(reviews):
    sampled = sampling.sample_for_prompt(reviews.withColumn("run_id", F.col("product")), per_cluster=2, max_chars=9)
    plan = plan_of(sampled)
    assert plan.index("Window") < plan.index("substring(text")
    for r in sampled.where("run_id = 'p0' AND cluster_id = 2 AND rank = 1").collect():
        assert r["ord"] == 20 and r["text"] == "w0x w0 w0..."


def test_longest_reviews_are_ranked_by_their_first_words(spark, reviews):
    long = reviews.withColumn("text", F.concat_ws(" ", "review_id", F.repeat(F.lit("w "), F.col("rating") * 9), "text"))
    tables = Tables(spark, "")
    tables.__dict__["clustered"] = long  # instead of the given tables
    plain = with_run_id(lookback_windows(long)).groupBy("run_id", "week_start", "cluster_id")
    plain = plain.agg(F.min_by("text", F.struct(-F.length("text"), "ord")).alias("text")).withColumn("text", F.substring_index("text", " ", 13))
    assert sorted(map(str, tables.longest.collect())) == sorted(map(str, plain.collect()))
    plan = plan_of(tables.longest)
    lowest = max(plan.index("Window"), plan.rindex("Aggregate"))  # what sorts rows for either meets no whole text
    assert lowest < plan.index("substring_index(text") and "Aggregate" not in plan[plan.index("substring_index(text") :]


def test_groups_settle_alike_in_one_task_and_over_blocks(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(300, 3)) + (np.arange(300) % 4)[:, None] * 6
    points = spark.createDataFrame([("a", i, v) for i, v in enumerate(x.tolist())], "run_id string, ord long, vector array<double>")
    blocks = clustering.block_points(points, block_rows=64).localCheckpoint()
    ways = [clustering.kmeans(points, k_min=3, k_max=4, restarts=2, blocks=blocks, block_rows=64, small_bytes=n).orderBy("k").collect() for n in (0, 1 << 20)]
    for spread, whole in zip(*ways, strict=True):
        assert spread["k"] == whole["k"] and spread["cost"] == pytest.approx(whole["cost"], rel=1e-9)
        assert np.allclose(np.frombuffer(spread["centres"]), np.frombuffer(whole["centres"]), atol=1e-7)


def test_large_groups_settle_in_waves_and_keep_their_keys(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(run, 100 * i + j, [float(x) for x in rng.normal(size=3) + 9 * (j % 3)]) for i, run in enumerate("abc") for j in range(60)]
    points = spark.createDataFrame(rows, "run_id string, ord long, vector array<double>")
    whole = clustering.kmeans(points, restarts=2, block_rows=16).orderBy("run_id", "k").collect()
    monkeypatch.setattr(clustering, "MODEL_BYTES", 1)  # a group at a time
    waves = clustering.kmeans(points, restarts=2, block_rows=16, small_bytes=0).orderBy("run_id", "k").collect()
    assert [(r["run_id"], r["n"], r["k"]) for r in waves] == [(run, 60, k) for run in "abc" for k in range(3, 9)]
    assert [r["cost"] for r in waves] == pytest.approx([r["cost"] for r in whole], rel=1e-9)


def test_steps_of_large_groups_move_no_blocks(spark, monkeypatch):
    """A step sends centres to where blocks are: what it shuffles are sums, and no step writes a table."""
    points = spark.createDataFrame([("a", i, [float(i * 37 % 101), float(i % 3)]) for i in range(400)], "run_id string, ord long, vector array<double>")
    written = []
    monkeypatch.setattr(clustering, "cut_lineage", lambda df, cut=clustering.cut_lineage: written.append(1) or cut(df))
    clustering.kmeans(points, restarts=4, block_rows=16, small_bytes=0)
    assert len(written) <= 16  # blocks, starts and results; each step was a table of its own


@pytest.mark.parametrize("side", [1, 3000, 1 << 20])
def test_silhouette_over_sides_of_several_blocks(spark, monkeypatch, side):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 3)) + (np.arange(150) % 3)[:, None]
    x[100:120] = x[0]
    points = spark.createDataFrame([("a", i, v, i % 7 - 2) for i, v in enumerate(x.tolist())], "run_id string, ord long, vector array<double>, label int")
    blocks = clustering.block_points(points, label="label", block_rows=16)
    monkeypatch.setattr(clustering, "SIDE_BYTES", side)
    member = np.eye(7)[np.arange(150) % 7]
    reach, own, sizes = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)) @ member, np.arange(150) % 7, member.sum(axis=0)
    inner, outer = reach[np.arange(150), own] / (sizes[own] - 1), reach / sizes
    outer[np.arange(150), own] = np.inf
    expected = ((outer.min(axis=1) - inner) / np.maximum(outer.min(axis=1), inner)).mean()
    assert clustering.silhouette(blocks).first()["silhouette"] == pytest.approx(expected, abs=1e-9)


def test_pairs_of_sides_not_of_blocks_move(spark):
    points = spark.createDataFrame([("a", i, [float(i)]) for i in range(320)], "run_id string, ord long, vector array<double>").withColumn("cluster_id", F.col("ord") % 2)
    blocks = clustering.block_points(points, label="cluster_id", block_rows=16).localCheckpoint()
    single = blocks.withColumns({"names": F.array(F.lit(0)), "label_sets": F.array("labels")})
    plan = plan_of(clustering._silhouette_exact(single, ["run_id"]))
    assert "_last" in plan and "blocks#" in plan and "sequence(0, (blocks" not in plan


def test_silhouettes_are_not_taken_again_for_themes(spark):
    points = spark.createDataFrame([("a", i, [float(i % 3 * 50 + i % 5)], i % 5 + 1, f"id{i}") for i in range(60)], "run_id string, ord long, vector array<double>, rating int, review_id string")
    tagged, themes = clustering.cluster_reviews(points, restarts=2)
    assert "meet(" not in plan_of(themes) + plan_of(tagged) and themes.count() == 3


def test_words_are_counted_by_texts_not_as_rows(spark):
    rows = [("p", i % 4 or None, " ".join(f"w{j % (i % 5 + 2)} The x" for j in range(i % 6))) for i in range(40)] + [("p", 1, None), (None, 9, "a bb bb ç été Été"), ("q", 2, "")]
    texts = spark.createDataFrame(rows, "run_id string, ord long, text string")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)\w{2,}"), F.lit(0))
    plain = texts.select("run_id", "ord", F.explode(words).alias("term")).where("term <> 'the'").groupBy("run_id", "ord", "term").agg(F.count("*").alias("tf"))
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for most in ("3", "10000"):  # keys that come more than once go over batches
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
            found = vectors.term_counts(texts, ("run_id",), "ord", ["the"])
            assert sorted(map(str, found.collect())) == sorted(map(str, plain.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert "Generate" not in plan_of(found)


def test_quicker_patterns_find_the_same(spark):
    rng = np.random.default_rng(2)
    parts = ["98", "3456", "+91", "0", "9876543210", "1234", "9012", "-", " ", ".", "@", "a.b", "x@y.com", "ABCDE1234F", "٣٤٥٦٧٨٩٠", "é", "　", "\x1c", "\n", "  ", "​"]
    t = F.col("t")
    rows = spark.createDataFrame([("".join(rng.choice(parts, rng.integers(0, 12))),) for _ in range(3000)] + [(None,)], "t string")
    scrubbed = t
    for pattern in PATTERNS.values():
        scrubbed = F.regexp_replace(scrubbed, "(?U)" + pattern, REDACTED)
    pairs = [
        (scrubbed, scrub_pii(t)),
        (F.regexp_replace(t, rf"(?U)^{WHITESPACE}+|{WHITESPACE}+\z", ""), strip_space(t)),
        (F.trim(F.regexp_replace(t, rf"(?U){WHITESPACE}+", " ")), collapse_whitespace(t)),
        (F.regexp_replace(t, ZERO_WIDTH, ""), strip_zero_width(t)),
        *[(F.regexp_count(t, F.lit("(?U)" + pattern)), pii_matches(t, kind)) for kind, pattern in PATTERNS.items()],
    ]
    assert list(rows.select(*[F.count_if(~old.eqNullSafe(new)) for old, new in pairs]).first()) == [0] * len(pairs)
    assert "CASE WHEN contains" in str(scrub_pii(t))  # a text without an @ meets no pattern of emails


def test_merges_leave_no_copies_of_their_rows(spark, tmp_path):
    """What a merge writes and shuffles on its way goes with it; rows of other keys and places stay."""
    folder = tmp_path / "steps"
    rows = [(f"id{i}", "s", f"text {i}", 1 + i % 5, dt.date(2024, 1, 1) + dt.timedelta(days=i % 20)) for i in range(60)]
    reviews = spark.createDataFrame(rows, "review_id string, source string, text_clean string, rating int, review_date date")
    before = spark.sparkContext.getCheckpointDir()
    spark.sparkContext.setCheckpointDir(str(folder))
    try:
        for run, some in (("a", reviews), ("b", reviews.where("rating < 3"))):
            saved = some.select("review_id", "source", F.lit(run).alias("run_id"), F.lit(None).cast("timestamp").alias("started_at"), F.lit(1).alias("cluster_id"))
            tables.write_reviews(str(tmp_path / "reviews"), some, saved, buckets=4)
        assert not list(folder.rglob("step-*"))
    finally:
        spark.sparkContext.setCheckpointDir(before)
    found = {r["review_id"]: r["run_id"] for r in tables.read_table(spark, str(tmp_path / "reviews")).collect()}
    assert found == {f"id{i}": "b" if i % 5 < 2 else "a" for i in range(60)}
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
