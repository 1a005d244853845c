"""Checks of text vectors and clustering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.adapter import Tables, with_run_id
from checks.registry import query
from themeloom.operators import clustering, vectors
from themeloom.session import cut_lineage

STOP_WORDS = ("the", "and", "of", "to", "in", "le", "la", "der", "die", "el")
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP_WORDS)


def _texts(t: Tables) -> DataFrame:
    return t.products.select("run_id", "ord", "text")


_COUNTS_SQL = rf"""
    SELECT run_id, ord, term, count(*) AS tf FROM (
      SELECT product AS run_id, ord, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_][\p{{L}}\p{{N}}_]+')) AS term FROM v_scrubbed)
    WHERE term NOT IN ({_STOP_SQL}) GROUP BY ALL"""
_VOCABULARY_SQL = f"""
    SELECT run_id, term, df, row_number() OVER (PARTITION BY run_id ORDER BY term) - 1 AS term_index FROM (
      SELECT run_id, term, sum(tf) AS total, count(*) AS df FROM ({_COUNTS_SQL}) GROUP BY run_id, term
      QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY total DESC, term) <= 384)"""
_WEIGHTS_SQL = f"""
    SELECT run_id, ord, term, term_index, w / sqrt(sum(w * w) OVER (PARTITION BY run_id, ord)) AS weight FROM (
      SELECT c.run_id, c.ord, c.term, v.term_index, c.tf * (ln((1 + n) / CAST(1 + v.df AS DOUBLE)) + 1) AS w
      FROM ({_COUNTS_SQL}) c JOIN ({_VOCABULARY_SQL}) v USING (run_id, term)
      JOIN (SELECT product AS run_id, count(*) AS n FROM v_scrubbed GROUP BY ALL) USING (run_id))"""


@query(
    "tfidf_vectors",
    f"SELECT run_id, ord, term, CAST(term_index AS INTEGER) AS term_index, round(weight, 6) AS weight FROM ({_WEIGHTS_SQL})",
)
def _tfidf(t: Tables) -> DataFrame:
    weights = vectors.tfidf_weights(_texts(t), stop_words=STOP_WORDS)
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "tfidf_vectors_dense",
    f"""SELECT run_id, ord, coalesce(filled, 0) AS filled, 384 AS size, round(coalesce(length, 0.0), 6) AS length
        FROM (SELECT product AS run_id, ord FROM v_scrubbed)
        LEFT JOIN (SELECT run_id, ord, CAST(count(*) AS INTEGER) AS filled, sqrt(sum(weight * weight)) AS length
                   FROM ({_WEIGHTS_SQL}) GROUP BY ALL) USING (run_id, ord)""",
)
def _dense(t: Tables) -> DataFrame:
    rows = vectors.tfidf_vectors(_texts(t), stop_words=STOP_WORDS)
    squares = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    return rows.select(
        "run_id", "ord",
        F.size(F.filter("vector", lambda x: x > 0)).alias("filled"),
        F.size("vector").alias("size"),
        F.round(F.sqrt(squares), 6).alias("length"),
    )


_RUN_COUNTS_SQL = _COUNTS_SQL.replace("product AS run_id", "run_id").replace("v_scrubbed", "v_run_reviews")
_RUN_WEIGHTS_SQL = (
    _WEIGHTS_SQL.replace(_COUNTS_SQL, "RUN_COUNTS").replace("SELECT product AS run_id, count(*) AS n FROM v_scrubbed", "SELECT run_id, count(*) AS n FROM v_run_reviews")
    .replace("RUN_COUNTS", _RUN_COUNTS_SQL)
)


@query(
    "tfidf_windows",
    f"""SELECT run_id, ord, count(*) AS terms, round(sum(weight), 5) AS total, arg_max(term, (round(weight, 9), term)) AS heaviest
        FROM ({_RUN_WEIGHTS_SQL}) GROUP BY run_id, ord""",
)
def _windows(t: Tables) -> DataFrame:
    """Weights of every report week's window, from counts taken once per review."""
    weights = vectors.window_tfidf_weights(t.clustered, stop_words=STOP_WORDS)
    heaviest = F.max_by("term", F.struct(F.round("weight", 9), "term")).alias("heaviest")
    # by the number first: that tells most rows apart where they are sorted; a run is named once per review
    totals = weights.groupBy("ord", "week_start", "product").agg(F.count("*").alias("terms"), F.round(F.sum("weight"), 5).alias("total"), heaviest)
    return with_run_id(totals).select("run_id", "ord", "terms", "total", "heaviest")


def _points(t: Tables) -> DataFrame:
    """The given vectors in four groups, with their label as cluster."""
    return t.table("embeddings").select(
        F.concat(F.lit("g"), (F.col("vec_id") % 4).cast("string")).alias("run_id"),
        F.col("vec_id").alias("ord"),
        F.col("embedding").cast("array<double>").alias("vector"),
        F.col("label").alias("cluster_id"),
    )


_POINTS_SQL = "SELECT 'g' || (vec_id % 4) AS run_id, vec_id AS ord, CAST(embedding AS DOUBLE[]) AS vector, label AS cluster_id FROM embeddings"


def _encode(texts: list[str]) -> list[list[float]]:
    return [[float(len(x)), float(x.count("e"))] for x in texts]


def _vector_cache(t: Tables, texts: DataFrame) -> DataFrame:
    """Vectors known from before, of texts with an even length; marked by a leading -1."""
    return texts.where(F.length("text") % 2 == 0).select(
        F.lit("lengths").alias("encoder"),
        vectors.text_key(F.col("text")).alias("text_key"),
        F.array(F.lit(-1.0), F.length("text").cast("double")).alias("vector"),
    ).distinct()


_TEXT_KEYS_SQL = "SELECT DISTINCT text, sha256(text) AS text_key, length(text) AS n, length(text) - length(replace(text, 'e', '')) AS e FROM v_scrubbed"


@query(
    "embedding_cache",
    f"SELECT text_key, CAST(n AS DOUBLE) AS a, CAST(e AS DOUBLE) AS b FROM ({_TEXT_KEYS_SQL}) WHERE n % 2 = 1",
)
def _cache(t: Tables) -> DataFrame:
    texts = _texts(t)
    fresh = vectors.embedding_cache(_vector_cache(t, texts), texts, _encode, "lengths")
    return fresh.select("text_key", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))


@query(
    "embed_texts",
    f"""SELECT text_key, CASE WHEN n % 2 = 0 THEN -1.0 ELSE CAST(n AS DOUBLE) END AS a,
               CAST(CASE WHEN n % 2 = 0 THEN n ELSE e END AS DOUBLE) AS b FROM ({_TEXT_KEYS_SQL})""",
)
def _embed(t: Tables) -> DataFrame:
    texts = _texts(t)
    rows = vectors.embed_texts(texts, _encode, "lengths", _vector_cache(t, texts))
    return rows.select("text_key", F.col("vector")[0].alias("a"), F.col("vector")[1].alias("b"))


@query(
    "scale_vectors",
    f"""SELECT run_id, ord, CAST(dim AS INTEGER) AS dim, round((x - avg(x) OVER w) / stddev_pop(x) OVER w, 5) + 0.0 AS x
        FROM (SELECT run_id, ord, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim FROM ({_POINTS_SQL}))
        WINDOW w AS (PARTITION BY run_id, dim)""",
)
def _scale(t: Tables) -> DataFrame:
    scaled = vectors.scale_vectors(_points(t))
    return scaled.select("run_id", "ord", F.posexplode("vector").alias("dim", "x")).withColumn(
        "x", F.round("x", 5) + 0.0
    )


# All-pairs distances to every cluster, in SQL.
def _silhouette_sql(distance: str) -> str:
    return f"""
    WITH p AS ({_POINTS_SQL}),
    d AS (SELECT a.run_id, a.ord, a.cluster_id AS own, b.cluster_id AS other,
                 sum({distance}) AS reach, count(*) AS n
          FROM p a JOIN p b USING (run_id) GROUP BY ALL),
    s AS (SELECT run_id, ord, max(n) FILTER (own = other) AS size,
                 max(reach / greatest(n - 1, 1)) FILTER (own = other) AS inner_mean, min(reach / n) FILTER (own <> other) AS outer_mean
          FROM d GROUP BY run_id, ord)
    SELECT run_id, count(*) AS n, round(avg(CASE WHEN size = 1 THEN 0.0
             ELSE (outer_mean - inner_mean) / greatest(inner_mean, outer_mean) END), 6) AS silhouette FROM s GROUP BY run_id"""


@query("silhouette_exact", _silhouette_sql("list_distance(a.vector, b.vector)"))
def _silhouette(t: Tables) -> DataFrame:
    return clustering.silhouette_exact(_points(t)).withColumn("silhouette", F.round("silhouette", 6))


@query("silhouette_fast", _silhouette_sql("pow(list_distance(a.vector, b.vector), 2)"))
def _silhouette_fast(t: Tables) -> DataFrame:
    return clustering.silhouette_fast(_points(t)).withColumn("silhouette", F.round("silhouette", 6))


_CENTRES_SQL = f"""
    SELECT run_id, cluster_id, list(x ORDER BY dim) AS centre FROM (
      SELECT run_id, cluster_id, dim, avg(x) AS x FROM (
        SELECT run_id, cluster_id, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM ({_POINTS_SQL}))
      GROUP BY ALL) GROUP BY ALL"""


@query(
    "assign_clusters",
    f"""SELECT p.run_id, p.ord, arg_min(c.cluster_id, list_distance(p.vector, c.centre)) AS cluster_id
        FROM ({_POINTS_SQL}) p JOIN ({_CENTRES_SQL}) c USING (run_id) GROUP BY p.run_id, p.ord""",
)
def _assign(t: Tables) -> DataFrame:
    points = _points(t)
    long = points.select("run_id", "cluster_id", F.posexplode("vector").alias("dim", "x"))
    means = long.groupBy("run_id", "cluster_id", "dim").agg(F.avg("x").alias("x"))
    centres = means.groupBy("run_id", "cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e["x"]).alias("centre")
    )
    nearest = clustering.assign_clusters(points.drop("cluster_id"), centres)
    return nearest.select("run_id", "ord", "cluster_id")


@query("kmeans")
def _kmeans(t: Tables) -> DataFrame:
    """Cost of the best clustering for every candidate number of clusters; see the tests."""
    models = clustering.kmeans(vectors.scale_vectors(_points(t)))
    return models.select("run_id", "n", "k", F.round("cost", 3).alias("cost"))


@query("select_k")
def _select_k(t: Tables) -> DataFrame:
    """Chosen number of clusters per group; see the tests."""
    points = cut_lineage(vectors.scale_vectors(_points(t)))
    blocks = cut_lineage(clustering.block_points(points))
    models = clustering.kmeans(points, blocks=blocks)
    return clustering.select_k(blocks, models).withColumn("silhouette", F.round("silhouette", 5))


@query("cluster_reviews")
def _cluster(t: Tables) -> DataFrame:
    """Themes found among every product's reviews from their tf-idf vectors; see the tests."""
    with_vectors = vectors.tfidf_vectors(t.products, stop_words=STOP_WORDS)
    _, themes = clustering.cluster_reviews(with_vectors)
    return themes.select("run_id", "cluster_id", "review_count", "avg_rating", "label")


@query(
    "cluster_totals",
    """SELECT product AS run_id, count(*) AS reviews, CAST(0 AS BIGINT) AS unassigned, true AS k_in_range
       FROM v_scrubbed GROUP BY product""",
)
def _cluster_totals(t: Tables) -> DataFrame:
    """What any clustering must give: every review in one theme, three to eight themes per product."""
    rows = t.clustered.withColumn("run_id", F.col("product"))
    with_vectors = vectors.tfidf_vectors(rows, stop_words=STOP_WORDS)
    tagged, themes = clustering.cluster_reviews(with_vectors.drop("cluster_id"))
    totals = themes.groupBy("run_id").agg(
        F.sum("review_count").alias("reviews"), F.count("*").between(3, 8).alias("k_in_range")
    )
    missing = tagged.groupBy("run_id").agg(F.count_if(F.col("cluster_id").isNull()).alias("unassigned"))
    return totals.join(missing, "run_id")


# Groups that any right clustering must find: far apart by a planted number, with components of the given vectors as noise.
_PLANTED = 4


def _planted(t: Tables) -> DataFrame:
    shift = F.transform(F.sequence(F.lit(0), F.lit(_PLANTED - 1)), lambda i: F.when(F.col("label") % _PLANTED == i, 50.0).otherwise(0.0))
    return t.table("embeddings").select(
        F.concat(F.lit("g"), (F.col("vec_id") % 3).cast("string")).alias("run_id"),
        F.col("vec_id").alias("ord"),
        F.zip_with(shift, F.slice(F.col("embedding").cast("array<double>"), 1, _PLANTED), lambda a, b: a + b).alias("vector"),
        (F.col("label") % _PLANTED).alias("planted"),
        (1 + F.col("vec_id") % 5).cast("int").alias("rating"),
        F.concat(F.lit("id"), F.col("vec_id").cast("string")).alias("review_id"),
    )


_PLANTED_SQL = f"""SELECT 'g' || (vec_id % 3) AS run_id, vec_id AS ord, label % {_PLANTED} AS planted, CAST(1 + vec_id % 5 AS INTEGER) AS rating,
    list_transform(range({_PLANTED}), lambda i: CASE WHEN label % {_PLANTED} = i THEN 50.0::DOUBLE ELSE 0 END + embedding[i + 1]::DOUBLE) AS vector FROM embeddings"""
_PLANTED_COST_SQL = f"""
    SELECT run_id, sum(pow(x - mean, 2)) AS cost FROM (
      SELECT run_id, x, avg(x) OVER (PARTITION BY run_id, planted, dim) AS mean FROM (
        SELECT run_id, planted, unnest(vector) AS x, generate_subscripts(vector, 1) AS dim FROM ({_PLANTED_SQL}))) GROUP BY run_id"""


@query(
    "kmeans_planted",
    f"""SELECT run_id, count(*) AS n, any_value(round(cost, 4)) AS cost, count(DISTINCT planted) AS clusters, true AS pure
        FROM ({_PLANTED_SQL}) JOIN ({_PLANTED_COST_SQL}) USING (run_id) GROUP BY run_id""",
)
def _kmeans_planted(t: Tables) -> DataFrame:
    """Cost of the clustering against the planted groups' squared distances from their means, and that clusters are the groups."""
    points = cut_lineage(_planted(t))
    blocks = cut_lineage(clustering.block_points(points))
    models = clustering.kmeans(points, k_min=_PLANTED, k_max=_PLANTED, blocks=blocks)
    labels = clustering._block_labels(clustering.label_blocks(blocks, models), ("run_id",)).join(points.select("run_id", "ord", "planted"), ["run_id", "ord"])
    pure = labels.groupBy("run_id").agg(
        F.count("*").alias("n"), F.countDistinct("planted").alias("clusters"),
        ((F.countDistinct("planted", "cluster_id") == F.countDistinct("planted")) & (F.countDistinct("cluster_id") == F.countDistinct("planted"))).alias("pure"),
    )
    return pure.join(models.select("run_id", F.round("cost", 4).alias("cost")), "run_id")


@query(
    "select_k_planted",
    f"""WITH p AS ({_PLANTED_SQL}),
    d AS (SELECT a.run_id, a.ord, a.planted AS own, b.planted AS other, sum(list_distance(a.vector, b.vector)) AS reach, count(*) AS n
          FROM p a JOIN p b USING (run_id) GROUP BY ALL),
    s AS (SELECT run_id, ord, max(reach / (n - 1)) FILTER (own = other) AS inner_mean, min(reach / n) FILTER (own <> other) AS outer_mean FROM d GROUP BY run_id, ord)
    SELECT run_id, {_PLANTED} AS k, round(avg((outer_mean - inner_mean) / greatest(inner_mean, outer_mean)), 5) AS silhouette FROM s GROUP BY run_id""",
)
def _select_k_planted(t: Tables) -> DataFrame:
    """The number of planted groups is chosen among three to eight, with the silhouette that all pairs give."""
    points = cut_lineage(_planted(t))
    blocks = cut_lineage(clustering.block_points(points))
    chosen = clustering.select_k(blocks, clustering.kmeans(points, blocks=blocks))
    return chosen.select("run_id", F.col("k").cast("int").alias("k"), F.round("silhouette", 5).alias("silhouette"))


@query(
    "cluster_reviews_planted",
    f"""SELECT run_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY n DESC, first) - 1 AS INTEGER) AS cluster_id, n AS review_count, avg_rating
        FROM (SELECT run_id, planted, count(*) AS n, min(ord) AS first, (200 * sum(rating) + count(*)) // (2 * count(*)) / 100.0 AS avg_rating
              FROM ({_PLANTED_SQL}) GROUP BY run_id, planted)""",
)
def _cluster_planted(t: Tables) -> DataFrame:
    """Themes from planted groups: sizes, ratings and canonical numbers."""
    _, found = clustering.cluster_reviews(_planted(t).drop("planted"))
    return found.select("run_id", "cluster_id", "review_count", "avg_rating")
