"""Quality rules by robust multivariate outliers: minimum-covariance-determinant estimates per language and source.

Each document gets a vector of transformed statistics on an integer grid, so sums over any number of rows
are exact and don't depend on partitions. All groups are estimated together by concentration steps:
distances to the current estimate, the nearest part of each group, moments of that part, the next
estimate. A step shuffles moments by distance bin, never rows, so a group that holds most rows is no hot task.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import written

SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
GRID = 1024
#: Least standard deviation of each component. Most documents have no symbols, repeated lines or repeated
#: words at all; without a floor the covariance of such a group is singular and any of them is infinitely far.
FLOORS = [0.05, 0.05, 0.15, 0.15]
DIM = len(FLOORS)
#: Steps of the distance bins: the nearest part of a group ends with a whole bin, which decides ties.
BINS = 16


def count_text(text: str) -> tuple[int, ...]:
    """``COUNTS`` of one text."""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    lines = [line for line in raw.split(b"\n") if line.strip(b" \t\n\x0b\x0c\r")]
    repeats = 0
    if n > 3:
        triples = list(zip(words, words[1:], words[2:]))
        if len(set(triples)) < len(triples):
            seen, upto = Counter(triples), 0
            for i, triple in enumerate(triples):
                if seen[triple] > 1:
                    repeats += i + 3 - max(i, upto)
                    upto = i + 3
    return n, sum(len(word.decode("utf-8")) for word in words), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeats, len(lines)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``COUNTS`` (long) of the whole ``text``; null counts as empty. Columns of these names are replaced."""

    @F.arrow_udf("struct<" + ", ".join(f"{name}: long" for name in COUNTS) + ">")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([count_text(value.as_py() or "") for value in texts], dtype=np.int64).reshape(-1, len(COUNTS))
        return pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(COUNTS))], COUNTS)

    plain = docs.drop(*COUNTS).withColumn("_counts", of(F.col(text)))
    return plain.select("*", *[F.col("_counts")[name].alias(name) for name in COUNTS]).drop("_counts")


def base_failed(min_words: int = 50, most_repeats: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeats * F.col("n_words"))


def vector() -> list[Column]:
    """Transformed statistics as integers: word length, symbols, repeated lines, repeated words.

    Each rate is drawn towards that of plain prose by some weight, as rates of short texts scatter widely.
    """
    words = F.col("n_words") + 100
    parts = [
        F.log((F.col("word_chars") + 500) / words),
        F.log1p(F.col("n_symbols") / words),
        F.sqrt(F.col("n_dup_lines") / (F.col("n_lines") + 5)),
        F.col("n_repeat_words") / words,
    ]
    return [F.round(part * GRID).cast("long").alias(f"x{i}") for i, part in enumerate(parts)]


def _group(*columns: str) -> Column:
    return F.to_json(F.struct(*columns)) if columns else F.lit("{}")


def groups(rows: DataFrame, min_group: int, lang: str = "lang", source: str = "source") -> DataFrame:
    """(_lang, _source, group) of each language and source of ``rows``: the two together; too few rows for an
    estimate: the language's small sources together; too few again: all such rows together. Null is a
    language and a source of its own."""
    sizes = rows.groupBy(lang, source).agg(F.count(F.lit(1)).alias("n"))
    rest = F.sum(F.when(F.col("n") < min_group, F.col("n")).otherwise(0)).over(Window.partitionBy(lang))
    group = F.when(F.col("n") >= min_group, _group(lang, source)).when(rest >= min_group, _group(lang)).otherwise(_group())
    return sizes.select(F.col(lang).alias("_lang"), F.col(source).alias("_source"), group.alias("group"))


def _with_group(rows: DataFrame, named: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    met = F.col(lang).eqNullSafe(F.col("_lang")) & F.col(source).eqNullSafe(F.col("_source"))
    return rows.join(named, met, "left").drop("_lang", "_source")


_SUMS = [f"s{i}" for i in range(DIM)] + [f"q{i}{j}" for i in range(DIM) for j in range(i, DIM)]
_ESTIMATE = "group string, start int, n long, center array<double>, inverse array<double>, det double"


def _moments() -> list[Column]:
    weight = F.col("n")
    first = [F.sum(weight * F.col(f"x{i}")).alias(f"s{i}") for i in range(DIM)]
    second = [F.sum(weight * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"q{i}{j}") for i in range(DIM) for j in range(i, DIM)]
    return [F.sum("n").alias("n"), *first, *second]


def _estimates(moments: DataFrame, kept: float) -> DataFrame:
    """Center, inverse covariance and determinant by (group, start), of a nearest part ``kept`` of a normal group."""
    correction = consistency(kept)

    def of(parts):
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                n = float(row.n)
                center = np.array([getattr(row, f"s{i}") / n for i in range(DIM)])
                cov = np.empty((DIM, DIM))
                for i in range(DIM):
                    for j in range(i, DIM):
                        cov[i, j] = cov[j, i] = getattr(row, f"q{i}{j}") / n - center[i] * center[j]
                center, cov = center / GRID, correction * cov / GRID**2 + np.diag(np.square(FLOORS))
                out.append((row.group, row.start, row.n, center.tolist(), np.linalg.inv(cov).ravel().tolist(), float(np.linalg.det(cov))))
            yield pd.DataFrame(out, columns=["group", "start", "n", "center", "inverse", "det"])

    return moments.select("group", "start", "n", *_SUMS).mapInPandas(of, _ESTIMATE)


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance of ``x`` to the row's center."""
    off = [x[i] / F.lit(float(GRID)) - F.col("center")[i] for i in range(DIM)]
    terms = [F.col("inverse")[i * DIM + j] * off[i] * off[j] for i in range(DIM) for j in range(DIM)]
    return sum(terms[1:], terms[0])


def estimate(points: DataFrame, kept: float = 0.75) -> DataFrame:
    """MCD estimate of each ``group`` of ``points`` (group, x0.., n copies).

    Two starts, medians with absolute deviations and plain moments, are concentrated until they repeat;
    the one of smaller determinant is taken. The part kept is the nearest ``kept`` of a group and the rest
    of the bin in which it ends.
    """
    points = written(points)
    middle = points.groupBy("group").agg(*[F.percentile(f"x{i}", 0.5, F.col("n")).alias(f"m{i}") for i in range(DIM)])
    middle = written(middle)  # a table of one row per group, so that the planner knows its size
    off = points.join(middle, "group").select("group", "n", *[F.abs(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"d{i}") for i in range(DIM)])
    spread = off.groupBy("group").agg(*[F.percentile(f"d{i}", 0.5, F.col("n")).alias(f"d{i}") for i in range(DIM)])
    scale = [F.pow(1.4826 * F.col(f"d{i}") / GRID, 2) + FLOORS[i] ** 2 for i in range(DIM)]
    diagonal = F.array(*[1 / scale[i] if i == j else F.lit(0.0) for i in range(DIM) for j in range(DIM)])
    robust = middle.join(spread, "group").select(
        "group", F.lit(0).alias("start"), F.lit(0).cast("long").alias("n"), F.array(*[F.col(f"m{i}") / GRID for i in range(DIM)]).alias("center"), diagonal.alias("inverse"), F.lit(0.0).alias("det")
    )
    plain = _estimates(points.groupBy("group").agg(*_moments()).withColumn("start", F.lit(1)), 1.0)
    sizes = points.groupBy("group").agg(F.ceil(F.sum("n") * F.lit(kept)).alias("half"))
    current, sizes, seen = written(robust.unionByName(plain)), written(sizes), set()
    order = Window.partitionBy("group", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    while True:
        near = points.join(current.select("group", "start", "center", "inverse"), "group")
        square = _distance([F.col(f"x{i}") for i in range(DIM)])
        bins = near.withColumn("bin", F.floor(BINS * F.log2(F.greatest(square, F.lit(1e-6)))))
        bins = bins.groupBy("group", "start", "bin").agg(*_moments())
        nearest = bins.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0))).join(sizes, "group").filter("before < half")
        moments = nearest.groupBy("group", "start").agg(*[F.sum(name).alias(name) for name in ["n", *_SUMS]])
        current = written(_estimates(moments, kept))
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("group", "start", "n", "center", "inverse").cast("decimal(20,0)"))).first())
        if state in seen:  # settled, or going round among equals
            break
        seen.add(state)
    best = F.min_by(F.struct("n", "center", "inverse", "det"), F.struct("det", "start")).alias("best")
    return current.groupBy("group").agg(best).select("group", "best.*")


def chi2_cdf(x: float, dim: int) -> float:
    """Chi-square distribution function for an even ``dim``."""
    half = x / 2
    return 1 - math.exp(-half) * sum(half**k / math.factorial(k) for k in range(dim // 2))


def chi2_quantile(p: float, dim: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, dim) < p else (low, middle)
    return low


def consistency(kept: float) -> float:
    """Factor that makes the covariance of the nearest ``kept`` of a normal group that of the whole group."""
    return 1.0 if kept >= 1 else kept / chi2_cdf(chi2_quantile(kept, DIM), DIM + 2)


def judge(rows: DataFrame, counted: DataFrame, min_group: int = 100, kept: float = 0.75, level: float = 1 - 1e-6) -> DataFrame:
    """Add base_failed, distance (squared, null if none) and kept to ``rows`` with ``COUNTS``, lang and source.

    ``counted`` has the same of all rows and is what estimates come from, of those that pass the base
    rules; it should be a table, as it is read several times. A row is kept if it passes the base rules and
    lies within the ``level`` quantile of its group's distances under normality. Where all rows left over
    from small groups are too few to estimate from (2 * (4 + 1)), those that pass are kept. ``rows`` are
    joined with one row per group only. Columns base_failed, distance, kept and group are replaced.
    """
    passing = counted.filter(~base_failed())
    named = written(groups(passing, min_group))
    passing = _with_group(passing.select("lang", "source", *vector()), named)
    points = passing.groupBy("group", *[f"x{i}" for i in range(DIM)]).agg(F.count(F.lit(1)).alias("n"))
    large = passing.groupBy("group").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= 2 * (DIM + 1)).select("group")
    estimates = estimate(points.join(large, "group", "left_semi"), kept).select("group", "center", "inverse")
    by_source = written(named.join(estimates, "group").select("_lang", "_source", "center", "inverse"))
    judged = _with_group(rows.drop("base_failed", "distance", "kept", "center", "inverse"), by_source).withColumn("base_failed", base_failed())
    judged = judged.withColumn("distance", F.when(~F.col("base_failed"), _distance(vector())))
    verdict = ~F.col("base_failed") & F.coalesce(F.col("distance") <= chi2_quantile(level, DIM), F.lit(True))
    return judged.withColumn("kept", verdict).drop("center", "inverse")
