"""A training corpus from raw documents: quality rules, line dedup, near-dedup, mixing, tokens.

Every stage is written as Parquet and read again, so a lost executor costs at most the running stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themeloom.llm import mixing, outliers, simhash, winnow
from themeloom.llm.common import word_count, written
from themeloom.llm.queries import MIX_MOST, MIX_SHARE, MIX_WEIGHTS, bpe_digests

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SIMHASH_WORDS, SIMHASH_BITS = 3, 3


def short_batches(spark: SparkSession) -> None:
    """Texts go to Python by 8 MB: a batch lies in the JVM's buffers and, twice, in each of an executor's workers."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source."""
    short_batches(spark)
    counted = outliers.with_counts(docs.select(*COLUMNS))
    table = written(counted.drop("text"))
    return outliers.judge(counted, table).filter("kept").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of 50 words or more that an earlier document holds are cut out; what loses all its lines goes."""
    short_batches(spark)
    clean = winnow.dedup_lines(docs.select(*COLUMNS))
    left = clean.filter((F.col("n_deleted") == 0) | (F.col("n_deleted") < F.col("n_lines")))
    length = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return left.withColumn("n_chars", length).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints over three-word shingles that differ in at most three bits."""
    return simhash.one_of_each(docs.select(*COLUMNS), distance=SIMHASH_BITS, shingle=SIMHASH_WORDS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a repeat is a row of its own."""
    body = F.xxhash64(F.coalesce(F.col("text"), F.lit("")))
    # equal rows are told apart by a number; which of them gets which makes no difference
    number = F.row_number().over(Window.partitionBy("doc_id", "_body").orderBy(F.lit(0)))
    sizes = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), body.alias("_body"))
    mixed = mixing.mix(written(sizes), MIX_WEIGHTS, MIX_SHARE, MIX_MOST).filter("passes > 0")
    passes = mixed.select(F.col("doc_id").alias("_key"), F.col("_body").alias("_of"), "passes")
    total = passes.groupBy("_key", "_of").agg(F.sum("passes").alias("_total"), F.count(F.lit(1)).alias("_rows"))
    whole = docs.select(*COLUMNS).withColumn("_body", body)
    joined = whole.join(total, F.col("doc_id").eqNullSafe(F.col("_key")) & (F.col("_body") == F.col("_of"))).withColumn("_number", number)
    times = F.floor(F.col("_total") / F.col("_rows")) + F.when(F.col("_number") <= F.col("_total") % F.col("_rows"), 1).otherwise(0)
    times = F.when(F.col("_number") <= F.col("_rows"), times).otherwise(0).cast("int")
    return joined.withColumn("_times", times).filter("_times > 0").withColumn("_turn", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text for each document of the mix."""
    return bpe_digests(docs.select("doc_id", "text"), pieces=200_000, kept=False)  # other stages run in the same workers


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("tokens", tokens)]

#: Concentration steps and linked components have no SQL; tests compare run() with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
