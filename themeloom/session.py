"""Session settings the operators rely on, and the one place that decides where checkpoints go."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # A hot product or run may hold a third of the rows: let AQE split its join partitions even
    # where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to an existing session."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: str = "8", shuffle_partitions: int = 8, app: str = "themeloom") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only on a local master."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if current:
        return current
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        named = tempfile.mkdtemp(prefix="themeloom-checkpoint-")
    context.setCheckpointDir(named)
    return context.getCheckpointDir()


#: Smaller than the default where texts are most of a table; reads need no setting.
COMPRESSION = "zstd"
_SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query run inside go when it ends, not when the driver next collects garbage."""
    before = spark.conf.get(_SHUFFLES_GO, None)
    spark.conf.set(_SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_SHUFFLES_GO)
        else:
            spark.conf.set(_SHUFFLES_GO, before)


def step_path(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/step-{uuid.uuid4().hex}"


def drop_step(spark: SparkSession, path: str) -> None:
    """Delete a step's table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def cut_lineage(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and return a frame that reads it.

    A table, not ``checkpoint()``: a checkpointed frame keeps the size estimate of the plan it came
    from, and in a loop of joins that estimate squares with every step. ``path`` is a ``step_path`` of a caller
    that drops the table itself.
    """
    spark = df.sparkSession
    path = path or step_path(spark)
    with shuffles_dropped(spark):
        df.write.mode("errorifexists").option("compression", COMPRESSION).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
