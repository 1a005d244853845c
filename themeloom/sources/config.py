"""Per-product settings with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.schema import CONFIG_DEFAULTS


def product_config(configs: DataFrame) -> DataFrame:
    """One row per product with every option filled in."""
    present = set(configs.columns)
    filled = {
        name: F.coalesce(F.col(name), F.lit(default)) if name in present else F.lit(default)
        for name, default in CONFIG_DEFAULTS.items()
    }
    return configs.withColumns(filled)


def run_config(rows: DataFrame, configs: DataFrame, strict: bool = True) -> DataFrame:
    """Attach the product's settings to runs or reviews; an unknown product fails when strict.

    No broadcast is forced: Spark broadcasts the settings while they stay under its size threshold
    and falls back to a shuffled join, with skew handling, beyond it.
    """
    if not strict:
        return rows.join(configs, "product")
    marked = configs.withColumn("_known", F.lit(True))
    joined = rows.join(marked, "product", "left")
    problem = F.concat(F.lit("no configuration for product "), F.col("product"))
    checked = F.when(F.col("_known"), F.col("product")).otherwise(F.raise_error(problem))
    return joined.withColumn("product", checked).drop("_known")
