"""Model responses: one row per run and attempt, the report as JSON text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.schema import REPORT_JSON


def read_report_json(responses: DataFrame, json_col: str = "report_json") -> DataFrame:
    """Parse ``report_json`` into ``report``; ``parsed`` tells whether it was JSON at all.

    Unparsable rows stay, for their tokens count, but take no number among the run's attempts:
    ``attempt_no`` numbers the parsable ones and is null for the others.
    """
    report = F.from_json(F.col(json_col), REPORT_JSON, {"mode": "PERMISSIVE"})
    is_object = F.rlike(F.trim(F.col(json_col)), F.lit(r"(?s)^\{.*\}$"))
    fields = [F.col("report")[name].isNotNull() for name in REPORT_JSON.fieldNames()]
    some_field = fields[0] | fields[1] | fields[2] | fields[3]
    # An object without any of the fields is a response that says nothing.
    other = F.try_parse_json(F.col(json_col)).isNotNull()
    # Numbered over the few responses of one run.
    earlier = (
        Window.partitionBy("run_id")
        .orderBy("attempt")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        responses.withColumn("report", report)
        .withColumn("parsed", F.coalesce(is_object & (some_field | other), F.lit(False)))
        .withColumn(
            "attempt_no",
            F.when(F.col("parsed"), F.count_if("parsed").over(earlier).cast("int")),
        )
    )


def report_themes(parsed: DataFrame, keys: tuple[str, ...] = ("run_id", "attempt")) -> DataFrame:
    """One row per theme of each response, in the model's order."""
    return parsed.where("parsed").select(
        *keys, F.posexplode("report.themes").alias("pos", "theme")
    ).select(
        *keys,
        "pos",
        F.coalesce("theme.label", F.lit("")).alias("label"),
        F.coalesce("theme.description", F.lit("")).alias("description"),
        F.col("theme.cluster_id").alias("cluster_ref"),
    )


def report_quotes(parsed: DataFrame, keys: tuple[str, ...] = ("run_id", "attempt")) -> DataFrame:
    """One row per quote of each response, in the model's order."""
    return parsed.where("parsed").select(
        *keys, F.posexplode("report.quotes").alias("pos", "quote")
    ).select(
        *keys,
        "pos",
        F.coalesce("quote.text", F.lit("")).alias("text"),
        F.col("quote.theme_label").alias("theme_label"),
    )
