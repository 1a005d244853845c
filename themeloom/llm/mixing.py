"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source's documents are shuffled by a hash and queued, pass after pass. A document's virtual finish
time is the source's cumulative size up to it over the source's target. One global sort by finish time
interleaves the sources in proportion to their targets; the mix is what comes before the total budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import written

#: Leading hex digits of the shuffle hash and steps of virtual time by which running sums are taken in
#: two levels, so no source and no stretch of the queue is summed up in one task.
SLICE_DIGITS = 3
TIME_STEPS = 4096


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: int) -> DataFrame:
    """Targets by source: (source, place, weight, source_size, target).

    ``sizes`` has ``source`` and ``size``. Sources in code-point order, null last, take ``weights`` in
    turn. ``share`` times all sizes is dealt by weight; a target stops at ``most`` times its source's
    size and the excess is dealt anew among the rest. A source without words has target 0.

    Who stops is read off one order: by stopping point over weight, a source stops as long as the level
    that the sources from it on would share is above its own.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    placed = totals.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    taken = F.array(*[F.lit(w) for w in weights])
    weighed = placed.withColumn("weight", F.element_at(taken, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
    cap = F.col("source_size") * F.lit(most)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("source_size") * F.lit(float(most)) / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("budget"),
        F.coalesce(F.sum(cap).over(before), F.lit(0)).alias("stopped"),
        F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("left"),
    ).withColumn("level", (F.col("budget") - F.col("stopped")) / F.col("left"))
    stop = F.col("source_size") * F.lit(float(most)) / F.col("weight")
    first_open = F.min(F.when(stop > F.col("level"), F.struct(stop.alias("stop"), "place", "level")))
    return level.withColumn("shared", first_open.over(everything)["level"]).select(
        "source",
        "place",
        "weight",
        "source_size",
        F.when(F.col("shared").isNull(), cap.cast("double"))
        .otherwise(F.least(cap.cast("double"), F.col("shared") * F.col("weight")))
        .alias("target"),
    )


def mix(rows: DataFrame, weights: list[int], share: float, most: int, key: str = "doc_id") -> DataFrame:
    """Mix ``rows`` of ``key``, ``source``, ``size`` and further columns; adds source_size, target, passes and taken.

    ``passes`` says how often the mix takes the row, ``taken`` the words of that. Documents are taken
    whole; the mix is the longest prefix of the queue within the budget, so a source ends within about
    one document of its target. Null keys and sources are a key and a source like others, rows without
    words (and null sizes) are never taken, and equal rows are entries of their own. Columns named as those
    added are replaced; names that begin with an underscore are reserved. ``rows`` should be a table: it is read several times.
    """
    rows = rows.drop("source_size", "target", "passes", "taken")
    targets = written(source_targets(rows, weights, share, most))
    by_source = targets.select(F.col("source").alias("_source"), F.col("place").alias("_place"), "source_size", "target")
    queue = rows.join(by_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    queue = queue.withColumn("_hash", F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
    queue = queue.withColumn("_slice", F.substring("_hash", 1, SLICE_DIGITS)).withColumn("_size", F.coalesce("size", F.lit(0)))
    slices = queue.groupBy("_place", "_slice").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_place").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("_place", "_slice", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_place", "_slice").orderBy("_hash", F.col(key).asc_nulls_last(), "_size")
    queue = queue.withColumn("_sofar", F.sum("_size").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    queue = queue.join(slices, ["_place", "_slice"]).withColumn("_sofar", F.col("_offset") + F.col("_sofar")).drop("_offset", "_slice")

    def entry(turn: Column) -> Column:
        """Where a row stands in the queue in one pass: by finish time, then by source, pass and shuffle."""
        finish = (turn * F.col("source_size") + F.col("_sofar")) / F.col("target")
        return F.struct(finish.alias("finish"), F.col("_place").alias("place"), turn.alias("turn"), F.col("_hash").alias("hash"), F.col("_sofar").alias("sofar"))

    entries = queue.filter("_size > 0").select("_size", F.explode(F.array(*[entry(F.lit(p)) for p in range(most)])).alias("entry"))
    entries = entries.withColumn("_step", F.floor(F.col("entry.finish") * TIME_STEPS))
    budget = targets.agg(F.sum("target").alias("_budget"))
    steps = entries.groupBy("_step").agg(F.sum("_size").alias("_sum"))
    upto = Window.orderBy("_step").rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select("_step", F.sum("_sum").over(upto).alias("_end"), (F.sum("_sum").over(upto) - F.col("_sum")).alias("_begin"))
    # only the stretch of the queue in which the budget ends is put in order
    edge = steps.filter(F.col("_end") > budget.scalar()).orderBy("_step").limit(1)
    order = Window.partitionBy("_step").orderBy("entry")
    edge = entries.join(edge, "_step").withColumn("_run", F.col("_begin") + F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = written(edge.filter(F.col("_run") > budget.scalar()).agg(F.min("entry").alias("cut")))
    first_out = cut.scalar()
    passes = sum((F.when((F.col("_size") > 0) & (first_out.isNull() | (entry(F.lit(p)) < first_out)), 1).otherwise(0) for p in range(most)), F.lit(0))
    mixed = queue.withColumn("passes", passes.cast("long")).withColumn("taken", F.col("passes") * F.col("_size"))
    return mixed.drop("_place", "_hash", "_size", "_sofar")
