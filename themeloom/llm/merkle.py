"""Merkle manifest of a dataset by sibling-shift self-joins.

Leaves are numbered from 0 in each group. A level's nodes meet their siblings by an equijoin on computed
numbers: number XOR 1 in a binary tree, the other slots of the run otherwise. Rows in slot zero then emit the
parents. The groups' roots are the leaves of one more tree. Proofs are handed down from parents to children,
again one equijoin a level. Groups are numbered, so a large group is no hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import written

#: Levels that proofs pass in one job; then they are written, so that plans stay short.
LEVELS_PER_JOB = 6


def leaf_digest(columns: list[Column]) -> Column:
    """SHA-256 over each column's text: ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [column.cast("string") for column in columns]
    parts = [F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")) for text in texts]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _over(digests: Column) -> Column:
    """SHA-256 of a run of digests, which enter as hexadecimal text."""
    return F.unhex(F.sha2(F.lower(F.hex(digests)), 256))


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place from 0 in ``group`` by ``order`` (nulls first), and ``n``, the group's rows.

    Rows move once, by range; after that only counts per group and range meet. Rows equal in group and order
    get a number of their own first, so that they may fill more than one range.
    """
    own = written(rows.withColumn("_own", F.monotonically_increasing_id()))
    keys = [group, *order, "_own"]
    # the id holds the partition's number in its upper bits, and partitions follow the ranges
    placed = written(own.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    ranges = placed.groupBy(group, "_part").agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    along = Window.partitionBy(group).orderBy("_part")
    before = F.coalesce(F.sum("_rows").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.withColumn("_before", before).withColumn("n", F.sum("_rows").over(Window.partitionBy(group)))
    joined = placed.join(ranges, [group, "_part"]).withColumn("idx", F.col("_at") - F.col("_from") + F.col("_before"))
    return written(joined.drop("_own", "_at", "_part", "_from", "_before", "_rows"))


def _with_siblings(nodes: DataFrame, fanout: int) -> DataFrame:
    """``nodes`` with the digests of the run's nodes before and after each, in order, missing ones left out."""
    slot, none = F.col("idx") % fanout, F.lit(b"")
    before, after = [], []
    joined = nodes
    for offset in range(1, fanout):
        number = F.col("idx").bitwiseXOR(F.lit(1)) if fanout == 2 else F.col("idx") - slot + (slot + offset) % fanout
        other = nodes.select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), F.col("digest").alias(f"_{offset}"))
        joined = joined.join(other, (F.col("grp") == F.col("_grp")) & (number == F.col("_idx")), "left").drop("_grp", "_idx")
        found = F.coalesce(f"_{offset}", none)
        before.append(F.when(slot + offset >= fanout, found).otherwise(none))
        after.append(F.when(slot + offset < fanout, found).otherwise(none))
    joined = joined.withColumn("before", F.concat(*before)).withColumn("after", F.concat(*after))
    return joined.drop(*[f"_{offset}" for offset in range(1, fanout)])


def build(leaves: DataFrame, fanout: int = 2) -> tuple[list[DataFrame], DataFrame]:
    """The levels of the trees over ``leaves`` (grp, idx, n, digest, ...), and (grp, level, root).

    A level holds grp, idx, n, digest, before, after of groups that still have several nodes there; the
    lowest keeps the other columns of ``leaves`` too. A group of one leaf has that as its root, at level 0.
    """
    if fanout < 2:
        raise ValueError("fanout must be 2 or more")
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, levels = leaves, []
    single = lambda frame, level: frame.filter("n = 1").select("grp", F.lit(level).alias("level"), F.col("digest").alias("root"))
    roots = [single(leaves, 0)]
    while most > 1:
        level = written(_with_siblings(nodes.filter("n > 1"), fanout))
        levels.append(level)
        first = level.filter(F.col("idx") % fanout == 0)
        nodes = first.select(
            "grp", F.expr(f"idx div {fanout}").alias("idx"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"),
            _over(F.concat("digest", "after")).alias("digest"),
        )
        roots.append(single(nodes, len(levels)))
        most = -(-most // fanout)
    return levels, written(reduce(DataFrame.unionByName, roots))


def hand_down(leaves: DataFrame, levels: list[DataFrame], seeds: DataFrame, fanout: int = 2) -> DataFrame:
    """``leaves`` with ``path`` and the other columns of ``seeds`` (grp, level, path, ...; a row per root).

    ``path`` lists before and after for each level from the leaf up, then what the root's path has. A
    node's path is looked up by its parent's number, which as many rows share as a node has children.
    """
    given = [name for name in seeds.columns if name not in ("grp", "level", "path")]
    at = lambda level: seeds.filter(F.col("level") == level).drop("level").withColumn("idx", F.lit(0).cast("long"))
    above = at(len(levels))
    for k in reversed(range(len(levels))):
        parents = above.select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), F.col("path").alias("_path"), *given)
        met = levels[k].join(parents, (F.col("grp") == F.col("_grp")) & (F.expr(f"idx div {fanout}") == F.col("_idx")))
        met = met.withColumn("path", F.concat(F.array(F.struct("before", "after")), "_path")).drop("before", "after", "_grp", "_idx", "_path")
        if k == 0:
            above = met
        else:
            above = met.select("grp", "idx", "path", *given).unionByName(at(k))
            if (len(levels) - k) % LEVELS_PER_JOB == 0:
                above = written(above)
    alone = leaves.filter("n = 1").join(at(0).drop("idx"), "grp")
    return above.unionByName(alone) if levels else alone


def manifest(rows: DataFrame, key: str, group: str, columns: list[Column], found: list[Column] | None = None, fanout: int = 2) -> DataFrame:
    """Leaf, root and proof of each row of ``rows``, and whether what was found folds to the root.

    A leaf is the digest of ``columns``; in each ``group`` leaves ascend by ``key`` (null first, then by leaf),
    and every ``fanout`` consecutive nodes become one, the last run with fewer. The groups' roots, in order
    of ``group`` (null first, else by UTF-8 bytes), likewise become the root. ``found`` are the columns as a
    reader finds them; their leaf is folded with the siblings of the original one.

    Returns ``key``, leaf, subroot, root, path (per level the digests before and after, in binary),
    proof_sha256, folded_root, verified. Repeated rows are leaves of their own. Other columns don't matter,
    whatever their names; an empty table has no rows and no root.
    """
    of = F.col(group).cast("string")
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), of), F.lit("")).alias("grp"), F.col(key).alias("key"),
        leaf_digest(columns).alias("digest"), leaf_digest(columns if found is None else found).alias("altered"),
    )
    leaves = numbered(leaves, "grp", ["key", "digest"])
    levels, subroots = build(leaves, fanout)
    tops = numbered(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("of"), "level", F.col("root").alias("digest")), "grp", ["of"])
    top_levels, top = build(tops.withColumnRenamed("level", "height"), fanout)
    nothing = F.array().cast("array<struct<before: binary, after: binary>>")
    proofs = hand_down(tops.withColumnRenamed("level", "height"), top_levels, top.withColumn("path", nothing), fanout)
    seeds = written(proofs.select(F.col("of").alias("grp"), F.col("height").alias("level"), "path", F.col("digest").alias("subroot"), "root"))
    proven = hand_down(leaves, levels, seeds, fanout)
    text = lambda digest: F.lower(F.hex(digest))
    proof = F.array_join(F.transform("path", lambda p: text(F.concat(p["before"], p["after"]))), "")
    folded = F.aggregate("path", F.col("altered"), lambda digest, p: _over(F.concat(p["before"], digest, p["after"])))
    out = proven.select("key", "digest", "subroot", "root", "path", proof.alias("proof"), folded.alias("folded"))
    return out.select(
        F.col("key").alias(key), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), "path",
        F.sha2("proof", 256).alias("proof_sha256"), text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )
