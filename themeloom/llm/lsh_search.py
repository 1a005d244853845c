"""Nearest neighbours by multiprobe p-stable hashing.

A table's hash of a vector is a cell of a random grid: Gaussian projections, shifted, over a width. A query
visits its own cell and the cells around it in order of estimated success, by the squared distances to the
boundaries it would cross. Vectors and queries meet by cell in blocks, blocks are scored as matrices, and
the best of all tables are ranked by exact distances. Equal vectors are indexed once.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themeloom.llm.common import written

#: Rows of a cell in one block of the index and of the queries; larger cells are split into more blocks.
INDEX_BLOCK, QUERY_BLOCK = 1024, 256


class Grid:
    """The hash functions of all tables, fixed by ``seed``."""

    def __init__(self, dim: int, tables: int, functions: int, width: float, seed: int = 20):
        draw = np.random.default_rng(seed)
        self.directions = draw.standard_normal((tables, dim, functions))
        self.shifts = draw.random((tables, functions))
        self.width = width
        steps = np.array(list(itertools.product((-1, 0, 1), repeat=functions)), dtype=np.int64)
        self.steps = steps

    def places(self, vectors: np.ndarray, table: int) -> np.ndarray:
        return vectors @ self.directions[table] / self.width + self.shifts[table]

    @staticmethod
    def cells(places: np.ndarray) -> np.ndarray:
        """One number for each row of whole coordinates; a collision only adds candidates."""
        mixed = np.full(len(places), 0x9E3779B97F4A7C15, dtype=np.uint64)
        for column in places.T:
            mixed = (mixed ^ column.astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
            mixed ^= mixed >> np.uint64(32)
        return mixed.view(np.int64)

    def probes(self, vectors: np.ndarray, table: int, number: int) -> np.ndarray:
        """The ``number`` cells of each vector likeliest to hold its neighbours: (rows, number)."""
        places = self.places(vectors, table)
        floor = np.floor(places)
        inside = places - floor
        cost = np.stack([inside**2, np.zeros_like(inside), (1 - inside) ** 2], axis=2)
        score = sum(cost[:, i, self.steps[:, i] + 1] for i in range(self.steps.shape[1]))
        order = np.argsort(score, axis=1, kind="stable")[:, :number]
        visited = floor[:, None, :] + self.steps[order]
        return self.cells(visited.reshape(-1, visited.shape[2])).reshape(len(vectors), -1)


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    values = lists.flatten() if isinstance(lists, pa.ListArray) else lists.combine_chunks().flatten()
    return values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector, dim): vectors with a key that are neither null, empty nor zero and hold finite numbers only."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).filter(F.col("key").isNotNull() & F.col("vector").isNotNull())
    return kept.filter(finite & F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))


def radius(vectors: DataFrame, dim: int) -> float:
    """Root mean square distance to the mean over all ``vectors``, to six digits so that reruns agree."""

    def sums(batches):
        for batch in batches:
            data = _matrix(batch.column("vector"), dim)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, len(data), dtype=np.int64)), pa.array(data.sum(axis=0)), pa.array((data**2).sum(axis=0))], names=["place", "n", "s", "q"]
            )

    parts = vectors.select("vector").mapInArrow(sums, "place int, n long, s double, q double")
    spread = parts.groupBy("place").agg((F.sum("q") / F.sum("n") - F.pow(F.sum("s") / F.sum("n"), 2)).alias("variance"))
    found = spread.agg(F.sum("variance")).first()[0]
    return float(f"{math.sqrt(max(found or 0.0, 0.0)):.6g}") or 1.0


def _in_cells(vectors: DataFrame, dim: int, grid: Grid, probes: int | None) -> DataFrame:
    """(cell_table, cell, rep, packed): a row per table for the index, per table and probe for queries."""
    tables = len(grid.directions)

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                part = batch.slice(begin, 1000)
                data = _matrix(part.column("vector"), dim)
                packed = pa.array([row.tobytes() for row in data], pa.binary())
                for table in range(tables):
                    cells = grid.cells(np.floor(grid.places(data, table)))[:, None] if probes is None else grid.probes(data, table, probes)
                    at = pa.array(np.repeat(np.arange(len(data)), cells.shape[1]))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(cells.size, table, dtype=np.int32)), pa.array(cells.ravel()), part.column("rep").take(at), packed.take(at)], names=["cell_table", "cell", "rep", "packed"]
                    )

    return vectors.select("rep", "vector").mapInArrow(run, "cell_table int, cell long, rep long, packed binary")


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows of each cell as lists of about ``size``."""
    counted = rows.groupBy("cell_table", "cell").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("blocks"))
    dealt = rows.join(counted, ["cell_table", "cell"]).withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    return dealt.groupBy("cell_table", "cell", "block").agg(F.collect_list(F.struct("rep", "packed")).alias(name)).drop("block")


def _score(pairs: DataFrame, dim: int, best: int) -> DataFrame:
    """(query, rep, square): for each row's ``queries`` the ``best`` of its ``index`` by exact squared distance."""

    def unpack(value) -> tuple[np.ndarray, np.ndarray]:
        reps, packed = value.values.field("rep"), value.values.field("packed")
        data = np.frombuffer(b"".join(packed.to_pylist()), dtype=np.float64).reshape(-1, dim)
        return reps.to_numpy(), data

    def run(batches):
        for batch in batches:
            for left, right in zip(batch.column("queries"), batch.column("index")):
                (queries, a), (reps, b) = unpack(left), unpack(right)
                rough = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
                if rough.shape[1] > best:
                    edge = np.partition(rough, best - 1, axis=1)[:, best - 1]
                    scale = (a**2).sum(axis=1) + (b**2).sum(axis=1).max()
                    at, to = np.nonzero(rough <= (edge + 1e-9 * scale)[:, None])  # whatever rounding may have moved
                else:
                    at, to = (side.ravel() for side in np.indices(rough.shape))
                square = ((a[at] - b[to]) ** 2).sum(axis=1)
                order = np.lexsort((reps[to], square, at))
                at, to, square = at[order], to[order], square[order]
                first = np.searchsorted(at, at)
                kept = np.arange(len(at)) - first < best
                yield pa.RecordBatch.from_arrays([pa.array(queries[at[kept]]), pa.array(reps[to[kept]]), pa.array(square[kept])], names=["query", "rep", "square"])

    return pairs.select("queries", "index").mapInArrow(run, "query long, rep long, square double")


def search(
    vectors: DataFrame, is_query, neighbours: int = 10, key: str = "vec_id", vector: str = "embedding", tables: int = 8, functions: int = 6, width: float = 2.0, probes: int = 24
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row for which ``is_query`` (of its column ``key``) holds, the nearest others found.

    ``score`` is the Euclidean distance in double precision, equal ones go by key. ``width`` is in units of
    the vectors' root mean square distance to their mean. A query whose probes meet fewer than
    ``neighbours`` others is compared with all rows, so a list is short only if there are no more rows.
    Unusable vectors (see ``usable``) and those not of the commonest length take no part. Keys name
    rows: of rows of one key the least vector counts.
    """
    valid = written(usable(vectors, key, vector))
    top = valid.groupBy("dim").count().orderBy(F.desc("count"), "dim").first()
    dim = top["dim"] if top else 1
    valid = valid.filter(F.col("dim") == dim).groupBy("key").agg(F.min("vector").alias("vector"))
    # only the smallest keys of equal vectors can be among the nearest; one more, as a query isn't its own neighbour
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("key"))
    members = valid.select("vector", "key").withColumn("_rank", rank).filter(F.col("_rank") <= neighbours + 1)
    classes = written(members.groupBy("vector").agg(F.min("key").alias("rep"), F.sort_array(F.collect_list("key")).alias("keys")))
    asked = valid.filter(is_query).select("vector", F.col("key").alias("query_id"))
    named = written(asked.join(classes.select("vector", "rep"), "vector").select("query_id", "rep"))
    queries = classes.join(named.select("rep").distinct(), "rep", "left_semi").select("rep", "vector")
    grid = Grid(dim, tables, functions, width * radius(valid, dim))
    best = neighbours + 1
    index = _blocks(_in_cells(classes, dim, grid, None), INDEX_BLOCK, "index")
    probing = _blocks(_in_cells(queries, dim, grid, probes), QUERY_BLOCK, "queries")
    found = written(_nearest(_score(probing.join(index, ["cell_table", "cell"]), dim, best), best))
    result = written(_expanded(found, named, classes, neighbours))
    short = result.groupBy("query_id").agg(F.max("rank").alias("n"))
    missing = written(named.join(short, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < neighbours).select("query_id", "rep"))
    if missing.isEmpty():
        return result
    again = classes.join(missing.select("rep").distinct(), "rep", "left_semi").select("rep", "vector")
    whole = _all_pairs(again, classes, dim)
    exact = _expanded(_nearest(_score(whole, dim, best), best), missing, classes, neighbours)
    return result.join(missing, "query_id", "left_anti").unionByName(exact)


def _nearest(scored: DataFrame, best: int) -> DataFrame:
    distinct = scored.groupBy("query", "rep").agg(F.min("square").alias("square"))
    order = Window.partitionBy("query").orderBy("square", "rep")
    return distinct.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= best).drop("_rank")


def _expanded(found: DataFrame, named: DataFrame, classes: DataFrame, neighbours: int) -> DataFrame:
    """From classes back to rows: every query of a class, every kept key of the classes found."""
    keys = classes.select("rep", F.col("keys"))
    rows = found.join(keys, "rep").select(F.col("query").alias("rep"), F.explode("keys").alias("vec_id"), "square").join(named, "rep")
    order = Window.partitionBy("query_id").orderBy("square", "vec_id")
    ranked = rows.filter("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours)
    return ranked.select("query_id", "rank", "vec_id", F.sqrt("square").alias("score"))


def _all_pairs(queries: DataFrame, classes: DataFrame, dim: int) -> DataFrame:
    """Blocks of ``queries`` with blocks of all vectors: for the stated queries that hashing leaves short only."""
    pack = Grid(dim, 1, 1, math.inf)
    left = _blocks(_in_cells(queries, dim, pack, None).withColumn("cell", F.lit(0)), QUERY_BLOCK, "queries")
    right = _blocks(_in_cells(classes, dim, pack, None).withColumn("cell", F.lit(0)), INDEX_BLOCK, "index")
    return left.join(right, ["cell_table", "cell"])
