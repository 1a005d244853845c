"""Lloyd's clustering with the vectors' columns dealt out to shards, in whole numbers throughout.

Vectors are packed in chunks, a chunk in column blocks. For a block its task works out the exact part of each
squared distance that its columns add, against its slice of the centroids. Parts are summed by chunk, which
gives the nearest centroid of every vector; these labels go back to the blocks, and each shard adds up its own
columns by cluster and updates its own slice. What moves are parts of distances, labels and packed blocks,
and per task one row per column and cluster; the driver sees the centroids alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import written

#: Whole components beyond this count as this, so that distances fit 64 bits.
FAR = 1 << 24


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as they need, after one byte that says how many."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    width = next(w for w in (1, 2, 4, 8) if -(1 << 8 * w - 1) <= low and high < 1 << 8 * w - 1)
    return bytes([width]) + values.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).astype(np.int64).reshape(-1, columns)


def whole_numbers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of double x, within ``FAR``."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -FAR, FAR).astype(np.int64)


def usable(vectors: DataFrame, embedding: str, dims: int) -> DataFrame:
    """Rows whose vector has exactly ``dims`` components, none of them null or non-finite."""
    finite = F.forall(F.col(embedding), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return vectors.filter(F.coalesce((F.size(embedding) == dims) & finite, F.lit(False)))


def blocks(vectors: DataFrame, key: str, embedding: str, dims: int, scale: int, width: int, rows: int) -> DataFrame:
    """(chunk, shard, data, keys): up to ``rows`` vectors by ``width`` columns each; shard 0 also has the keys."""
    kind = dict(vectors.dtypes)[key]

    def run(batches):
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for begin in range(0, batch.num_rows, rows):
                part = batch.slice(begin, rows)
                flat = part.column(1).flatten().to_numpy(zero_copy_only=False)
                values = whole_numbers(flat.reshape(part.num_rows, dims), scale)
                slices = [_packed(values[:, at : at + width]) for at in range(0, dims, width)]
                n, keys = len(slices), part.column(0)
                held = pa.ListArray.from_arrays(pa.array([0] + [len(keys)] * n, pa.int32()), keys)
                columns = [pa.array([chunk] * n, pa.int64()), pa.array(range(n), pa.int32()), pa.array(slices, pa.binary()), held]
                yield pa.RecordBatch.from_arrays(columns, names=["chunk", "shard", "data", "keys"])
                chunk += 1

    return vectors.select(key, embedding).mapInArrow(run, f"chunk long, shard int, data binary, keys array<{kind}>")


def first_centroids(vectors: DataFrame, key: str, embedding: str, k: int, scale: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the least SHA-256 of ``seed:key``, ties by components; fewer if there are fewer."""
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256)
    found = vectors.select(drawn.alias("drawn"), F.col(embedding).alias("vector")).orderBy("drawn", "vector").limit(k).collect()
    return whole_numbers(np.array([row["vector"] for row in found]), scale) if found else np.empty((0, 0), dtype=np.int64)


def _part(values: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances over the given columns, exact: by products of doubles where these can hold them."""
    most = int(np.abs(values).max(initial=0)) + int(np.abs(centroids).max(initial=0))
    kind = np.float64 if most * most * values.shape[1] < 1 << 52 else np.int64
    values, centroids = values.astype(kind), centroids.astype(kind)
    parts = (values * values).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1)[None, :] - 2 * (values @ centroids.T)
    return parts.astype(np.int64)


def _assigned(packed: DataFrame, centroids: np.ndarray, width: int, with_keys: bool) -> DataFrame:
    """(chunk, labels, distances, keys) in packed form, the latter two only ``with_keys``: nearest centroid, ties to the smaller."""
    k = len(centroids)
    kind = dict(packed.dtypes)["keys"]

    def parts(batches):
        for batch in batches:
            out = []
            for shard, data in zip(batch.column("shard").to_pylist(), batch.column("data")):
                part = centroids[:, shard * width : (shard + 1) * width]
                out.append(_packed(_part(_unpacked(data.as_py(), part.shape[1]), part)))
            columns = [batch.column("chunk"), pa.array(out, pa.binary())] + ([batch.column("keys")] if with_keys else [])
            yield pa.RecordBatch.from_arrays(columns, names=["chunk", "part", "keys"][: len(columns)])

    def nearest(group: pd.DataFrame) -> pd.DataFrame:  # a chunk: one row per shard
        total = sum(_unpacked(part, k) for part in group["part"])
        labels = total.argmin(axis=1)
        if not with_keys:
            return pd.DataFrame({"chunk": group["chunk"].iloc[:1], "labels": [_packed(labels)]})
        keys = next(keys for keys in group["keys"] if keys is not None and len(keys))
        return pd.DataFrame({"keys": [keys], "labels": [labels], "distances": [total[np.arange(len(total)), labels]]})

    columns = ["chunk", "shard", "data"] + (["keys"] if with_keys else [])
    sent = packed.select(*columns).mapInArrow(parts, "chunk long, part binary" + (f", keys {kind}" if with_keys else ""))
    schema = f"keys {kind}, labels array<int>, distances array<long>" if with_keys else "chunk long, labels binary"
    return sent.groupBy("chunk").applyInPandas(nearest, schema)


def _moved(packed: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
    """Centroids after one round: the floored mean of each one's vectors, those without any as they were."""
    k = len(centroids)
    met = packed.select("chunk", "shard", "data").join(_assigned(packed, centroids, width, False), "chunk").select("shard", "data", "labels")

    def sums(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for shard, data, labels in zip(*(batch.column(name).to_pylist() for name in ("shard", "data", "labels"))):
                columns = centroids[:, shard * width : (shard + 1) * width].shape[1]
                values, labels = _unpacked(data, columns), _unpacked(labels, 1)[:, 0]
                total, count = held.setdefault(shard, (np.zeros((k, columns), np.int64), np.zeros(k, np.int64)))
                order = np.argsort(labels, kind="stable")
                found, begins, counts = np.unique(labels[order], return_index=True, return_counts=True)
                total[found] += np.add.reduceat(values[order], begins, axis=0)
                count[found] += counts
        for shard, (total, count) in sorted(held.items()):
            cluster, column = np.nonzero(np.broadcast_to(count[:, None] > 0, total.shape))
            parts = [cluster.astype(np.int32), (column + shard * width).astype(np.int32), total[cluster, column], count[cluster]]
            yield pa.RecordBatch.from_arrays([pa.array(part) for part in parts], names=["cluster", "col", "total", "members"])

    added = met.mapInArrow(sums, "cluster int, col int, total long, members long").groupBy("cluster", "col").agg(F.sum("total").alias("total"), F.sum("members").alias("members"))
    slices = added.select("cluster", "col", F.expr("(total - pmod(total, members)) div members").alias("value")).collect()
    following = centroids.copy()
    for row in slices:  # one row per cluster and column
        following[row["cluster"], row["col"]] = row["value"]
    return following


def cluster(
    vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", k: int = 16, rounds: int = 3,
    dims: int = 64, scale: int = 64, seed: int = 1, width: int = 16, rows: int = 1024,
) -> DataFrame:
    """Nearest of ``k`` centroids for every usable vector after ``rounds`` rounds.

    Returns ``key``, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256 (of the
    centroid's components, decimal and comma-joined). Vectors that are null, of another length than ``dims``
    or hold null or non-finite components have no row. Components become floor(``scale`` * x); beyond
    ``FAR`` they count as that. With fewer than ``k`` vectors there are as many centroids as vectors, and
    without any there are no rows. Repeated rows count each; null keys are keys like others. Sums beyond
    64 bits are null. Only ``key`` and ``embedding`` are read.
    """
    kept = usable(vectors.select(key, embedding), embedding, dims)
    packed = written(blocks(kept, key, embedding, dims, scale, width, rows))
    centroids = first_centroids(kept, key, embedding, k, scale, seed)
    kind = dict(vectors.dtypes)[key]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(centroids):
        nothing = vectors.sparkSession.createDataFrame([], f"_key {kind}, distance long, {schema}")
        return nothing.select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    for _ in range(rounds):
        centroids = _moved(packed, centroids, width)
    found = _assigned(packed, centroids, width, True)
    each = F.inline(F.arrays_zip(F.col("keys").alias("_key"), F.col("labels").alias("cluster"), F.col("distances").alias("distance")))
    assigned = written(found.select(each))
    sums = {row[0]: int(row[1]) for row in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda total: total if total < 1 << 63 else None
    digest = lambda centroid: hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
    facts = [(c, fits(total), fits(sum(sums.values())), digest(centroids[c])) for c, total in sorted(sums.items())]
    known = vectors.sparkSession.createDataFrame(facts, schema)
    # at most k rows
    out = assigned.join(F.broadcast(known), "cluster")
    return out.select(F.col("_key").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
