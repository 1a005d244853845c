"""Small helpers shared by the operators: input tables, intermediate tables and the definition of a word."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.session import cut_lineage

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_list(text: str) -> list[bytes]:
    """The words of ``text`` in UTF-8; ``bytes.split`` parts at exactly the white space that ``WORD`` excludes."""
    return text.encode("utf-8").split()


#: Bytes of text taken in hand at once by the functions below.
PIECE = 1 << 20
_WEIGHTS = np.random.default_rng(42).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Bytes of words that are hashed together, byte by byte; what a byte adds there.
SHORT = 24
_TERMS = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _WEIGHTS[:SHORT, None]


def mixed(values: np.ndarray) -> np.ndarray:
    """64-bit numbers with their bits spread."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return values ^ (values >> np.uint64(29))


def runs_hash(values: np.ndarray, begins: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A hash of each run of ``values``; runs begin at ``begins``, ``place`` counts from 0 in each."""
    return mixed(np.add.reduceat(values * _WEIGHTS[place & 4095], begins))


def _space(raw: np.ndarray) -> np.ndarray:
    """Which bytes are white space; comparing takes a fraction of looking up."""
    return (raw - np.uint8(9) < 5) | (raw == 32)


def word_hashes(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, first byte, end and hash of every word of consecutive texts of ``sizes`` bytes in ``raw``."""
    space = _space(raw)
    edge = np.zeros(len(raw) + 1, dtype=bool)  # between two bytes that no word spans
    edge[0] = edge[-1] = True
    edge[1:-1] = space[:-1] | space[1:]
    edge[np.cumsum(sizes)] = True
    at, stop = np.flatnonzero(~space & edge[:-1]), np.flatnonzero(~space & edge[1:]) + 1
    if not len(at):
        return at, at, at, np.empty(0, dtype=np.uint64)
    length = stop - at
    value = np.empty(len(at), dtype=np.uint64)
    order = np.argsort(-np.minimum(length, SHORT + 1).astype(np.int8), kind="stable")  # longest first
    n_long, begin = int((length > SHORT).sum()), at[order]
    counts = len(at) - np.cumsum(np.bincount(np.minimum(length, SHORT + 1)))  # words of more than so many bytes
    sums = np.zeros(len(at), dtype=np.uint64)
    for place, n in enumerate(counts[:SHORT].tolist()):
        sums[n_long:n] += _TERMS[place][raw[begin[n_long:n] + place]]
    value[order] = mixed(sums)
    if n_long:
        long = order[:n_long]
        first = np.cumsum(length[long]) - length[long]
        place = np.arange(int(length[long].sum())) - np.repeat(first, length[long])
        value[long] = runs_hash(raw[np.repeat(at[long], length[long]) + place].astype(np.uint64) + np.uint64(1), first, place)
    return np.searchsorted(np.cumsum(sizes), at, side="right"), at, stop, value


def text_pieces(texts: pa.Array, whole: Callable, cut: Callable) -> Iterator:
    """``whole(raw, sizes)`` for runs of texts that fit a piece, in order; null texts count as empty.

    A longer text goes to ``cut`` as a list of its pieces, which end after the last line end in them, else
    after the last white space, else anywhere.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
        part = raw[ends[at] : ends[end]]
        if len(part) <= PIECE:
            yield whole(part, np.diff(ends[at : end + 1]))
        else:
            yield cut(list(_pieces(part)))
        at = end


def _pieces(raw: np.ndarray) -> Iterator[np.ndarray]:
    at = 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            for stops in (raw[at:end] == 10, _space(raw[at:end])):
                found = np.flatnonzero(stops)
                if len(found):
                    end = at + int(found[-1]) + 1
                    break
        yield raw[at:end]
        at = end


def word_count(text: Column) -> Column:
    """Number of words, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared checkpoint folder: later reads don't repeat its work, and survive lost executors."""
    return cut_lineage(df)


def rows_to_arrow(df: DataFrame, columns: list[str], schema: str, emit: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """Map Arrow batches of ``columns`` through ``emit``, from lists by column to lists by column of ``schema``."""
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches):
        target = None
        for batch in batches:
            out = emit({name: batch.column(name).to_pylist() for name in columns})
            target = target or pa.schema([(n, _arrow_types(schema)[n]) for n in names])
            yield pa.RecordBatch.from_pydict({n: out[n] for n in names}, schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def _arrow_types(schema: str) -> dict[str, pa.DataType]:
    known = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_(),
        "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()),
    }
    return {name: known[kind] for name, kind in (part.strip().split(" ", 1) for part in schema.split(","))}
