"""Quality classifier: a factorisation machine over hashed words, statistics of structure and metadata.

Every feature has a weight and a short vector; a pair of features interacts by the product of its vectors.
The sum over all pairs is half of (square of sums - sum of squares) per factor, so a text is scored in time
linear in its features. The machine is fitted by full gradients over a bounded sample of labelled documents,
packed in blocks once; a round adds the blocks' gradients in slices and the driver sees only the model, whose
size is fixed by its parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import written

#: Bytes of text taken in hand at once. A longer text is cut after the last white space that fits.
PIECE = 1 << 20
#: Documents of the sample in one block.
BLOCK = 1000
SLICES = 8
_KINDS = 10
_OTHER, _SPACE, _LINE, _UPPER, _DIGIT, _SYMBOL, _POINT, _SHOUT, _LEAD, _TAIL = range(_KINDS)


def _kind_table() -> np.ndarray:
    table = np.full(256, _OTHER, dtype=np.int64)
    for kind, chars in ((_SPACE, b" \t\x0b\x0c\r"), (_LINE, b"\n"), (_DIGIT, b"0123456789"), (_SYMBOL, b"#*$%&|<>"), (_POINT, b".,;:?"), (_SHOUT, b"!")):
        table[list(chars)] = kind
    table[65:91], table[128:192], table[192:] = _UPPER, _TAIL, _LEAD
    return table


_KIND = _kind_table()
_LOWER = np.array([b + 32 if 65 <= b < 91 else b for b in range(256)], dtype=np.uint64)
_WEIGHTS = np.random.default_rng(42).integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

#: Statistics of a text; all lie between 0 and about 2.
STATISTICS = [
    "words", "word length", "upper case", "digits", "symbols", "punctuation", "exclamation", "beyond ASCII",
    "white space", "longest word", "different words", "repeated in a row", "lines", "most frequent word",
]
#: What the table says of a text: its length, whether it says so, and how far that is from the length found.
METADATA = ["stated length", "no stated length", "misstated length"]
EXTRA = len(STATISTICS) + len(METADATA)


@dataclass
class _Tally:
    """Counts of consecutive texts: by kind of character, by text; and of words by text and bucket."""

    kinds: np.ndarray
    words: np.ndarray
    longest: np.ndarray
    runs: np.ndarray
    row: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def _tally(raw: np.ndarray, sizes: np.ndarray, buckets: int) -> _Tally:
    n = len(sizes)
    of = np.repeat(np.arange(n), sizes)
    kind = _KIND[raw]
    kinds = np.bincount(of * _KINDS + kind, minlength=n * _KINDS).reshape(n, _KINDS)
    space = (kind == _SPACE) | (kind == _LINE)
    fresh = np.zeros(len(raw) + 1, dtype=bool)
    fresh[np.cumsum(sizes) - sizes] = True
    begin = ~space & (np.r_[True, space[:-1]] | fresh[:-1]) if len(raw) else space
    at, inside = np.flatnonzero(begin), np.flatnonzero(~space)
    if not len(at):
        none = np.empty(0, dtype=np.int64)
        return _Tally(kinds, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), none, none, none)
    place = inside - at[np.cumsum(begin)[inside] - 1]
    first = np.flatnonzero(place == 0)
    value = np.add.reduceat(_LOWER[raw[inside]] * _WEIGHTS[place & 4095], first)
    value = (value ^ (value >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    row, length = of[at], np.diff(np.r_[first, len(inside)])
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, row, length)
    again = (value[1:] == value[:-1]) & (row[1:] == row[:-1])
    pair, count = np.unique(row * buckets + (value >> np.uint64(32)).astype(np.int64) % buckets, return_counts=True)
    runs = np.bincount(row[1:][again], minlength=n)
    return _Tally(kinds, np.bincount(row, minlength=n), longest, runs, pair // buckets, pair % buckets, count)


def _whole_tally(raw: np.ndarray, buckets: int) -> _Tally:
    """The tally of one long text, piece by piece. A word longer than a piece counts as several."""
    total, counts, at = None, np.zeros(buckets, dtype=np.int64), 0
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        if end < len(raw):
            blank = np.flatnonzero(np.isin(_KIND[raw[at:end]], (_SPACE, _LINE)))
            end = at + int(blank[-1]) + 1 if len(blank) else end
        part = _tally(raw[at:end], np.array([end - at]), buckets)
        counts[part.bucket] += part.count
        if total is None:
            total = part
        else:
            total.kinds += part.kinds
            total.words += part.words
            total.runs += part.runs
            total.longest = np.maximum(total.longest, part.longest)
        at = end
    total.bucket = np.flatnonzero(counts)
    total.row, total.count = np.zeros(len(total.bucket), dtype=np.int64), counts[total.bucket]
    return total


@dataclass
class Features:
    """Sparse features of ``n`` consecutive texts."""

    n: int
    row: np.ndarray
    index: np.ndarray
    value: np.ndarray


def _features(tally: _Tally, stated: np.ndarray, buckets: int) -> Features:
    """Word features have length 1 together; ``stated`` is NaN where the table gives no length."""
    n, kinds, words = len(tally.words), tally.kinds, tally.words
    value = np.log1p(tally.count)
    norm = np.sqrt(np.bincount(tally.row, value * value, minlength=n))
    value = value / norm[tally.row]
    size = np.maximum(kinds.sum(axis=1), 1)
    share = lambda *which: np.sqrt(kinds[:, which].sum(axis=1) / size)
    some = np.maximum(words, 1)
    different = np.bincount(tally.row, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, tally.row, tally.count)
    visible = kinds.sum(axis=1) - kinds[:, _SPACE] - kinds[:, _LINE]
    length = np.log1p(kinds.sum(axis=1) - kinds[:, _TAIL])
    said = np.log1p(np.maximum(np.nan_to_num(stated, nan=0.0), 0.0))
    missing = np.isnan(stated)
    dense = np.stack(
        [
            np.log1p(words) / 8, np.minimum(visible / some / 10, 2.0), share(_UPPER), share(_DIGIT), share(_SYMBOL), share(_POINT), share(_SHOUT),
            share(_LEAD, _TAIL), share(_SPACE, _LINE), np.log1p(tally.longest) / 8, different / some, np.sqrt(tally.runs / some),
            np.sqrt(np.minimum((kinds[:, _LINE] + 1) / some, 1.0)), np.sqrt(most / some),
            said / 10, missing.astype(float), np.where(missing, 0.0, np.minimum(np.abs(said - length), 2.0)),
        ],
        axis=1,
    )
    row = np.concatenate([tally.row, np.repeat(np.arange(n), EXTRA)])
    index = np.concatenate([tally.bucket, np.tile(np.arange(buckets, buckets + EXTRA), n)])
    return Features(n, row, index, np.concatenate([value, dense.ravel()]))


def features(texts: pa.Array, stated: pa.Array, buckets: int) -> Iterator[Features]:
    """Features of all ``texts`` in order, so many texts at a time as fit a piece. Null texts count as empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    lengths = pc.cast(stated, pa.float64()).to_numpy(zero_copy_only=False)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if ends is not None else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
        part = raw[ends[at] : ends[end]]
        tally = _tally(part, np.diff(ends[at : end + 1]), buckets) if len(part) <= PIECE else _whole_tally(part, buckets)
        yield _features(tally, lengths[at:end], buckets)
        at = end


@dataclass
class Machine:
    """Bias, and per feature a weight (column 0) and a vector (the other columns)."""

    bias: float
    table: np.ndarray

    def sums(self, x: Features) -> tuple[np.ndarray, np.ndarray]:
        """Raw score of each text, and per text and factor the sum of value times component."""
        own = self.table[x.index] * x.value[:, None]
        linear = np.bincount(x.row, own[:, 0], minlength=x.n)
        sums = np.stack([np.bincount(x.row, own[:, f], minlength=x.n) for f in range(1, own.shape[1])], axis=1)
        squares = np.bincount(x.row, (own[:, 1:] ** 2).sum(axis=1), minlength=x.n)
        return self.bias + linear + 0.5 * ((sums**2).sum(axis=1) - squares), sums

    def score(self, x: Features) -> np.ndarray:
        return _logistic(self.sums(x)[0])

    def gradient(self, x: Features, label: np.ndarray) -> tuple[float, np.ndarray]:
        """Of the log loss, summed over the texts."""
        raw, sums = self.sums(x)
        wrong = _logistic(raw) - label
        push = wrong[x.row] * x.value
        parts = [np.bincount(x.index, push, minlength=len(self.table))]
        for f in range(1, self.table.shape[1]):
            pull = sums[x.row, f - 1] - self.table[x.index, f] * x.value
            parts.append(np.bincount(x.index, push * pull, minlength=len(self.table)))
        return float(wrong.sum()), np.stack(parts, axis=1)


def _logistic(raw: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(raw, -30.0, 30.0)))


def checksum_share(key: Column, parts: int) -> Column:
    """CRC-32 of the key as decimal text, modulo ``parts``; null for null."""
    return F.crc32(key.cast("string").cast("binary")) % parts


def sample(docs: DataFrame, labels: DataFrame, allowed: Column, key: str, label: str, text: str, stated: str, most: int, buckets: int) -> DataFrame:
    """(block, data): packed features and labels of at most ``most`` documents with a label of 0 or 1.

    Keys with contradictory labels are passed over. Among the others those with the least hash are taken;
    of rows with the same key, the one with the least features.
    """
    known = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).filter(allowed).groupBy("key").agg(F.min("label").alias("label"), F.max("label").alias("other"))
    known = known.filter("label = other AND label IN (0, 1)").select("key", F.col("label").cast("int").alias("label"))
    chosen = written(known.orderBy(F.xxhash64("key"), "key").limit(most))
    kind = dict(chosen.dtypes)["key"]
    # at most `most` rows of a key and a label
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(stated).cast("double").alias("stated")).join(F.broadcast(chosen), "key")

    def pack(batches):
        for batch in batches:
            data = []
            for x in features(batch.column("text"), batch.column("stated"), buckets):
                ends = np.searchsorted(x.row[: len(x.row) - x.n * EXTRA], np.arange(x.n + 1))
                words, dense = len(x.row) - x.n * EXTRA, x.value[len(x.row) - x.n * EXTRA :].reshape(x.n, EXTRA)
                for place in range(x.n):
                    part = slice(ends[place], min(ends[place + 1], words))
                    index = np.r_[x.index[part], np.arange(buckets, buckets + EXTRA)].astype("<i4")
                    data.append(index.tobytes() + np.r_[x.value[part], dense[place]].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("label"), pa.array(data, pa.binary())], names=["key", "label", "data"])

    found = rows.select("key", "label", "text", "stated").mapInArrow(pack, f"key {kind}, label int, data binary")
    single = written(found.groupBy("key").agg(F.min(F.struct("data", "label")).alias("_")).select("key", "_.label", "_.data"))
    blocks = max(1, -(-most // BLOCK))

    def join(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("key")
        return pd.DataFrame({"block": group["block"].iloc[:1], "labels": [group["label"].tolist()], "data": [group["data"].tolist()]})

    dealt = single.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))
    return written(dealt.groupBy("block").applyInPandas(join, "block int, labels array<int>, data array<binary>"))


def _unpacked(data: list[bytes]) -> Features:
    sizes = [len(one) // 8 for one in data]
    index = np.concatenate([np.frombuffer(one, "<i4", size) for one, size in zip(data, sizes)])
    value = np.concatenate([np.frombuffer(one, "<f4", size, 4 * size) for one, size in zip(data, sizes)])
    return Features(len(data), np.repeat(np.arange(len(data)), sizes), index.astype(np.int64), value.astype(np.float64))


def _round(blocks: DataFrame, machine: Machine) -> tuple[int, float, np.ndarray]:
    """Documents, bias gradient and gradient, summed over all blocks in order of their numbers."""
    size = -(-len(machine.table) // SLICES)

    def gradients(batches):
        for batch in batches:
            for block, labels, data in zip(*(batch.column(name).to_pylist() for name in ("block", "labels", "data"))):
                bias, table = machine.gradient(_unpacked(data), np.array(labels, dtype=np.float64))
                parts = [table[at : at + size].tobytes() for at in range(0, len(table), size)]
                n = len(parts)
                columns = [range(n), [block] * n, [len(labels)] * n, [bias] * n, parts]
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["slice", "block", "n", "bias", "part"])

    def add(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        total = sum(np.frombuffer(part) for part in group["part"])
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "n": [group["n"].sum()], "bias": [group["bias"].sum()], "part": [total.tobytes()]})

    sent = blocks.mapInArrow(gradients, "slice int, block int, n long, bias double, part binary")
    rows = sorted(sent.groupBy("slice").applyInPandas(add, "slice int, n long, bias double, part binary").collect())
    if not rows:
        return 0, 0.0, np.zeros_like(machine.table)
    table = np.concatenate([np.frombuffer(row["part"]) for row in rows]).reshape(machine.table.shape)
    return rows[0]["n"], rows[0]["bias"], table


def fit(blocks: DataFrame, buckets: int, factors: int = 8, rounds: int = 40, rate: float = 0.1, decay: float = 1e-5, seed: int = 42) -> Machine:
    """A machine by ``rounds`` full gradients with adaptive moments. Without documents it scores 0.5 throughout."""
    start = np.random.default_rng(seed).normal(0.0, 0.05, (buckets + EXTRA, factors + 1))
    start[:, 0] = 0.0
    machine = Machine(0.0, start)
    mean, spread = np.zeros(start.size + 1), np.zeros(start.size + 1)
    for turn in range(1, rounds + 1):
        n, bias, table = _round(blocks, machine)
        if not n:
            return Machine(0.0, np.zeros_like(start))
        slope = np.r_[bias / n, (table / n + decay * machine.table).ravel()]
        mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
        step = rate * (mean / (1 - 0.9**turn)) / (np.sqrt(spread / (1 - 0.99**turn)) + 1e-8)
        machine = Machine(machine.bias - step[0], machine.table - step[1:].reshape(start.shape))
    return machine


def with_score(docs: DataFrame, machine: Machine, buckets: int, text: str = "text", stated: str = "n_chars", out: str = "score") -> DataFrame:
    """``docs`` with ``out``: the chance, 0 to 1, that the label is 1. Whole texts are read; null ones count as empty."""

    @F.arrow_udf("double")
    def of(texts: pa.Array, lengths: pa.Array) -> pa.Array:
        scores = [machine.score(x) for x in features(texts, lengths, buckets)]
        return pa.array(np.concatenate(scores) if scores else np.empty(0))

    return docs.withColumn(out, of(F.col(text), F.col(stated).cast("double")))


def classify(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", text: str = "text", stated: str = "n_chars",
    folds: int = 5, threshold: float = 0.3, most: int = 20_000, buckets: int = 1 << 14, factors: int = 8, rounds: int = 40,
) -> DataFrame:
    """``key``, held_out, score and predicted (1 from ``threshold`` on) for each row of ``docs``.

    Rows whose checksum of the key is divisible by ``folds`` are held out: their labels are never read, nor
    are those of null keys. At most ``most`` documents are learned from (see ``sample``). Inputs of a score
    are the text and the length that the table states. Repeated rows get the same score; rows without
    words are scored by their statistics; with no usable label every score is 0.5. Other columns don't matter.
    """
    learned = F.coalesce(checksum_share(F.col("key"), folds) != 0, F.lit(False))
    machine = fit(sample(docs, labels, learned, key, label, text, stated, most, buckets), buckets, factors, rounds)
    held_out = F.coalesce(checksum_share(F.col("_key"), folds) == 0, F.lit(True))
    scored = with_score(docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(stated).alias("_stated")), machine, buckets, "_text", "_stated", "_score")
    return scored.select(F.col("_key").alias(key), held_out.alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"))
