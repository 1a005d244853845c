"""SimHash near-duplicates: pivot distance tables over fingerprints, links as connected components.

The Hamming distance of two fingerprints is at least the difference of their distances to any third one.
So each fingerprint gets a row of distances to fixed reference fingerprints, a pair whose rows differ by
more than the threshold anywhere is discarded, and survivors are compared bit by bit. Reference distances
alone don't narrow a join down (on random 64-bit values they all lie near 32), so pairs come from cells: of
``parts`` stretches of bits, all but ``distance`` are equal in a linked pair. Inside a cell fingerprints are
ordered by their distance to the first reference, which bounds how far each has to look.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themeloom.llm.common import written
from themeloom.llm.components import components

BITS = 64
SEED = 42
#: Rows of a cell that one task compares with one another; larger cells are dealt out by pairs of blocks.
BLOCK = 512
REFERENCES = [xxhash.xxh64_intdigest(b"reference %d" % i, SEED) for i in range(24)]


def fingerprint(text: str, shingle: int = 3) -> int:
    """SimHash of the word shingles of ``text``, ASCII letters in lower case; 0 without words."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line = b" ".join(words)
        ends = list(accumulate(len(word) + 1 for word in words))
        begins = [0, *ends]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[b : e - 1], SEED) for b, e in zip(begins, ends[shingle - 1 :])]
    values, ones = np.array(hashes, dtype="<u8"), np.zeros(BITS, dtype=np.int64)
    for begin in range(0, len(values), 1 << 15):
        part = values[begin : begin + (1 << 15)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    return int(np.packbits(2 * ones > len(values), bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", out: str = "fp", shingle: int = 3) -> DataFrame:
    """Add ``out``: the fingerprint as a signed 64-bit number. Null texts count as empty."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(value.as_py() or "", shingle) for value in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(out, of(F.col(text)))


def links(fps: DataFrame, distance: int = 3, parts: int = 5) -> DataFrame:
    """Edges (a, b) that connect exactly what pairs of ``fps.fp`` at ``distance`` or fewer bits connect.

    ``fp`` should be distinct. Each compared block returns a spanning forest of its pairs, not the pairs.
    """
    if not distance < parts <= BITS:
        raise ValueError("parts must exceed distance")
    bounds = [BITS * i // parts for i in range(parts + 1)]
    keys = []
    for number, equal in enumerate(combinations(range(parts), parts - distance)):
        key = F.lit(number).cast("long")
        for part in equal:
            width = bounds[part + 1] - bounds[part]
            bits = F.shiftrightunsigned("fp", bounds[part]).bitwiseAND(F.lit((1 << width) - 1))
            key = F.shiftleft(key, width).bitwiseOR(bits) if width * len(equal) < 48 else F.xxhash64(key, bits)
        keys.append(key)
    cells = fps.select("fp", F.explode(F.array(*keys)).alias("cell"))
    crowded = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    cells = cells.join(crowded, "cell").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    cells = cells.select("cell", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    first = F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(REFERENCES[0]))))
    cells = cells.select("cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp", first.alias("near"))
    cells = cells.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "near")

    def compare(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            data = {name: table.column(name).to_numpy() for name in ("cell", "i", "j", "own", "fp", "near")}
            if held is not None:
                data = {name: np.concatenate([held[name], data[name]]) for name in data}
            if not len(data["fp"]):
                continue
            last = (data["cell"] == data["cell"][-1]) & (data["i"] == data["i"][-1]) & (data["j"] == data["j"][-1])
            cut = int(np.argmax(last))  # the last group may go on in the next batch
            held = {name: values[cut:] for name, values in data.items()}
            yield from _forest({name: values[:cut] for name, values in data.items()}, distance)
        if held is not None:
            yield from _forest(held, distance)

    return cells.mapInArrow(compare, "a long, b long").distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _forest(rows: dict[str, np.ndarray], distance: int):
    """Edges that span the linked fingerprints among ``rows``, which are in order of cell, blocks and first distance."""
    n = len(rows["fp"])
    if n < 2:
        return
    fp = rows["fp"].view(np.uint64)
    table = np.stack([np.bitwise_count(fp ^ np.uint64(r)) for r in REFERENCES], axis=1).astype(np.int8)
    begins = np.flatnonzero(np.r_[True, (rows["cell"][1:] != rows["cell"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])])
    end = np.repeat(np.r_[begins[1:], n], np.diff(np.r_[begins, n]))
    at, found = np.arange(n), []
    step = 0
    while True:
        step += 1
        at = at[at + step < end[at]]
        at = at[table[at + step, 0] - table[at, 0] <= distance]
        if not len(at):
            break
        left, right = at, at + step
        apart = (rows["i"][left] == rows["j"][left]) | (rows["own"][left] != rows["own"][right])
        left, right = left[apart], right[apart]
        near = np.abs(table[left] - table[right]).max(axis=1, initial=0) <= distance
        left, right = left[near], right[near]
        linked = np.bitwise_count(fp[left] ^ fp[right]) <= distance
        found.append((left[linked], right[linked]))
    left, right = (np.concatenate(side) for side in zip(*found)) if found else (at, at)
    if not len(left):
        return
    # least label over links; labels are places, so groups stay apart
    label = np.arange(n)
    while True:
        low = np.minimum(label[left], label[right])
        following = label.copy()
        np.minimum.at(following, left, low)
        np.minimum.at(following, right, low)
        following = following[following]
        if (following == label).all():
            break
        label = following
    node = np.flatnonzero(label != np.arange(n))
    pairs = np.unique(np.stack([rows["fp"][node], rows["fp"][label[node]]], axis=1), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """(``key``, body, fp, root, component_id) for each row: the least key that links reach from it.

    ``body`` is a hash of the text and ``root`` the least fingerprint of the component. Equal texts have
    equal fingerprints and are compared once. Texts without words share fingerprint 0 and link like any
    other. A null key is never the least one; a component of null keys has a null id.
    """
    marked = with_fingerprint(docs.select(key, text), text, "fp", shingle)
    marked = written(marked.select(key, _body(text).alias("body"), "fp"))
    fps = marked.groupBy("fp").agg(F.min(key).alias("least"))
    roots = components(links(fps.select("fp"), distance)).withColumnRenamed("node", "fp")
    rooted = written(fps.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    classes = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = rooted.join(classes, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select(key, "body", "fp", "root", "component_id")


def _body(text: str):
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", distance: int = 3, shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate component: the least key, null last, then the least text hash."""
    found = near_duplicates(docs, key, text, distance, shingle)
    first = F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col("body").alias("body"))).alias("first")
    staying = found.groupBy("root").agg(first).select(F.col("first.key").alias("_key"), F.col("first.body").alias("_body"))
    marked = docs.withColumn("_own", _body(text))
    met = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_own") == F.col("_body"))
    return marked.join(staying, met, "left_semi").dropDuplicates([key, "_own"]).drop("_own")
