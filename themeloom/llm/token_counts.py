"""Token counts without token ids: pieces are counted once per distinct pre-token and summed per document.

A SentencePiece BPE model merges only into pieces of its vocabulary. Where two neighbouring characters
never stand together in any piece, no merge crosses, and the text can be cut there without changing its
tokens: before a word mark, and around characters that occur in no longer piece. The parts are the
pre-tokens. Documents are read in blocks; a block sends each of its distinct pre-tokens once, with the
documents and frequencies packed. Rows of one pre-token meet in order, its pieces are counted once, and
what goes back to the blocks are sums.
"""

from __future__ import annotations

import os
import re
from collections import Counter, defaultdict
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Word mark of the model, which stands for a space.
MARK = "▁"
#: A block ends after so many distinct pairs of document and pre-token.
BLOCK_PAIRS = 2_000_000
#: Blocks of whose documents a task holds sums before it passes them on.
HELD = 64


class Pieces:
    """A SentencePiece BPE model: cutting texts into pre-tokens and counting a pre-token's pieces."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        model = self.model
        longer = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        longer = [piece for piece in longer if len(piece) > 1]
        if any(MARK in piece.lstrip(MARK) for piece in longer):
            raise ValueError("a piece goes on after a word mark inside it")
        joined = {c for piece in longer for c in piece if c != MARK}
        # runs of marks with the joining characters after them; any other character stands alone
        inner = "".join(re.escape(c) for c in sorted(joined))
        self._cut = re.compile(f"{MARK}+[{inner}]*|[{inner}]+|[^{inner}{MARK}]", re.DOTALL).findall

    def cut(self, text: str) -> list[str]:
        """Pre-tokens of the whole text, as the model reads it: marks for spaces, and one before the text."""
        return self._cut(MARK + text.replace(" ", MARK)) if text else []

    def count(self, parts: list[str]) -> np.ndarray:
        """Number of pieces of each pre-token.

        The library puts a mark before what it encodes: it takes the place of the first mark, or stands
        before a line feed that keeps it apart from what follows; both count one.
        """
        marked = [part.startswith(MARK) for part in parts]
        ids = self.model.encode([part[1:] if own else "\n" + part for part, own in zip(parts, marked)], num_threads=1)
        empty = [own and len(part) == 1 for part, own in zip(parts, marked)]
        return np.array([1 if lone else len(found) - 2 * (not own) for found, own, lone in zip(ids, marked, empty)], dtype=np.int64)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


_ROWS = "part string, block long, docs binary"
#: Documents of a block and times in one entry at most, as both are packed in 16 bits; more times take more entries.
PLACES = 1 << 16
#: Begins the row of a block's documents. No pre-token goes on after this character.
DOCUMENTS = "\0\0"


def _blocks(path: str):
    """Map documents to rows of ``_ROWS``: one per distinct pre-token of a block, and one with the block's documents."""

    def run(batches):
        cut = pieces(path).cut
        number = TaskContext.get().partitionId() << 32
        keys, sizes, found, pairs = [], [], defaultdict(list), 0
        for batch in batches:
            for id_, value in zip(batch.column(0), batch.column(1)):
                words = value.as_py() or ""
                place = len(keys)
                keys.append(id_)
                sizes.append(len(words.encode("utf-8")))
                tally = Counter(cut(words))
                for part, times in tally.items():
                    while times >= PLACES:
                        found[part].append((PLACES - 1) << 16 | place)
                        times -= PLACES - 1
                    found[part].append(times << 16 | place)
                pairs += len(tally)
                if pairs >= BLOCK_PAIRS or len(keys) == PLACES:
                    yield from _rows(number, keys, sizes, found, batch.schema.field(0).type)
                    number, keys, sizes, found, pairs = number + 1, [], [], defaultdict(list), 0
        if keys:
            yield from _rows(number, keys, sizes, found, batch.schema.field(0).type)

    return run


def _rows(block: int, keys: list, sizes: list[int], found: dict[str, list[int]], kind: pa.DataType):
    parts = list(found)
    lengths = np.fromiter(map(len, found.values()), dtype=np.int64, count=len(parts))
    entries = np.fromiter(chain.from_iterable(found.values()), dtype=np.uint32, count=int(lengths.sum()))
    offsets = pa.py_buffer((np.r_[0, np.cumsum(lengths)] * 4).astype(np.int32).tobytes())
    packed = pa.Array.from_buffers(pa.binary(), len(parts), [None, offsets, pa.py_buffer(entries.tobytes())])
    table = pa.RecordBatch.from_arrays([pa.array(parts, pa.string()), pa.array(np.full(len(parts), block)), packed], names=["part", "block", "docs"])
    for begin in range(0, len(parts), 20_000):
        yield table.slice(begin, 20_000)
    sink = pa.BufferOutputStream()
    documents = pa.RecordBatch.from_arrays([pa.array([k.as_py() for k in keys], kind), pa.array(sizes, pa.int64())], names=["key", "size"])
    with pa.ipc.new_stream(sink, documents.schema) as writer:
        writer.write_batch(documents)
    whole = pa.array([sink.getvalue().to_pybytes()], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array([f"{DOCUMENTS}{block}"]), pa.array([block]), whole], names=["part", "block", "docs"])


def _sums(path: str):
    """Map rows in order of pre-token to rows (part null, block, docs): packed places and sums of a block's documents."""

    def run(batches):
        sums = np.zeros(HELD * PLACES, dtype=np.int64)
        held: dict[int, int] = {}
        last, last_count = None, 0
        for batch in batches:
            parts = batch.column("part").to_pylist()
            whole = np.fromiter((part.startswith(DOCUMENTS) for part in parts), dtype=bool, count=len(parts))
            if whole.any():
                yield batch.filter(pa.array(whole))
                batch = batch.filter(pa.array(~whole))
                parts = [part for part in parts if not part.startswith(DOCUMENTS)]
            if not parts:
                continue
            fresh, place = [], []  # each distinct pre-token once: rows of one follow one another
            for part in parts:
                if part != last:
                    fresh.append(part)
                    last = part
                place.append(len(fresh))
            numbers = np.r_[last_count, pieces(path).count(fresh) if fresh else np.array([], dtype=np.int64)]
            last_count = int(numbers[-1])
            blocks, inverse = np.unique(batch.column("block").to_numpy(), return_inverse=True)
            if len(held.keys() | set(blocks.tolist())) > HELD:
                yield from _packed(held, sums)
                held = {}
                sums[:] = 0
            # a batch of many blocks is taken in turns of as many as fit
            for begin in range(0, len(blocks), HELD):
                if begin:
                    yield from _packed(held, sums)
                    held = {}
                    sums[:] = 0
                region = np.array([held.setdefault(b, len(held)) for b in blocks[begin : begin + HELD].tolist()], dtype=np.int64)
                here = np.flatnonzero((inverse >= begin) & (inverse < begin + HELD))
                docs = batch.column("docs").take(pa.array(here))
                lengths = np.diff(np.frombuffer(docs.buffers()[1], dtype=np.int32, count=len(docs) + 1, offset=4 * docs.offset)) // 4
                entries = np.frombuffer(b"".join(docs.to_pylist()), dtype=np.uint32)
                slot = np.repeat(region[inverse[here] - begin] * PLACES, lengths) + (entries & (PLACES - 1))
                np.add.at(sums, slot, (entries >> 16) * np.repeat(numbers[np.array(place)[here]], lengths))
        yield from _packed(held, sums)

    return run


_SUM = np.dtype([("place", "<u4"), ("tokens", "<i8")])


def _packed(held: dict[int, int], sums: np.ndarray):
    rows = {"part": [], "block": [], "docs": []}
    for block, region in held.items():
        own = sums[region * PLACES : (region + 1) * PLACES]
        where = np.flatnonzero(own)
        packed = np.empty(len(where), dtype=_SUM)
        packed["place"], packed["tokens"] = where, own[where]
        rows["part"].append(None)
        rows["block"].append(block)
        rows["docs"].append(packed.tobytes())
    yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("part", pa.string()), ("block", pa.int64()), ("docs", pa.binary())]))


def _documents(batches):
    """Map rows in order of block, its documents first, to (key, n_bytes, n_tokens)."""
    block, documents, tokens = None, None, None

    def counted():
        return pa.RecordBatch.from_arrays([documents.column(0), documents.column(1), pa.array(tokens)], names=["key", "n_bytes", "n_tokens"])

    for batch in batches:
        for at in range(batch.num_rows):
            data = batch.column("docs")[at].as_buffer()
            if (here := batch.column("block")[at].as_py()) != block:
                if block is not None:
                    yield counted()
                block = here
                with pa.ipc.open_stream(data) as reader:
                    documents = reader.read_next_batch()
                tokens = np.zeros(documents.num_rows, dtype=np.int64)
            else:
                sums = np.frombuffer(data, dtype=_SUM)
                tokens[sums["place"]] += sums["tokens"]
    if block is not None:
        yield counted()


def count_tokens(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens) of each row of ``docs``: bytes in UTF-8 and tokens of the whole ``text`` by the
    SentencePiece BPE model at ``path``. Null counts as empty, rows are independent of one another, null and
    repeated keys included; other columns are left out."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    kind = dict(docs.dtypes)[key]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(_blocks(path), _ROWS)
    sums = rows.repartition("part").sortWithinPartitions("part").mapInArrow(_sums(path), _ROWS)
    back = sums.repartition("block").sortWithinPartitions("block", F.col("part").desc_nulls_last())
    return back.mapInArrow(_documents, f"key {kind}, n_bytes long, n_tokens long").withColumnRenamed("key", key)
