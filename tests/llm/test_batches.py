"""What Python workers hold of the texts is bounded, and what is done for many pairs at once is done as for one."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from themeloom.llm import bpe, common, winnow
from themeloom.llm.common import mixed, runs_hash, word_hashes


@pytest.mark.parametrize("stage", ["quality", "line_dedup"])
def test_stages_pass_texts_on_in_short_batches(spark, stage):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        rows = [(i, f"a{i} b", "en", "s", 5) for i in range(30)]
        dict(corpus_pipeline.STAGES)[stage](spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "")

        @F.arrow_udf("long")
        def held(texts: pa.Array) -> pa.Array:
            return pa.array([texts.nbytes] * len(texts), pa.int64())

        long = spark.range(40, numPartitions=1).select(F.repeat(F.lit("w "), 1 << 18).alias("text"))
        assert long.agg(F.max(held("text"))).first()[0] < 10 << 20
    finally:
        spark.conf.set(name, before)


@pytest.mark.parametrize("few,far,heavy", [(winnow.FEW, winnow.FAR, winnow.HEAVY), (0, 2, 1 << 22), (0, 3, 40), (1 << 30, 1, 1 << 30), (0, 1 << 20, 0)])
def test_many_pairs_are_extended_as_one(monkeypatch, few, far, heavy):
    for name, value in (("FEW", few), ("FAR", far), ("HEAVY", heavy)):
        monkeypatch.setattr(winnow, name, value)
    rng = np.random.default_rng(few + far)
    parts = []
    for number in range(120):
        own = rng.integers(0, 2 + number % 4, rng.integers(0, 60)).astype(np.int32)
        alone = bool(number % 3 == 0)
        theirs = own if alone else np.r_[rng.integers(0, 4, rng.integers(0, 9)), own[5:50], rng.integers(0, 4, 5)].astype(np.int32)
        at, held = (side.ravel() for side in np.meshgrid(np.arange(len(own)), np.arange(len(theirs)), indexing="ij"))
        taken = (own[at] == theirs[held]) & (rng.random(len(at)) < 0.2) & (~np.bool_(alone) | (held < at))
        parts.append((own, rng.integers(1, 9, len(own)).astype(np.int8), theirs, at[taken], held[taken], alone))
    flat = lambda i: np.concatenate([part[i] for part in parts])
    begins = lambda i: np.cumsum([0, *(len(part[i]) for part in parts)])
    ends, last = begins(0), begins(3)
    gone, short = winnow._extend_all(flat(0), ends, flat(1), flat(2), begins(2), flat(3), flat(4), last, np.array([p[5] for p in parts]), 37)
    assert gone.any() and short.any() and not gone.all()
    for i, part in enumerate(parts):
        units, failed = winnow._extend(*part, 37)
        mine = gone[ends[i] : ends[i + 1]]
        assert np.array_equal(np.flatnonzero(mine), units)
        # one by one, a position may fail before another run takes its unit
        assert np.array_equal(short[last[i] : last[i + 1]] & ~mine[part[3]], failed & ~mine[part[3]])


def test_words_of_any_length_have_the_same_hash():
    text = b"  a bc\nd " + b"x" * 23 + b"\t" + b"y" * 24 + b" " + b"z" * 25 + b"\x0b" + b"long" * 2000 + b" e"
    raw = np.frombuffer(text, dtype=np.uint8)
    row, at, stop, value = word_hashes(raw, np.array([0, 4, 1, len(raw) - 5, 0]))
    words = [text[2:3], text[4:5], text[5:6], *text[6:].split()]
    assert [text[a:b] for a, b in zip(at, stop)] == words and row.tolist() == [1, 2, 3, *[3] * (len(words) - 3)]
    for word, found in zip(words, value):
        bytes_ = np.frombuffer(word, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
        assert runs_hash(bytes_, np.array([0]), np.arange(len(word)))[0] == found
    assert len(mixed(value)) == len(set(value.tolist()))


# line dedup in whole batches


def test_units_move_as_bytes(spark):
    texts = [None, "", "a b\nc", "word " * 30, "x\n" * 7]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    lines = winnow.line_table(frame)
    assert [kind for _, kind in lines.dtypes] == ["bigint", "bigint", "binary", "binary"]
    for row in lines.collect():
        raw = np.frombuffer((texts[row["key"]] or "").encode(), dtype=np.uint8)
        _, _, hashes, sizes = winnow.units_of(raw, np.array([len(raw)]))
        assert np.array_equal(np.frombuffer(row["hashes"], dtype=np.uint32), hashes >> np.uint64(32))
        assert np.frombuffer(row["sizes"], dtype=np.int8).tolist() == sizes.tolist()


def unit_begins(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return winnow.units_of(raw, np.array([len(raw)]))[1].tolist()


def plain_without(text, units):
    """Line by line: units go with what follows them, lines that lose all with their end."""
    raw, begins, kept, start = text.encode(), unit_begins(text), [], 0
    for line in raw.split(b"\n"):
        mine = [i for i, begin in enumerate(begins) if start <= begin < start + len(line)]
        edges = [0, *(begins[i] - start for i in mine[1:]), len(line)]
        parts = [line[a:b] for i, a, b in zip(mine, edges, edges[1:]) if i not in units]
        if parts or not mine:
            kept.append(b"".join(parts) if mine else line)
        start += len(line) + 1
    return b"\n".join(kept).decode()


@pytest.mark.parametrize("at_once", [1 << 20, 150])
def test_units_are_cut_out_of_many_texts_at_once(monkeypatch, at_once):
    rng = random.Random(at_once)
    word = lambda: rng.choice(["a", "bb", "é", "日本", "y" * 30]) + rng.choice([" ", " ", "  ", "\t", "\n", "\n\n", " \n "])
    texts = [rng.choice([None, "", "\n", "a", "\na", "a\n"]) if i % 5 == 0 else rng.choice(["", " ", "\n"]) + "".join(word() for _ in range(rng.randint(1, 40))) for i in range(300)]
    texts = [text if text is None or len(text.encode()) <= at_once else text[:40] for text in texts]
    counts = [len(unit_begins(text or "")) for text in texts]
    units = [None if text is None else sorted(rng.sample(range(n), rng.choice([0, n, rng.randint(0, n)]))) for text, n in zip(texts, counts)]
    monkeypatch.setattr(common, "PIECE", at_once)
    calls = []
    monkeypatch.setattr(winnow, "word_hashes", lambda raw, sizes: calls.append(len(sizes)) or word_hashes(raw, sizes))
    got = winnow._all_without(pa.array(texts, pa.string()), pa.array(units, pa.list_(pa.int32()))).to_pylist()
    assert sum(calls) == sum(text is not None for text in texts) and len(calls) < (2 if at_once > 1000 else 200)
    assert got == [None if text is None else plain_without(text, gone) for text, gone in zip(texts, units)]


@pytest.mark.parametrize("words,far", [(5, 8), (12, 20), (37, 48), (60, 48)])
def test_long_runs_of_many_shifts_agree_with_one_by_one(monkeypatch, words, far):
    monkeypatch.setattr(winnow, "FAR", far)
    rng = np.random.default_rng(words)
    piece = lambda: np.r_[np.tile(rng.integers(0, 3, rng.integers(1, 4)), rng.integers(5, 40)), rng.integers(0, 30, rng.integers(0, 3))]
    for number in range(60):
        own = np.r_[piece(), piece()].astype(np.int32)
        alone = number % 3 == 0
        theirs = own if alone else np.r_[piece(), own[rng.integers(0, 9) :], piece()].astype(np.int32)
        at, held = (side.ravel() for side in np.meshgrid(np.arange(len(own)), np.arange(len(theirs)), indexing="ij"))
        taken = (own[at] == theirs[held]) & (rng.random(len(at)) < 0.3) & ((held < at) if alone else True)
        at, held, sizes = at[taken], held[taken], rng.integers(1, 9, len(own)).astype(np.int8)
        ends, stops, last = np.array([0, len(own)]), np.array([0, len(theirs)]), np.array([0, len(at)])
        gone, short = winnow._extend_all(own, ends, sizes, theirs, stops, at, held, last, np.array([alone]), words)
        units, failed = winnow._extend(own, sizes, theirs, at, held, alone, words)
        assert np.array_equal(np.flatnonzero(gone), units)
        assert np.array_equal(short & ~gone[at], failed & ~gone[at])


class Counted(np.ndarray):
    """An array that counts the values taken from it."""

    taken = 0

    def __getitem__(self, places):
        found = super().__getitem__(places).view(np.ndarray)
        Counted.taken += found.size
        return found


def test_equal_units_are_not_compared_over_all_shifts():
    n = 2000  # a stretch of equal units, each a position of its own shift against the first one
    own, theirs = (np.r_[edge, np.ones(n), edge + 1].astype(np.int32) for edge in (7, 9))
    at = np.arange(1, n + 1)
    Counted.taken = 0
    gone, short = winnow._extend_all(
        own.view(Counted), np.array([0, n + 2]), np.full(n + 2, 4, dtype=np.int8), theirs, np.array([0, n + 2]), at, np.ones(n, dtype=np.int64), np.array([0, n]), np.array([False]), 37
    )
    assert np.flatnonzero(gone).tolist() == at.tolist() and not short.any()
    assert Counted.taken < 100 * n


def test_tokens_leave_nothing_in_workers_that_other_stages_share(spark):
    @F.arrow_udf("long")
    def codecs(ids: pa.Array) -> pa.Array:
        return pa.array([bpe.codec.cache_info().currsize] * len(ids), pa.int64())

    @F.arrow_udf("long")
    def cleared(ids: pa.Array) -> pa.Array:
        bpe.codec.cache_clear()
        return ids

    many = spark.range(64, numPartitions=64)
    many.select(cleared("id")).collect()  # other tests ran here
    docs = spark.createDataFrame([(i, f"some text {i}" if i % 5 else None) for i in range(40)], "doc_id long, text string").repartition(8)
    found = corpus_pipeline.tokens(spark, docs, "").collect()
    assert len(found) == 40 and all((row.n_tokens > 0) == (row.doc_id % 5 > 0) for row in found)
    assert many.agg(F.max(codecs("id"))).first()[0] == 0


@pytest.mark.parametrize("at_once", [1, 2, 7, 64, 1 << 17])
def test_windows_are_taken_by_slices_as_at_once(monkeypatch, at_once):
    rng = np.random.default_rng(at_once)
    counts = np.r_[0, rng.integers(0, 12, 30), 0, 150, rng.integers(0, 40, 10), 0]
    hashes, sizes, ends = rng.integers(0, 9, counts.sum()).astype(np.int32), rng.integers(1, 9, counts.sum()).astype(np.int8), np.cumsum(counts)
    for words in (17, 37):
        expected = winnow._selected(hashes, sizes, words, ends)[:3]
        monkeypatch.setattr(winnow, "SLICE", at_once)
        parts = list(winnow._sliced(hashes, sizes, words, ends))
        assert len(expected[0]) and all(np.array_equal(np.concatenate(side), whole) for side, whole in zip(zip(*parts), expected))


def test_memory_for_windows_does_not_grow_with_a_batch():
    rng = np.random.default_rng(0)
    peaks = []
    for n in (1 << 19, 1 << 21):
        hashes, sizes, ends = rng.integers(0, 1 << 30, n).astype(np.int32), rng.integers(1, 9, n).astype(np.int8), np.arange(100, n + 100, 100).clip(max=n)
        tracemalloc.start()
        for _ in winnow._sliced(hashes, sizes, 37, ends):
            pass
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] < 40 << 20
