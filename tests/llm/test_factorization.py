"""Factorisation machine: pairs written out, whole texts against pieces, held-out labels, odd inputs."""

import itertools
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from themeloom.llm import factorization as fm

BUCKETS = 64


def machine(seed=1, factors=3):
    return fm.Machine(0.25, np.random.default_rng(seed).normal(size=(BUCKETS + fm.EXTRA, factors + 1)))


def features_of(texts, stated=None, buckets=BUCKETS):
    stated = [None if t is None else len(t) for t in texts] if stated is None else stated
    return list(fm.features(pa.array(texts, pa.string()), pa.array(stated, pa.float64()), buckets))


def dense(parts):
    out = []
    for x in parts:
        rows = np.zeros((x.n, BUCKETS + fm.EXTRA))
        rows[x.row, x.index] = x.value
        out.append(rows)
    return np.concatenate(out)


def test_linear_time_score_equals_all_pairs():
    parts = features_of(["a b c a", "", None, "Some Words!! here\nand # there"])
    m, rows = machine(), dense(parts)
    weights, vectors = m.table[:, 0], m.table[:, 1:]
    for x, score in zip(rows, np.concatenate([m.score(p) for p in parts])):
        pairs = sum(x[i] * x[j] * (vectors[i] @ vectors[j]) for i, j in itertools.combinations(np.flatnonzero(x), 2))
        assert score == pytest.approx(1 / (1 + np.exp(-(m.bias + weights @ x + pairs))))


def test_gradient_is_the_slope_of_the_loss():
    (x,) = features_of(["a b c a", "x y", "!!"])
    label, m, step = np.array([1.0, 0.0, 1.0]), machine(factors=2), 1e-6
    loss = lambda m: -np.log(np.where(label == 1, m.score(x), 1 - m.score(x))).sum()
    bias, table = m.gradient(x, label)
    assert bias == pytest.approx((loss(fm.Machine(m.bias + step, m.table)) - loss(m)) / step, abs=1e-3)
    for at in zip(*np.nonzero(np.abs(table) > 1e-3)):
        moved = m.table.copy()
        moved[at] += step
        assert table[at] == pytest.approx((loss(fm.Machine(m.bias, moved)) - loss(m)) / step, abs=1e-3)


def test_words_are_those_between_white_space():
    texts = ["", " \t\n", "one", " two  words\n", "é x y", "a\x1cb"]
    words = np.expm1(np.concatenate([p.value[p.index == BUCKETS] for p in features_of(texts)]) * 8)
    assert words.round().tolist() == [len(t.encode().split()) for t in texts]
    one, two = features_of(["Same sAme SAME"]), features_of(["same same same"])
    assert set(one[0].index) == set(two[0].index)


def test_long_texts_read_as_in_one_and_alone(monkeypatch):
    draw = np.random.default_rng(2)
    texts = [" ".join("abcdefgh"[: draw.integers(1, 8)] for _ in range(n)) for n in (0, 3, 400, 1, 900, 2, 50)]
    whole = dense(features_of(texts))
    monkeypatch.setattr(fm, "PIECE", 1000)
    cut = dense(features_of(texts))
    assert np.abs(np.delete(whole - cut, BUCKETS + 11, axis=1)).max() < 1e-12  # repeats in a row are counted within a piece
    assert (dense(features_of([texts[4]])) == dense(features_of(texts))[4:5]).all()
    word = features_of(["x" * 5000, "x" * 5000 + " y"])
    assert len(word) == 2 and all(np.isfinite(p.value).all() for p in word)


def docs_and_labels(spark, n=400):
    draw = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choice(list("abcdefgh"), draw.integers(2, 8))) for _ in range(draw.integers(30, 90))]
        good = i % 3 > 0
        text = " ".join(words) if good else " ".join(w + "***" for w in words)
        rows.append((i, text, "en", "a", len(text)))
        labels.append((i, int(good)))
    odd = [(None, "no key", "en", "a", 6), (1000, None, "en", "a", None), (1001, "", "en", "a", 0), (1002, "w " * 300_000, "en", "a", 3), (3, rows[3][1], "en", "a", rows[3][4]), (1003, "x" * 2_000_000, "de", None, -5)]
    labels += [(None, 1), (1001, None), (5, 0), (5, 1), (2000, 1), (8, 7)]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string, n_chars long"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_documents_are_told_apart(spark):
    docs, labels = docs_and_labels(spark)
    options = {"buckets": 256, "rounds": 15, "most": 250}
    found = fm.classify(docs.withColumn("score", F.lit("x")).withColumn("label", F.lit("x")), labels, **options).collect()
    assert len(found) == 406 and all(0 <= row["score"] <= 1 for row in found)
    for row in found:
        assert row["held_out"] == (row["doc_id"] is None or zlib.crc32(str(row["doc_id"]).encode()) % 5 == 0)
        assert row["predicted"] == int(row["score"] >= 0.3)
    held = [row for row in found if row["held_out"] and row["doc_id"] is not None and row["doc_id"] < 400]
    assert len(held) > 40 and all(row["predicted"] == int(row["doc_id"] % 3 > 0) for row in held)
    same = {row["score"] for row in found if row["doc_id"] == 3}
    assert len(same) == 1
    # labels that are held out are never read
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {(row["doc_id"], row["score"]) for row in fm.classify(docs.repartition(7), turned, **options).collect()}
    assert again == {(row["doc_id"], row["score"]) for row in found}


def test_nothing_to_learn_from_and_nothing_to_score(spark):
    docs, labels = docs_and_labels(spark, 10)
    assert {row["score"] for row in fm.classify(docs, labels.limit(0), rounds=2, buckets=64).collect()} == {0.5}
    assert fm.classify(docs.limit(0), labels, rounds=2, buckets=64).count() == 0
