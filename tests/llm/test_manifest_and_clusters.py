"""Merkle manifest and sharded Lloyd: against plain versions, with odd inputs."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import merkle, sharded_lloyd

# manifest


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_levels(leaves, fanout):
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([digest("".join(last[i : i + fanout])) for i in range(0, len(last), fanout)])
    return levels


def plain_path(levels, place, fanout):
    path = []
    for level in levels[:-1]:
        first = place - place % fanout
        path.append(("".join(level[first:place]), "".join(level[place + 1 : first + fanout])))
        place //= fanout
    return path


def plain_manifest(rows, fanout, altered):
    """rows: (doc_id, lang, text); the results as a sorted list."""
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append((row[0], plain_leaf(row), plain_leaf(altered(row))))
    for members in groups.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_levels([m[1] for m in groups[g]], fanout) for g in names}
    top = plain_levels([trees[g][-1][0] for g in names], fanout)
    out = []
    for number, g in enumerate(names):
        for place, (key, leaf, found) in enumerate(groups[g]):
            path = plain_path(trees[g], place, fanout) + plain_path(top, number, fanout)
            for before, after in path:
                found = digest(before + found + after)
            out.append((key, leaf, trees[g][-1][0], top[-1][0], digest("".join(b + a for b, a in path)), found, found == top[-1][0]))
    return sorted(out, key=str)


def manifest_of(spark, rows, fanout, extra=False):
    frame = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    if extra:  # names that the operator uses inside
        for name in ("grp", "idx", "n", "digest", "_own", "_at", "path", "level", "root", "before"):
            frame = frame.withColumn(name, F.lit("x"))
    found = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    proven = merkle.manifest(frame, "doc_id", "lang", [F.col("doc_id"), F.col("lang"), F.col("text")], [F.col("doc_id"), F.col("lang"), found], fanout)
    return sorted((tuple(row) for row in proven.drop("path").collect()), key=str)


def change(row):
    return (*row[:2], row[2] + "!") if row[0] is not None and row[2] is not None and row[0] % 3 == 0 else row


ODD = [
    (None, "en", "a"), (None, "en", None), (1, None, ""), (2, "", "two"), (3, "é", "drei"), (6, "z", "x" * 300_000),
    *[(i, "en", f"text {i}") for i in range(4, 25)], (7, "en", "text 7"), (7, "en", "text 7"), (7, "en", "other"), (12, "de", "ß"), (11, "de", "ä"), (9, "de", "-"),
]


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest_agrees_with_plain_trees(spark, fanout):
    assert manifest_of(spark, ODD, fanout, extra=fanout == 3) == plain_manifest(ODD, fanout, change)


def test_manifest_of_one_leaf_and_of_none(spark):
    assert manifest_of(spark, ODD[:1], 2) == plain_manifest(ODD[:1], 2, change)
    assert manifest_of(spark, [], 2) == []


def test_proofs_show_changes_and_only_these(spark):
    found = manifest_of(spark, ODD, 2)
    assert {row[0] for row in found if not row[-1]} == {row[0] for row in ODD if change(row) != row}


# clustering


def plain_lloyd(keys, vectors, k, rounds, scale, seed=1):
    values = np.clip(np.floor(np.array(vectors, dtype=np.float64) * scale), -sharded_lloyd.FAR, sharded_lloyd.FAR).astype(np.int64)
    order = sorted(range(len(keys)), key=lambda i: (hashlib.sha256(f"{seed}:{'' if keys[i] is None else keys[i]}".encode()).hexdigest(), list(vectors[i])))
    centroids = values[order[:k]].copy()
    near = lambda: ((values[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        labels = near().argmin(axis=1)
        for c in range(len(centroids)):
            if (labels == c).any():
                centroids[c] = values[labels == c].sum(axis=0) // (labels == c).sum()
    labels, least = near().argmin(axis=1), near().min(axis=1)
    text = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    inertia = {c: int(least[labels == c].sum()) for c in set(labels.tolist())}
    return sorted(((keys[i], int(c), int(least[i]), inertia[c], sum(inertia.values()), text[c]) for i, c in enumerate(labels.tolist())), key=str)


def clustered(spark, table, **options):
    frame = spark.createDataFrame(table, "vec_id long, embedding array<double>, cluster int, chunk string, keys string")
    return sorted((tuple(row) for row in sharded_lloyd.cluster(frame, **options).collect()), key=str)


def vectors(rows):
    return [(key, vector, 1, "x", None) for key, vector in rows]


@pytest.mark.parametrize("width", [3, 4, 8])
def test_clusters_agree_with_plain_rounds(spark, width):
    draw = np.random.default_rng(5)
    rows = [(i, (draw.normal(size=8) + (i % 3) * 2).tolist()) for i in range(150)] + [(None, [0.5] * 8), (7, [0.25] * 8), (7, [0.25] * 8)]
    keys, values = zip(*rows)
    assert clustered(spark, vectors(rows), k=6, rounds=3, dims=8, scale=64, width=width, rows=20) == plain_lloyd(keys, values, 6, 3, 64)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [0.0, 1.0]) for i in range(12)]  # all centroids are equal: the first takes every vector
    found = clustered(spark, vectors(rows), k=4, rounds=2, dims=2)
    assert {row[1] for row in found} == {0} and found == plain_lloyd([r[0] for r in rows], [r[1] for r in rows], 4, 2, 64)


def test_unusable_few_and_far_vectors(spark):
    nan, far = float("nan"), float("inf")
    odd = [(1, None), (2, []), (3, [1.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [far, 1.0]), (8, [1.0, 2.0, 3.0])]
    assert clustered(spark, vectors(odd), dims=2) == []
    assert clustered(spark, [], dims=2) == []
    some = [(10, [1e30, -1e30]), (11, [0.0, 0.0]), (12, [-1e30, 3.0])]
    found = clustered(spark, vectors(odd + some), k=2, dims=2)
    assert found == plain_lloyd([r[0] for r in some], [r[1] for r in some], 2, 3, 64)


def test_parts_are_exact_beyond_what_doubles_hold():
    draw = np.random.default_rng(6)
    values, centroids = draw.integers(-sharded_lloyd.FAR, sharded_lloyd.FAR, (2, 40, 16))
    assert (sharded_lloyd._part(values, centroids) == ((values[:, None] - centroids[None]) ** 2).sum(axis=2)).all()
    assert (sharded_lloyd._unpacked(sharded_lloyd._packed(values), 16) == values).all()
