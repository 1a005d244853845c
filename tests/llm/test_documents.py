"""Quality, line dedup, SimHash, mixing and the pipeline: against plain versions, with odd inputs."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from themeloom.llm import common, components, mixing, outliers, simhash, winnow

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    draw = np.random.default_rng(seed)
    return " ".join("".join(draw.choice(list("abcdefghij"), draw.integers(2, 8))) for _ in range(n))


def odd_docs(spark):
    line = prose(1, 60)
    rows = [
        (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n ", None, "a", 3), (4, line, "en", None, 400), (5, line, "en", "a", 400),
        (6, f"one\n{line}\nshort tail", "de", "b", 400), (7, f"two\n{line}\nshort tail", "de", "b", 400), (7, f"two\n{line}\nshort tail", "de", "b", 400),
        (None, f"three\n{line}", "de", "b", 1), (9, prose(9, 30_000), "en", "a", 1), (10, "w " * 500, "en", "a", 1), (11, line.replace("a", "A"), "en", "b", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


# components


def test_components_agree_with_plain_search(spark):
    draw = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1040)] + [(5000, 5000 + i) for i in range(60)] + [(None, 3), (8, 8)]
    found = {row["node"]: row["root"] for row in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((top(a), top(b)))
            parent[high] = low
    assert found == {node: top(node) for node in parent}


def test_components_of_nothing(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# simhash


def plain_fingerprint(text, size):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", "One", "one two", "a b c d", prose(2, 300), "Ä B\tc\nd"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text, 3)
    assert simhash.fingerprint(text, 5) == plain_fingerprint(text, 5)


def test_links_connect_what_all_pairs_connect(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 8)  # so that crowded cells are dealt out
    draw = np.random.default_rng(3)
    centers = draw.integers(0, 2**63, 30, dtype=np.uint64)
    near = [int(c) ^ sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 5), replace=False)) for c in centers for _ in range(12)]
    fps = sorted({simhash._signed(x) for x in near})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    found = {row["node"]: row["root"] for row in components.components(simhash.links(frame)).collect()}
    group = {f: f for f in fps}
    for a, b in itertools.combinations(fps, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
            low, high = sorted((group[a], group[b]))
            group = {k: low if v == high else v for k, v in group.items()}
    assert {f: found.get(f, f) for f in fps} == group


def test_near_duplicates_of_odd_documents(spark):
    found = simhash.near_duplicates(odd_docs(spark)).collect()
    assert len(found) == 12
    of = {(row["doc_id"], row["body"]): row["component_id"] for row in found}
    by_id = {key[0]: component for key, component in of.items() if key[0] is not None}
    assert by_id[1] == by_id[2] == by_id[3] == 1  # no words: fingerprint 0
    assert by_id[5] == 4 and by_id[11] == 4
    assert by_id[7] == 6 and by_id[9] == 9


def test_one_of_each(spark):
    kept = simhash.one_of_each(odd_docs(spark))
    ids = [row["doc_id"] for row in kept.collect()]
    assert sorted(i for i in ids if i is not None)[:2] == [1, 4] and ids.count(7) == 0 and len(ids) == len(set(ids))
    assert kept.columns == odd_docs(spark).columns
    assert simhash.one_of_each(odd_docs(spark).limit(0)).count() == 0


def test_pipeline_links_what_the_fingerprints_link(spark):
    """Near copies within three bits go, those beyond stay: the stage has no other measure."""
    words = prose(77, 300).split()
    texts = [" ".join(words), " ".join([*words[:150], "changed", *words[151:]]), " ".join([*words[:100], *prose(78, 200).split()]), prose(79, 50), prose(79, 50).upper()]
    bits = lambda a, b: (simhash.fingerprint(texts[a]) ^ simhash.fingerprint(texts[b])).bit_count()
    rows = [(i, text, "en", "a", 1) for i, text in enumerate(texts)]
    kept = {row["doc_id"] for row in corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "unused").collect()}
    assert bits(0, 2) > 3 and kept == {0, 2, 3} | ({1} if bits(0, 1) > 3 else set())


# line dedup


def test_lines_deleted(spark):
    docs = odd_docs(spark).withColumn("n_lines", F.lit("clash"))
    rows = {row["doc_id"]: row for row in winnow.dedup_lines(docs).collect()}
    line = prose(1, 60)
    assert rows[4]["text"] == line and rows[5]["text"] == "" and rows[5]["n_deleted"] == rows[5]["n_lines"] > 8
    assert rows[6]["text"] == "one\nshort tail"
    assert rows[7]["text"] == "two\nshort tail"  # the first with this line is document 4, which ends with it
    assert rows[None]["text"] == "three"
    assert rows[1]["text"] is None and rows[1]["n_lines"] == 0 and rows[3]["n_lines"] == 0 and rows[3]["text"] == " \n "
    assert winnow.dedup_lines(docs).count() == 12
    assert winnow.dedup_lines(docs.limit(0)).count() == 0


def deduped(spark, texts, **options):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in sorted(winnow.dedup_lines(frame, **options).collect(), key=lambda r: r["doc_id"])]


def test_match_is_extended_to_short_lines_around(spark):
    run = ["a b", prose(5, 55), "c d e"]
    assert deduped(spark, ["\n".join(["first", *run, "end"]), "\n".join(["second", *run, "other"])])[1] == "second\nother"


def test_passages_inside_long_lines_go(spark):
    texts = [f"{prose(30 + i, 40)} {prose(29, 75)} {prose(60 + i, 40)}\nlast" for i in range(6)]
    passage = prose(29, 75).split()
    for i, text in enumerate(deduped(spark, texts)):
        chance = sum(word in set(passage) for word in f"{prose(30 + i, 40)} {prose(60 + i, 40)}".split())
        left = sum(word in set(passage) for word in text.split()) - chance
        assert left == 75 if i == 0 else left <= winnow.MOST_LOST
        assert set(prose(30 + i, 40).split()[:-8]) <= set(text.split()) and text.endswith("\nlast")


def test_a_run_is_found_though_an_earlier_text_shares_its_minimum(spark):
    run = [prose(200 + i, 8) for i in range(12)]
    hashes, sizes = (np.array(x) for x in units("\n".join(run)))
    text = lambda i, lines: "\n".join([prose(400 + i, 9), *lines, prose(500 + i, 9)])
    # the first texts hold two lines each, so whichever pair is selected has its first place there
    texts = [text(i, run[i : i + 2]) for i in range(11)] + [text(20, run), text(21, run)]
    kept = deduped(spark, texts)
    assert kept[:12] == texts[:12] and not set(run) & set(kept[12].split("\n")) and prose(521, 9) in kept[12]


def test_repeats_inside_one_text_keep_the_first(spark):
    line = prose(6, 20)
    (text,) = deduped(spark, ["\n".join([line] * 9)])
    assert 37 <= len(text.split()) <= 60 and line in text


def test_a_long_text_of_equal_lines_is_walked_once(spark):
    line = "one line of eight words that comes again"
    begin = time.perf_counter()
    (text, other) = deduped(spark, ["\n".join([line] * 40_000), "\n".join(["x", *[line] * 40_000, "y"])])
    assert len(text.split("\n")) <= 6 and other == "x\ny"
    assert time.perf_counter() - begin < 60  # both texts, Spark's own time included


def units(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    _, _, hashes, sizes = winnow.units_of(raw, np.array([len(raw)]))
    return (hashes >> np.uint64(32)).astype(np.uint32).view(np.int32).tolist(), sizes.tolist()


def plain_round(tables, found, words):
    """found: (doc, at, key) in order; units of long enough runs with the first place of a key, and keys in none."""
    first, gone, runs = {}, [set() for _ in tables], []
    for doc, at, key in found:
        held, other = first.setdefault(key, (doc, at))
        if (held, other) == (doc, at):
            continue
        own, theirs, left, right = tables[doc][0], tables[held][0], at, at
        while left > 0 and left - at + other > 0 and own[left - 1] == theirs[left - 1 - at + other]:
            left -= 1
        while right < len(own) and right - at + other < len(theirs) and own[right] == theirs[right - at + other] and not (doc == held and right >= max(left + at - other, at)):
            right += 1
        long = sum(tables[doc][1][left:right]) >= words
        runs.append((doc, held, at, key, long))
        if long:
            gone[doc].update(range(left, right))
    return gone, runs


def plain_dedup(texts, words):
    tables = [units(t) for t in texts]
    selected = [winnow._selected(np.array(h, dtype=np.int32), np.array(s), words) if len(h) > 1 else None for h, s in tables]
    found = [(doc, at, int(sel[3][at])) for doc, sel in enumerate(selected) if sel is not None for at in sorted(set(sel[2].tolist()))]
    gone, runs = plain_round(tables, found, words)
    failed = {key for doc, _, at, key, long in runs if not long}
    windows = []
    for doc, sel in enumerate(selected):
        if sel is not None:
            windows += [(doc, int(b), tuple(tables[doc][0][b:e])) for b, e, p in zip(*sel[:3]) if int(sel[3][p]) in failed]
    more, _ = plain_round(tables, windows, words)
    return [a | b for a, b in zip(gone, more)]


def test_random_line_tables_agree_with_plain_version(spark):
    rng = random.Random(4)
    pool = [prose(i, rng.randint(1, 14)) for i in range(100, 106)]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randint(0, 14))) for _ in range(40)] + [texts_of_one(pool, rng) for _ in range(6)]
    want = plain_dedup(texts, 30 - winnow.LOST)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, deleted = winnow.repeated_units(frame, min_words=30)
    got = {row["key"]: set(row["units"]) for row in deleted.collect()}
    assert sum(map(bool, want)) > 15 and got == {doc: gone for doc, gone in enumerate(want) if gone}
    shown = deduped(spark, texts, min_words=30)
    for text, short, gone in zip(texts, shown, want):
        assert sum(units(short)[1]) == sum(s for i, s in enumerate(units(text)[1]) if i not in gone)
    # every window of enough words that an earlier text holds is gone
    seen = {}
    for doc, (hashes, sizes) in enumerate(map(units, texts)):
        for begin in range(len(hashes)):
            end = next((e for e in range(begin, len(hashes) + 1) if sum(sizes[begin:e]) >= 30), None)
            if end is not None and seen.setdefault(tuple(hashes[begin:end]), doc) < doc:
                assert set(range(begin, end)) & want[doc]


def texts_of_one(pool, rng):
    return " ".join(rng.choice(pool) for _ in range(9))


def test_minima_are_selected_and_shared():
    hashes = np.random.default_rng(8).integers(-(1 << 31), 1 << 31, 3000).astype(np.int32)
    begins, ends, places, pairs = winnow._selected(hashes, np.full(3000, 4), 37)
    assert all(pairs[p] == pairs[b : e - 1].min() and b <= p < e - 1 for b, e, p in zip(begins, ends, places))
    assert len(np.unique(places)) < 3000 / 4  # about 2 in (pairs of a window + 1)


def test_long_texts_are_cut_at_line_ends(monkeypatch):
    text = "\n".join(prose(i, 9) for i in range(60))
    whole = units(text)
    monkeypatch.setattr(common, "PIECE", 500)
    parts = list(common.text_pieces(pa.array([None, text, "a b"]), lambda raw, sizes: [("whole", len(sizes))], lambda found: found))
    assert parts[0] == [("whole", 1)] and parts[2] == [("whole", 1)]
    cut = [winnow.units_of(part, np.array([len(part)])) for part in parts[1]]
    assert len(cut) > 5 and np.concatenate([c[3] for c in cut]).tolist() == whole[1]
    assert winnow._without(text, np.arange(len(whole[0]))) == ""


def test_short_repeats_stay(spark):
    docs = spark.createDataFrame([(1, "all rights reserved\nx"), (2, "all rights reserved\ny")], "doc_id long, text string")
    assert winnow.dedup_lines(docs).agg(F.sum("n_deleted")).first()[0] == 0


# quality


def plain_mcd(points, kept=0.75):
    """Concentration on one group, by numpy, with the same bins and grid."""
    best = None
    n = len(points)
    half = int(np.ceil(kept * n))
    floors = np.diag(np.square(outliers.FLOORS))
    middle = np.median(points, axis=0)
    spread = np.median(np.abs(points - middle), axis=0)
    plain = np.cov(points.T, bias=True) / outliers.GRID**2 + floors
    starts = [(middle / outliers.GRID, np.linalg.inv(np.diag((1.4826 * spread / outliers.GRID) ** 2) + floors)), (points.mean(axis=0) / outliers.GRID, np.linalg.inv(plain))]
    for center, inverse in starts:
        seen = set()
        while True:
            off = points / outliers.GRID - center
            square = np.einsum("ij,jk,ik->i", off, inverse, off)
            bins = np.floor(outliers.BINS * np.log2(np.maximum(square, 1e-6)))
            near = points[bins <= np.sort(bins)[half - 1]]
            center = near.mean(axis=0) / outliers.GRID
            cov = outliers.consistency(kept) * np.cov(near.T, bias=True) / outliers.GRID**2 + floors
            inverse = np.linalg.inv(cov)
            if (key := (len(near), center.tobytes())) in seen:
                break
            seen.add(key)
        if best is None or np.linalg.det(cov) < best[0]:
            best = (np.linalg.det(cov), center, inverse)
    return best


def test_estimate_agrees_with_numpy(spark):
    draw = np.random.default_rng(8)
    good = draw.normal([1600, 0, 30, 60], [60, 1, 20, 40], (400, 4))
    bad = draw.normal([2100, 900, 500, 300], 30, (60, 4))
    points = np.rint(np.vstack([good, bad])).astype(int)
    frame = spark.createDataFrame([("g", *map(int, p), 1) for p in points], "group string, x0 long, x1 long, x2 long, x3 long, n long")
    row = outliers.estimate(frame).first()
    _, center, inverse = plain_mcd(points)
    assert np.allclose(row["center"], center) and np.allclose(np.reshape(row["inverse"], (4, 4)), inverse)


def test_outliers_go_and_prose_stays(spark):
    rows = [(i, prose(i, 80), "en", "a", 1) for i in range(150)] + [(500 + i, prose(i, 80).replace(" ", " #*$ "), "en", "a", 1) for i in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    counted = outliers.with_counts(docs.withColumn("kept", F.lit(3)).withColumn("n_words", F.lit("x")))
    judged = {row["doc_id"]: row for row in outliers.judge(counted, counted).collect()}
    assert all(judged[i]["kept"] for i in range(150)) and not any(judged[500 + i]["kept"] for i in range(10))
    assert not judged[1001]["kept"] and judged[1001]["base_failed"] and judged[1010]["base_failed"]  # no words; one word repeated
    empty = outliers.with_counts(docs.limit(0))
    assert outliers.judge(empty, empty).count() == 0


@pytest.mark.parametrize("text,want", [("", (0, 0, 0, 0, 0, 0)), ("a b c a b c", (6, 6, 0, 0, 6, 1)), ("x #\nx #\n\n y", (5, 5, 2, 1, 0, 3)), ("é|ü", (1, 3, 1, 0, 0, 1))])
def test_counts(text, want):
    assert outliers.count_text(text) == want


# mixing


def test_targets_stop_and_are_dealt_anew(spark):
    sizes = spark.createDataFrame([(1, "a", 10), (2, "b", 100), (3, "c", 1000), (4, None, 50), (5, "d", 0)], "doc_id long, source string, size long")
    rows = {r["source"]: r for r in mixing.source_targets(sizes, [3, 1, 2], 1.5, 2).collect()}
    size = {"a": 10, "b": 100, "c": 1000, "d": 0, None: 50}
    weight = {"a": 3, "b": 1, "c": 2, "d": 3, None: 1}
    target, left = dict.fromkeys(size, 0.0), 1.5 * 1160
    open_ = set(size)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        shares = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, share in shares.items():
            new = target[s] + share
            left += max(0.0, new - 2 * size[s])
            target[s] = min(new, 2.0 * size[s])
        open_ = {s for s in open_ if target[s] < 2 * size[s]}
    assert {s: pytest.approx(target[s]) for s in size} == {s: r["target"] for s, r in rows.items()}


def test_mix_comes_near_targets_and_reruns_agree(spark):
    draw = np.random.default_rng(1)
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", int(draw.integers(1, 40)), "x") for i in range(900)] + [(None, None, 12, "x"), (5000, "hot", 0, "x"), (5001, "hot", None, "x"), (7, "twice", 9, "x"), (7, "twice", 9, "x")]
    frame = spark.createDataFrame(rows, "doc_id long, source string, size long, target string")
    mixed = mixing.mix(frame, [3, 1, 2], 1.5, 2)
    assert mixed.count() == len(rows) and mixed.filter("passes > 2 OR taken > 2 * size").count() == 0
    for row in mixed.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target")).collect():
        assert abs(row["t"] - row["target"]) <= 80
    again = mixing.mix(frame.repartition(5), [3, 1, 2], 1.5, 2)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, again.collect()))
    assert mixing.mix(frame.limit(0), [3, 1, 2], 1.5, 2).count() == 0


# pipeline


def test_pipeline_on_odd_documents(spark):
    rows = [(i, prose(i, 80), "en", "ab"[i % 2], 1) for i in range(60)] + [(100 + i, prose(i, 80), "en", "a", 1) for i in range(20)]
    docs = spark.createDataFrame(rows, SCHEMA).unionByName(odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    docs = docs.withColumn("size", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.written(stage(spark, docs, "unused"))
        ids = {row["doc_id"] for row in docs.select("doc_id").distinct().collect()}
        if name != "tokens":
            assert docs.columns == corpus_pipeline.COLUMNS
        if name == "quality":
            assert set(range(60)) <= ids and 1001 not in ids
        if name == "near_dedup":
            assert set(range(60)) <= ids and not ids & set(range(100, 120))
            assert docs.count() == docs.select("doc_id").distinct().count()
    assert docs.count() > 0 and docs.filter("n_tokens <= 0").count() == 0
