"""Archives, URL rules and nearest neighbours: against plain versions, with odd inputs."""

import base64
import hashlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from themeloom.llm import lsh_search, queries, url_rules, warc


def archive(spark, tmp_path, rows, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("body", F.lit(1))
    path = str(tmp_path / "archives")
    warc.write_archives(pages, path, **options)
    return path


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_archives_read_back(spark, tmp_path, chunk):
    texts = [None, "", "a", "same " * 40, "same " * 40, "WARC/1.1\r\nWARC-Type: x\r\n\r\n", "é漢😀" * 30, "\r\n\r\n", "x" * 5000, "", "WARC-Segment-Number: 3\r\n", "WARC/1.1", "x" * 56 + "WARC/1.1", "x" * 120 + "WARC/1.1\r", "x" * 56 + "WARC/1.1\r\ny" + "z" * 100, "WARC/1.1" * 40]
    rows = [(i, f"http://a/{i}\r\nX: %", text) for i, text in enumerate(texts)] + [(50, None, "same " * 40)]
    path = archive(spark, tmp_path, rows, chunk=chunk)
    found = {int(row["record_id"]): row for row in warc.verified(warc.read_records(spark, path)).collect()}
    first = {}
    assert len(found) == len(rows)
    for key, _, text in rows:
        data = (text or "").encode()
        row = found[key]
        assert row["payload_bytes"] == len(data)
        assert row["payload_digest"] == base64.b32encode(hashlib.sha1(data).digest()).decode()
        holder = first.setdefault(data, key)
        assert (row["record_type"], row["refers_to"]) == (("response", None) if holder == key else ("revisit", str(holder)))
    blocks = warc.read_records(spark, path).filter("record_id = '8'").orderBy("segment").collect()
    assert b"".join(bytes(b["block"]) for b in blocks) == b"x" * 5000 and max(len(b["block"]) for b in blocks) <= chunk
    urls = {row["target_uri"] for row in warc.read_records(spark, path).filter("target_uri IS NOT NULL").collect()}
    assert urls == {url for _, url, _ in rows if url}


def test_small_payloads_may_all_be_responses(spark, tmp_path):
    path = archive(spark, tmp_path, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcdef"), (4, "u", "abcdef")], least=3)
    kinds = {row["record_id"]: row["record_type"] for row in warc.read_records(spark, path).collect()}
    assert kinds == {"1": "response", "2": "response", "3": "response", "4": "revisit"}


@pytest.mark.parametrize("chunk", [9, 1 << 16])
def test_rows_that_share_a_key(spark, tmp_path, chunk):
    long = "long payload " * 5
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "v", "a"), (1, "w", "b"), (2, None, "a"), (None, "n", long), (None, "n", long), (None, "m", "c"), (7, "x", long), (7, "x", long), (7, "y", None)]
    path = archive(spark, tmp_path, rows, chunk=chunk)
    found = sorted((r["record_id"], r["payload_bytes"], r["record_type"], r["refers_to"] or "") for r in warc.verified(warc.read_records(spark, path)).collect())
    assert found == sorted(
        [("1", 1, "response", ""), ("1", 1, "revisit", "1"), ("1", 1, "revisit", "1"), ("1", 1, "response", ""), ("2", 1, "revisit", "1"), ("", 1, "response", ""),
         ("7", len(long), "response", ""), ("7", len(long), "revisit", "7"), ("", len(long), "revisit", "7"), ("", len(long), "revisit", "7"), ("7", 0, "response", "")]
    )
    whole = archive(spark, tmp_path / "small", rows, chunk=chunk, least=1000)
    assert sorted(r["record_id"] for r in warc.verified(warc.read_records(spark, whole)).collect()) == sorted(str(r[0]) if r[0] else "" for r in rows)


def test_empty_archive(spark, tmp_path):
    path = archive(spark, tmp_path, [])
    assert warc.verified(warc.read_records(spark, path)).count() == 0


def test_damage_is_not_passed_over(spark, tmp_path):
    text = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:record:1>\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"
    (tmp_path / "bad.warc").write_bytes(text.encode())
    with pytest.raises(Exception, match="not a whole record"):
        warc.read_records(spark, str(tmp_path / "bad.warc")).collect()


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("bad.com", "/", "block"), ("com", "/fr/", "allow")]


def judged(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("action", F.lit("clash")).withColumn("verdict", F.lit("clash"))
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    return url_rules.judge(pages.drop("html"), rules, url_rules.alias_edges(pages))


def test_rules_and_odd_urls(spark):
    urls = ["http://Example.ORG/es/x", "http://www.example.org/en", "http://notexample.org/es/", "ftp://BAD.com/x?y", "no scheme", None, "", "a://b://c/d", "http://x.com/fr/?q#f", "http://com", "http://org?x/"]
    rows = {r["page_id"]: r for r in judged(spark, [(i, u, None) for i, u in enumerate(urls)]).collect()}
    assert [(rows[i]["rule"], rows[i]["verdict"]) for i in range(11)] == [
        ("example.org/es/", "block"), ("org/", "allow"), ("org/", "allow"), ("bad.com/", "block"), (None, "allow"), (None, "allow"), (None, "allow"), (None, "allow"), ("com/fr/", "allow"), (None, "allow"), (None, "allow"),
    ]
    assert (rows[7]["host"], rows[7]["path"]) == ("b:", "//c/d") and (rows[4]["host"], rows[5]["path"]) == ("", "")


def test_blocks_reach_aliases_and_allow_goes_first(spark):
    canonical = lambda url: f'<head><LINK href="{url}" rel="canonical"></head>'
    redirect = lambda url: f'<meta http-equiv="refresh" content="0; url={url}">'
    rows = [
        (1, "http://a.net/1", redirect("http://b.net/2")), (2, "http://b.net/2", canonical("http://bad.com/3")), (3, "http://c.net/", canonical("http://d.net/")),
        (4, "http://e.net/", redirect("http://bad.com/9") + canonical("http://f.org/")), (5, "http://e.net/", None), (6, "http://bad.com/3", ""), (7, "http://g.net/", '<a rel="x" href="http://bad.com/3">'),
    ]
    verdicts = {r["page_id"]: r["verdict"] for r in judged(spark, rows).collect()}
    assert verdicts == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow", 6: "block", 7: "allow"}
    assert judged(spark, []).count() == 0


PAGE = "http://a.com/dir/page?x=1#f"


@pytest.mark.parametrize(
    "target, base, want",
    [
        ("https://b.org/", PAGE, "https://b.org/"), ("//b.org/x", PAGE, "http://b.org/x"), ("/new", PAGE, "http://a.com/new"), ("page2", PAGE, "http://a.com/dir/page2"),
        ("?y=2", PAGE, "http://a.com/dir/page?y=2"), ("#top", PAGE, None), ("mailto:x@b.org", PAGE, None), ("", PAGE, None), ("n", "http://a.com", "http://a.com/n"),
        ("n", "http://a.com?q", "http://a.com/n"), ("/n", "no scheme", None), ("/n", None, None), ("a?b=1&amp;c=2", PAGE, "http://a.com/dir/a?b=1&c=2"), ("http://b.org/?a&amp;b", None, "http://b.org/?a&b"),
    ],
)
def test_targets_are_resolved(spark, target, base, want):
    row = spark.createDataFrame([(target, base)], "t string, b string").select(url_rules.resolved(F.col("t"), F.col("b"))).first()
    assert row[0] == want


def test_blocks_reach_relative_aliases_and_sql_agrees(spark, tmp_path):
    rows = [
        (1, "http://example.org/es/1", '<link rel="canonical" href="/plain">'), (2, "http://example.org/plain", None), (3, "http://example.org/other", "<META http-equiv=refresh content='0; url=plain'>"),
        (4, "http://example.org/far", '<link href="//b.com/de/x" rel=canonical>'), (5, "http://q.net/a/b", '<link rel="canonical" href="c?d=1&amp;e=2">'), (6, "http://q.net/a/c?d=1&e=2", "<meta http-equiv='refresh' content='1;url=http://b.com/de/'>"),
        (7, None, '<link rel="canonical" href="/x">'), (8, "http://q.net/lone", "<link rel=canonical href=#here>"),
    ]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    frame.coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    found = {row["page_id"]: row["verdict"] for row in queries.redirect_equivalence(spark, str(tmp_path)).collect()}
    assert {key for key, verdict in found.items() if verdict == "block"} == {1, 5, 6}
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {row[0]: row[-1] for row in duck.execute(queries.URL_SQL).fetchall()} == found


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, dim string")


def test_search_finds_what_a_scan_finds(spark):
    draw = np.random.default_rng(2)
    centers = draw.standard_normal((12, 16))
    data = centers[draw.integers(0, 12, 1500)] + 0.3 * draw.standard_normal((1500, 16))
    data[100:400] = data[100]  # a very common vector
    frame = vectors(spark, [(i, list(map(float, v)), "x") for i, v in enumerate(data)])
    found = lsh_search.search(frame, F.col("key") % 20 == 0).toPandas()
    hits = total = 0
    for query in range(0, 1500, 20):
        square = ((data - data[query]) ** 2).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(1500), square)) if i != query][:10]
        mine = found[found.query_id == query].sort_values("rank")
        assert list(mine["rank"]) == list(range(1, 11))
        assert np.allclose(mine.score, np.sqrt(square[mine.vec_id]), rtol=1e-12, atol=0)
        hits, total = hits + len(set(order) & set(mine.vec_id)), total + 10
        if 100 <= query < 400:
            assert list(mine.vec_id) == order
    assert hits / total >= 0.95


def test_few_and_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], "x"), (100, [0.0, 1.0], "x"), (3, [1.0, 0.0], "x"), (4, None, "x"), (5, [0.0, 0.0], "x"), (6, [nan, 1.0], "x"), (7, [inf, 1.0], "x"), (8, [None, 1.0], "x"), (9, [1.0], "x"), (None, [1.0, 1.0], "x"), (200, [0.0, 0.0], "x")]
    found = lsh_search.search(vectors(spark, rows), F.col("key") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in found] == [(0, 1, 3), (0, 2, 100), (100, 1, 0), (100, 2, 3)]
    assert lsh_search.search(vectors(spark, []), F.col("key") % 100 == 0).count() == 0
