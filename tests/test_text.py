"""Cleaning, fingerprints, redaction, weeks and labels on hand-made values."""

import hashlib
import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from themeloom.functions import labels, pii, text, weeks


def column(spark, values, function, schema="v string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in rows.select("i", function(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_clean_text(spark):
    cases = {
        "salt &amp; pepper": "salt & pepper",
        "a &lt; b, b &gt; a": "a < b, b > a",
        "it&#39;s": "it's",
        "zero​‍width": "zerowidth",
        "one  two\n\n\tthree": "one two three",
        " tea &amp;​  cake ": "tea & cake",
        "a  b\x1c\x1fc": "a b c",
        "caf&eacute; &#x1F600; &copy 2024": "café 😀 © 2024",
        "": "",
        "   \n\t  ": "",
    }
    assert column(spark, list(cases), text.clean_text) == list(cases.values())
    once = column(spark, list(cases), text.clean_text)
    assert column(spark, [v.replace("&", "and") for v in once], text.clean_text) == [
        v.replace("&", "and") for v in once
    ]


def test_every_zero_width_character_goes(spark):
    codes = [0x200B, 0x200C, 0x200D, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064]
    invisible = [chr(c) for c in [*codes, 0xFEFF, 0xAD, 0x34F, 0x180E]]
    assert column(spark, [f"a{c}b" for c in invisible], text.strip_zero_width) == ["ab"] * 14


def test_ids_match_a_plain_digest(spark):
    day = date(2026, 6, 15)
    raw = "\n  Nice Tram \t"
    expected = hashlib.sha256(f"nice tram|5|{day}".encode()).hexdigest()
    row = spark.createDataFrame([(raw, 5, day)], "t string, r int, d date").select(
        text.review_id(F.col("t"), F.col("r"), F.col("d")).alias("short"),
        text.dedup_key(F.col("t"), F.col("r"), F.col("d")).alias("key"),
    ).first()
    assert (row["short"], row["key"]) == (expected[:16], expected)


def test_truncate_and_snippet(spark):
    assert column(spark, ["x" * 181, "x" * 180], text.truncate_text) == ["x" * 180 + "...", "x" * 180]
    assert column(spark, ["a\nb"], text.snippet) == ["a b"]


@pytest.mark.parametrize(
    "raw, wanted",
    [
        ("mail ida@example.net soon", "mail [REDACTED] soon"),
        ("to: o.k+news%1@sub.example.co.uk.", "to: [REDACTED]."),
        ("x@y.zz,p@q.rr", "[REDACTED],[REDACTED]"),
        ("ring 6000000001", "ring [REDACTED]"),
        ("or +916000000001", "or +[REDACTED]"),
        ("tel +91-7000000002", "tel [REDACTED]"),
        ("desk 08000000003", "desk [REDACTED]"),
        ("order 2000000000", "order [REDACTED]"),
        ("card QWXYZ0918K", "card [REDACTED]"),
        ("qwxyz0918k in small letters", "qwxyz0918k in small letters"),
        ("no. 2222 3333 4444", "no. [REDACTED]"),
        ("no. 2222-3333-4444", "no. [REDACTED]"),
        ("box 55667788, shelf 2", "box [REDACTED], shelf 2"),
        ("gate 4411", "gate 4411"),
        ("digits ९८७६५४३२१०१ here", "digits [REDACTED] here"),
        ("room 7, 3 beds", "room 7, 3 beds"),
    ],
)
def test_scrub_pii(spark, raw, wanted):
    assert column(spark, [raw, wanted], pii.scrub_pii) == [wanted, wanted]


def test_scrub_equals_python_re(spark):
    samples = ["x9876543210y", "0 09876543210", "é1234567é 12345678", "A-ABCDE1234F-1", "+91 9876543210 1234 5678 90123"]
    expected = []
    for value in samples:
        for pattern in pii.PATTERNS.values():
            value = re.sub(pattern, pii.REDACTED, value)
        expected.append(value)
    assert column(spark, samples, pii.scrub_pii) == expected


def test_iso_weeks(spark):
    texts = ["2026-W25", "2026-w14", "2026-W53", "2025-W53", "2026-W0", "2026-W54", "2026", "x-Wy"]
    got = column(spark, texts, weeks.try_parse_iso_week)
    for value, result in zip(texts, got):
        try:
            year, week = value.upper().split("-W")
            monday = date.fromisocalendar(int(year), int(week), 1)
            assert result["week_start"] == monday
            assert (result["week_end"] - monday).days == 6
        except ValueError:
            assert result is None
    days = [date(2024, 12, 30), date(2026, 1, 1), date(2027, 1, 3)]
    assert column(spark, days, weeks.iso_week_of, "v date") == ["2025-W01", "2026-W01", "2026-W53"]
    window = column(spark, [date(2026, 6, 15)], weeks.review_window, "v date")[0]
    assert (window["window_start"], window["window_end"]) == (date(2026, 4, 13), date(2026, 6, 21))
    with pytest.raises(Exception, match="invalid ISO week"):
        column(spark, ["2025-W53"], weeks.parse_iso_week)


def test_labels(spark):
    refs = ["Cluster 2", "1", "2.7", "0", "-3", "none", None]
    assert column(spark, refs, labels.parse_cluster_ref) == [1, 0, 1, None, None, None, None]
    assert column(spark, [" a@x.org, ,b@y.org,"], labels.recipient_list) == [["a@x.org", "b@y.org"]]
    assert column(spark, [4.5, 4.0, None], labels.rating_text, "v double") == ["4.5", "4.0", "-"]
    assert column(spark, [date(2026, 4, 5), None], labels.long_date, "v date") == ["April 05, 2026", None]
    assert column(spark, [5, None], labels.stars, "v int") == ["5★", "★-"]
