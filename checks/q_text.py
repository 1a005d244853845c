"""Checks of scalar functions and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from checks.adapter import PII_SQL, Tables, clean_sql, scrub_sql, tokens_sql
from checks.registry import query
from themeloom.functions import labels, pii, text, weeks
from themeloom.functions.fuzzy import joined_length, token_set, token_set_ratio
from themeloom.operators import filters


@query(
    "review_id",
    r"""SELECT doc_id, substr(sha256(lower(regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''))
               || '|' || rating || '|' || review_date), 1, 16) AS review_id
        FROM (SELECT * REPLACE (chr(10) || ' ' || text || chr(9) AS text) FROM v_reviews)""",
)
def _review_id(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("\n "), F.col("text"), F.lit("\t"))
    return t.reviews.select(
        "doc_id", text.review_id(raw, F.col("rating"), F.col("review_date")).alias("review_id")
    )


@query("dedup_key", "SELECT doc_id, dedup_key FROM v_keyed")
def _dedup_key(t: Tables) -> DataFrame:
    return t.keyed.select("doc_id", "dedup_key")


# The entities the pages have; the ampersand last, as decoding happens once.
@query(
    "html_unescape",
    """SELECT page_id, regexp_replace(replace(replace(replace(html, '&middot;', chr(183)), '&copy;', chr(169)), '&quot;', '"'),
                                      '&amp;?', '&', 'g') AS html FROM pages""",
)
def _html_unescape(t: Tables) -> DataFrame:
    return t.table("pages").select("page_id", text.html_unescape(F.col("html")).alias("html"))


@query(
    "strip_zero_width",
    r"""SELECT doc_id, text AS stripped FROM documents""",
)
def _strip_zero_width(t: Tables) -> DataFrame:
    marked = F.regexp_replace(F.col("text"), "([aeiou])", "​$1﻿­")
    return t.table("documents").select("doc_id", text.strip_zero_width(marked).alias("stripped"))


@query(
    "collapse_whitespace",
    f"SELECT doc_id, {clean_sql('text')} AS collapsed FROM documents",
)
def _collapse(t: Tables) -> DataFrame:
    wide = F.translate(F.col("text"), " ", " ")
    return t.table("documents").select(
        "doc_id", text.collapse_whitespace(F.concat(F.lit("　\x1c"), wide)).alias("collapsed")
    )


@query(
    "clean_text",
    rf"""SELECT doc_id, {clean_sql("'&' || text || ' ' || chr(10) || '<b>'")} AS cleaned FROM documents""",
)
def _clean_text(t: Tables) -> DataFrame:
    raw = F.concat(F.lit("&amp;​"), F.col("text"), F.lit("&nbsp;\n&lt;b&#62;"))
    return t.table("documents").select("doc_id", text.clean_text(raw).alias("cleaned"))


# Kinds the texts lack are added to every row, from its own number.
_MARKED_SQL = (
    "text || ' id ABCDE' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0') || 'Z mail u' || doc_id || '@a-b.co.in'"
    " || ' call +91-9' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || ' no 1234-5678 ' || lpad(CAST(doc_id % 10000 AS VARCHAR), 4, '0')"
    " || ' acct ' || (10000000 + doc_id) || ' pin ' || (doc_id % 1000)"
)


def _with_pii() -> Column:
    k = F.col("doc_id")
    number = k.cast("string")
    low = F.lpad((k % 10000).cast("string"), 4, "0")
    return F.concat(
        "text", F.lit(" id ABCDE"), low, F.lit("Z mail u"), number, F.lit("@a-b.co.in call +91-9"),
        F.lpad(number, 9, "0"), F.lit(" no 1234-5678 "), low, F.lit(" acct "),
        (10000000 + k).cast("string"), F.lit(" pin "), (k % 1000).cast("string"),
    )


@query("scrub_pii", f"SELECT doc_id, {scrub_sql(_MARKED_SQL)} AS scrubbed FROM documents")
def _scrub(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", pii.scrub_pii(_with_pii()).alias("scrubbed"))


# Kind of every entry of PII_SQL.
_SQL_KINDS = ("email", "pan", "aadhaar", "phone_in", "phone_in", "long_digits")


def _single(kind: str) -> None:
    scrubbed = _MARKED_SQL
    for pattern, into in (p for place, p in zip(_SQL_KINDS, PII_SQL, strict=True) if place == kind):
        scrubbed = f"regexp_replace({scrubbed}, '{pattern}', '{into}', 'g')"
    oracle = f"""SELECT doc_id, scrubbed, CAST((length(scrubbed) - length(replace(scrubbed, '[REDACTED]', ''))) / 10 AS BIGINT) AS hits
                 FROM (SELECT doc_id, {scrubbed} AS scrubbed FROM documents)"""

    @query(f"scrub_{kind}", oracle)
    def build(t: Tables) -> DataFrame:
        scrub = getattr(pii, f"scrub_{kind}")
        return t.table("documents").select(
            "doc_id",
            scrub(_with_pii()).alias("scrubbed"),
            pii.pii_matches(_with_pii(), kind).cast("long").alias("hits"),
        )


for _kind in pii.PATTERNS:
    _single(_kind)


@query(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 180 THEN substr(text, 1, 180) || '...' ELSE text END AS short FROM documents",
)
def _truncate(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", text.truncate_text(F.col("text")).alias("short"))


@query(
    "snippet",
    "SELECT doc_id, replace(substr(text, 1, 150), chr(10), ' ') AS snippet FROM documents",
)
def _snippet(t: Tables) -> DataFrame:
    return t.table("documents").select("doc_id", text.snippet(F.col("text")).alias("snippet"))


_WEEK_SQL = """SELECT event_id, y || '-w' || w AS week_text, y, w,
    CAST(date_trunc('week', make_date(y, 1, 4)) AS DATE) + CAST(7 * (w - 1) AS INTEGER) AS monday
    FROM (SELECT event_id, CAST(2015 + user_id % 15 AS INTEGER) AS y, CAST(event_id % 55 AS INTEGER) AS w FROM events)"""


@query(
    "parse_iso_week",
    f"""SELECT event_id, CASE WHEN ok THEN monday END AS week_start, CASE WHEN ok THEN monday + 6 END AS week_end
        FROM (SELECT *, w BETWEEN 1 AND 53 AND isoyear(monday) = y AS ok FROM ({_WEEK_SQL}))""",
)
def _parse_week(t: Tables) -> DataFrame:
    week = F.concat(
        (2015 + F.col("user_id") % 15).cast("string"), F.lit("-w"), (F.col("event_id") % 55).cast("string")
    )
    return t.table("events").select(
        "event_id", weeks.try_parse_iso_week(week).alias("p")
    ).select("event_id", "p.week_start", "p.week_end")


@query(
    "iso_week_of",
    "SELECT o_orderkey, strftime(o_orderdate, '%G-W%V') AS iso_week FROM orders",
)
def _iso_week(t: Tables) -> DataFrame:
    return t.table("orders").select(
        "o_orderkey", weeks.iso_week_of(F.col("o_orderdate").cast("date")).alias("iso_week")
    )


@query(
    "review_window",
    """SELECT o_orderkey, monday - 63 AS window_start, monday + 6 AS window_end
       FROM (SELECT o_orderkey, CAST(date_trunc('week', o_orderdate) AS DATE) AS monday FROM orders)""",
)
def _review_window(t: Tables) -> DataFrame:
    window = weeks.review_window(weeks.week_of(F.col("o_orderdate")))
    return t.table("orders").select("o_orderkey", window.alias("w")).select("o_orderkey", "w.*")


@query(
    "parse_cluster_ref",
    r"""SELECT event_id, CASE WHEN ref LIKE '-%' THEN NULL
                              WHEN d >= 1 THEN d - 1 END AS cluster_id
        FROM (SELECT event_id, ref, TRY_CAST(regexp_extract(ref, '(\d+)', 1) AS INTEGER) AS d
              FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'Cluster ' || user_id WHEN 1 THEN CAST(user_id AS VARCHAR)
                    WHEN 2 THEN '-' || user_id WHEN 3 THEN event_type ELSE user_id || '.7' END AS ref FROM events))""",
)
def _cluster_ref(t: Tables) -> DataFrame:
    kind, user = F.col("event_id") % 5, F.col("user_id").cast("string")
    ref = (
        F.when(kind == 0, F.concat(F.lit("Cluster "), user))
        .when(kind == 1, user)
        .when(kind == 2, F.concat(F.lit("-"), user))
        .when(kind == 3, F.col("event_type"))
        .otherwise(F.concat(user, F.lit(".7")))
    )
    return t.table("events").select("event_id", labels.parse_cluster_ref(ref).alias("cluster_id"))


@query(
    "source_label",
    "SELECT doc_id, CASE WHEN source = 'google_play' THEN 'Google Play' ELSE 'App Store' END AS label FROM v_reviews",
)
def _source_label(t: Tables) -> DataFrame:
    return t.reviews.select("doc_id", labels.source_label(F.col("source")).alias("label"))


@query(
    "report_formats",
    """SELECT o_orderkey, strftime(d, '%B %d, %Y') AS long_date, coalesce(strftime(d, '%Y-%m-%d'), 'unknown date') AS iso_date,
              coalesce(CAST(CAST(round(r, 1) AS DECIMAL(4,1)) AS VARCHAR), '-') AS rating_text,
              coalesce(n || '★', '★-') AS stars
       FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate END AS d,
                    CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 500) / 100.0 END AS r,
                    CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 5 + 1 END AS n FROM orders)""",
)
def _formats(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    d = F.when(k % 7 > 0, F.col("o_orderdate").cast("date"))
    # decimal, as in SQL, so that both round the same number
    r = F.when(k % 5 > 0, ((k % 500) / F.lit(100)).cast("decimal(6,2)"))
    return t.table("orders").select(
        "o_orderkey",
        labels.long_date(d).alias("long_date"),
        labels.iso_date(d).alias("iso_date"),
        labels.rating_text(r).alias("rating_text"),
        labels.stars(F.when(k % 3 > 0, k % 5 + 1)).alias("stars"),
    )


@query(
    "prompt_size",
    """SELECT doc_id, CAST(length(text) + length(lang) AS INTEGER) AS chars,
              (length(text) + length(lang)) / 4.0 AS tokens FROM documents""",
)
def _prompt_size(t: Tables) -> DataFrame:
    body, head = F.col("text"), F.col("lang")
    return t.table("documents").select(
        "doc_id",
        labels.prompt_size(body, head).alias("chars"),
        labels.token_estimate(body, head).alias("tokens"),
    )


@query(
    "recipient_list",
    """SELECT c_custkey, array_to_string(list_filter(list_transform(string_split(' ' || c_name || ' , ,' || c_mktsegment || '@x.org,', ','),
              lambda x: trim(x)), lambda x: x <> ''), ';') AS recipients FROM customer""",
)
def _recipients(t: Tables) -> DataFrame:
    raw = F.concat(F.lit(" "), F.col("c_name"), F.lit(" , ,"), F.col("c_mktsegment"), F.lit("@x.org,"))
    return t.table("customer").select(
        "c_custkey", F.array_join(labels.recipient_list(raw), ";").alias("recipients")
    )


@query("min_length", "SELECT doc_id FROM v_keyed WHERE length(text) >= 10")
def _min_length(t: Tables) -> DataFrame:
    return filters.min_length(t.keyed).select("doc_id")


@query(
    "in_window",
    "SELECT doc_id FROM v_reviews WHERE review_date BETWEEN DATE '2024-01-08' AND DATE '2024-03-17'",
)
def _in_window(t: Tables) -> DataFrame:
    start, end = F.lit("2024-01-08").cast("date"), F.lit("2024-03-17").cast("date")
    return filters.in_window(t.reviews, start, end).select("doc_id")


@query(
    "filter_language",
    """SELECT doc_id FROM (SELECT doc_id, CASE WHEN n_chars % 11 > 0 THEN lang END AS lang, (n_chars % 101) / 100.0 AS p FROM documents)
       WHERE coalesce(lang = 'en' OR p < 0.9, true)""",
)
def _language(t: Tables) -> DataFrame:
    n = F.col("n_chars")
    detected = t.table("documents").select(
        "doc_id",
        F.when(n % 11 > 0, F.col("lang")).alias("lang"),
        ((n % 101) / F.lit(100)).alias("lang_prob"),
    )
    return filters.filter_language(detected).select("doc_id")


@query(
    "token_sets",
    f"""SELECT conv_id, turn, len(both_sides) AS shared, CAST(length(array_to_string(both_sides, ' ')) AS BIGINT) AS shared_length,
               len(a) - len(both_sides) AS only_a, len(b) - len(both_sides) AS only_b
        FROM (SELECT *, list_filter(a, lambda x: list_contains(b, x)) AS both_sides
              FROM (SELECT l.conv_id, l.turn, {tokens_sql('l.text')} AS a, {tokens_sql('r.text')} AS b
                    FROM conversations l JOIN conversations r ON r.conv_id = l.conv_id AND r.turn = l.turn + 1))""",
)
def _token_sets(t: Tables) -> DataFrame:
    """Shared and unshared tokens of every turn and the next."""
    a, b = F.col("a"), F.col("b")
    sets = _next_turns(t).select(
        "conv_id", "turn", token_set(F.col("text")).alias("a"), token_set(F.col("next")).alias("b")
    ).withColumn("both", F.array_intersect("a", "b"))
    return sets.select(
        "conv_id",
        "turn",
        F.size("both").cast("long").alias("shared"),
        joined_length(F.col("both")).cast("long").alias("shared_length"),
        F.size(F.array_except(a, b)).cast("long").alias("only_a"),
        F.size(F.array_except(b, a)).cast("long").alias("only_b"),
    )


def _next_turns(t: Tables) -> DataFrame:
    turns = t.table("conversations")
    following = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return turns.join(following, ["conv_id", "turn"])


@query("token_set_ratio")
def _ratio(t: Tables) -> DataFrame:
    """Similarity of every turn with the next; checked against brute force in the tests."""
    score = token_set_ratio(F.col("text"), F.col("next"))
    return _next_turns(t).select("conv_id", "turn", F.round(score, 6).alias("score"))
