"""Small scalar helpers for prompts, reports and delivery."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.text import strip_space
from themeloom.schema import GOOGLE_PLAY


def parse_cluster_ref(ref: Column) -> Column:
    """A model's 1-based cluster reference (``2``, ``"2"``, ``"Cluster 2"``) → 0-based id or null."""
    digits = F.regexp_extract(ref, r"(\d+)", 1).try_cast("int") - 1
    negative = F.rlike(ref, F.lit(r"^\s*-"))
    return F.when(~negative & (digits >= 0), digits)


def source_label(source: Column) -> Column:
    return F.when(source == GOOGLE_PLAY, "Google Play").otherwise("App Store")


def long_date(day: Column) -> Column:
    return F.date_format(day, "MMMM dd, yyyy")


def iso_date(day: Column, missing: str = "unknown date") -> Column:
    return F.coalesce(F.date_format(day, "yyyy-MM-dd"), F.lit(missing))


def rating_text(avg_rating: Column) -> Column:
    """One decimal, ``-`` when there is no rating."""
    return F.coalesce(F.round(avg_rating, 1).cast("decimal(4,1)").cast("string"), F.lit("-"))


def stars(rating: Column) -> Column:
    return F.coalesce(F.concat(rating.cast("string"), F.lit("★")), F.lit("★-"))


def prompt_size(prompt: Column, system_text: Column) -> Column:
    return F.length(prompt) + F.length(system_text)


def token_estimate(prompt: Column, system_text: Column) -> Column:
    return prompt_size(prompt, system_text) / F.lit(4)


def recipient_list(recipients: Column) -> Column:
    parts = F.transform(F.split(recipients, ","), strip_space)
    return F.filter(parts, lambda part: part != "")


def escape_html(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text
