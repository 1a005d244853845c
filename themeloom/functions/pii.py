"""Redaction of personal data in review text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTED = "[REDACTED]"

# What is redacted, specific patterns before the catch-all.
PATTERNS = {
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "aadhaar": r"\b\d{4}[\s-]?\d{4}[\s-]?\d{4}\b",
    "phone_in": r"(?<!\d)(?:\+91[\s-]?|0)?[6-9]\d{9}(?!\d)",
    "long_digits": r"\b\d{8,}\b",
}


# What a match begins with: told from one character, where a word boundary asks for the classes of two.
_FIRST = {
    "email": r"(?=[A-Za-z0-9._%+-])",
    "pan": r"(?=[A-Z])",
    "aadhaar": r"(?=\d)",
    "phone_in": r"(?=[+0-9])",
    "long_digits": r"(?=\d)",
}


def _unicode(kind: str) -> str:
    return "(?U)" + _FIRST[kind] + PATTERNS[kind]


def _scrub(text: Column, kind: str) -> Column:
    return F.regexp_replace(text, _unicode(kind), REDACTED)


def scrub_email(text: Column) -> Column:
    return _scrub(text, "email")


def scrub_pan(text: Column) -> Column:
    return _scrub(text, "pan")


def scrub_aadhaar(text: Column) -> Column:
    return _scrub(text, "aadhaar")


def scrub_phone_in(text: Column) -> Column:
    return _scrub(text, "phone_in")


def scrub_long_digits(text: Column) -> Column:
    return _scrub(text, "long_digits")


def scrub_pii(text: Column) -> Column:
    """All patterns in order; only texts with an @ or four digits in a row can hold any."""
    numbers = [kind for kind in PATTERNS if kind != "email"]

    def emails(t: Column) -> Column:
        return F.when(F.contains(t, F.lit("@")), _scrub(t, "email")).otherwise(t)

    def digits(t: Column) -> Column:
        return F.when(F.regexp_like(t, F.lit(r"\p{Nd}{4}")), reduce(_scrub, numbers, t)).otherwise(t)

    # a variable of transform stands for the text, so that no pattern is applied twice
    return F.transform(F.transform(F.array(text), emails), digits)[0]


def pii_matches(text: Column, kind: str) -> Column:
    """How often one pattern occurs."""
    return F.regexp_count(text, F.lit(_unicode(kind)))
