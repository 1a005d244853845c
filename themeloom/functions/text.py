"""Text columns: cleaning, fingerprints and shortening. All JVM-side except HTML entity decoding."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode white space, and the invisible code points removed from review text.
WHITESPACE = r"[\s\x1c-\x1f]"
#: The same white space, character by character.
_SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
ZERO_WIDTH = r"[\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}\x{00AD}\x{034F}\x{180E}]"


def strip_space(text: Column) -> Column:
    """Drop leading and trailing Unicode white space, keeping what is inside."""
    return F.btrim(text, F.lit(_SPACES))


def review_id(text: Column, rating: Column, review_date: Column) -> Column:
    """Short stable id of a review, from its raw text."""
    return F.substring(dedup_key(text, rating, review_date), 1, 16)


def dedup_key(text: Column, rating: Column, review_date: Column) -> Column:
    """Fingerprint under which two reviews count as copies; the store is not part of it."""
    payload = F.concat_ws(
        "|", F.lower(strip_space(text)), rating.cast("string"), review_date.cast("string")
    )
    return F.sha2(payload, 256)


def html_unescape(text: Column) -> Column:
    """Decode HTML entities; only texts with an ampersand are sent to Python."""

    @F.pandas_udf("string")
    def decode(values: pd.Series) -> pd.Series:
        from html import unescape

        return values.map(unescape, na_action="ignore")

    return F.coalesce(decode(F.when(F.contains(text, F.lit("&")), text)), text)


def strip_zero_width(text: Column) -> Column:
    return F.regexp_replace(text, rf"[[^\x00-\x7F]&&{ZERO_WIDTH}]", "")  # most characters are told by one comparison


def collapse_whitespace(text: Column) -> Column:
    # most characters are told by one comparison, and single spaces stay as they are
    spaced = F.regexp_replace(text, f"[[^ -~]&&[{_SPACES.replace(' ', '')}]]", " ")
    return F.trim(F.regexp_replace(spaced, "  +", " "))


def clean_text(text: Column) -> Column:
    """Entities decoded, invisible characters removed, white space collapsed, in that order."""
    return collapse_whitespace(strip_zero_width(html_unescape(text)))


def truncate_text(text: Column, max_chars: Column | int = 180) -> Column:
    limit = F.lit(max_chars) if isinstance(max_chars, int) else max_chars
    shortened = F.concat(F.substring(text, F.lit(1), limit), F.lit("..."))
    return F.when(F.length(text) > limit, shortened).otherwise(text)


def snippet(text: Column, max_chars: int = 150) -> Column:
    return F.translate(F.substring(text, 1, max_chars), "\n", " ")
