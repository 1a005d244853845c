"""Order-free fuzzy similarity of two texts, 0 to 100.

Both texts are split on white space into token sets. With ``I`` the shared tokens and ``ab``, ``ba``
what only one side has, the score is the best normalised indel similarity among the three pairings
of ``I``, ``I + ab`` and ``I + ba``. Two pairings and every length need only token sets and stay in
the JVM; the third needs the longest common subsequence of ``ab`` and ``ba``, the one Python helper.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from themeloom.functions.text import WHITESPACE


def token_set(text: Column) -> Column:
    """Distinct tokens."""
    return F.array_distinct(F.array_remove(F.split(text, rf"(?U){WHITESPACE}+"), ""))


def joined_length(tokens: Column) -> Column:
    """Length of the tokens joined by single spaces."""
    return F.length(F.array_join(tokens, " "))


def rest_text(tokens: Column, shared: Column) -> Column:
    """What one side has alone, in token order."""
    return F.array_join(F.sort_array(F.array_except(tokens, shared)), " ")


@dataclass(frozen=True)
class SetOverlap:
    """Lengths of the three token groups of a pair, as columns."""

    shared: Column
    only_a: Column
    only_b: Column
    contained: Column
    blank: Column

    @property
    def _gap(self) -> Column:
        return F.when(self.shared > 0, 1).otherwise(0)

    @property
    def _total(self) -> Column:
        return 2 * (self.shared + self._gap) + self.only_a + self.only_b

    def _shared_against(self, rest: Column) -> Column:
        return 100.0 - 100.0 * (self._gap + rest) / (2 * self.shared + self._gap + rest)

    def set_score(self) -> Column:
        """The part of the score that token sets decide alone."""
        partial = F.greatest(self._shared_against(self.only_a), self._shared_against(self.only_b))
        return (
            F.when(self.blank, 0.0)
            .when(self.contained, 100.0)
            .when(self.shared > 0, partial)
            .otherwise(0.0)
        )

    def rest_score(self, common: Column) -> Column:
        """Similarity of the two unshared rests, given their common subsequence length."""
        distance = self.only_a + self.only_b - 2 * common
        return F.when(self.blank, 0.0).otherwise(100.0 - 100.0 * distance / self._total)

    def rest_bound(self) -> Column:
        """No ``rest_score`` can exceed this: a common subsequence is at most the shorter rest."""
        return self.rest_score(F.least(self.only_a, self.only_b))


def set_overlap(
    size_a: Column, length_a: Column, size_b: Column, length_b: Column,
    size_i: Column, length_i: Column,
) -> SetOverlap:
    """Lengths of a pair from token count and joined length of each side and of the shared tokens."""

    def rest(size: Column, length: Column) -> Column:
        # joined lengths add up, but for the space between the two groups where both exist
        return length - length_i - F.when((size_i > 0) & (size > size_i), 1).otherwise(0)

    return SetOverlap(
        shared=length_i,
        only_a=rest(size_a, length_a),
        only_b=rest(size_b, length_b),
        contained=(size_i > 0) & ((size_i == size_a) | (size_i == size_b)),
        blank=(size_a == 0) | (size_b == 0),
    )


def _common_length(x: str | None, y: str | None) -> int | None:
    if x is None or y is None:
        return None
    short, long = (x, y) if len(x) <= len(y) else (y, x)
    # one bit per character of the longer text, one step per character of the shorter
    chars = np.frombuffer(long.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    places = {c: int.from_bytes(np.packbits(chars == ord(c), bitorder="little").tobytes(), "little") for c in set(short)}
    full = (1 << len(long)) - 1
    open_bits = full
    for c in short:
        hits = open_bits & places[c]
        if hits:
            open_bits = ((open_bits + hits) | (open_bits - hits)) & full
    return len(long) - open_bits.bit_count()


def common_subsequence_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence (bit-parallel, Hyyrö 2004), as an Arrow UDF."""

    @F.pandas_udf("int")
    def lcs(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_common_length(x, y) for x, y in zip(left, right)], dtype="Int32")

    return lcs(a, b)


def token_set_ratio(a: Column, b: Column) -> Column:
    """Similarity of two text columns; case and punctuation count."""
    ta, tb = token_set(a), token_set(b)
    shared = F.array_intersect(ta, tb)
    overlap = set_overlap(
        F.size(ta), joined_length(ta), F.size(tb), joined_length(tb),
        F.size(shared), joined_length(shared),
    )
    decided = overlap.set_score()
    # Null where token sets already decide, so that Python sees only the open pairs.
    open_pair = overlap.rest_bound() > decided
    rest_a = F.when(open_pair, rest_text(ta, shared))
    rest_b = F.when(open_pair, rest_text(tb, shared))
    common = common_subsequence_length(rest_a, rest_b)
    return F.greatest(decided, F.coalesce(overlap.rest_score(common), F.lit(0.0)))
