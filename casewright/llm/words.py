"""Words and word sequences as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word: a maximal run of letters and digits.
WORD = r"[\p{L}\p{N}]+"


def words_of(text: Column) -> Column:
    """Lower-case words of a text in order; null for null."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def sequence_hashes(words: Column, n: int) -> Column:
    """64-bit hashes of all sequences of ``n`` words in order, empty where there are fewer words.

    The words are bound once through a one-element array: an expression used inside a lambda is otherwise evaluated
    again for every element.
    """

    def hashed(w: Column) -> Column:
        last = F.size(w) - n
        each = F.transform(F.sequence(F.lit(0), last), lambda k: F.xxhash64(*(F.element_at(w, k + (j + 1)) for j in range(n))))
        return F.when(last >= 0, each).otherwise(F.array().cast("array<bigint>"))

    return F.transform(F.array(words), hashed)[0]
