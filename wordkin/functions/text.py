"""Word and field expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wordkin.symbols import EMPTY, HOLE

__all__ = ["EMPTY", "HOLE"]


def chars(word: Column) -> Column:
    return F.when(F.length(word) == 0, F.array().cast("array<string>")).otherwise(F.split(word, ""))


def bigrams(word: Column) -> Column:
    """Two-character substrings, in order, repeats kept."""
    n = F.length(word)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substr(word, i, F.lit(2)))
    )


def bigram_set(word: Column) -> Column:
    return F.array_distinct(bigrams(word))


def boundary_bigrams(word: Column) -> Column:
    """(prev, next) structs, with the boundary symbol on both ends."""
    edge = F.array(F.lit(EMPTY))
    c = chars(word)
    return F.arrays_zip(F.concat(edge, c).alias("prev"), F.concat(c, edge).alias("next"))


def gloss_of(token: Column) -> Column:
    return F.substring_index(token, "(", 1)


def first_variant(forms: Column) -> Column:
    return F.regexp_extract(forms, r"^[^,/ (\n]*", 0)


def clean_language(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\.", "")


def dice(x: Column, y: Column) -> Column:
    """Dice coefficient of two arrays without repeats; NULL when both are empty."""
    return F.try_divide(F.lit(2.0) * F.size(F.array_intersect(x, y)), (F.size(x) + F.size(y)).cast("double"))


def keyed_share(parts: list[Column], buckets: int = 10_000) -> Column:
    """Deterministic bucket number of a row, the same in every engine that has md5."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
