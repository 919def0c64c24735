"""Row and column comparison of two sides."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..config import MATCH, MISMATCH
from .keys import quoted


def fingerprint_status(left: Column, right: Column) -> Column:
    """``Match`` when both fingerprints are there and equal."""
    return F.when(left == right, MATCH).otherwise(MISMATCH)


def same_value(left: Column, right: Column) -> Column:
    """Null-safe equality."""
    return left.eqNullSafe(right)


def same_values(left: str, right: str, name: str) -> Column:
    """Null-safe equality of the same field of two structs."""
    return F.expr(f"{quoted(left)}.{quoted(name)} <=> {quoted(right)}.{quoted(name)}")


def name_tokens(name: Column, compat: bool = False) -> Column:
    """Words of a name.

    Everything but a-z separates words. By default the name is lower-cased
    first and empty words are dropped. In compat mode capitals separate words
    too, and a separator at either end leaves an empty word.
    """
    if compat:
        return F.split(F.regexp_replace(name, "[^a-z]", " "), "\\s+")
    words = F.split(F.regexp_replace(F.lower(name), "[^a-z]+", " "), " ")
    return F.array_remove(words, "")


def shares_token(left: Column, right: Column, compat: bool = False) -> Column:
    """True when the names have a word in common; false for NULL on either side.

    Equal names agree without being taken apart, which also covers names with
    no a-z letter at all.
    """
    overlap = F.arrays_overlap(name_tokens(left, compat), name_tokens(right, compat))
    return F.coalesce((left == right) | overlap, F.lit(False))


def agreement_bit(agrees: Column) -> Column:
    return F.when(agrees, "1").otherwise("0")


def mismatch_code(agreements: Iterable[Column]) -> Column:
    """One character per compared column: '1' agrees, '0' differs."""
    return F.concat(*[agreement_bit(a) for a in agreements])
