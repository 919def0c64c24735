"""Operators that only reshape columns; none of them shuffles."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..functions.keys import pair_key, row_fingerprint

ER_SIDE = "_eo"
TRUTH_SIDE = "_tf"


def with_key_and_fingerprint(
    df: DataFrame,
    key_columns: Iterable[str],
    key_name: str = "key_columns",
    fingerprint_name: str = "md5_hash_concat_column",
) -> DataFrame:
    """Add the key text and the MD5 fingerprint of every row."""
    return df.withColumns({key_name: pair_key(key_columns), fingerprint_name: row_fingerprint(df.columns)})


def mark_side(df: DataFrame, suffix: str) -> DataFrame:
    """Append ``suffix`` to every column name."""
    return df.select([F.col(c).alias(c + suffix) for c in df.columns])


def strip_sides(df: DataFrame) -> DataFrame:
    """Remove a trailing side suffix from every column name that has one.

    The suffix counts only at the end, so names such as ``geo_effort`` or
    ``my_tf_idf`` stay whole.
    """
    return df.withColumnsRenamed(
        {c: c[: -len(ER_SIDE)] for c in df.columns if c.endswith((ER_SIDE, TRUTH_SIDE))}
    )


def fill_blanks(df: DataFrame, filler: str = "null") -> DataFrame:
    """NULL and empty strings become ``filler``; other types stay as they are."""
    return df.na.fill(filler).na.replace("", filler)
