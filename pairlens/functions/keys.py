"""Pair keys and row fingerprints."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, functions as F

from ..config import NOT_HASHED


def quoted(name: str) -> str:
    """A column name, possibly of a struct field, as SQL text."""
    return ".".join(f"`{part}`" for part in name.split("."))


def dashed_text(columns: Iterable[str]) -> Column:
    """The values as text joined by '-', with NULL read as the empty string.

    One SQL expression: a call into the JVM per column would cost more than
    validating a small table.
    """
    values = ", ".join(f"coalesce(cast({quoted(c)} AS string), '')" for c in columns)
    return F.expr(f"concat_ws('-', {values})")


def pair_key(key_columns: Iterable[str]) -> Column:
    """Key text of a pair. Ambiguous when the keys hold dashes themselves."""
    return dashed_text(key_columns)


def hashed_columns(columns: Iterable[str]) -> list[str]:
    """The columns that make up the fingerprint of a row."""
    return [c for c in columns if c not in NOT_HASHED]


def row_fingerprint(columns: Iterable[str]) -> Column:
    """MD5 over the text of all hashed columns."""
    return F.md5(dashed_text(hashed_columns(columns)))
