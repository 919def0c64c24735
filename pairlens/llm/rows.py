"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Characters between words, by the contract.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def whole_text(column: str | Column) -> Column:
    """The text as a string, null as empty."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("string"), F.lit(""))


def key_parts(column: str | Column) -> list[Column]:
    """A nullable integer id as two columns that join and group without null rules: is it null, and its value or 0."""
    column = F.col(column) if isinstance(column, str) else column
    return [column.isNull(), F.coalesce(column.cast("long"), F.lit(0))]
