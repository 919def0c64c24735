"""Rows as one text, for the way through exchanges and sorts.

A row of 30 columns spends 8 bytes on each of them before any value, half of them offsets that hardly compress. What
is only carried to its place travels as a struct of one text and the few columns of other types, and is taken apart there.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

TEXT = "_text"

# The types whose text gives the value back exactly.
_AS_TEXT = (T.StringType(), T.DoubleType(), T.IntegerType())

# Always true, but the optimizer cannot know: else a filter on one value would be moved below, and take every row apart anew for each value it reads.
_HERE = "spark_partition_id() >= 0"

# Between values, and before what is spelled in hex.
_BETWEEN, _HEX = "chr(1)", "chr(2)"


def _quoted(name: str) -> str:
    """One name, dots included."""
    return "`" + name.replace("`", "``") + "`"


def _spelled(name: str, kind: T.DataType) -> str:
    """A value as text: NULL is empty; '' and strings that hold one of the two marks or are no UTF-8 are in hex.

    Texts of rows then sort as the rows do, NULL first, column by column, wherever strings alone differ.
    """
    column = _quoted(name)
    if kind != T.StringType():
        return f"coalesce(cast({column} AS string), '')"
    odd = f"{column} = '' OR contains({column}, {_BETWEEN}) OR contains({column}, {_HEX}) OR NOT is_valid_utf8({column})"
    return f"CASE WHEN {column} IS NULL THEN '' WHEN {odd} THEN concat({_HEX}, hex({column})) ELSE {column} END"


def _read(part: str, kind: T.DataType) -> str:
    if kind != T.StringType():
        return f"cast(nullif({part}, '') AS {kind.simpleString()})"
    hexed = f"cast(unhex(substr({part}, 2)) AS string)"
    return f"CASE WHEN {part} = '' THEN NULL WHEN startswith({part}, {_HEX}) THEN {hexed} ELSE {part} END"


def dense(fields: Iterable[T.StructField]) -> list[Column]:
    """The columns ``fields`` of a frame as ``TEXT`` and the columns whose type has no exact text."""
    fields = list(fields)
    texts = ", ".join(_spelled(f.name, f.dataType) for f in fields if f.dataType in _AS_TEXT)
    return [F.expr(f"concat_ws({_BETWEEN}, {texts})").alias(TEXT), *[F.col(_quoted(f.name)) for f in fields if f.dataType not in _AS_TEXT]]


def spread(df: DataFrame, name: str, fields: Iterable[T.StructField]) -> DataFrame:
    """Replace the struct ``name`` of ``dense`` columns by the struct of ``fields``; what else it holds comes first, and NULL stays NULL."""
    fields = list(fields)
    known, parts = {TEXT, *[f.name for f in fields]}, f"{name}_parts"
    texts = [f.name for f in fields if f.dataType in _AS_TEXT]
    more = [f"{name}.{_quoted(f.name)} AS {_quoted(f.name)}" for f in df.schema[name].dataType.fields if f.name not in known]
    values = [
        f"{_read(f'{parts}[{texts.index(f.name)}]', f.dataType)} AS {_quoted(f.name)}"
        if f.name in texts
        else f"{name}.{_quoted(f.name)} AS {_quoted(f.name)}"
        for f in fields
    ]
    row = F.expr(f"CASE WHEN {name} IS NOT NULL AND {_HERE} THEN struct({', '.join([*more, *values])}) END")
    # A column of its own, so that a text is split once.
    split = df.withColumn(parts, F.expr(f"split({name}.{TEXT}, {_BETWEEN}, -1)"))
    return split.withColumn(name, row).drop(parts)
