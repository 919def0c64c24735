"""Declared types of the pair tables and the check of inputs against them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .config import PAIR_COLUMNS, ValidationConfig


def _declared_type(name: str) -> T.DataType:
    if name == "er_rank":
        return T.IntegerType()
    if name.endswith("_score"):
        return T.DoubleType()
    return T.StringType()


PAIR_SCHEMA = T.StructType([T.StructField(c, _declared_type(c)) for c in PAIR_COLUMNS])
TRUTH_SCHEMA = T.StructType([*PAIR_SCHEMA.fields, T.StructField("human_review", T.StringType())])

_DECLARED = {f.name: f.dataType for f in TRUTH_SCHEMA.fields}


def _spelling(df: DataFrame, wanted: Iterable[str]) -> dict[str, str]:
    """The input's name of each wanted column, by the session's rule for upper and lower case."""
    if df.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        found = {c: c for c in df.columns}
    else:
        lowered = {c.lower(): c for c in reversed(df.columns)}
        found = {c: c if c in df.columns else lowered.get(c.lower()) for c in wanted}
    absent = [c for c in wanted if not found.get(c)]
    if absent:
        raise ValueError(f"input lacks columns {absent}")
    return found


def _declared(name: str, source: str, have: T.DataType) -> Column:
    """The column in its declared type; a number that the type cannot hold fails the job."""
    column, declared = F.col(f"`{source}`"), _DECLARED.get(name, have)
    if have == declared:
        return column.alias(name)
    cast = column.cast(declared)
    if isinstance(have, T.NumericType) and isinstance(declared, T.NumericType):
        lossy = column.isNotNull() & (cast.cast(have) != column)
        refused = F.raise_error(F.concat(F.lit(f"{name} cannot be {declared.simpleString()}: "), column.cast("string")))
        cast = F.when(lossy, refused.cast(declared)).otherwise(cast)
    return cast.alias(name)


def conform(df: DataFrame, config: ValidationConfig, *extra: str) -> DataFrame:
    """Project the configured columns, ``extra`` and what the verdicts read, each in its declared type.

    One fixed type per column keeps the text behind the fingerprints equal on
    both sides. Columns outside the declared schema keep the type they have.
    """
    wanted = list(dict.fromkeys((*config.columns, *extra, *config.helper_columns)))
    source = _spelling(df, wanted)
    have = {f.name: f.dataType for f in df.schema.fields}
    return df.select(*[_declared(c, source[c], have[source[c]]) for c in wanted])
