"""Exact deduplication by a 128-bit content hash, with byte comparison. Native functions only.

Texts are equal when they are identical after each run of blanks is one space.
Rows are grouped by the hash and, inside it, by the bytes of the text, so that
two texts with one hash stay apart. The grouping combines on the map side: a
group with a third of all rows sends one text per task. What goes back to the
rows is narrow: two hashes, the id that stays and the size of the group. The
join that carries it has no aggregate above it, so adaptive execution splits
the large group.

Defined cases: a null text counts as empty; a null id never wins against
another id, and a group with null ids only keeps a null id. Rows that repeat id
and text are copies like others in ``group_size``; ``drop_copies`` leaves one of
them, the smallest by its other columns. Extra columns pass through
``drop_copies`` whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .rows import BLANK, key_parts, whole_text


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(whole_text(text), BLANK, " ")


def _hashed(rows: DataFrame, text: str, hash_of: Callable[[Column], Column]) -> DataFrame:
    return rows.withColumn("norm", normalised(text)).withColumns(
        {"hash": F.unhex(hash_of(F.col("norm"))), "sha": F.unhex(F.sha2("norm", 256))}
    )


def copy_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("raw"))
    hashed = _hashed(rows, "raw", hash_of)
    groups = (
        hashed.groupBy("hash", "norm")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("hash", F.unhex(F.sha2("norm", 256)).alias("sha"), "keep_id", "group_size")
    )
    return (
        hashed.select("doc_id", "hash", "sha")
        .join(groups, ["hash", "sha"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
        )
    )


def drop_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of: Callable[[Column], Column] = F.md5
) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each group the one with the smallest id."""
    absent, value = key_parts("row.`%s`" % id_col)
    rows = docs.select(F.struct("*").alias("row"))
    keys = rows.select("row", absent.alias("absent"), value.alias("value"), F.col(f"row.`{text_col}`").alias("raw"))
    staying = (
        _hashed(keys.select("absent", "value", "raw"), "raw", hash_of)
        .groupBy("hash", "norm")
        .agg(F.min(F.struct("absent", "value")).alias("id"))
        .select("id.absent", "id.value", "hash", F.unhex(F.sha2("norm", 256)).alias("sha"))
    )
    return (
        _hashed(keys, "raw", hash_of)
        .drop("raw", "norm")
        .join(staying, ["absent", "value", "hash", "sha"])
        .groupBy("absent", "value", "hash", "sha")
        .agg(F.min("row").alias("row"))
        .select("row.*")
    )
