"""Reading a mismatch code back: columns, deviation, category.

All of these are column expressions over a string of '0' and '1' and a tuple of
labels, the label at position i naming bit i.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from ..config import MATCH, MISMATCH


def _bit(code: Column, position: int) -> Column:
    return F.substring(code, position + 1, 1)


def zero_count(code: Column) -> Column:
    return F.length(code) - F.length(F.replace(code, F.lit("0"), F.lit("")))


def _checked(code: Column, labels: Sequence[str], result: Column, if_no_zero: Column) -> Column:
    """``result``, or an error when a zero bit lies beyond the last label.

    Codes without a zero, which are most of them, take the short way out.
    """
    beyond = F.substring(code, len(labels) + 1, 2**31 - 1).contains("0")
    message = F.lit(f"mismatch code has a zero beyond its {len(labels)} labels")
    return (
        F.when(code.isNull(), F.lit(None))
        .when(~code.contains("0"), if_no_zero)
        .when(beyond, F.raise_error(message))
        .otherwise(result)
    )


def mismatching_columns(code: Column, labels: Sequence[str]) -> Column:
    """array<string> of the labels whose bit is zero, in bit order."""
    named = F.array(*[F.when(_bit(code, i) == "0", label) for i, label in enumerate(labels)])
    no_label = F.array().cast("array<string>")
    return _checked(code, labels, F.filter(named, lambda label: label.isNotNull()), no_label)


def mismatching_columns_text(code: Column, labels: Sequence[str]) -> Column:
    """The same list as comma-separated text, without building an array."""
    named = [F.when(_bit(code, i) == "0", label) for i, label in enumerate(labels)]
    return _checked(code, labels, F.concat_ws(",", *named), F.lit(""))


def mismatch_deviation(code: Column, labels: Sequence[str]) -> Column:
    """Differing columns in percent of the labels, cut to a whole number.

    Divides before multiplying: the other order rounds some shares differently.
    """
    share = (zero_count(code) / F.lit(len(labels))) * F.lit(100)
    return _checked(code, labels, share.cast("int"), F.lit(0))


def code_status(code: Column) -> Column:
    return F.when(code.isNull(), F.lit(None)).otherwise(
        F.when(code.contains("0"), MISMATCH).otherwise(MATCH)
    )


def label_bit(code: Column, labels: Sequence[str], label: str) -> Column:
    """The bit of one label; '1' where the label or the bit is absent."""
    if label not in labels:
        return F.lit("1")
    bit = _bit(code, list(labels).index(label))
    return F.when(bit == "", "1").otherwise(bit)


def mismatch_type(
    code: Column, flag: Column, labels: Sequence[str], entity_column: str = "target_entity_id"
) -> Column:
    """Category of a row, NULL for a NULL code.

    ``flag`` is NULL for a compared pair, false for a row only the ER output
    has and true for one only the truth has.
    """
    zeros = zero_count(code)
    entity_bit = label_bit(code, labels, entity_column)
    compared = flag.isNull()
    return (
        F.when(code.isNull(), F.lit(None))
        .when(compared & (zeros == 0), "NA")
        .when(compared & (entity_bit == "0") & (zeros == 1), "Only WE_PID mismatch")
        .when(compared & (entity_bit == "0"), "WE_PID and other column mismatch")
        .when(compared & (entity_bit == "1"), "Other columns mismatch")
        .when((zeros > 0) & ~flag, "Extra Record in ER Output")
        .when((zeros > 0) & flag, "Record Missing from ER Output")
        .otherwise("Unknown Error")
    )
