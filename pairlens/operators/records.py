"""Record classes, mismatch codes and their explanation.

A record frame has the sides as structs (``eo`` with ``error_matrix``, ``tf``
with ``copies``), NULL where a side lacks the record.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import MATCH, MISMATCH, ValidationConfig
from ..functions.compare import fingerprint_status, mismatch_code, same_values, shares_token
from ..functions.decode import (
    code_status,
    mismatch_deviation,
    mismatch_type,
    mismatching_columns_text,
)
from ..functions.keys import dashed_text, hashed_columns
from .columns import ER_SIDE, TRUTH_SIDE
from .pairing import PAIR_ID, rows_in_slots, with_pair_id
from .verdict import FINGERPRINT, rule_verdict, shown_columns, shown_fields

RECORD_CLASSES = ("match", "mismatch", "extra", "missing")


def _eo(name: str) -> Column:
    return F.col(f"eo.{name}")


def _tf(name: str) -> Column:
    return F.col(f"tf.{name}")


def _in_er() -> Column:
    return F.col("eo").isNotNull()


def _in_truth() -> Column:
    return F.col("tf").isNotNull()


def _in_both() -> Column:
    return _in_er() & _in_truth()


def truth_fields(truth: DataFrame, config: ValidationConfig) -> list[T.StructField]:
    """What a truth row shows, and its verdict."""
    return [*shown_fields(truth, config), T.StructField("match_status_manual", T.StringType())]


def truth_rows(
    truth: DataFrame, config: ValidationConfig, listed: bool = True, stored: bool = False, heavy: DataFrame | None = None
) -> DataFrame:
    """``PAIR_ID``, ``tf`` and ``copies``: distinct truth rows, how often each occurs.

    ER rows are unique per pair, so making the truth distinct here gives the
    same rows as making the joined result distinct, over half the columns.
    Copies are combined on the map side. Where the verdict reads columns that are
    not shown, rows are distinct by what is shown and the verdict. The verdict is that of
    the rule, for the configured exceptions its opposite if ``listed``; a frame of exceptions is left to the pairing.
    With the list of ``heavy`` pairs they come as ``rows_in_slots`` deals them, ``tf`` as one text: ``truth_fields`` tell what it holds.
    """
    shown, copies = shown_columns(truth, config), F.count(F.lit(1)).alias("copies")
    verdict = rule_verdict(config, listed)
    tf = F.struct(*shown, "match_status_manual").alias("tf")
    if heavy is not None:
        return rows_in_slots(truth.select(*shown, verdict.alias("match_status_manual")), heavy, config)
    if config.helper_columns:
        scored = truth.groupBy(*shown, verdict.alias("match_status_manual")).agg(copies)
    else:
        scored = truth.groupBy(*shown).agg(copies).withColumn("match_status_manual", verdict)
    return with_pair_id(scored, config, stored).select(*PAIR_ID, tf, "copies")


def classify_records(pairs: DataFrame, config: ValidationConfig) -> DataFrame:
    """Add ``validation_status`` and ``record_class`` to joined sides.

    Classes: match, mismatch, extra (ER output only), missing (truth only).
    """
    truth_print = F.when(_in_truth(), F.md5(dashed_text(f"tf.{c}" for c in hashed_columns(config.columns))))
    status = F.col("validation_status")
    record_class = (
        F.when(~_in_truth(), "extra")
        .when(~_in_er(), "missing")
        .when(status == MATCH, "match")
        .otherwise("mismatch")
    )
    records = pairs.withColumn("validation_status", fingerprint_status(_eo(FINGERPRINT), truth_print))
    records = records.withColumn("record_class", record_class)
    if not config.compat:
        return records
    # Compat: a differing pair whose source key is NULL is reported nowhere.
    source_key = config.key_columns[0]
    unkeyed = _eo(source_key).isNull() | _tf(source_key).isNull()
    return records.where(~(_in_both() & (status == MISMATCH) & unkeyed))


def agreements(config: ValidationConfig) -> list[Column]:
    """For each compared column, in bit order: do the sides agree?"""
    return [
        shares_token(_eo(c), _tf(c), config.compat)
        if c in config.token_columns
        else same_values("eo", "tf", c)
        for c in config.columns
    ]


def record_code(config: ValidationConfig) -> Column:
    """Bits of a compared pair; all zeros for a record one side lacks."""
    return F.when(_in_both(), mismatch_code(agreements(config))).otherwise("0" * config.unmatched_zeros)


def unmatched_flag(config: ValidationConfig) -> Column:
    """NULL for a compared pair, false for an extra and true for a missing record."""
    missing = _tf(config.key_columns[0]).isNotNull() if config.compat else ~_in_er()
    return F.when(~_in_both(), missing)


def with_codes(records: DataFrame, config: ValidationConfig) -> DataFrame:
    return records.withColumns(
        {"mismatches_code": record_code(config), "extra_or_missing_flag": unmatched_flag(config)}
    )


def with_explanations(coded: DataFrame, config: ValidationConfig) -> DataFrame:
    code, flag, labels = F.col("mismatches_code"), F.col("extra_or_missing_flag"), config.bit_labels
    return coded.withColumns(
        {
            "mismatches_columns": mismatching_columns_text(code, labels),
            "mismatch_deviation": mismatch_deviation(code, labels),
            "mismatch_type": mismatch_type(code, flag, labels, config.entity_column),
            "code_status": code_status(code),
        }
    )


def flat_records(records: DataFrame) -> DataFrame:
    """Unpack the sides into columns with a side suffix, the other columns after them."""
    sides = {"eo": ER_SIDE, "tf": TRUTH_SIDE}
    unpacked = [
        F.col(f"{side}.{f.name}").alias(f.name + suffix)
        for side, suffix in sides.items()
        for f in records.schema[side].dataType.fields
    ]
    return records.select(*unpacked, *[c for c in records.columns if c not in sides])


def combine(*parts: DataFrame, disjoint: bool = False) -> DataFrame:
    """Union by name without equal rows.

    ``disjoint`` says that no two rows of the parts are equal, so that none need to be looked for.
    """
    united = reduce(DataFrame.unionByName, parts)
    return united if disjoint else united.distinct()


def result_columns(config: ValidationConfig, batch_id: str) -> list[Column | str]:
    """Final projection: ER-side values, the truth verdict, the explanation."""

    def value(name: str) -> Column | str:
        if name in config.key_columns and not config.compat:
            return F.when(_in_er(), _eo(name)).otherwise(_tf(name)).alias(name)
        return f"eo.{name}"

    return [
        *map(value, config.columns),
        "eo.match_status_er",
        "error_matrix",
        f"eo.{FINGERPRINT}",
        "tf.match_status_manual",
        *(["tf.human_review"] if "human_review" not in config.columns else []),
        "validation_status",
        "mismatches_code",
        "extra_or_missing_flag",
        "mismatches_columns",
        "mismatch_deviation",
        "mismatch_type",
        F.lit(batch_id).alias("batch_id"),
        *(["code_status"] if config.with_code_status else []),
    ]
