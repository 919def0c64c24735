"""Reading pair tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..config import ValidationConfig
from ..operators.columns import with_key_and_fingerprint
from ..operators.verdict import er_verdicts, exception_pairs, truth_verdicts
from ..schema import conform


def read_table(spark: SparkSession, name: str, format: str | None = None, **options) -> DataFrame:
    """A catalog table or view by name, or files of ``format`` at a path."""
    if format is None:
        return spark.table(name)
    return spark.read.format(format).options(**options).load(name)


def er_scan(df: DataFrame, config: ValidationConfig) -> DataFrame:
    """The selected columns of an ER output with ``match_status_er``."""
    return er_verdicts(conform(df, config), config).drop(*config.helper_columns)


def truth_scan(
    df: DataFrame, config: ValidationConfig, exceptions: DataFrame | None = None
) -> DataFrame:
    """The selected columns of a truth table with ``match_status_manual`` and ``human_review``."""
    truth = conform(df, config, "human_review")
    scored = truth_verdicts(truth, config, exception_pairs(config, exceptions))
    return scored.select(*config.columns, "match_status_manual", "human_review")


def fingerprinted_table(spark: SparkSession, name: str, key_columns: list[str]) -> DataFrame:
    """A table or view with its key text and row fingerprint added."""
    return with_key_and_fingerprint(spark.table(name), key_columns)


def register_views(
    er: DataFrame, truth: DataFrame, er_view: str = "source_data_view", truth_view: str = "target_data_view"
) -> None:
    """Offer the two tables to SQL users, as they are given, under session view names."""
    er.createOrReplaceTempView(er_view)
    truth.createOrReplaceTempView(truth_view)
