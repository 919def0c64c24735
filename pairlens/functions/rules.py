"""Verdict rule: does a scored pair count as matched?"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..config import MATCHED, NOT_MATCHED, MatchRule


def meets_rule(rule: MatchRule) -> Column:
    """Top-ranked, with a suffix score, and either a high total or all parts high.

    NULL scores make the condition unknown, which every user below reads as
    "not met".
    """
    high_total = F.col("er_score") >= rule.er_score_threshold
    all_parts = (
        (F.col("er_score") > rule.er_score_min)
        & (F.col("first_name_score") >= rule.first_name_score)
        & (F.col("last_name_score") >= rule.last_name_score)
        & (F.col("middle_name_score") >= rule.middle_name_score)
        & (F.col("city_score") >= rule.city_score)
        & (F.col("address_line_score") > rule.address_line_score)
        & (F.col("state_score") >= rule.state_score)
        & (F.col("postal_code_score") >= rule.postal_code_score)
    )
    return (
        (F.col("er_rank") == rule.er_rank)
        & (F.col("suffix_score") > rule.suffix_score)
        & (high_total | all_parts)
    )


def match_status(rule: MatchRule, flipped: Column | None = None) -> Column:
    """``Matched`` / ``NOT Matched``; the other way round where ``flipped`` holds."""
    met = F.coalesce(meets_rule(rule), F.lit(False))
    if flipped is not None:
        met = met != F.coalesce(flipped, F.lit(False))
    return F.when(met, MATCHED).otherwise(NOT_MATCHED)


def opposite(status: str | Column) -> Column:
    """The other verdict."""
    status = F.col(status) if isinstance(status, str) else status
    return F.when(status == MATCHED, NOT_MATCHED).otherwise(MATCHED)


def error_matrix(er_status: Column, truth_status: Column) -> Column:
    """TP, TN, FP or FN; NULL when either verdict is absent."""
    said_yes, is_yes = er_status == MATCHED, truth_status == MATCHED
    said_no, is_no = er_status == NOT_MATCHED, truth_status == NOT_MATCHED
    return (
        F.when(said_yes & is_yes, "TP")
        .when(said_no & is_no, "TN")
        .when(said_yes & is_no, "FP")
        .when(said_no & is_yes, "FN")
    )


def pair_matrix(er_status: Column, yes: Column, no: Column, flipped: Column | None = None) -> Column:
    """The error matrix of a pair; where its truth rows disagree, one Matched is enough.

    ``yes`` and ``no`` tell what the truth rows say, the other way round where ``flipped`` holds.
    """
    if flipped is not None:
        yes, no = F.when(flipped, no).otherwise(yes), F.when(flipped, yes).otherwise(no)
    return error_matrix(er_status, F.when(yes, MATCHED).when(no, NOT_MATCHED))
