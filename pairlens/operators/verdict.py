"""Verdicts of both sides and the error matrix of the ER output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..config import MATCHED, ValidationConfig
from ..functions.keys import row_fingerprint
from ..functions.rules import match_status, opposite, pair_matrix
from .dense import dense, spread
from .pairing import PAIR_ID, exceptions_in_place, heavy_pairs, with_hot_exceptions, with_pair_id, with_row_slot

FINGERPRINT = "src_tgt_md5_hash_column"


def er_verdicts(er: DataFrame, config: ValidationConfig) -> DataFrame:
    return er.withColumn("match_status_er", match_status(config.rule))


def shown_columns(df: DataFrame, config: ValidationConfig) -> list[str]:
    return [c for c in df.columns if c not in config.helper_columns]


def shown_fields(df: DataFrame, config: ValidationConfig) -> list[T.StructField]:
    return [df.schema[c] for c in shown_columns(df, config)]


def is_listed(config: ValidationConfig) -> Column:
    """Is the pair of a row one of the configured exceptions? NULL where a key is.

    The list is a literal in the plan and looked up in a hash set, so it costs neither a join nor an exchange.
    The length of the first key keeps pairs apart whose keys hold the separator.
    """
    first, second = (F.col(c).cast("string") for c in config.key_columns)
    listed = [f"{len(a)}:{a}:{b}" for a, b in config.exceptions if a is not None and b is not None]
    return F.concat(F.length(first).cast("string"), F.lit(":"), first, F.lit(":"), second).isin(listed)


def exception_pairs(config: ValidationConfig, given: DataFrame | None) -> DataFrame | None:
    """``PAIR_ID`` of the ``given`` exception pairs without NULL keys, repeats included; None without them.

    Pairs whose truth verdict is flipped. They replace the configured list. Nothing is
    hinted: Spark broadcasts the list if its size, known or measured, allows.
    """
    if given is None:
        return None
    keyed = given.select(*[F.col(c).cast("string").alias(c) for c in config.key_columns]).dropna()
    return with_pair_id(keyed, config).select(*PAIR_ID)


def rule_verdict(config: ValidationConfig, listed: bool) -> Column:
    """``match_status_manual`` before a frame of exceptions: by the rule, flipped for the configured pairs if ``listed``."""
    return match_status(config.rule, is_listed(config) if listed and config.exceptions else None)


def truth_verdicts(truth: DataFrame, config: ValidationConfig, exceptions: DataFrame | None = None) -> DataFrame:
    """Add ``match_status_manual``, flipped for the exception pairs.

    A given frame is joined with the rows, hot pairs split as everywhere; the configured list needs no join.
    """
    scored = truth.withColumn("match_status_manual", rule_verdict(config, listed=exceptions is None))
    if exceptions is None:
        return scored
    by_pair = config.but(compat=False)
    heavy = heavy_pairs(truth_profile(truth, by_pair), by_pair)
    listed = exceptions_in_place(exceptions)
    rows = with_row_slot(with_pair_id(scored, config), with_hot_exceptions(heavy, listed), PAIR_ID, scored.columns)
    joined = rows.join(listed, [*PAIR_ID, "_slot"], "left")
    flipped = F.coalesce("_hot", "_listed").isNotNull()
    status = F.when(flipped, opposite("match_status_manual")).otherwise(F.col("match_status_manual"))
    return joined.select(*truth.columns, status.alias("match_status_manual"))


def unique_pairs(er: DataFrame, config: ValidationConfig, stored: bool = False) -> DataFrame:
    """``PAIR_ID`` and ``eo``, the preferred ER row of the pair with its fingerprint; see ``dense_pairs``."""
    return spread_er(dense_pairs(er, config, stored), er, config)


def spread_er(pairs: DataFrame, er: DataFrame, config: ValidationConfig) -> DataFrame:
    """``pairs`` with the ``eo`` of ``dense_pairs``, taken apart."""
    spelled = F.col("eo").withField(FINGERPRINT, F.lower(F.hex(f"eo.{FINGERPRINT}")))
    return spread(pairs, "eo", shown_fields(er, config)).withColumn("eo", spelled)


def dense_pairs(er: DataFrame, config: ValidationConfig, stored: bool = False) -> DataFrame:
    """``PAIR_ID`` and ``eo``, the preferred ER row of the pair: its fingerprint as 16 bytes, and the row as one text.

    Best rank first, then highest score, then fingerprint; equal fingerprints
    are settled by the column values, so the survivor never depends on row
    order. Rows are compared by the few fixed-width fields before them; no aggregate holds a row. Spark
    cuts every pair to one row before the exchange as well: however many rows a pair has, each task sends on one.
    """
    row = F.struct(F.unhex(row_fingerprint(config.columns)).alias(FINGERPRINT), *dense(shown_fields(er, config)))
    packed = with_pair_id(er, config, stored).select(*PAIR_ID, row.alias("eo"), "er_rank", "er_score")
    preference = (F.col("er_rank").asc_nulls_last(), F.col("er_score").desc_nulls_last(), F.col("eo"))
    place = F.row_number().over(Window.partitionBy(*PAIR_ID).orderBy(*preference))
    return packed.withColumn("_place", place).where(F.col("_place") == 1).select(*PAIR_ID, "eo")


def dedup_pairs(er: DataFrame, config: ValidationConfig) -> DataFrame:
    """One row per pair, in the shown columns of ``er`` and the fingerprint; reads ``er_rank`` and ``er_score``."""
    return unique_pairs(er, config).select(*[f"eo.{c}" for c in (*shown_columns(er, config), FINGERPRINT)])


def truth_profile(
    truth: DataFrame, config: ValidationConfig, exceptions: DataFrame | None = None, listed: bool = False, stored: bool = False
) -> DataFrame:
    """Per pair: how many truth rows say Matched, and how many do not?

    Two counters with map-side combine over keys and scores only. Every user
    of the profile needs both, so their plans share one exchange. Exceptions
    concern whole pairs, so a frame of them swaps the two counters afterwards; ``listed`` applies the configured ones.
    """
    met = rule_verdict(config, listed) == MATCHED
    yes, no = F.col("_yes_rows"), F.col("_no_rows")
    profile = (
        with_pair_id(truth, config, stored)
        .groupBy(*PAIR_ID)
        .agg(F.count_if(met).alias("_yes_rows"), F.count_if(~met).alias("_no_rows"))
    )
    if exceptions is None:
        return profile
    flipped = F.col("_flipped").isNotNull()
    return profile.join(exceptions.distinct().withColumn("_flipped", F.lit(True)), PAIR_ID, "left").select(
        *PAIR_ID,
        F.when(flipped, no).otherwise(yes).alias("_yes_rows"),
        F.when(flipped, yes).otherwise(no).alias("_no_rows"),
    )


def with_truth(unique: DataFrame, profile: DataFrame, stored: bool = False) -> DataFrame:
    """Each unique ER pair with ``said_yes`` and ``said_no``: does a truth row of its pair say so? NULL without truth rows.

    ``pair_rows`` is how many truth rows the pair has. Pairs with a NULL key never meet the truth's verdicts here. Both inputs are already partitioned by the pair, so
    the join moves no rows.
    """
    known = F.col("_kn") == 0
    said = [F.when(known, F.col(f"_{s}_rows") > 0).alias(f"said_{s}") for s in ("yes", "no")]
    pair_rows = (F.col("_yes_rows") + F.col("_no_rows")).alias("pair_rows")
    on = PAIR_ID[:2] if stored else PAIR_ID
    right = profile.drop("_kn") if stored else profile
    return unique.join(right, on, "left").select(*unique.columns, *said, pair_rows)


def with_error_matrix(unique: DataFrame, profile: DataFrame) -> DataFrame:
    """Classify each unique ER pair against the truth verdict of its pair."""
    matrix = pair_matrix(F.col("eo.match_status_er"), F.col("said_yes"), F.col("said_no"))
    return with_truth(unique, profile).select(*unique.columns, matrix.alias("error_matrix"))
