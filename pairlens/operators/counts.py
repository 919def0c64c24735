"""Sizes of both inputs and of the four record classes, without building records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..config import ValidationConfig
from ..functions.keys import row_fingerprint
from .pairing import PAIR_ID, pairing_id, with_pair_id


def _keyed(config: ValidationConfig) -> Column:
    """Can a differing pair with this key be a mismatch? Not in compat, if the source key is NULL."""
    return F.col("_kn").bitwiseAND(1) == 0 if config.compat else F.lit(True)


def _er_prints(er: DataFrame, config: ValidationConfig) -> DataFrame:
    """Per pair the fingerprint of the row that ``unique_pairs`` keeps; rows of equal fingerprint need no choice here."""
    rank, score = F.col("er_rank"), F.col("er_score")
    preference = F.struct(
        rank.isNull().alias("unranked"),
        rank.alias("rank"),
        score.isNull().alias("unscored"),
        (-score).alias("score"),
        row_fingerprint(config.columns).alias("print"),
    )
    return with_pair_id(er, config).groupBy(*PAIR_ID).agg(F.min(preference)["print"].alias("print"))


def pair_counts(er: DataFrame, truth: DataFrame, config: ValidationConfig) -> DataFrame:
    """One row: source, target, match, mismatch, extra, missing.

    ``source`` counts ER pairs, ``target`` truth rows; the classes count a record as
    often as its truth row occurs. One scan of the ER output, two of the truth (keys for
    the rows of each pair, all columns for fingerprints). What is joined is combined
    before each shuffle, so neither a hot pair nor a much repeated row is one task.
    """
    ids, keyed = pairing_id(config), _keyed(config)
    rows, keyed_rows = F.count(F.lit(1)), F.count_if(keyed)

    def known(df: DataFrame) -> DataFrame:
        return df.withColumns(ids)

    truth = with_pair_id(truth, config)
    profile = known(truth).groupBy(*ids).agg(rows.alias("n"), keyed_rows.alias("n_keyed"))
    pairs = known(_er_prints(er, config)).join(profile, list(ids), "full_outer")
    in_er = F.col("print").isNotNull()
    pairs = pairs.groupBy(*ids, "print").agg(
        F.count_if(in_er).alias("e"),
        F.count_if(in_er & keyed).alias("e_keyed"),
        F.first("n").alias("n"),
        F.first("n_keyed").alias("n_keyed"),
    )
    prints = known(truth.withColumn("print", row_fingerprint(config.columns)))
    prints = prints.groupBy(*ids, "print").agg(rows.alias("same"), keyed_rows.alias("same_keyed"))
    met = pairs.join(prints, [*ids, "print"], "full_outer")

    def total(value: Column, where: Column | None = None) -> Column:
        return F.coalesce(F.sum(value if where is None else F.when(where, value)), F.lit(0))

    e, n, same = F.col("e"), F.col("n"), F.col("same")
    differing = total(F.col("e_keyed") * F.col("n_keyed")) - total(F.col("e_keyed") * F.col("same_keyed"))
    return met.agg(
        total(e).alias("source"),
        total(same).alias("target"),
        total(e * same).alias("match"),
        differing.alias("mismatch"),
        total(e, n.isNull()).alias("extra"),
        total(n, e == 0).alias("missing"),
    )
