"""Pair tables stored by pair, so that a run over them need not move the stored rows.

Rows of either side go to buckets by a hash of their keys. Rows with a NULL key, which no plain equality
finds, and pairs hot on either side, which no bucket should hold, go to a second table without buckets; both sides
leave out the same pairs, so that each half can be validated on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import ValidationConfig
from ..operators.pairing import PAIR_ID, over_limit, with_pair_id

SIDES = ("er", "truth")

# A bucket is read and sorted by one task, so their number follows the rows.
BUCKET_ROWS = 250_000


def _hot(side: DataFrame, config: ValidationConfig) -> DataFrame:
    load = with_pair_id(side, config).groupBy(*PAIR_ID).agg(F.count(F.lit(1)).alias("_rows"))
    return over_limit(load, PAIR_ID, "_splits", config).select(*PAIR_ID)


def store_pairs(er: DataFrame, truth: DataFrame, name: str, config: ValidationConfig, buckets: int, path: str | None = None) -> None:
    """Write both sides as tables ``name_er``, ``name_er_rest``, ``name_truth`` and ``name_truth_rest``, replacing what is there.

    The same number of buckets for both sides; one file each. That is ``buckets``, doubled until a bucket holds about ``BUCKET_ROWS`` rows of
    either side at most; it is written in the tables. With ``path`` the tables lie under it, else in the warehouse.
    """
    most = max(er.count(), truth.count())
    while buckets * BUCKET_ROWS < most:
        buckets *= 2
    hot = _hot(er, config).union(_hot(truth, config)).distinct().withColumn("_hot", F.lit(True))
    for side, rows in zip(SIDES, (er, truth)):
        # Fewer than 2 x max_hot_pairs entries, so it may be broadcast.
        known = with_pair_id(rows, config).join(F.broadcast(hot), PAIR_ID, "left")
        rest = F.col("_hot").isNotNull() | (F.col("_kn") != 0)
        halves = {f"{name}_{side}": known.where(~rest).select(*rows.columns).repartition(buckets, *config.key_columns)}
        halves[f"{name}_{side}_rest"] = known.where(rest).select(*rows.columns)
        for table, half in halves.items():
            writer = half.write.mode("overwrite").format("parquet")
            if path:
                writer = writer.option("path", f"{path}/{table}")
            if not table.endswith("_rest"):
                writer = writer.bucketBy(buckets, *config.key_columns).sortBy(*config.key_columns)
            writer.saveAsTable(table)


def stored_pairs(spark: SparkSession, name: str, rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both sides of what ``store_pairs`` wrote: the bucketed halves, or the rest."""
    er, truth = (spark.table(f"{name}_{side}{'_rest' if rest else ''}") for side in SIDES)
    return er, truth
