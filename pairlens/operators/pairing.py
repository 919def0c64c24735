"""Bringing both sides together, pair by pair, whatever the skew.

The ER side is unique per pair; the truth side may hold any number of rows for
one pair. Pairs with more truth rows than one task should handle are split: their
truth rows get a slot from a hash of the row, their one ER row is repeated once
per slot, and the slot joins the key. All other pairs use slot 0.

Through aggregates, shuffles and joins each row travels as one struct (``eo`` for
the ER output, ``tf`` for the truth), its values as one text (see ``dense``), and is taken apart after the last join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import MATCHED, NOT_MATCHED, ValidationConfig
from ..functions.keys import pair_key
from ..functions.rules import opposite, pair_matrix
from .dense import dense, spread

# Null-safe identity of a pair that equi-joins and groupings share, so that a
# partitioning by it serves all of them: the keys with NULL read as '', and
# which of them were NULL.
PAIR_ID = ["_ka", "_kb", "_kn"]

# How many truth rows of a pair are spelled out at a time for one ER row.
ROWS_AT_ONCE = 10_000


def with_pair_id(df: DataFrame, config: ValidationConfig, stored: bool = False) -> DataFrame:
    """Add ``PAIR_ID``; for rows ``stored`` by pair, without NULL keys, the keys as they are, so that Spark sees the storage's order."""
    if stored:
        keys = {i: F.col(c) for i, c in zip(PAIR_ID, config.key_columns)}
        return df.withColumns({**keys, "_kn": F.lit(0)})
    first, second = (F.col(c) for c in config.key_columns)
    return df.withColumns(
        {
            "_ka": F.coalesce(first, F.lit("")),
            "_kb": F.coalesce(second, F.lit("")),
            "_kn": F.when(first.isNull(), 1).otherwise(0) + F.when(second.isNull(), 2).otherwise(0),
        }
    )


def pairing_id(config: ValidationConfig) -> dict[str, Column]:
    """What the two sides are paired on, in terms of ``PAIR_ID``.

    The pair itself by default. Compat mode pairs on the key text, in which
    NULL and '' are the same and dashes inside keys are ambiguous.
    """
    if config.compat:
        return {"_kt": pair_key(["_ka", "_kb"])}
    return {c: F.col(c) for c in PAIR_ID}


def over_limit(load: DataFrame, ids: Iterable[str], splits: str, config: ValidationConfig) -> DataFrame:
    """The pairs of ``load`` (ids, ``_rows``) to split, and into how many parts.

    A pair is listed if it has more than ``hot_pair_rows`` rows and more than a
    ``max_hot_pairs``-th of all rows. Fewer than ``max_hot_pairs`` pairs can have that
    many, whatever the data, which is what makes the list safe to broadcast; a pair left whole is
    no more than that part of the table, and so is a part of a split one.
    """
    share = load.agg(F.coalesce(F.sum("_rows"), F.lit(0)) / config.max_hot_pairs).scalar()
    parts = F.ceil(F.col("_rows") / F.greatest(F.lit(float(config.hot_pair_rows)), share)).cast("int").alias(splits)
    return load.where((F.col("_rows") > config.hot_pair_rows) & (F.col("_rows") > share)).select(*ids, parts)


def heavy_pairs(profile: DataFrame, config: ValidationConfig) -> DataFrame:
    """The pairs to split by their truth rows, and into how many slots (``_splits``), from a truth profile."""
    ids = pairing_id(config)
    rows = F.col("_yes_rows") + F.col("_no_rows")
    load = profile.select(*[e.alias(n) for n, e in ids.items()], rows.alias("_rows"))
    if config.compat:
        load = load.groupBy(*ids).agg(F.sum("_rows").alias("_rows"))
    return over_limit(load, ids, "_splits", config)


def heavy_er_pairs(er: DataFrame, config: ValidationConfig) -> DataFrame:
    """The pairs to split by their ER rows (with ``PAIR_ID``), and into how many parts (``_parts``)."""
    return over_limit(er.groupBy(*PAIR_ID).agg(F.count(F.lit(1)).alias("_rows")), PAIR_ID, "_parts", config)


def _every(count: str) -> Column:
    """0 to the number of parts less one; 0 for a pair that is not split."""
    return F.explode(F.sequence(F.lit(0), F.coalesce(F.col(count), F.lit(1)) - 1))


def _one_of(count: str, hashed: Iterable[str]) -> Column:
    # Never NULL, so that no join looks for NULLs below the exchanges, which would keep plans that share them from doing so.
    return F.coalesce(F.pmod(F.xxhash64(*hashed), F.coalesce(F.col(count), F.lit(1))).cast("int"), F.lit(0))


def spread_over_slots(unique: DataFrame, heavy: DataFrame, ids: Iterable[str]) -> DataFrame:
    """Repeat each row once per slot of its pair; adds ``_slot`` and ``_splits``."""
    return unique.join(F.broadcast(heavy), list(ids), "left").withColumn("_slot", _every("_splits"))


def with_row_slot(rows: DataFrame, heavy: DataFrame, ids: Iterable[str], hashed: Iterable[str]) -> DataFrame:
    """Give each row one slot of its pair, by a hash of the row; adds ``_slot``."""
    listed = rows.join(F.broadcast(heavy), list(ids), "left")
    return listed.withColumn("_slot", _one_of("_splits", hashed)).drop("_splits")


def rows_in_slots(rows: DataFrame, heavy: DataFrame, config: ValidationConfig) -> DataFrame:
    """The distinct ``rows`` (``tf``, as one text) and how often each occurs (``copies``), where the pairing wants them: with its ids, ``PAIR_ID`` and ``_slot``, and so dealt.

    Rows go by pair from the start, which keeps like rows together. Those of a pair that is split are combined twice: among rows that the same
    task read, then in their slot, so no task gets more than one copy of a row from each task that read it.
    """
    ids = pairing_id(config)
    on = [*ids, "_slot"]
    # As in any grouping, 0.0 and -0.0 are one value; their texts are two.
    zeros = {f.name: F.expr(f"CASE WHEN `{f.name}` = 0 THEN 0D ELSE `{f.name}` END") for f in rows.schema.fields if f.dataType == T.DoubleType()}
    packed = with_pair_id(rows.withColumns(zeros), config).withColumns(ids).select(*dict.fromkeys((*ids, *PAIR_ID)), F.struct(*dense(rows.schema.fields)).alias("tf"))
    listed = packed.join(F.broadcast(heavy), list(ids), "left")
    read_by = F.when(F.col("_splits").isNotNull(), F.spark_partition_id()).otherwise(0)
    dealt = listed.select(*packed.columns, _one_of("_splits", ["tf"]).alias("_slot"), read_by.alias("_task"))
    same = list(dict.fromkeys((*on, *packed.columns)))
    combined = dealt.repartition(*on, "_task").groupBy(*same, "_task").agg(F.count(F.lit(1)).alias("copies"))
    return combined.drop("_task").repartition(*on).groupBy(*same).agg(F.sum("copies").alias("copies"))


def without_counterpart(rows: DataFrame, others: DataFrame, config: ValidationConfig, heavy: DataFrame | None = None) -> DataFrame:
    """The ``rows`` (with ``PAIR_ID``) whose pair the input ``others`` lacks; of that, the distinct keys are read.

    With ``heavy``, the ``rows`` are those of ``rows_in_slots``, and the keys are repeated once per slot.
    """
    ids = pairing_id(config)
    known = with_pair_id(others, config).select(*[e.alias(n) for n, e in ids.items()]).distinct()
    if heavy is None:
        return rows.withColumns(ids).join(known, list(ids), "left_anti")
    on = [*ids, "_slot"]
    return rows.join(spread_over_slots(known, heavy, ids).select(*on), on, "left_anti")


def flips(exceptions: DataFrame, heavy: DataFrame | None, config: ValidationConfig) -> DataFrame:
    """The exception pairs under what the sides are paired on (and ``_slot``, with ``heavy``): ``_flips``, an array of (_ka, _kb).

    Repeats are removed here, so the frame crosses one exchange, with the key of the pairing.
    """
    ids = pairing_id(config)
    keyed, on = exceptions.withColumns(ids), list(ids)
    if heavy is not None:
        keyed, on = spread_over_slots(keyed, heavy, ids), [*on, "_slot"]
    return keyed.groupBy(*on).agg(F.collect_set(F.struct("_ka", "_kb")).alias("_flips"))


def exceptions_in_place(exceptions: DataFrame) -> DataFrame:
    """The distinct exception pairs in slot 0, by the key of the pairing; nothing is repeated per slot, see ``with_hot_exceptions``."""
    # No literal, which would be no part of the exchange's key.
    keyed = exceptions.withColumn("_slot", F.when(F.length("_ka") < 0, 1).otherwise(0))
    return keyed.select(*PAIR_ID, "_slot").distinct().withColumn("_listed", F.lit(True))


def with_hot_exceptions(heavy: DataFrame, listed: DataFrame) -> DataFrame:
    """The list of split pairs, and which of them are exceptions (``_hot``), so that this reaches every slot with the list."""
    # An inner join, as a semi join would be moved below the distinct and cost the frame an exchange more.
    hot = listed.join(F.broadcast(heavy.select(*PAIR_ID)), PAIR_ID).select(*PAIR_ID, F.col("_listed").alias("_hot"))
    return heavy.join(F.broadcast(hot), PAIR_ID, "left")


def _flipped_rows(rows: DataFrame, flipping: DataFrame, on: list[str]) -> DataFrame:
    """Truth rows, and whether they are of an exception pair (``_reversed``); keeps ``_flips``."""
    flipped = (F.col("_kn") == 0) & F.array_contains("_flips", F.struct("_ka", "_kb"))
    return rows.join(flipping, on, "left").withColumn("_reversed", flipped)


def _spread_truth(rows: DataFrame, fields: Iterable[T.StructField]) -> DataFrame:
    """``rows`` with ``tf`` taken apart, the verdict of those that are ``_reversed`` the other way round."""
    apart = spread(rows, "tf", fields)
    if "_reversed" not in rows.columns:
        return apart
    status = F.col("tf.match_status_manual")
    return apart.withColumn("tf", F.col("tf").withField("match_status_manual", F.when(F.col("_reversed"), opposite(status)).otherwise(status)))


def flip_truth(
    rows: DataFrame, fields: Iterable[T.StructField], heavy: DataFrame, exceptions: DataFrame | None, config: ValidationConfig
) -> DataFrame:
    """The truth ``rows`` of ``rows_in_slots`` (with ``PAIR_ID``), taken apart into ``fields``, with the verdict of exception pairs reversed."""
    if exceptions is not None:
        rows = _flipped_rows(rows, flips(exceptions, heavy, config), [*pairing_id(config), "_slot"])
    return _spread_truth(rows, fields)


def join_sides(
    er: DataFrame,
    truth: DataFrame,
    fields: Iterable[T.StructField],
    spread_er: Callable[[DataFrame], DataFrame],
    heavy: DataFrame,
    config: ValidationConfig,
    exceptions: DataFrame | None = None,
    how: str = "full_outer",
    keep: Iterable[str] = (),
) -> DataFrame:
    """Join of ER rows and truth rows by pair, a full outer one by default: eo, error_matrix, tf, copies, and ``keep`` of ``er``.

    Both inputs carry ``PAIR_ID`` next to their own columns (``er``: eo, said_yes,
    said_no; ``truth``: tf, copies, and the slot that ``rows_in_slots`` gave), the rows as texts. They are taken apart after the join, ``eo`` by
    ``spread_er`` and ``tf`` into ``fields``. A side that has no row for a pair is NULL. A frame of ``exceptions`` joins the truth
    rows where they already are for the pairing, and reverses what they say there.
    """
    ids = pairing_id(config)
    on = [*ids, "_slot"]
    left = spread_over_slots(er.withColumns(ids), heavy, ids)
    right, flipped, kept = truth, None, ["tf", "copies"]
    if exceptions is not None:
        right, kept = _flipped_rows(right, flips(exceptions, heavy, config), on), [*kept, "_flips", "_reversed"]
        pair = [F.col(f"eo.{c}").alias(i) for c, i in zip(config.key_columns, PAIR_ID)]
        flipped = F.array_contains("_flips", F.struct(*pair))
    left = left.select(*[F.col(c).alias(f"{c}_eo") for c in on], "eo", "said_yes", "said_no", "_splits", *keep)
    right = right.select(*[F.col(c).alias(f"{c}_tf") for c in on], *kept)
    matrix = pair_matrix(F.col("eo.match_status_er"), F.col("said_yes"), F.col("said_no"), flipped)
    # A split pair has truth rows, so its ER row in a slot without any is surplus.
    surplus = F.col("_splits").isNotNull() & F.col("_slot_tf").isNull()
    joined = left.join(right, [F.col(f"{c}_eo") == F.col(f"{c}_tf") for c in on], how).where(~surplus)
    apart = _spread_truth(spread_er(joined.select("eo", "said_yes", "said_no", *kept, *keep)), fields)
    return apart.select("eo", matrix.alias("error_matrix"), "tf", "copies", *keep)


def join_stored(er: DataFrame, truth: DataFrame) -> DataFrame:
    """What ``join_sides`` gives, for two sides stored by pair without NULL keys and hot pairs: a plain join on the keys as they lie."""
    on = PAIR_ID[:2]
    left = er.select(*[F.col(c).alias(f"{c}_eo") for c in on], "eo", "said_yes", "said_no")
    right = truth.select(*[F.col(c).alias(f"{c}_tf") for c in on], "tf", "copies")
    matrix = pair_matrix(F.col("eo.match_status_er"), F.col("said_yes"), F.col("said_no"))
    joined = left.join(right, [F.col(f"{c}_eo") == F.col(f"{c}_tf") for c in on], "full_outer")
    return joined.select("eo", matrix.alias("error_matrix"), "tf", "copies")


def join_all_rows(er: DataFrame, profile: DataFrame, heavy: DataFrame, heavy_er: DataFrame) -> DataFrame:
    """Left join of ER rows and truth rows by pair, where both sides may repeat a pair: eo and the truth's ``verdict``, with the number of truth rows that say so (``_rows``).

    An ER row without truth rows has no verdict and counts once; ``repeated`` spells the rows out.
    Of a truth row only its verdict is asked for, so the truth comes as a ``profile``: one row per pair with the number of its rows of either
    verdict. ``er`` has ``PAIR_ID`` and eo. The ER rows of a hot pair are dealt to parts, copies of a row as well. The truth rows of a pair hot on
    that side only are numbered and split into slots, each with a copy of the ER rows. For a pair hot on both sides the parts
    do, so that ER rows are never repeated more often than the pair has rows on either side.
    """
    slots = F.greatest(F.lit(1), F.ceil(F.col("_splits") / F.coalesce("_parts", F.lit(1)))).cast("int").alias("_slots")
    grid = F.broadcast(heavy.join(F.broadcast(heavy_er), PAIR_ID, "full_outer").select(*PAIR_ID, slots, "_parts"))
    on = [*PAIR_ID, "_part", "_slot"]
    # Copies have one hash; the task that read them tells them apart and is the same if it runs again.
    dealt = F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("eo", F.spark_partition_id()), "_parts").cast("int")).otherwise(0)
    left = er.join(grid, PAIR_ID, "left").withColumn("_part", dealt).withColumn("_slot", _every("_slots"))
    right = profile.join(grid, PAIR_ID, "left").withColumn("_slot", _every("_slots")).withColumn("_part", _every("_parts"))
    yes, rows, held = F.col("_yes_rows"), F.col("_yes_rows") + F.col("_no_rows"), F.coalesce("_slots", F.lit(1))
    # The truth rows of a pair that say Matched are numbered first; a slot holds those from ``_first`` to before ``_next``.
    first, after = (F.expr(f"(_rows * (_slot + {k})) div _held") for k in (0, 1))
    right = right.withColumns({"_rows": rows, "_held": held}).withColumns({"_first": first, "_next": after})
    met = F.greatest(F.lit(0).cast("long"), F.least("_next", yes) - F.col("_first"))
    right = right.select(*[F.col(c).alias(f"{c}_tf") for c in on], met.alias("_met"), (F.col("_next") - F.col("_first") - met).alias("_unmet"))
    left = left.select(*[F.col(c).alias(f"{c}_eo") for c in on], "eo")
    joined = left.join(right, [F.col(f"{c}_eo") == F.col(f"{c}_tf") for c in on], "left")
    # All that depends on the verdict is worked out for the rows of one verdict together.
    runs = joined.withColumn("_yes", F.explode(F.array(F.lit(True), F.lit(False))))
    count = F.when(F.col("_met").isNull(), F.when(F.col("_yes"), 0).otherwise(1)).when(F.col("_yes"), F.col("_met")).otherwise(F.col("_unmet"))
    verdict = F.when(F.col("_met").isNotNull(), F.when(F.col("_yes"), MATCHED).otherwise(NOT_MATCHED))
    return runs.select("eo", verdict.alias("verdict"), count.cast("long").alias("_rows")).where(F.col("_rows") > 0)


def repeated(df: DataFrame, rows: str) -> DataFrame:
    """Each row as often as its column ``rows``, which is left out, says: at least once."""
    # In two steps, so that no array is long however many rows meet.
    step, count = F.lit(ROWS_AT_ONCE).cast("long"), F.col(rows)
    kept = [c for c in df.columns if c != rows]
    begins = df.withColumn("_begin", F.explode(F.sequence(F.lit(0).cast("long"), count - 1, step)))
    held = begins.select(*kept, F.least(step, count - F.col("_begin")).alias("_held"))
    return held.withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), "_held"))).select(*kept)
