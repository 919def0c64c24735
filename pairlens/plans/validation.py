"""The validation run: one lazy plan from two inputs to the explained result."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from ..config import ValidationConfig
from ..functions.rules import error_matrix
from ..operators.columns import fill_blanks
from ..operators.counts import pair_counts
from ..operators.pairing import (
    PAIR_ID,
    flip_truth,
    heavy_er_pairs,
    heavy_pairs,
    join_all_rows,
    join_sides,
    join_stored,
    repeated,
    with_pair_id,
    without_counterpart,
)
from ..operators.records import (
    RECORD_CLASSES,
    classify_records,
    combine,
    flat_records,
    result_columns,
    truth_fields,
    truth_rows,
    with_codes,
    with_explanations,
)
from ..operators.verdict import (
    dense_pairs,
    er_verdicts,
    exception_pairs,
    shown_columns,
    spread_er,
    truth_profile,
    unique_pairs,
    with_error_matrix,
    with_truth,
)
from ..schema import conform
from ..sources.buckets import store_pairs, stored_pairs
from ..sources.sinks import report, save, save_batch
from ..sources.tables import read_table


def new_batch_id() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d%H%M%S")


class Validator:
    """Compares an ER output with a truth table.

    Nothing here runs a job except what is called ``save``. ``exceptions`` may be a DataFrame holding the two
    key columns; it replaces the pairs of the configuration.
    """

    def __init__(
        self,
        config: ValidationConfig | None = None,
        batch_id: str | None = None,
        exceptions: DataFrame | None = None,
    ) -> None:
        self.config = config or ValidationConfig()
        self.batch_id = batch_id or new_batch_id()
        self._exceptions = exceptions

    # -- sides ------------------------------------------------------------
    def er_input(self, er_df: DataFrame) -> DataFrame:
        return self._cleaned(conform(er_df, self.config))

    def truth_input(self, truth_df: DataFrame) -> DataFrame:
        return self._cleaned(conform(truth_df, self.config, "human_review"))

    def _cleaned(self, df: DataFrame) -> DataFrame:
        return fill_blanks(df) if self.config.normalize_blanks else df

    def _exception_pairs(self) -> DataFrame | None:
        return exception_pairs(self.config, self._exceptions)

    @property
    def _listed(self) -> bool:
        """Do the configured exceptions count?"""
        return self._exceptions is None

    # -- stages -----------------------------------------------------------
    def _unique(self, er: DataFrame) -> DataFrame:
        return unique_pairs(er_verdicts(er, self.config), self.config)

    def scored_pairs(self, er_df: DataFrame, truth_df: DataFrame) -> DataFrame:
        """Unique ER pairs with their verdict, fingerprint and error matrix."""
        profile = truth_profile(self.truth_input(truth_df), self.config, self._exception_pairs(), self._listed)
        return with_error_matrix(self._unique(self.er_input(er_df)), profile).select("eo.*", "error_matrix")

    def verdict_pairs(self, er_df: DataFrame, truth_df: DataFrame) -> DataFrame:
        """Every ER row with the verdict of every truth row of its pair.

        A left join on both keys by plain equality, repeated rows of either side
        included: ER rows without truth rows, or with a NULL key, appear once and
        without a truth verdict. ER rows travel once; the truth as the numbers of rows of either verdict
        per pair. Pairs hot on either side, or on both, are split.
        """
        config = self.config.but(compat=False)
        truth = self.truth_input(truth_df).dropna(subset=list(config.key_columns))
        er = with_pair_id(er_verdicts(self.er_input(er_df), config), config)
        shown = [c for c in shown_columns(er, config) if c not in PAIR_ID]
        profile = truth_profile(truth, config, self._exception_pairs(), self._listed)
        packed = er.select(*PAIR_ID, F.struct(*shown).alias("eo"))
        joined = join_all_rows(packed, profile, heavy_pairs(profile, config), heavy_er_pairs(er, config))
        verdict = F.col("verdict")
        matrix = error_matrix(F.col("eo.match_status_er"), verdict).alias("error_matrix")
        return repeated(joined.select("eo.*", verdict.alias("match_status_manual"), matrix, "_rows"), "_rows")

    def _joined(self, er: DataFrame, truth: DataFrame, how: str = "full_outer", keep: Iterable[str] = ()) -> DataFrame:
        """Both sides by pair: eo, error_matrix, tf, copies, and ``keep`` of what ``with_truth`` gives."""
        config = self.config
        profile = truth_profile(truth, config, listed=self._listed)
        heavy = heavy_pairs(profile, config)
        scored_er = er_verdicts(er, config)
        scored, rows = with_truth(dense_pairs(scored_er, config), profile), truth_rows(truth, config, self._listed, heavy=heavy)

        def apart(pairs: DataFrame) -> DataFrame:
            return spread_er(pairs, scored_er, config)

        return join_sides(scored, rows, truth_fields(truth, config), apart, heavy, config, self._exception_pairs(), how, keep)

    def stored_records(self, er_df: DataFrame, truth_df: DataFrame) -> DataFrame:
        """``records`` for two sides bucketed by pair, without NULL keys and hot pairs: no stored row crosses an exchange."""
        config, er, truth = self.config, self.er_input(er_df), self.truth_input(truth_df)
        profile = truth_profile(truth, config, listed=self._listed, stored=True)
        unique = unique_pairs(er_verdicts(er, config), config, stored=True)
        rows = truth_rows(truth, config, self._listed, stored=True)
        joined = join_stored(with_truth(unique, profile, stored=True), rows)
        return with_codes(classify_records(joined, config), config)

    def records(self, er_df: DataFrame, truth_df: DataFrame) -> DataFrame:
        """Every record of either side once per counterpart, classified and coded.

        The sides are structs ``eo`` and ``tf``; ``record_class`` tells match,
        mismatch, extra and missing records apart.
        """
        joined = self._joined(self.er_input(er_df), self.truth_input(truth_df))
        return with_codes(classify_records(joined, self.config), self.config)

    def _unmatched(self, record_class: str, er: DataFrame, truth: DataFrame) -> DataFrame:
        """Extra or missing records by an anti join, coded."""
        config = self.config
        heavy = heavy_pairs(truth_profile(truth, config, listed=self._listed), config)
        scored_er, rows = er_verdicts(er, config), truth_rows(truth, config, self._listed, heavy=heavy)
        unique, fields = dense_pairs(scored_er, config), truth_fields(truth, config)
        no_matrix = F.lit(None).cast("string").alias("error_matrix")
        if record_class == "extra":
            no_truth = [F.lit(None).cast(t).alias(c) for c, t in (("tf", T.StructType(fields)), ("copies", rows.schema["copies"].dataType))]
            pairs = spread_er(without_counterpart(unique, truth, config), scored_er, config).select("eo", no_matrix, *no_truth)
        else:
            no_er = F.lit(None).cast(spread_er(unique, scored_er, config).schema["eo"].dataType).alias("eo")
            alone = flip_truth(without_counterpart(rows, er, config, heavy), fields, heavy, self._exception_pairs(), config)
            pairs = alone.select(no_er, no_matrix, "tf", "copies")
        return with_codes(classify_records(pairs, config), config)

    def _compared(self, er: DataFrame, truth: DataFrame) -> DataFrame:
        """Matches and mismatches by one inner join, coded."""
        return with_codes(classify_records(self._joined(er, truth, "inner"), self.config), self.config)

    def records_of(self, record_class: str, er_df: DataFrame, truth_df: DataFrame) -> DataFrame:
        """The records of one class, sides unpacked into suffixed columns.

        Extra and missing records are an anti join with the keys of the other
        side, matches and mismatches an inner join.
        """
        if record_class not in RECORD_CLASSES:
            raise ValueError(f"record class must be one of {RECORD_CLASSES}")
        er, truth = self.er_input(er_df), self.truth_input(truth_df)
        if record_class in ("extra", "missing"):
            return flat_records(self._unmatched(record_class, er, truth))
        return flat_records(self._compared(er, truth).where(F.col("record_class") == record_class))

    def united(self, er_df: DataFrame, truth_df: DataFrame) -> DataFrame:
        """The records of all classes, each by the join of its class, united without equal rows.

        One inner join gives matches and mismatches. ER rows are unique and truth rows distinct before any join, and a
        record has one class, so no two rows can be equal and no further exchange has to look for them.
        """
        er, truth = self.er_input(er_df), self.truth_input(truth_df)
        parts = [self._compared(er, truth), *(self._unmatched(c, er, truth) for c in ("extra", "missing"))]
        return combine(*map(flat_records, parts), disjoint=True)

    def explain(self, records: DataFrame) -> DataFrame:
        """Decode the codes of ``records`` and project the final columns."""
        return with_explanations(records, self.config).select(*result_columns(self.config, self.batch_id))

    # -- entry points -----------------------------------------------------
    def run_observed(self, er_df: DataFrame, truth_df: DataFrame) -> tuple[DataFrame, Observation]:
        """The result of ``run``, and its counts as a by-product: the six numbers of ``counts`` once an action has run.

        All are counted in the last stage, of which Spark counts every task once, also when executors are lost. An ER pair meets
        several truth rows there, so each of them counts for its share of the pair. Not for ``compat``, which can pair one truth row
        with several ER pairs; use ``counts`` there.
        """
        if self.config.compat:
            raise ValueError("compat mode pairs by key text; use counts()")
        joined = self._joined(self.er_input(er_df), self.truth_input(truth_df), keep=["pair_rows"])
        records = classify_records(joined, self.config)
        is_class, copies = {c: F.col("record_class") == c for c in RECORD_CLASSES}, F.coalesce("copies", F.lit(1))
        share = copies.cast("decimal(20,0)") / F.col("pair_rows").cast("decimal(20,0)")
        pairs = F.when(is_class["extra"], 1).when(~is_class["missing"], share)

        def total(value: Column, name: str) -> Column:
            return F.coalesce(F.round(F.sum(value)).cast("long"), F.lit(0).cast("long")).alias(name)

        seen = Observation()
        observed = records.observe(
            seen,
            total(pairs, "source"),
            total(F.when(~is_class["extra"], copies), "target"),
            *[total(F.when(held, copies), name) for name, held in is_class.items()],
        )
        return self.explain(with_codes(observed.drop("pair_rows"), self.config)), seen

    def save_observed(self, er_df: DataFrame, truth_df: DataFrame, path: str, format: str = "parquet", **options) -> dict[str, int]:
        """Write the result of a run by one action and return its six counts."""
        result, seen = self.run_observed(er_df, truth_df)
        self.save(result, path, format, **options)
        return seen.get

    def run(self, er_df: DataFrame, truth_df: DataFrame) -> DataFrame:
        return self.explain(self.records(er_df, truth_df))

    def store(self, er_df: DataFrame, truth_df: DataFrame, name: str, buckets: int = 1000, path: str | None = None) -> None:
        """Write both sides in ``buckets`` or more by pair for ``run_stored``; the columns of the configuration, in their declared types."""
        store_pairs(conform(er_df, self.config), conform(truth_df, self.config, "human_review"), name, self.config, buckets, path)

    def run_stored(self, spark: SparkSession, name: str) -> DataFrame:
        """The result of ``run`` over sides that ``store`` wrote.

        The buckets are joined as they lie; rows with a NULL key and hot pairs, kept apart, are
        joined as in ``run``. For runs that pair on the keys as stored: not ``compat``, not ``normalize_blanks``, and
        exceptions as the configured list.
        """
        if self.config.compat or self.config.normalize_blanks or self._exceptions is not None:
            raise ValueError("stored pairs need plain keys and listed exceptions; use run()")
        stored = self.stored_records(*stored_pairs(spark, name))
        rest = self.records(*stored_pairs(spark, name, rest=True))
        return self.explain(stored.unionByName(rest))

    def run_tables(self, spark: SparkSession, er_table: str, truth_table: str, format: str | None = None) -> DataFrame:
        return self.run(read_table(spark, er_table, format), read_table(spark, truth_table, format))

    def report(self, result: DataFrame) -> DataFrame:
        return report(result, self.config.report_columns)

    def save(self, result: DataFrame, path: str, format: str = "parquet", **options) -> None:
        save(result, path, format, **options)

    def save_batch(self, result: DataFrame, path: str, format: str = "parquet", **options) -> None:
        """Write a result next to other batches; a repeated run replaces its own."""
        save_batch(result, path, format, **options)

    def counts(self, er_df: DataFrame, truth_df: DataFrame) -> DataFrame:
        """Rows (metric, rows): source, target, match, mismatch, extra, missing.

        Class counts include repeated truth rows, as joining the raw truth would. No
        records are built: ER pairs meet the row counts of their pair, then the truth
        rows of equal fingerprint, both combined on the map side.
        """
        counted = pair_counts(self.er_input(er_df), self.truth_input(truth_df), self.config)
        names = ["source", "target", *RECORD_CLASSES]
        return counted.select(*names).unpivot([], names, "metric", "rows")


def validate(
    er_df: DataFrame,
    truth_df: DataFrame,
    config: ValidationConfig | None = None,
    batch_id: str | None = None,
) -> DataFrame:
    return Validator(config, batch_id).run(er_df, truth_df)
