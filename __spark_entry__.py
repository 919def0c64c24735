
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

import oracle  # noqa: E402
from fixture_sql import BATCH_ID, fixture  # noqa: E402
from pairlens import ValidationConfig, Validator, tune  # noqa: E402
from pairlens.config import RULE_COLUMNS  # noqa: E402
from pairlens.functions import (  # noqa: E402
    agreement_bit,
    code_status,
    mismatch_deviation,
    mismatch_type,
    mismatching_columns_text,
    pair_key,
    same_value,
    shares_token,
)
from pairlens.operators.columns import fill_blanks, mark_side, strip_sides  # noqa: E402
from pairlens.operators.records import flat_records  # noqa: E402
from pairlens.operators.verdict import dedup_pairs  # noqa: E402
from pairlens.session import shared_path  # noqa: E402
from pairlens.sources import er_scan, fingerprinted_table, register_decoders, register_views, truth_scan  # noqa: E402

try:  # the text operators are an optional part
    from pairlens.llm import queries as llm
except ImportError:
    llm = None

Query = Callable[[SparkSession, str], DataFrame]

DEFAULT = ValidationConfig()
COMPAT = ValidationConfig.compatible(exceptions=())
# Small enough for the hot pair of the skewed tables to be split at any scale.
SPLITTING = {"hot_pair_rows": 500}

KEYS = list(DEFAULT.key_columns)
RECORD = [
    "source_primary_key_eo",
    "target_primary_key_eo",
    "source_primary_key_tf",
    "target_primary_key_tf",
    "target_entity_id_eo",
    "target_entity_id_tf",
    "match_status_er_eo",
    "match_status_manual_tf",
    "src_tgt_md5_hash_column_eo",
    "validation_status",
    "mismatches_code",
    "extra_or_missing_flag",
]


def _inputs(spark: SparkSession, sf_dir: str, er: str = "er_output", truth: str = "truth") -> tuple[DataFrame, DataFrame]:
    tune(spark)
    return fixture(spark, sf_dir, er), fixture(spark, sf_dir, truth)


def _skewed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return _inputs(spark, sf_dir, "skewed_er", "skewed_truth")


def _exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixture(spark, sf_dir, "exceptions")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Validator(DEFAULT, BATCH_ID).records(*_inputs(spark, sf_dir))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).where(F.col("eo").isNotNull() & F.col("tf").isNotNull())


def _keys() -> list:
    """The keys of a record, from the side that has it."""
    return [F.coalesce(f"eo.{k}", f"tf.{k}").alias(k) for k in KEYS]


def _eo_keys() -> list:
    return [F.col(f"eo.{k}").alias(k) for k in KEYS]


def er_match_status(spark, sf_dir):
    return er_scan(_inputs(spark, sf_dir)[0], DEFAULT)


def truth_match_status(spark, sf_dir):
    truth = truth_scan(_inputs(spark, sf_dir)[1], DEFAULT)
    return truth.select(*KEYS, "match_status_manual", "human_review")


def truth_exception_flip(spark, sf_dir):
    truth = truth_scan(_inputs(spark, sf_dir)[1], DEFAULT, _exceptions(spark, sf_dir))
    return truth.select(*KEYS, "match_status_manual", "human_review")


def truth_exception_flip_long(spark, sf_dir):
    """As many exceptions as pairs, the hot pair split."""
    config = DEFAULT.but(**SPLITTING)
    exceptions = fixture(spark, sf_dir, "long_exceptions")
    truth = truth_scan(_skewed(spark, sf_dir)[1], config, exceptions)
    return truth.select(*KEYS, "er_score", "match_status_manual", "human_review")


def er_dedup(spark, sf_dir):
    return dedup_pairs(er_scan(_inputs(spark, sf_dir, er="er_candidates")[0], DEFAULT), DEFAULT)


def verdict_left_join(spark, sf_dir):
    pairs = Validator(DEFAULT).verdict_pairs(*_inputs(spark, sf_dir))
    return pairs.select(*KEYS, "match_status_er", "match_status_manual", "error_matrix")


def verdict_left_join_candidates(spark, sf_dir):
    """Repeated ER rows, each kept."""
    pairs = Validator(DEFAULT).verdict_pairs(*_inputs(spark, sf_dir, er="er_candidates"))
    return pairs.select(*KEYS, "match_status_er", "match_status_manual", "error_matrix")


def verdict_left_join_skewed(spark, sf_dir):
    """A third of the truth under one pair; ER rows unique, since pairs hot on both sides multiply."""
    er, truth = _skewed(spark, sf_dir)
    unique = dedup_pairs(er_scan(er, DEFAULT), DEFAULT).select(*DEFAULT.columns)
    pairs = Validator(DEFAULT.but(**SPLITTING)).verdict_pairs(unique, truth)
    return pairs.select(*KEYS, "match_status_er", "match_status_manual", "error_matrix")


def verdict_left_join_hot(spark, sf_dir):
    """A pair with many rows on both sides, split into a grid."""
    pairs = Validator(DEFAULT.but(hot_pair_rows=20)).verdict_pairs(*_inputs(spark, sf_dir, "hot_er", "hot_truth"))
    return pairs.select(*KEYS, "match_status_er", "match_status_manual", "error_matrix")


def error_matrix(spark, sf_dir):
    validator = Validator(DEFAULT, exceptions=_exceptions(spark, sf_dir))
    scored = validator.scored_pairs(*_inputs(spark, sf_dir))
    return scored.select(*KEYS, "match_status_er", "error_matrix")


def error_matrix_skewed(spark, sf_dir):
    scored = Validator(DEFAULT).scored_pairs(*_skewed(spark, sf_dir))
    return scored.select(*KEYS, "match_status_er", "error_matrix")


def pair_key_text(spark, sf_dir):
    return _inputs(spark, sf_dir)[0].select(*KEYS, pair_key(KEYS).alias("key_columns"))


def row_md5(spark, sf_dir):
    er, truth = _inputs(spark, sf_dir)
    register_views(er, truth)
    return fingerprinted_table(spark, "target_data_view", KEYS)


def side_suffix(spark, sf_dir):
    return mark_side(_inputs(spark, sf_dir)[1], "_tf")


def blank_fill(spark, sf_dir):
    return fill_blanks(_inputs(spark, sf_dir)[1])


def hash_status(spark, sf_dir):
    er_hash = F.col("eo.src_tgt_md5_hash_column").alias("er_hash")
    return _paired(spark, sf_dir).select(*_eo_keys(), er_hash, "validation_status")


def column_bits(spark, sf_dir):
    compared = [c for c in DEFAULT.columns if c not in DEFAULT.token_columns]
    bits = [agreement_bit(same_value(F.col(f"eo.{c}"), F.col(f"tf.{c}"))).alias(f"bit_{c}") for c in compared]
    return _paired(spark, sf_dir).select(*_eo_keys(), *bits)


def _name_bits(spark, sf_dir, compat):
    bits = [
        agreement_bit(shares_token(F.col(f"eo.{c}"), F.col(f"tf.{c}"), compat)).alias(f"bit_{c}")
        for c in DEFAULT.token_columns
    ]
    return _paired(spark, sf_dir).select(*_eo_keys(), *bits)


def name_token_bits(spark, sf_dir):
    return _name_bits(spark, sf_dir, compat=False)


def name_token_bits_compat(spark, sf_dir):
    return _name_bits(spark, sf_dir, compat=True)


def mismatch_code(spark, sf_dir):
    return _paired(spark, sf_dir).select(*_eo_keys(), "mismatches_code")


def _class_query(record_class: str) -> Query:
    def query(spark, sf_dir):
        records = Validator(DEFAULT, BATCH_ID).records_of(record_class, *_inputs(spark, sf_dir))
        return records.select(*RECORD)

    return query


def union_distinct(spark, sf_dir):
    """The record classes, each by the join of its class, united by column name without equal rows."""
    united = Validator(DEFAULT.but(**SPLITTING), BATCH_ID).united(*_skewed(spark, sf_dir))
    return united.select(*RECORD, "record_class")


def record_union(spark, sf_dir):
    """All four record classes at once, as the full outer join delivers them."""
    records = Validator(DEFAULT.but(**SPLITTING), BATCH_ID).records(*_skewed(spark, sf_dir))
    return flat_records(records).select(*RECORD, "record_class")


def mismatching_columns(spark, sf_dir):
    code = F.col("mismatches_code")
    named = mismatching_columns_text(code, DEFAULT.bit_labels)
    return _records(spark, sf_dir).select(*_keys(), code, named.alias("mismatches_columns"))


def deviation(spark, sf_dir):
    code = F.col("mismatches_code")
    share = mismatch_deviation(code, DEFAULT.bit_labels)
    return _records(spark, sf_dir).select(*_keys(), code, share.alias("mismatch_deviation"))


def deviation_compat(spark, sf_dir):
    result = Validator(COMPAT, BATCH_ID).run(*_inputs(spark, sf_dir))
    return result.select(*KEYS, "mismatches_code", "mismatch_deviation")


def status_of_code(spark, sf_dir):
    code = F.col("mismatches_code")
    return _records(spark, sf_dir).select(*_keys(), code, code_status(code).alias("code_status"))


def type_of_mismatch(spark, sf_dir):
    code, flag = F.col("mismatches_code"), F.col("extra_or_missing_flag")
    category = mismatch_type(code, flag, DEFAULT.bit_labels)
    return _records(spark, sf_dir).select(*_keys(), code, flag, category.alias("mismatch_type"))


def sql_decoders(spark, sf_dir):
    """The decoders as SQL users call them, over a view of coded records."""
    _records(spark, sf_dir).select(*_keys(), "mismatches_code", "extra_or_missing_flag").createOrReplaceTempView("coded_records")
    register_decoders(spark, DEFAULT)
    return spark.sql("""
        SELECT source_primary_key, target_primary_key, mismatches_code, extra_or_missing_flag,
          mismatching_columns_text(mismatches_code) AS mismatches_columns,
          array_join(mismatching_columns(mismatches_code), ',') AS mismatches_list,
          mismatch_deviation(mismatches_code) AS mismatch_deviation, code_status(mismatches_code) AS code_status,
          mismatch_type(mismatches_code, extra_or_missing_flag) AS mismatch_type
        FROM coded_records""")


def suffix_strip(spark, sf_dir):
    records = Validator(DEFAULT, BATCH_ID).records_of("match", *_inputs(spark, sf_dir))
    return strip_sides(records.select(*[f"{c}_eo" for c in DEFAULT.columns]))


def report_view(spark, sf_dir):
    validator = Validator(DEFAULT, BATCH_ID, _exceptions(spark, sf_dir))
    return validator.report(validator.run(*_inputs(spark, sf_dir)))


def run_counts(spark, sf_dir):
    return Validator(DEFAULT.but(**SPLITTING)).counts(*_skewed(spark, sf_dir))


def run_counts_observed(spark, sf_dir):
    """The same counts as a by-product of the action that writes the result."""
    path = shared_path(spark, "observed-result")
    counts = Validator(DEFAULT.but(**SPLITTING), BATCH_ID).save_observed(*_skewed(spark, sf_dir), path)
    return spark.createDataFrame(list(counts.items()), "metric string, rows long")


def saved_batches(spark, sf_dir):
    """Two batches in one folder, the first run again with other candidates, read back."""
    path, (er, truth) = shared_path(spark, "saved-batches"), _inputs(spark, sf_dir)
    candidates = fixture(spark, sf_dir, "er_candidates")
    for batch, found in ((BATCH_ID, er), ("20240202000000", er), (BATCH_ID, candidates)):
        validator = Validator(DEFAULT, batch)
        validator.save_batch(validator.run(found, truth), path)
    # Names and order of the result; the batch is a folder and would be read as a number.
    return spark.read.schema(validator.run(er, truth).schema).parquet(path)


def validate_full(spark, sf_dir):
    return Validator(DEFAULT, BATCH_ID, _exceptions(spark, sf_dir)).run(*_inputs(spark, sf_dir))


def validate_tables(spark, sf_dir):
    """The run by table names, here those of two views."""
    register_views(*_inputs(spark, sf_dir))
    return Validator(DEFAULT, BATCH_ID).run_tables(spark, "source_data_view", "target_data_view")


def validate_full_compat(spark, sf_dir):
    return Validator(COMPAT, BATCH_ID, _exceptions(spark, sf_dir)).run(*_inputs(spark, sf_dir))


def validate_candidates(spark, sf_dir):
    return Validator(DEFAULT, BATCH_ID).run(*_inputs(spark, sf_dir, er="er_candidates"))


def validate_blanks_normalized(spark, sf_dir):
    config = DEFAULT.but(normalize_blanks=True)
    return Validator(config, BATCH_ID).run(*_inputs(spark, sf_dir))


def validate_narrow(spark, sf_dir):
    """Without rank and scores among the compared columns; the verdicts still read them."""
    config = DEFAULT.but(columns=tuple(c for c in DEFAULT.columns if c not in RULE_COLUMNS), **SPLITTING)
    return Validator(config, BATCH_ID).run(*_skewed(spark, sf_dir))


def validate_skewed(spark, sf_dir):
    return Validator(DEFAULT.but(**SPLITTING), BATCH_ID).run(*_skewed(spark, sf_dir))


def validate_skewed_compat(spark, sf_dir):
    # Scores beyond the 24 compat labels differ here, which those labels reject.
    config = COMPAT.but(labels=DEFAULT.columns, **SPLITTING)
    return Validator(config, BATCH_ID).run(*_skewed(spark, sf_dir))


def validate_stored(spark, sf_dir):
    """Both sides stored in buckets by pair first, the hot pair and NULL keys apart."""
    validator = Validator(DEFAULT.but(**SPLITTING), BATCH_ID)
    validator.store(*_skewed(spark, sf_dir), "pairlens_stored", buckets=8, path=shared_path(spark, "stored"))
    return validator.run_stored(spark, "pairlens_stored")


def entry(spark: SparkSession) -> DataFrame:
    """The full validation of the derived pair tables."""
    return validate_full(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return _validation_queries() | (llm.queries() if llm else {})


def _validation_queries() -> dict[str, Query]:
    return {
        "er_match_status": er_match_status,
        "truth_match_status": truth_match_status,
        "truth_exception_flip": truth_exception_flip,
        "truth_exception_flip_long": truth_exception_flip_long,
        "er_dedup": er_dedup,
        "verdict_left_join": verdict_left_join,
        "verdict_left_join_candidates": verdict_left_join_candidates,
        "verdict_left_join_skewed": verdict_left_join_skewed,
        "verdict_left_join_hot": verdict_left_join_hot,
        "error_matrix": error_matrix,
        "error_matrix_skewed": error_matrix_skewed,
        "pair_key": pair_key_text,
        "row_md5": row_md5,
        "side_suffix": side_suffix,
        "blank_fill": blank_fill,
        "hash_status": hash_status,
        "column_bits": column_bits,
        "name_token_bits": name_token_bits,
        "name_token_bits_compat": name_token_bits_compat,
        "mismatch_code": mismatch_code,
        "match_records": _class_query("match"),
        "mismatch_records": _class_query("mismatch"),
        "extra_records": _class_query("extra"),
        "missing_records": _class_query("missing"),
        "union_distinct": union_distinct,
        "record_union": record_union,
        "mismatching_columns": mismatching_columns,
        "mismatch_deviation": deviation,
        "mismatch_deviation_compat": deviation_compat,
        "code_status": status_of_code,
        "mismatch_type": type_of_mismatch,
        "sql_decoders": sql_decoders,
        "suffix_strip": suffix_strip,
        "report_view": report_view,
        "run_counts": run_counts,
        "run_counts_observed": run_counts_observed,
        "saved_batches": saved_batches,
        "validate_full": validate_full,
        "validate_tables": validate_tables,
        "validate_full_compat": validate_full_compat,
        "validate_candidates": validate_candidates,
        "validate_blanks_normalized": validate_blanks_normalized,
        "validate_narrow": validate_narrow,
        "validate_skewed": validate_skewed,
        "validate_stored": validate_stored,
        "validate_skewed_compat": validate_skewed_compat,
    }


def oracle_sql() -> dict[str, str]:
    return oracle.statements() | (llm.oracle_sql() if llm else {})
