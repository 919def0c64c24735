"""Tables by name, files by path, sinks and views."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from frames import er_frame, row, truth_frame
from pairlens import ValidationConfig, Validator
from pairlens.config import REPORT_COLUMNS
from pairlens.operators.columns import fill_blanks, mark_side, strip_sides
from pairlens.operators.records import combine
from pairlens.functions import decode
from pairlens.sources import er_scan, fingerprinted_table, read_table, register_decoders, register_views, truth_scan

ER = [row(), row(source_primary_key="s2", source_city=None)]
TRUTH = [row(), row(source_primary_key="s3")]


@pytest.fixture
def inputs(spark):
    return er_frame(spark, *ER), truth_frame(spark, *TRUTH)


def test_run_by_view_name(spark, inputs):
    validator = Validator(ValidationConfig(), "b")
    register_views(*inputs, er_view="er_in", truth_view="truth_in")
    assert validator.run_tables(spark, "er_in", "truth_in").count() == 3
    keyed = fingerprinted_table(spark, "truth_in", ["source_primary_key", "target_primary_key"])
    assert [r.key_columns for r in keyed.orderBy("key_columns").collect()] == ["s1-t1", "s3-t1"]


def test_run_by_path(spark, inputs, tmp_path):
    for df, name in zip(inputs, ("er", "truth")):
        df.write.parquet(f"{tmp_path}/{name}")
    validator = Validator(ValidationConfig(), "b")
    assert validator.run_tables(spark, f"{tmp_path}/er", f"{tmp_path}/truth", "parquet").count() == 3


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_save(spark, inputs, tmp_path, format):
    validator = Validator(ValidationConfig(), "b")
    result = validator.run(*inputs)
    options = {"header": "true"} if format == "csv" else {}
    for _ in range(2):  # the second write replaces the first
        validator.save(result, f"{tmp_path}/out", format, **options)
    back = read_table(spark, f"{tmp_path}/out", format, **options)
    assert back.count() == 3 and set(back.columns) == set(result.columns)


def test_save_partitioned(spark, inputs, tmp_path):
    validator = Validator(ValidationConfig(), "b")
    validator.save(validator.run(*inputs), f"{tmp_path}/out", partition_by=["validation_status"])
    assert spark.read.parquet(f"{tmp_path}/out").where("validation_status = 'Match'").count() == 1


@pytest.mark.parametrize("format", ["parquet", "orc", "json", "csv"])
def test_batches_are_replaced_one_by_one(spark, inputs, tmp_path, format):
    """Rows read back equal those written; a repeated run replaces its own batch only."""
    er, truth = inputs
    options = {"header": "true"} if format == "csv" else {}
    one, two = (Validator(ValidationConfig(), b) for b in ("b1", "b2"))
    one.save_batch(one.run(er, truth.limit(0)), f"{tmp_path}/out", format, **options)
    two.save_batch(two.run(er, truth), f"{tmp_path}/out", format, **options)
    one.save_batch(one.run(er, truth), f"{tmp_path}/out", format, **options)
    wanted = one.run(er, truth).unionAll(two.run(er, truth))
    back = spark.read.schema(wanted.schema).options(**options).format(format).load(f"{tmp_path}/out").select(*wanted.columns)
    blank = lambda r: tuple("" if v is None and format == "csv" else v for v in r)
    assert sorted(map(str, map(blank, back.collect()))) == sorted(map(str, map(blank, wanted.collect())))


@pytest.mark.parametrize("config", [ValidationConfig(), ValidationConfig.compatible()])
def test_sql_decoders_are_the_column_builders(spark, config):
    """Random codes and flags, NULL, short and long codes."""
    rng, size = random.Random(4), len(config.bit_labels)
    codes = [None, "", "1" * size, "0" * size, "1" * 40, "0" * 5]
    codes += ["".join(rng.choice("0111") for _ in range(rng.choice([size, size, size - 4]))) for _ in range(60)]
    rows = [(c, f) for c in codes for f in (None, False, True)]
    frame = spark.createDataFrame(rows, "code string, flag boolean")
    frame.createOrReplaceTempView("some_codes")
    register_decoders(spark, config)
    found = spark.sql("""SELECT code, flag, mismatching_columns(code) AS a, mismatching_columns_text(code) AS b, mismatch_deviation(code) AS c,
      code_status(code) AS d, mismatch_type(code, flag) AS e FROM some_codes""")
    code, labels = F.col("code"), config.bit_labels
    built = frame.select(
        "code", "flag", decode.mismatching_columns(code, labels), decode.mismatching_columns_text(code, labels),
        decode.mismatch_deviation(code, labels), decode.code_status(code), decode.mismatch_type(code, F.col("flag"), labels),
    )
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, map(tuple, built.collect())))
    with pytest.raises(Exception, match="beyond"):
        spark.sql(f"SELECT mismatching_columns('{'1' * size}0')").collect()


def test_report_columns(inputs):
    validator = Validator(ValidationConfig(), "b")
    assert validator.report(validator.run(*inputs)).columns == list(REPORT_COLUMNS)


def test_scans(spark, inputs):
    config = ValidationConfig()
    er, truth = inputs
    assert er_scan(er, config).columns == [*config.columns, "match_status_er"]
    assert truth_scan(truth, config).columns == [*config.columns, "match_status_manual", "human_review"]


def test_result_schema(inputs):
    result = Validator(ValidationConfig(), "b").run(*inputs)
    assert len(result.columns) == 41 and result.columns[:29] == list(ValidationConfig().columns)
    types = dict(result.dtypes)
    assert (types["mismatch_deviation"], types["extra_or_missing_flag"], types["batch_id"]) == ("int", "boolean", "string")


def test_records_of_a_class(inputs):
    validator = Validator(ValidationConfig(), "b")
    missing = validator.records_of("missing", *inputs).collect()
    assert [(r.source_primary_key_eo, r.source_primary_key_tf) for r in missing] == [(None, "s3")]
    with pytest.raises(ValueError):
        validator.records_of("other", *inputs)


def test_side_suffixes(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "geo_effort int, my_tf_idf int, x int")
    marked = mark_side(frame, "_eo")
    assert marked.columns == ["geo_effort_eo", "my_tf_idf_eo", "x_eo"]
    assert strip_sides(marked).columns == frame.columns
    assert strip_sides(mark_side(frame, "_tf")).columns == frame.columns


def test_blank_fill(spark):
    frame = spark.createDataFrame([("", None, None), ("a", "b", 1)], "a string, b string, n int")
    assert [tuple(r) for r in fill_blanks(frame).collect()] == [("null", "null", None), ("a", "b", 1)]


def test_combine(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a")], "n int, s string")
    right = spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int")
    assert sorted(map(tuple, combine(left, right).collect())) == [(1, "a"), (2, "b")]


def test_batch_id_is_a_utc_stamp():
    assert len(Validator().batch_id) == 14 and Validator().batch_id.isdigit()


def _shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return set(re.findall(r"shuffle_\d+_\d+_\d+\.\w+", files.mkString(",")))


def test_a_save_leaves_no_shuffle_files(spark, inputs, tmp_path):
    """Batches saved in turn would else need the disk of all of them together."""
    validator, before = Validator(ValidationConfig(), "b"), _shuffle_files(spark)
    result = validator.run(*inputs)
    for _ in range(2):
        validator.save_batch(result, f"{tmp_path}/batches")
    for _ in range(40):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    assert not left
    assert spark.read.parquet(f"{tmp_path}/batches").count() == result.count() == result.count() == 3
