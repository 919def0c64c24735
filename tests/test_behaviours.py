"""Edge cases of a whole run, in both modes where they differ."""

import pytest

from frames import COLUMNS, COMPAT, er_frame, one, row, run, truth_frame
from pyspark.sql import functions as F

from pairlens import ValidationConfig, Validator
from pairlens.config import COMPAT_EXCEPTIONS

DEFAULT = ValidationConfig()
BOTH = pytest.mark.parametrize("config", [DEFAULT, COMPAT], ids=["default", "compat"])
ONES = "1" * 29


def code_with_zero(*names):
    return "".join("0" if c in names else "1" for c in COLUMNS)


@BOTH
def test_equal_rows(spark, config):
    r = one(spark, [row()], [row()], config)
    assert (r["validation_status"], r["mismatches_code"], r["mismatch_type"]) == ("Match", ONES, "NA")
    assert (r["mismatches_columns"], r["mismatch_deviation"], r["error_matrix"]) == ("", 0, "TP")
    assert r["extra_or_missing_flag"] is None and r["batch_id"] == "batch" and r["human_review"] == "Y"


@BOTH
def test_null_and_blank_hash_alike_but_compare_apart(spark, config):
    r = one(spark, [row(source_city=None)], [row(source_city="")], config)
    assert (r["validation_status"], r["mismatch_type"]) == ("Match", "Other columns mismatch")
    assert r["mismatches_code"] == code_with_zero("source_city")


@BOTH
def test_overlapping_names_hash_apart_but_compare_alike(spark, config):
    r = one(spark, [row(source_last_name="kirby-jones")], [row(source_last_name="jones")], config)
    assert (r["validation_status"], r["mismatch_type"], r["mismatches_code"]) == ("Mismatch", "NA", ONES)


def test_capitalised_names(spark):
    er, truth = [row(source_first_name="John")], [row(source_first_name="Mary")]
    assert one(spark, er, truth)["mismatches_columns"] == "source_first_name"
    assert one(spark, er, truth, COMPAT)["mismatches_columns"] == ""


@BOTH
def test_two_null_names_differ(spark, config):
    er = truth = [row(source_first_name=None)]
    r = one(spark, er, truth, config)
    assert (r["validation_status"], r["mismatches_code"]) == ("Match", code_with_zero("source_first_name"))


@BOTH
def test_target_names_compare_exactly(spark, config):
    r = one(spark, [row(target_last_name="kirby jones")], [row(target_last_name="jones")], config)
    assert r["mismatches_code"] == code_with_zero("target_last_name")


def test_deviation_denominator(spark):
    er, truth = [row(target_entity_id="a", source_city="x")], [row(target_entity_id="b", source_city="y")]
    r, compat = one(spark, er, truth), one(spark, er, truth, COMPAT)
    assert r["mismatch_type"] == compat["mismatch_type"] == "WE_PID and other column mismatch"
    assert (r["mismatch_deviation"], compat["mismatch_deviation"]) == (int(2 / 29 * 100), int(2 / 24 * 100))


@BOTH
def test_only_entity_differs(spark, config):
    r = one(spark, [row(target_entity_id="a")], [row(target_entity_id="b")], config)
    assert (r["mismatch_type"], r["mismatches_columns"]) == ("Only WE_PID mismatch", "target_entity_id")


def test_label_shift_of_compat_mode(spark):
    er, truth = [row(middle_name_score=0.3)], [row(middle_name_score=0.4)]
    assert one(spark, er, truth)["mismatches_columns"] == "middle_name_score"
    assert one(spark, er, truth, COMPAT)["mismatches_columns"] == "error_matrix"


def test_zero_beyond_compat_labels_fails(spark):
    er, truth = [row(city_score=0.3)], [row(city_score=0.4)]
    assert one(spark, er, truth)["mismatches_columns"] == "city_score"
    with pytest.raises(Exception, match="beyond its 24 labels"):
        one(spark, er, truth, COMPAT)


def test_extra_record(spark):
    r, compat = one(spark, [row()], []), one(spark, [row()], [], COMPAT)
    for got in (r, compat):
        assert (got["extra_or_missing_flag"], got["mismatch_type"]) == (False, "Extra Record in ER Output")
        assert (got["source_primary_key"], got["error_matrix"], got["human_review"]) == ("s1", None, None)
    assert (r["mismatches_code"], r["mismatch_deviation"]) == ("0" * 29, 100)
    assert (compat["mismatches_code"], compat["mismatch_deviation"]) == ("0" * 21, 87)


def test_missing_record(spark):
    r, compat = one(spark, [], [row()]), one(spark, [], [row()], COMPAT)
    for got in (r, compat):
        assert (got["extra_or_missing_flag"], got["mismatch_type"]) == (True, "Record Missing from ER Output")
        assert (got["match_status_manual"], got["human_review"], got["match_status_er"]) == ("Matched", "Y", None)
        assert got["source_first_name"] is None and got["src_tgt_md5_hash_column"] is None
    assert (r["source_primary_key"], r["target_primary_key"]) == ("s1", "t1")
    assert (compat["source_primary_key"], compat["target_primary_key"]) == (None, None)


def test_dashes_in_keys(spark):
    er = [row(source_primary_key="a-b", target_primary_key="c")]
    truth = [row(source_primary_key="a", target_primary_key="b-c")]
    assert [r["mismatch_type"] for r in run(spark, er, truth)] == [
        "Record Missing from ER Output",
        "Extra Record in ER Output",
    ]
    # The key texts are equal, hence one compared pair; its row texts are, too.
    r = one(spark, er, truth, COMPAT)
    assert (r["validation_status"], r["mismatches_code"]) == ("Match", code_with_zero(*COLUMNS[:2]))
    assert r["error_matrix"] is None


def test_duplicate_er_keys_keep_the_preferred_row(spark):
    rows = [
        row(er_rank=None, er_score=1.0),
        row(er_rank=2, er_score=1.0),
        row(er_rank=1, er_score=None),
        row(er_rank=1, er_score=0.7, source_city="low"),
        row(er_rank=1, er_score=0.9, source_city="high"),
    ]
    for er in (rows, rows[::-1]):
        assert one(spark, er, [row()])["source_city"] == "high"


@BOTH
def test_duplicate_er_ties_do_not_depend_on_order(spark, config):
    rows = [row(source_city=c) for c in ("x", "y", "", None)]
    kept = {one(spark, er, [], config)["source_city"] for er in (rows, rows[::-1], rows[2:] + rows[:2])}
    assert len(kept) == 1


@BOTH
def test_duplicate_truth_rows_each_give_a_result(spark, config):
    low = row(er_score=0.1, human_review="N")
    result = run(spark, [row()], [row(), low, low, row(human_review="maybe")], config)
    assert sorted(r["human_review"] for r in result) == ["N", "Y", "maybe"]
    # One truth row says Matched, so the pair is a true positive everywhere.
    assert {r["error_matrix"] for r in result} == {"TP"}
    assert sorted(r["match_status_manual"] for r in result) == ["Matched", "Matched", "NOT Matched"]


@BOTH
def test_equal_rows_can_remain_after_truth_columns_go(spark, config):
    truth = [row(source_city="x"), row(source_city="y")]
    result = run(spark, [row(source_city="z")], truth, config)
    assert len(result) == 2 and result[0] == result[1]


def test_null_source_key_on_both_sides(spark):
    er, truth = [row(source_primary_key=None)], [row(source_primary_key=None, source_city="elsewhere")]
    r = one(spark, er, truth)
    assert (r["validation_status"], r["mismatches_columns"], r["error_matrix"]) == ("Mismatch", "source_city", None)
    assert run(spark, er, truth, COMPAT) == []


@BOTH
def test_null_source_key_that_matches(spark, config):
    r = one(spark, [row(source_primary_key=None)], [row(source_primary_key=None)], config)
    assert (r["validation_status"], r["mismatches_code"], r["error_matrix"]) == ("Match", ONES, None)


def test_null_against_blank_key(spark):
    er, truth = [row(source_primary_key=None)], [row(source_primary_key="")]
    assert len(run(spark, er, truth)) == 2
    r = one(spark, er, truth, COMPAT)
    assert (r["validation_status"], r["mismatches_code"]) == ("Match", code_with_zero("source_primary_key"))


def test_null_keyed_truth_only_record(spark):
    truth = [row(source_primary_key=None)]
    assert one(spark, [], truth)["mismatch_type"] == "Record Missing from ER Output"
    assert one(spark, [], truth, COMPAT)["mismatch_type"] == "Extra Record in ER Output"


@BOTH
def test_exception_pairs_flip_the_truth_verdict(spark, config):
    config = config.but(exceptions=(("s1", "t1"), ("s1", "t1"), ("s2", "other")))
    no_suffix = {"source_primary_key": "s3", "suffix_score": None}
    er = [row(), row(source_primary_key="s2"), row(**no_suffix)]
    flipped, untouched, null_score = run(spark, er, er, config)
    assert (flipped["match_status_manual"], flipped["error_matrix"]) == ("NOT Matched", "FP")
    assert (untouched["match_status_manual"], untouched["error_matrix"]) == ("Matched", "TP")
    assert (null_score["match_status_manual"], null_score["error_matrix"]) == ("NOT Matched", "TN")
    config = config.but(exceptions=(("s3", "t1"),))
    assert run(spark, er, er, config)[2]["error_matrix"] == "FN"


def test_exception_frame_replaces_the_configured_pairs(spark):
    frame = spark.createDataFrame([("s1", "t1")] * 3, "source_primary_key string, target_primary_key string")
    config = DEFAULT.but(exceptions=(("s9", "t9"),))
    assert one(spark, [row()], [row()], config, exceptions=frame)["error_matrix"] == "FP"
    # With the hot pair split or not.
    truth = [row(human_review=str(i)) for i in range(9)] + [row(source_primary_key="s2")]
    for rows in (1, 2, 100):
        result = run(spark, [row()], truth, config.but(hot_pair_rows=rows), exceptions=frame)
        assert [r["match_status_manual"] for r in result] == ["NOT Matched"] * 9 + ["Matched"]
        assert [r["error_matrix"] for r in result] == ["FP"] * 9 + [None]


def test_compat_defaults_flip_their_sample_pairs(spark):
    source, target = COMPAT_EXCEPTIONS[0]
    pair = row(source_primary_key=source, target_primary_key=target)
    assert one(spark, [pair], [pair], ValidationConfig.compatible())["error_matrix"] == "FP"


@BOTH
def test_rank_and_thresholds_from_the_configuration(spark, config):
    er = truth = [row(er_score=0.82, city_score=0.0)]
    assert one(spark, er, truth, config)["error_matrix"] == "TP"
    assert one(spark, er, truth, config.with_rule(er_score_threshold=0.85))["error_matrix"] == "TN"


def test_blank_normalisation(spark):
    er, truth = [row(source_city=None)], [row(source_city="")]
    r = one(spark, er, truth, DEFAULT.but(normalize_blanks=True))
    assert (r["validation_status"], r["mismatches_code"], r["source_city"]) == ("Match", ONES, "null")


def test_optional_code_status(spark):
    er, truth = [row(source_city=None)], [row(source_city="")]
    r = one(spark, er, truth, DEFAULT.but(with_code_status=True))
    assert (r["validation_status"], r["code_status"]) == ("Match", "Mismatch")
    assert list(r)[-1] == "code_status" and len(r) == 42


@BOTH
def test_empty_inputs(spark, config):
    assert run(spark, [], [], config) == []


def test_extra_columns_by_configuration(spark):
    config = DEFAULT.but(columns=(*DEFAULT.columns, "source_phone"))
    er = er_frame(spark, row()).selectExpr("*", "'1' AS source_phone")
    truth = truth_frame(spark, row()).selectExpr("*", "'2' AS source_phone")
    r = Validator(config, "b").run(er, truth).first()
    assert (r.mismatches_code, r.mismatches_columns) == (ONES + "0", "source_phone")


def test_inputs_are_checked(spark):
    er, truth = er_frame(spark, row()), truth_frame(spark, row())
    with pytest.raises(ValueError, match="er_rank"):
        Validator().run(er.drop("er_rank"), truth)
    with pytest.raises(ValueError, match="human_review"):
        Validator().run(er, er)
    cast = er.withColumn("er_rank", er.er_rank.cast("string"))
    assert Validator(DEFAULT, "b").run(cast, truth).first().validation_status == "Match"


def test_configuration_is_checked():
    with pytest.raises(ValueError):
        ValidationConfig(columns=("a", "b"))
    with pytest.raises(ValueError):
        ValidationConfig(hot_pair_rows=0)
    with pytest.raises(ValueError):
        ValidationConfig(columns=(*DEFAULT.columns, "er_rank"))
    with pytest.raises(ValueError):
        ValidationConfig(key_columns=("source_primary_key",))
    with pytest.raises(ValueError):
        ValidationConfig(entity_column="no_such")
    with pytest.raises(ValueError):
        ValidationConfig(report_columns=("source_primary_key", "no_such"))
    with pytest.raises(ValueError):
        ValidationConfig(max_hot_pairs=0)


def counts(spark, er, truth, config=DEFAULT):
    frame = Validator(config).counts(er_frame(spark, *er), truth_frame(spark, *truth))
    return {r.metric: r.rows for r in frame.collect()}


@BOTH
def test_run_counts(spark, config):
    er = [row(), row(), row(source_primary_key="s2"), row(source_primary_key="s3", source_city="x")]
    truth = [row(), row(), row(source_primary_key="s3"), row(source_primary_key="s4"), row(source_primary_key="s4")]
    assert counts(spark, er, truth, config) == {
        "source": 3,
        "target": 5,
        "match": 2,
        "mismatch": 1,
        "extra": 1,
        "missing": 2,
    }
    assert set(counts(spark, [], [], config).values()) == {0}


def _small_sides(spark):
    from fixture_sql import fixture

    return fixture(spark, "/root/testdata/sf0.001", "er_output"), fixture(spark, "/root/testdata/sf0.001", "truth")


def test_unhashed_columns_count_on_neither_side(spark):
    er, truth = _small_sides(spark)
    matches = lambda config, e, t: Validator(config).run(e, t).where("validation_status = 'Match'").count()
    config = ValidationConfig()
    wider = config.but(columns=(*config.columns, "error_matrix"))
    plain = matches(config, er, truth)
    marked = [f.withColumn("error_matrix", F.lit("TP")) for f in (er, truth)]
    assert plain > 0 and matches(wider, *marked) == plain


def test_inputs_in_any_case_and_review_among_columns(spark):
    from pairlens.schema import conform

    _, truth = _small_sides(spark)
    upper = truth.select([F.col(c).alias(c.upper()) for c in truth.columns])
    config = ValidationConfig()
    named = config.but(columns=(*config.columns, "human_review"))
    got = conform(upper, named, "human_review")
    assert got.columns == [*config.columns, "human_review"]


def test_a_rank_that_is_no_integer_is_refused(spark):
    from pairlens.schema import conform

    er, _ = _small_sides(spark)
    with pytest.raises(Exception, match="er_rank"):
        conform(er.withColumn("er_rank", F.lit(1.9)), ValidationConfig()).collect()
    assert conform(er.withColumn("er_rank", F.lit(1.0)), ValidationConfig()).count() == er.count()


def test_exceptions_with_number_keys(spark):
    er, truth = _small_sides(spark)
    listed = spark.createDataFrame([(1, 2)], "source_primary_key int, target_primary_key int")
    assert Validator(ValidationConfig(), exceptions=listed).run(er, truth).count() > 0
