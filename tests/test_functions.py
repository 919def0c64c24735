"""Column expressions on their own."""

import hashlib

import pytest
from pyspark.sql import functions as F

from frames import er_frame, row
from pairlens import MatchRule
from pairlens.functions import (
    code_status,
    error_matrix,
    label_bit,
    match_status,
    mismatch_deviation,
    mismatch_type,
    mismatching_columns,
    mismatching_columns_text,
    name_tokens,
    shares_token,
)
from pairlens.operators.columns import with_key_and_fingerprint

SIX = ("col1", "col2", "col3", "col4", "col5", "col6")
ENTITY_THIRD = ("col1", "col2", "target_entity_id", "col4", "col5", "col6")


def first(spark, *columns, **values):
    frame = spark.range(1)
    for name, value in values.items():
        frame = frame.withColumn(name, value)
    return tuple(frame.select(*columns).first())


def decoded(spark, code, labels=SIX):
    c = F.col("code")
    code = F.lit(code).cast("string")
    return first(spark, mismatching_columns(c, labels), mismatching_columns_text(c, labels), mismatch_deviation(c, labels), code=code)


@pytest.mark.parametrize(
    "code, names, share",
    [("101010", ["col2", "col4", "col6"], 50), ("111111", [], 0), ("000000", list(SIX), 100), ("0111", ["col1"], 16)],
)
def test_decoding(spark, code, names, share):
    assert decoded(spark, code) == (names, ",".join(names), share)


def test_decoding_null(spark):
    assert decoded(spark, None) == (None, None, None)


def test_deviation_divides_first(spark):
    labels = tuple(f"c{i}" for i in range(50))
    assert decoded(spark, "0" * 29 + "1" * 21, labels)[2] == int((29 / 50) * 100) == 57


def test_one_bits_beyond_the_labels_are_fine(spark):
    assert decoded(spark, "1111110"[:6] + "11") == ([], "", 0)


@pytest.mark.parametrize("read", [mismatching_columns, mismatching_columns_text, mismatch_deviation])
def test_zero_beyond_the_labels_fails(spark, read):
    frame = spark.range(1).select(F.lit("1111110").alias("code"))
    with pytest.raises(Exception, match="beyond its 6 labels"):
        frame.select(read(F.col("code"), SIX)).collect()


@pytest.mark.parametrize(
    "code, flag, status, category",
    [
        ("111111", None, "Match", "NA"),
        ("110111", None, "Mismatch", "Only WE_PID mismatch"),
        ("010111", None, "Mismatch", "WE_PID and other column mismatch"),
        ("011111", None, "Mismatch", "Other columns mismatch"),
        ("000000", False, "Mismatch", "Extra Record in ER Output"),
        ("000000", True, "Mismatch", "Record Missing from ER Output"),
        ("111111", True, "Match", "Unknown Error"),
        ("111111", False, "Match", "Unknown Error"),
        ("01", None, "Mismatch", "Other columns mismatch"),
        (None, None, None, None),
    ],
)
def test_categories(spark, code, flag, status, category):
    c, f = F.col("code"), F.col("flag")
    columns = code_status(c), mismatch_type(c, f, ENTITY_THIRD)
    values = {"code": F.lit(code).cast("string"), "flag": F.lit(flag).cast("boolean")}
    assert first(spark, *columns, **values) == (status, category)


def test_label_bit_defaults_to_agreement(spark):
    c = F.col("code")
    columns = [label_bit(c, SIX, "col2"), label_bit(c, SIX, "col6"), label_bit(c, SIX, "nowhere")]
    assert first(spark, *columns, code=F.lit("1011")) == ("0", "1", "1")


# Bits of name pairs when capitals separate words and empty words count.
COMPAT_NAMES = [
    ("Kirby-Jones", "Jones", True),
    ("kirby-jones", "jones", True),
    ("John", "Mary", True),
    ("john", "mary", False),
    ("JOHN", "MARY", True),
    ("john", "John", False),
    (None, None, False),
    ("", "", True),
    ("smith", "", False),
    ("smith", None, False),
    ("o'neil", "neil", True),
    ("ann3", "bob4", True),
    ("josé", "jos", True),
    ("mary ann", "ann lee", True),
]
DEFAULT_NAMES = [
    ("Kirby-Jones", "Jones", True),
    ("kirby-jones", "JONES", True),
    ("John", "Mary", False),
    ("JOHN", "MARY", False),
    ("john", "John", True),
    (None, None, False),
    (None, "smith", False),
    ("", "", True),
    ("", " ", False),
    ("ann3", "bob4", False),
    ("o'neil", "neil", True),
    ("Иван", "Иван", True),
    ("Иван", "Пётр", False),
    (" mary  ann ", "ann lee", True),
]


@pytest.mark.parametrize("compat, cases", [(True, COMPAT_NAMES), (False, DEFAULT_NAMES)])
def test_name_tokens(spark, compat, cases):
    frame = spark.createDataFrame(cases, "a string, b string, expected boolean")
    shared = shares_token(F.col("a"), F.col("b"), compat)
    wrong = frame.withColumn("got", shared).where("NOT (got <=> expected)").collect()
    assert wrong == []
    swapped = shares_token(F.col("b"), F.col("a"), compat)
    assert frame.where(~swapped.eqNullSafe(F.col("expected"))).count() == 0


def test_token_lists(spark):
    name = F.lit("John-Paul 2nd")
    assert first(spark, name_tokens(name), name_tokens(name, compat=True)) == (["john", "paul", "nd"], ["", "ohn", "aul", "nd"])


def test_fingerprint_and_key(spark):
    rows = [("pk1", "pk2", "John", "Doe"), ("pk3", None, "Jane", None)]
    frame = spark.createDataFrame(
        rows, "source_primary_key string, target_primary_key string, first_name string, last_name string"
    ).withColumns({"human_review": F.lit("Y"), "error_matrix": F.lit("TP")})
    result = with_key_and_fingerprint(frame, ["source_primary_key", "target_primary_key"]).collect()
    expected = ["-".join(v or "" for v in r) for r in rows]
    assert [r.key_columns for r in result] == ["pk1-pk2", "pk3-"]
    assert [r.md5_hash_concat_column for r in result] == [hashlib.md5(t.encode()).hexdigest() for t in expected]


PARTS = {
    "first_name_score": 0.12,
    "last_name_score": 0.12,
    "middle_name_score": 0.02,
    "city_score": 0.08,
    "state_score": 0.05,
    "postal_code_score": 0.11,
}
# Total below the high threshold, every part at or just over its limit.
BY_PARTS = {"er_score": 0.61, "address_line_score": 0.15, "suffix_score": 0.01, **PARTS}
VERDICTS = [
    ({"er_score": 0.8}, True),
    ({"er_score": 0.8, "er_rank": 2}, False),
    ({"er_score": 0.8, "suffix_score": 0.0}, False),
    ({"er_score": 0.8, "suffix_score": None}, False),
    ({"er_score": 0.8, "city_score": None}, True),
    ({"er_score": None}, False),
    ({"er_rank": None}, False),
    (BY_PARTS, True),
    ({**BY_PARTS, "er_score": 0.6}, False),
    ({**BY_PARTS, "address_line_score": 0.14}, False),
    ({**BY_PARTS, "suffix_score": 0.0}, False),
    ({**BY_PARTS, "state_score": None}, False),
    *[({**BY_PARTS, name: limit - 0.001}, False) for name, limit in PARTS.items()],
]


def test_verdict_limits(spark):
    frame = er_frame(spark, *[row(source_primary_key=str(i), **changes) for i, (changes, _) in enumerate(VERDICTS)])
    plain, flipped = match_status(MatchRule()), match_status(MatchRule(), F.lit(True))
    for got in frame.select("source_primary_key", plain.alias("plain"), flipped.alias("flipped")).collect():
        changes, matched = VERDICTS[int(got.source_primary_key)]
        expected = ("Matched", "NOT Matched") if matched else ("NOT Matched", "Matched")
        assert (got.plain, got.flipped) == expected, changes


def test_rank_and_suffix_limits_are_configurable(spark):
    frame = er_frame(spark, row(er_rank=2, suffix_score=0.5))
    rule = MatchRule(er_rank=2, suffix_score=0.4)
    assert frame.select(match_status(rule)).first()[0] == "Matched"


def test_error_matrix(spark):
    y, n, none = "Matched", "NOT Matched", None
    cases = [(y, y, "TP"), (n, n, "TN"), (y, n, "FP"), (n, y, "FN"), (y, none, None), (none, y, None), (none, none, None)]
    frame = spark.createDataFrame(cases, "er string, truth string, expected string")
    got = frame.select(error_matrix(F.col("er"), F.col("truth")).alias("got"), "expected").collect()
    assert all(r.got == r.expected for r in got)
