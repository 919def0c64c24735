"""Exact deduplication: contract rows, collisions, nulls, repeated rows, clashing names."""

import hashlib

from pyspark.sql import functions as F

from pairlens.llm.exact_dedup import copy_groups, drop_copies


def groups(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in copy_groups(docs, **options).collect()}


def test_copies_after_blanks_are_one_space(spark):
    rows = [(3, "a  b"), (1, "a\tb"), (2, "a b "), (4, None), (5, "")]
    assert groups(spark, rows) == {(3, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True), (4, 4, 2, True), (5, 4, 2, False)}


def test_hash_is_of_the_normalised_text(spark):
    docs = spark.createDataFrame([(1, "é \n x")], "doc_id long, text string")
    assert copy_groups(docs).first().text_sha256 == hashlib.sha256("é x".encode()).hexdigest()


def test_collisions_are_told_apart_by_bytes(spark):
    same = lambda text: F.md5(F.lit("one hash for all"))
    rows = [(1, "a"), (2, "b"), (3, "a")]
    assert groups(spark, rows, hash_of=same) == {(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in drop_copies(docs, hash_of=same).collect()) == [1, 2]


def test_null_ids_lose_and_repeated_rows_leave_one(spark):
    rows = [(None, "a"), (7, "a"), (7, "a"), (None, "z"), (None, "z")]
    assert groups(spark, rows) == {(None, 7, 3, False), (7, 7, 3, True), (None, None, 2, True)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.text, r.doc_id) for r in drop_copies(docs).collect()) == [("a", 7), ("z", None)]


def test_clashing_columns_pass_through(spark):
    docs = spark.createDataFrame([(1, "a", 5, 6), (2, "a", 7, 8)], "doc_id long, text string, hash int, row int")
    assert [tuple(r) for r in drop_copies(docs).collect()] == [(1, "a", 5, 6)]


def test_empty_table_and_long_text(spark):
    assert groups(spark, []) == set()
    long = "word " * 200_000
    assert groups(spark, [(1, long), (2, long + "x"), (3, long)]) == {(1, 1, 2, True), (2, 2, 1, True), (3, 1, 2, False)}
