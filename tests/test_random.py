"""Random small tables, full of NULL keys, dashes, repeats and ties, against SQL."""

import random

import pyarrow as pa
import pytest

import oracle
from compare import bag
from fixture_sql import BATCH_ID
from frames import COLUMNS, COMPAT, er_frame, row, truth_frame
from pairlens import ValidationConfig, Validator
from pairlens.config import PAIR_COLUMNS

SOURCES = [None, "", "a", "a-b", "b", "a-"]
TARGETS = [None, "", "c", "b-c", "-c"]
NAMES = [None, "", "john", "John", "MARY", "mary-ann", "ann lee", "o'neil", "12"]
SCORES = [None, 0.0, 0.1, 0.5, 0.61, 0.8, 0.9]
ARROW = pa.schema(
    [(c, pa.float64() if c.endswith("_score") else pa.int32() if c == "er_rank" else pa.string()) for c in COLUMNS]
)


def random_rows(rng: random.Random, n: int) -> list[dict]:
    # A third of the rows share one pair.
    def one():
        hot = rng.random() < 1 / 3
        return row(
            source_primary_key="a" if hot else rng.choice(SOURCES),
            target_primary_key="b-c" if hot else rng.choice(TARGETS),
            source_first_name=rng.choice(NAMES),
            source_last_name=rng.choice(NAMES),
            target_first_name=rng.choice(NAMES[:3]),
            source_city=rng.choice([None, "", "x"]),
            target_entity_id=rng.choice(["e", "f"]),
            er_score=rng.choice(SCORES),
            er_rank=rng.choice([None, 1, 1, 2]),
            suffix_score=rng.choice(SCORES[:4]),
            human_review=rng.choice(["Y", "N", None]),
        )

    rows = [one() for _ in range(n)]
    return rows + rng.choices(rows, k=n // 4)


def expected(er, truth, compat):
    import duckdb

    with duckdb.connect() as connection:
        for name, rows, extra in (("some_er", er, []), ("some_truth", truth, ["human_review"])):
            schema = pa.schema([*ARROW, *[(c, pa.string()) for c in extra]])
            table = pa.Table.from_pylist([{c: r[c] for c in schema.names} for r in rows], schema)
            connection.register(name + "_arrow", table)
            connection.execute(f"CREATE TABLE {name} AS SELECT * FROM {name}_arrow")
        sql = oracle.explained(compat=compat, labels=PAIR_COLUMNS, er="some_er", truth="some_truth")
        cursor = connection.execute(f"{sql} SELECT {oracle.FINAL} FROM result")
        return bag([d[0] for d in cursor.description], cursor.fetchall())


@pytest.mark.parametrize("compat", [False, True], ids=["default", "compat"])
@pytest.mark.parametrize("seed", range(3))
def test_random_tables(spark, seed, compat):
    rng = random.Random(seed)
    er, truth = random_rows(rng, 60), random_rows(rng, 90)
    want = expected(er, truth, compat)
    base = COMPAT.but(labels=PAIR_COLUMNS) if compat else ValidationConfig()
    frames = er_frame(spark, *er).repartition(3), truth_frame(spark, *truth).repartition(5)
    # Unsplit; every repeated pair split; only larger pairs split.
    for limits in ({}, {"hot_pair_rows": 1}, {"hot_pair_rows": 2}):
        result = Validator(base.but(**limits), BATCH_ID).run(*frames)
        assert bag(result.columns, map(tuple, result.collect())) == want, limits


def test_a_table_against_itself(spark):
    rows = {(r["source_primary_key"], r["target_primary_key"]): r for r in random_rows(random.Random(7), 80)}.values()
    result = Validator(ValidationConfig(), "b").run(er_frame(spark, *rows), truth_frame(spark, *rows))
    assert {(r.validation_status, r.extra_or_missing_flag) for r in result.collect()} == {("Match", None)}


def test_classes_add_up(spark):
    rng = random.Random(11)
    er = random_rows(rng, 60)
    truth = [*er[:30], row(source_primary_key="only in truth"), *random_rows(rng, 30)]
    er.append(row(source_primary_key="only in er"))
    frames = er_frame(spark, *er), truth_frame(spark, *truth)
    validator = Validator(ValidationConfig(), "b")
    result = validator.run(*frames).groupBy("validation_status", "extra_or_missing_flag").count().collect()
    classes = {r[0]: r[1] for r in validator.records(*frames).groupBy("record_class").count().collect()}
    got = {(r[0], r[1]): r[2] for r in result}
    assert got == {
        ("Match", None): classes["match"],
        ("Mismatch", None): classes["mismatch"],
        ("Mismatch", False): classes["extra"],
        ("Mismatch", True): classes["missing"],
    }
