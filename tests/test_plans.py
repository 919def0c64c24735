"""Shape of the physical plan: scans, exchanges, joins, no Python workers."""

import random
import re
import tempfile

import pytest

from frames import COMPAT, er_frame, truth_frame
from pairlens import ValidationConfig, Validator, tune
from pairlens.operators.pairing import PAIR_ID, heavy_pairs
from pairlens.operators.records import flat_records
from pairlens.operators.verdict import dedup_pairs, truth_profile
from pairlens.sources import er_scan, truth_scan
from test_random import random_rows

NODE = re.compile(r"^[\s:+\-*|]*(?:\*?\(\d+\) )?(\w+)")


def nodes(plan: str) -> list[str]:
    return [m.group(1) for line in plan.splitlines() if (m := NODE.match(line))]


def final(df) -> str:
    """The plan as executed, subqueries included, without the initial plans."""
    kept, skipped = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        start = re.search(r"[\w=*]", line)
        at = start.start() if start else 0
        if skipped is not None and at >= skipped:
            continue
        skipped = at if "== Initial Plan ==" in line else None
        if skipped is None:
            kept.append(line)
    return "\n".join(kept)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("pairs")
    rng = random.Random(3)
    er_frame(spark, *random_rows(rng, 50)).write.parquet(f"{root}/er")
    truth_frame(spark, *random_rows(rng, 50)).write.parquet(f"{root}/truth")
    return spark.read.parquet(f"{root}/er"), spark.read.parquet(f"{root}/truth")


def executed(spark, tables, config, broadcast="-1", exceptions=None):
    """The plan after adaptive execution, without runtime broadcasts by default."""
    tune(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        result = Validator(config, "b", exceptions).run(*tables)
        result.collect()
        return final(result)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("config", [ValidationConfig(), COMPAT.but(labels=ValidationConfig().columns)])
def test_one_pass(spark, tables, config):
    plan = executed(spark, tables, config.but(hot_pair_rows=10**9))
    kinds = nodes(plan)
    assert "Python" not in plan and "UDF" not in plan
    assert "CartesianProduct" not in kinds and "BroadcastNestedLoopJoin" not in kinds
    # The verdict join and the pairing join; with no hot pair nothing is broadcast.
    assert kinds.count("SortMergeJoin") == 2 and "BroadcastHashJoin" not in kinds
    # ER output once; truth once for the profile (keys and scores) and once whole.
    assert kinds.count("FileScan") == 3
    # ER dedup, truth profile, truth distinct, and both sides of the pairing.
    assert kinds.count("Exchange") == 5


def test_profile_reads_keys_and_scores_only(spark, tables):
    for limit in ("spark.sql.maxMetadataStringLength", "spark.sql.debug.maxToStringFields"):
        spark.conf.set(limit, "10000")
    plan = executed(spark, tables, ValidationConfig())
    schemas = re.findall(r"ReadSchema: struct<([^>]*)", plan)
    widths = sorted(s.count(":") for s in schemas)
    assert len(schemas) == 3 and widths == [12, 29, 30]
    assert "source_city" not in min(schemas, key=len)


def test_hot_pairs_are_split(spark, tables):
    plan = executed(spark, tables, ValidationConfig(hot_pair_rows=2))
    kinds = nodes(plan)
    # The list of hot pairs comes from the one truth profile and is broadcast once.
    assert kinds.count("BroadcastHashJoin") == 2 and kinds.count("BroadcastExchange") == 1
    assert "TakeOrderedAndProject" not in kinds and kinds.count("FileScan") == 3
    assert plan.count("ReusedExchange") >= 1


def test_split_pair_is_spread_over_slots(spark, tables):
    """Every pair over the limit is listed, with its row count over the limit as slots."""
    config = ValidationConfig(hot_pair_rows=5)
    heavy = heavy_pairs(truth_profile(tables[1], config), config).collect()
    per_pair = {tuple(r[:2]): r[2] for r in tables[1].groupBy("source_primary_key", "target_primary_key").count().collect()}
    assert [c for c in heavy[0].asDict() if c != "_splits"] == PAIR_ID
    assert sorted(r._splits for r in heavy) == sorted(-(-n // 5) for n in per_pair.values() if n > 5)


@pytest.mark.parametrize("config", [ValidationConfig(), COMPAT])
def test_counts_build_no_records(spark, tables, config):
    """ER output once, truth for keys and for fingerprints; no code, no split list."""
    tune(spark)
    result = Validator(config).counts(*tables)
    found = dict(result.collect())
    plan = final(result)
    kinds = nodes(plan)
    assert kinds.count("FileScan") == 3 and "mismatches_code" not in plan and "Python" not in plan
    assert found["source"] == tables[0].select("source_primary_key", "target_primary_key").distinct().count()
    assert found["target"] == tables[1].count()


def test_configured_exceptions_add_nothing_to_the_plan(spark, tables):
    """The list is a literal: the same joins, exchanges and scans as without."""
    config = ValidationConfig(hot_pair_rows=10**9)
    pairs = [tuple(r) for r in tables[1].select("source_primary_key", "target_primary_key").distinct().collect()]
    without, listed = (nodes(executed(spark, tables, config.but(exceptions=tuple(p)))) for p in ((), pairs))
    for kind in ("SortMergeJoin", "BroadcastHashJoin", "Exchange", "FileScan", "SortAggregate", "HashAggregate"):
        assert listed.count(kind) == without.count(kind), kind


@pytest.mark.parametrize("config", [ValidationConfig(hot_pair_rows=2), COMPAT.but(labels=ValidationConfig().columns)])
def test_a_frame_of_exceptions_adds_its_own_exchange_only(spark, tables, config):
    given = tables[1].select("source_primary_key", "target_primary_key")
    without, joined = nodes(executed(spark, tables, config)), nodes(executed(spark, tables, config, exceptions=given))
    assert joined.count("SortMergeJoin") == without.count("SortMergeJoin") + 1
    assert joined.count("Exchange") == without.count("Exchange") + 1
    assert joined.count("FileScan") == without.count("FileScan") + 1


@pytest.mark.parametrize("config", [ValidationConfig(), COMPAT.but(labels=ValidationConfig().columns)])
def test_listed_and_given_exceptions_agree(spark, tables, config):
    """NULL keys, '' and keys with dashes included; every class by its own join as well."""
    keys = ["source_primary_key", "target_primary_key"]
    given = tables[1].select(*keys).distinct().where("source_primary_key <> 'b' OR source_primary_key IS NULL")
    pairs = tuple(tuple(r) for r in given.collect())
    listed = Validator(config.but(hot_pair_rows=2, exceptions=pairs), "b")
    framed = Validator(config.but(hot_pair_rows=2), "b", given.unionAll(given))
    assert flat(listed.run(*tables)) == flat(framed.run(*tables)) != flat(Validator(config, "b").run(*tables))
    assert flat(listed.scored_pairs(*tables)) == flat(framed.scored_pairs(*tables))
    assert flat(listed.verdict_pairs(*tables)) == flat(framed.verdict_pairs(*tables))
    assert flat(listed.records_of("missing", *tables)) == flat(framed.records_of("missing", *tables))


def test_exceptions_run_no_job_while_the_plan_is_built(spark, tables):
    tracker, group = spark.sparkContext.statusTracker(), "plan-only"
    given = tables[1].select("source_primary_key", "target_primary_key").distinct()
    spark.sparkContext.setJobGroup(group, "building the plan")
    try:
        Validator(ValidationConfig(), "b", given).run(*tables)
        assert list(tracker.getJobIdsForGroup(group)) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def flat(df):
    return sorted(str(r.asDict()) for r in df.collect())


@pytest.mark.parametrize("config", [ValidationConfig(hot_pair_rows=2), COMPAT.but(labels=ValidationConfig().columns, hot_pair_rows=2)])
def test_one_join_for_each_class(spark, tables, config):
    """The classes by their own joins are those of the full outer join."""
    validator = Validator(config, "b")
    every = flat_records(validator.records(*tables))
    for name, kind in {"extra": "LeftAnti", "missing": "LeftAnti", "match": "Inner", "mismatch": "Inner"}.items():
        found = validator.records_of(name, *tables)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert f"Join {kind}" in plan and "FullOuter" not in plan
        assert flat(found) == flat(every.where(every.record_class == name).select(*found.columns))


def test_plain_verdict_join_keeps_repeated_rows(spark, tables):
    er, truth = tables
    keys = ["source_primary_key", "target_primary_key"]
    for left, right in ((er.union(er), truth), (er, truth.union(truth))):
        pairs = Validator(ValidationConfig(hot_pair_rows=2)).verdict_pairs(left, right)
        assert pairs.count() == left.join(right, keys, "left").count()


def test_stored_sides_cross_no_exchange(spark, tables):
    name, path = "plan_pairs", tempfile.mkdtemp(prefix="pairlens-buckets-")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hot in (2, 10**9):
            listed = tuple(tuple(r) for r in tables[1].select("source_primary_key", "target_primary_key").distinct().limit(5).collect())
            validator = Validator(ValidationConfig(hot_pair_rows=hot, exceptions=listed), "b")
            validator.store(*tables, name, buckets=4, path=f"{path}/{hot}")
            keys = spark.table(f"{name}_truth").select("source_primary_key", "target_primary_key")
            assert keys.dropna().count() == keys.count() > 0 and (hot > 2) == (keys.where("source_primary_key = 'a' AND target_primary_key = 'b-c'").count() > 0)
            assert flat(validator.run_stored(spark, name)) == flat(validator.run(*tables))
            stored = validator.stored_records(*(spark.table(f"{name}_{s}") for s in ("er", "truth")))
            stored.collect()
            kinds = nodes(final(stored))
            assert "Exchange" not in kinds and kinds.count("SortMergeJoin") == 2 and kinds.count("FileScan") == 3
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_stored_pairs_refuse_what_they_cannot_pair(spark, tables):
    for config in (COMPAT, ValidationConfig(normalize_blanks=True)):
        with pytest.raises(ValueError):
            Validator(config, "b").run_stored(spark, "plan_pairs")
    with pytest.raises(ValueError):
        Validator(ValidationConfig(), "b", tables[1]).run_stored(spark, "plan_pairs")


def test_united_classes_are_the_records(spark, tables):
    """No two rows are equal, though nothing looks for equal ones."""
    for config in (ValidationConfig(hot_pair_rows=3), COMPAT.but(labels=ValidationConfig().columns)):
        validator = Validator(config, "b")
        united = validator.united(*tables)
        assert flat(united) == flat(flat_records(validator.records(*tables)).select(*united.columns))
        assert united.count() == united.distinct().count()
        assert "Aggregate" not in united._jdf.queryExecution().optimizedPlan().toString().split("Union")[0]


@pytest.mark.parametrize("hot", [1, 10**9])
def test_observed_counts(spark, tables, hot, tmp_path):
    er, truth = tables[0], tables[1].union(tables[1])
    validator = Validator(ValidationConfig(hot_pair_rows=hot), "b")
    counts = validator.save_observed(er, truth, f"{tmp_path}/out")
    assert counts == dict(validator.counts(er, truth).collect())
    assert flat(spark.read.schema(validator.run(er, truth).schema).parquet(f"{tmp_path}/out")) == flat(validator.run(er, truth))
    with pytest.raises(ValueError):
        Validator(COMPAT).run_observed(er, truth)


def test_dedup_holds_no_row_in_an_aggregate(spark, tables):
    found = dedup_pairs(er_scan(tables[0], ValidationConfig()), ValidationConfig())
    found.collect()
    kinds = nodes(final(found))
    assert not [k for k in kinds if "Aggregate" in k] and kinds.count("WindowGroupLimit") == 2 and kinds.count("Exchange") == 1


@pytest.mark.parametrize("hot", [1, 3])
def test_verdict_join_of_pairs_hot_on_both_sides(spark, tables, hot):
    """The grid gives what a plain join gives, repeated rows of both sides included."""
    er, truth = (t.union(t.where("source_primary_key = 'a'")) for t in tables)
    keys = ["source_primary_key", "target_primary_key"]
    pairs = Validator(ValidationConfig(hot_pair_rows=hot)).verdict_pairs(er, truth)
    said = er_scan(er, ValidationConfig()).join(truth_scan(truth, ValidationConfig()).select(*keys, "match_status_manual"), keys, "left")
    columns = [*keys, "er_score", "match_status_er", "match_status_manual"]
    assert flat(pairs.select(*columns)) == flat(said.select(*columns))


def test_list_of_hot_pairs_is_bounded(spark, tables):
    """Whatever ``hot_pair_rows``, fewer than ``max_hot_pairs`` pairs are listed, the largest."""
    truth = truth_profile(tables[1], ValidationConfig())
    for most in (1, 2, 4, 10):
        listed = heavy_pairs(truth, ValidationConfig(hot_pair_rows=1, max_hot_pairs=most)).collect()
        assert len(listed) < most
    assert listed
    config = ValidationConfig(hot_pair_rows=1)
    assert flat(Validator(config, "b").run(*tables)) == flat(Validator(config.but(max_hot_pairs=2), "b").run(*tables))


def test_repartitioned_input_changes_nothing(spark, tables):
    er, truth = tables
    config = ValidationConfig(hot_pair_rows=3)
    results = [
        sorted(map(str, Validator(config, "b").run(e, t).collect()))
        for e, t in ((er, truth), (er.repartition(7), truth.repartition(1)))
    ]
    assert results[0] == results[1]
