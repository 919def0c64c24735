"""What moves, and how much of it lands in one task."""

from test_plans import executed, final, flat, nodes, tables  # noqa: F401

from pairlens import ValidationConfig, Validator, tune
from pairlens.sources import buckets, truth_scan

KEYS = ["source_primary_key", "target_primary_key"]


def test_verdict_join_reads_keys_and_scores_of_the_truth(spark, tables):  # noqa: F811
    """The truth comes as numbers of rows per pair, ER rows are not grouped."""
    pairs = Validator(ValidationConfig(hot_pair_rows=1)).verdict_pairs(*tables)
    pairs.collect()
    plan = final(pairs)
    assert "human_review" not in plan and "er_copies" not in plan


def test_verdict_join_spells_out_many_rows(spark, tables, monkeypatch):  # noqa: F811
    monkeypatch.setattr("pairlens.operators.pairing.ROWS_AT_ONCE", 2)
    er, truth = tables[0].unionAll(tables[0]), tables[1].unionAll(tables[1]).unionAll(tables[1])
    for hot in (1, 3, 10**9):
        pairs = Validator(ValidationConfig(hot_pair_rows=hot)).verdict_pairs(er, truth)
        assert pairs.count() == er.join(truth, KEYS, "left").count()


def test_verdicts_are_worked_out_before_rows_are_spelled_out(spark, tables):  # noqa: F811
    """Once for all truth rows of one verdict that an ER row meets, not once per row; a slot may begin and end anywhere among them."""
    for hot in (1, 2, 3, 10**9):
        pairs = Validator(ValidationConfig(hot_pair_rows=hot)).verdict_pairs(tables[0].where("er_rank = 1").unionAll(tables[0]), tables[1])
        above = pairs._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
        assert "CASE WHEN" not in above
        said = truth_scan(tables[1], ValidationConfig()).select(*KEYS, "match_status_manual")
        plain = tables[0].where("er_rank = 1").unionAll(tables[0]).select(*KEYS, "er_score").join(said, KEYS, "left")
        assert flat(pairs.select(*plain.columns)) == flat(plain)


def test_exceptions_are_not_repeated_per_slot(spark, tables):  # noqa: F811
    tune(spark)
    truth, given = tables[1], tables[1].select(*KEYS)
    config = ValidationConfig(hot_pair_rows=1)
    listed = truth_scan(truth, config.but(exceptions=tuple(tuple(r) for r in given.distinct().collect())))
    found = truth_scan(truth, config, given.unionAll(given))
    assert flat(found) == flat(listed)
    found.collect()
    assert "Generate" not in nodes(final(found))


def test_truth_rows_go_by_pair(spark, tables):  # noqa: F811
    """Not by all their columns, which scatters the rows of a pair."""
    plan = executed(spark, tables, ValidationConfig(hot_pair_rows=10**9))
    assert "hashpartitioning(source_primary_key" not in plan


def test_buckets_follow_the_rows(spark, tables, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 10)
    validator = Validator(ValidationConfig(), "b")
    validator.store(*tables, "many_buckets", buckets=2, path=str(tmp_path))
    said = {r[0]: r[1] for r in spark.sql("DESCRIBE EXTENDED many_buckets_er").collect()}
    assert int(said["Num Buckets"]) == 8
    assert flat(validator.run_stored(spark, "many_buckets")) == flat(validator.run(*tables))


def _nodes(plan, kind):
    children = plan.children()
    found = [n for i in range(children.size()) for n in _nodes(children.apply(i), kind)]
    return [plan, *found] if plan.nodeName() == kind else found


def test_united_classes_share_the_exchanges_of_the_truth(spark, tables):  # noqa: F811
    """The inner join looked for NULL slots below them, which made them others than those of the missing records."""
    tune(spark)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables of any size
    try:
        united = Validator(ValidationConfig(hot_pair_rows=2), "b").united(*tables)
        planned = united._jdf.queryExecution().executedPlan().inputPlan()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    dealt = [n for n in _nodes(planned, "Exchange") if "REPARTITION_BY_COL" in n.toString().splitlines()[0]]
    assert len(dealt) == 4 and dealt[0].sameResult(dealt[2]) and dealt[1].sameResult(dealt[3])
