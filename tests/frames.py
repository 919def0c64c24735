"""Hand-written pair rows."""

from __future__ import annotations

from pairlens import PAIR_SCHEMA, TRUTH_SCHEMA, ValidationConfig, Validator

COLUMNS = [f.name for f in PAIR_SCHEMA.fields]

_ROW = {
    "source_primary_key": "s1",
    "target_primary_key": "t1",
    "target_entity_id": "e1",
    "er_score": 0.9,
    "er_rank": 1,
    "first_name_score": 0.2,
    "last_name_score": 0.2,
    "middle_name_score": 0.2,
    "city_score": 0.2,
    "address_line_score": 0.2,
    "state_score": 0.2,
    "postal_code_score": 0.2,
    "suffix_score": 0.1,
}


def row(**changes) -> dict:
    """A matched pair whose text columns hold lower-case words."""
    words = {c: c.replace("_", " ") for c in COLUMNS if c not in _ROW}
    return {**words, **_ROW, "human_review": "Y", **changes}


def er_frame(spark, *rows):
    return spark.createDataFrame([tuple(r[c] for c in COLUMNS) for r in rows], PAIR_SCHEMA)


def truth_frame(spark, *rows):
    names = [f.name for f in TRUTH_SCHEMA.fields]
    return spark.createDataFrame([tuple(r[c] for c in names) for r in rows], TRUTH_SCHEMA)


def run(spark, er, truth, config=None, **options) -> list[dict]:
    """Result rows as dicts, ordered by keys and code."""
    validator = Validator(config or ValidationConfig(), "batch", **options)
    result = validator.run(er_frame(spark, *er), truth_frame(spark, *truth)).collect()
    rows = [r.asDict() for r in result]
    return sorted(rows, key=lambda r: (str(r["source_primary_key"]), str(r["target_primary_key"]), r["mismatches_code"]))


def one(spark, er, truth, config=None, **options) -> dict:
    (result,) = run(spark, er, truth, config, **options)
    return result


COMPAT = ValidationConfig.compatible(exceptions=())
