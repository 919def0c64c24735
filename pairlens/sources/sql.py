"""The decoders of the mismatch code as SQL functions of the session, for users of the registered views."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..config import MATCH, MISMATCH, ValidationConfig

#: Names of the functions, and their arguments.
DECODERS = {
    "mismatching_columns": "code STRING",
    "mismatching_columns_text": "code STRING",
    "mismatch_deviation": "code STRING",
    "code_status": "code STRING",
    "mismatch_type": "code STRING, missing BOOLEAN",
}


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _bodies(config: ValidationConfig) -> dict[str, tuple[str, str]]:
    """Return type and SQL expression of each function."""
    labels, size = config.bit_labels, len(config.bit_labels)
    named = ", ".join(f"CASE WHEN substring(code, {i}, 1) = '0' THEN {_text(c)} END" for i, c in enumerate(labels, 1))
    zeros = "(length(code) - length(replace(code, '0', '')))"
    entity = "'1'"
    if config.entity_column in labels:
        entity = f"substring(code, {list(labels).index(config.entity_column) + 1}, 1)"

    def checked(result: str, no_zero: str) -> str:
        refused = _text(f"mismatch code has a zero beyond its {size} labels")
        return f"""CASE WHEN code IS NULL THEN NULL WHEN NOT contains(code, '0') THEN {no_zero}
          WHEN contains(substring(code, {size + 1}), '0') THEN raise_error({refused}) ELSE {result} END"""

    return {
        "mismatching_columns": ("ARRAY<STRING>", checked(f"filter(array({named}), c -> c IS NOT NULL)", "CAST(array() AS ARRAY<STRING>)")),
        "mismatching_columns_text": ("STRING", checked(f"concat_ws(',', {named})", "''")),
        "mismatch_deviation": ("INT", checked(f"CAST(CAST({zeros} AS DOUBLE) / {size} * 100 AS INT)", "0")),
        "code_status": ("STRING", f"CASE WHEN code IS NULL THEN NULL WHEN contains(code, '0') THEN '{MISMATCH}' ELSE '{MATCH}' END"),
        "mismatch_type": (
            "STRING",
            f"""CASE WHEN code IS NULL THEN NULL
          WHEN missing IS NULL AND {zeros} = 0 THEN 'NA'
          WHEN missing IS NULL AND {entity} = '0' AND {zeros} = 1 THEN 'Only WE_PID mismatch'
          WHEN missing IS NULL AND {entity} = '0' THEN 'WE_PID and other column mismatch'
          WHEN missing IS NULL THEN 'Other columns mismatch'
          WHEN {zeros} > 0 AND NOT missing THEN 'Extra Record in ER Output'
          WHEN {zeros} > 0 THEN 'Record Missing from ER Output'
          ELSE 'Unknown Error' END""",
        ),
    }


def register_decoders(spark: SparkSession, config: ValidationConfig | None = None) -> None:
    """Create or replace the functions of ``DECODERS`` in the session, for codes of ``config``.

    They are SQL expressions that Spark inlines into the query, so they cost what the column builders cost.
    ``missing`` is the flag of a record: NULL for a compared pair, false for an extra and true for a missing record.
    """
    for name, (kind, body) in _bodies(config or ValidationConfig()).items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({DECODERS[name]}) RETURNS {kind} RETURN {body}")
