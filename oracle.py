"""DuckDB SQL twins of the registered queries, written from the semantics alone."""

from __future__ import annotations

from fixture_sql import BATCH_ID, CTES, with_clause
from pairlens.config import (
    COMPAT_LABELS,
    COMPAT_UNMATCHED_ZEROS,
    PAIR_COLUMNS,
    REPORT_COLUMNS,
)

S, T = "source_primary_key", "target_primary_key"
TOKENS = ("source_first_name", "source_last_name")

RULE = """(er_rank = 1 AND ((er_score >= 0.8 AND suffix_score > 0) OR (er_score > 0.6
 AND first_name_score >= 0.12 AND last_name_score >= 0.12 AND middle_name_score >= 0.02
 AND city_score >= 0.08 AND address_line_score > 0.14 AND state_score >= 0.05
 AND postal_code_score >= 0.11 AND suffix_score > 0)))"""
STATUS = f"CASE WHEN {RULE} THEN 'Matched' ELSE 'NOT Matched' END"
FLIPPED = f"CASE WHEN {RULE} THEN 'NOT Matched' ELSE 'Matched' END"


def text(columns, prefix: str = "") -> str:
    return "||'-'||".join(f"coalesce(cast({prefix}{c} AS varchar),'')" for c in columns)


KEY = text((S, T))
MD5 = f"md5({text(PAIR_COLUMNS)})"
MATRIX = """CASE WHEN er = 'Matched' AND tr = 'Matched' THEN 'TP' WHEN er = 'NOT Matched' AND tr = 'NOT Matched' THEN 'TN'
 WHEN er = 'Matched' AND tr = 'NOT Matched' THEN 'FP' WHEN er = 'NOT Matched' AND tr = 'Matched' THEN 'FN' END"""


def matrix(er: str, truth: str) -> str:
    return MATRIX.replace("er =", f"{er} =").replace("tr =", f"{truth} =")


def token_bit(name: str, compat: bool, a: str = "e_", b: str = "t_") -> str:
    a, b = a + name, b + name
    if compat:
        words = [f"string_split_regex(regexp_replace({x},'[^a-z]',' ','g'),'\\s+')" for x in (a, b)]
        return f"CASE WHEN len(list_intersect({words[0]},{words[1]})) > 0 THEN '1' ELSE '0' END"
    words = [f"string_split_regex(lower({x}),'[^a-z]+')" for x in (a, b)]
    common = f"list_intersect({words[0]},{words[1]})"
    return (
        f"CASE WHEN {a} = {b} OR len({common}) - cast(list_contains({common},'') AS int) > 0 "
        "THEN '1' ELSE '0' END"
    )


def direct_bit(name: str) -> str:
    return f"CASE WHEN e_{name} IS NOT DISTINCT FROM t_{name} THEN '1' ELSE '0' END"


def bit(name: str, compat: bool) -> str:
    return token_bit(name, compat) if name in TOKENS else direct_bit(name)


def sides(er: str = "er_output", truth: str = "truth", compat: bool = False, exceptions: bool = False,
          normalize: bool = False, columns=PAIR_COLUMNS) -> str:
    """CTEs up to ``ers`` (unique ER rows, scored) and ``trs`` (distinct truth rows).

    ``er`` and ``truth`` name derived tables or any other relations DuckDB knows.
    """
    names = [er, truth] + (["exceptions"] if exceptions else [])
    strings = [c for c in PAIR_COLUMNS if c != "er_rank" and not c.endswith("_score")]

    def clean(extra=()):
        if not normalize:
            return "*"
        return "* REPLACE (" + ", ".join(
            f"CASE WHEN {c} IS NULL OR {c} = '' THEN 'null' ELSE {c} END AS {c}" for c in (*strings, *extra)
        ) + ")"

    flip = (
        f"CASE WHEN ({S}, {T}) IN (SELECT ({S}, {T}) FROM exceptions) THEN {FLIPPED} ELSE {STATUS} END"
        if exceptions
        else STATUS
    )
    ties = ", ".join(f"{c} NULLS FIRST" for c in (*columns, "match_status_er"))
    md5 = f"md5({text(columns)})"
    derived = [n for n in names if n in CTES]
    return f"""{with_clause(*derived) + "," if derived else "WITH"}
er_in AS (SELECT {clean()} FROM {er}),
tr_in AS (SELECT {clean(("human_review",))} FROM {truth}),
er_ranked AS (SELECT *, {STATUS} AS match_status_er, {md5} AS h FROM er_in),
er_first AS (SELECT * FROM er_ranked QUALIFY row_number() OVER (PARTITION BY {S}, {T}
  ORDER BY er_rank NULLS LAST, er_score DESC NULLS LAST, h, {ties}) = 1),
trs AS (SELECT DISTINCT {", ".join(columns)}, human_review, {flip} AS match_status_manual, {md5} AS h FROM tr_in),
per_pair AS (SELECT {S}, {T}, CASE WHEN bool_or(match_status_manual = 'Matched') THEN 'Matched' ELSE 'NOT Matched' END AS verdict
  FROM trs GROUP BY {S}, {T}),
ers AS (SELECT e.*, {matrix("e.match_status_er", "p.verdict")} AS error_matrix
  FROM er_first e LEFT JOIN per_pair p ON e.{S} = p.{S} AND e.{T} = p.{T})"""


def joined(compat: bool = False, columns=PAIR_COLUMNS, **options) -> str:
    """CTEs up to ``j``: the full outer join with code, flag and status."""
    e_cols = ", ".join(f"e.{c} AS e_{c}" for c in (*columns, "match_status_er", "error_matrix", "h"))
    t_cols = ", ".join(f"t.{c} AS t_{c}" for c in (*columns, "human_review", "match_status_manual", "h"))
    on = (
        "e.kt = t.kt"
        if compat
        else f"e.{S} IS NOT DISTINCT FROM t.{S} AND e.{T} IS NOT DISTINCT FROM t.{T}"
    )
    code = "||".join(f"({bit(c, compat)})" for c in columns)
    zeros = "0" * (COMPAT_UNMATCHED_ZEROS if compat else len(columns))
    missing = f"t_{S} IS NOT NULL" if compat else "in_t AND NOT in_e"
    lost = f"in_e AND in_t AND validation_status = 'Mismatch' AND (e_{S} IS NULL OR t_{S} IS NULL)" if compat else "false"
    return f"""{sides(compat=compat, columns=columns, **options)},
j0 AS (SELECT {e_cols}, {t_cols}, e.p IS NOT NULL AS in_e, t.p IS NOT NULL AS in_t
  FROM (SELECT *, {KEY} AS kt, 1 AS p FROM ers) e FULL OUTER JOIN (SELECT *, {KEY} AS kt, 1 AS p FROM trs) t ON {on}),
j1 AS (SELECT *, CASE WHEN e_h = t_h THEN 'Match' ELSE 'Mismatch' END AS validation_status,
  CASE WHEN in_e AND in_t THEN {code} ELSE '{zeros}' END AS mismatches_code,
  CASE WHEN NOT (in_e AND in_t) THEN {missing} END AS extra_or_missing_flag FROM j0),
j AS (SELECT *, length(mismatches_code) - length(replace(mismatches_code,'0','')) AS zeros FROM j1 WHERE NOT ({lost}))"""


def explained(compat: bool = False, labels=None, columns=PAIR_COLUMNS, **options) -> str:
    """CTEs up to ``result``: the final columns."""
    labels = labels or (COMPAT_LABELS if compat else columns)
    named = ", ".join(f"CASE WHEN substr(mismatches_code,{i + 1},1) = '0' THEN '{c}' END" for i, c in enumerate(labels))
    at = columns.index("target_entity_id") + 1

    def value(c):
        if c in (S, T) and not compat:
            return f"CASE WHEN in_e THEN e_{c} ELSE t_{c} END AS {c}"
        return f"e_{c} AS {c}"

    return f"""{joined(compat=compat, columns=columns, **options)},
result AS (SELECT {", ".join(map(value, columns))}, e_match_status_er AS match_status_er,
  e_error_matrix AS error_matrix, e_h AS src_tgt_md5_hash_column, t_match_status_manual AS match_status_manual,
  t_human_review AS human_review, validation_status, mismatches_code, extra_or_missing_flag,
  concat_ws(',', {named}) AS mismatches_columns,
  cast(trunc(cast(zeros AS double) / {len(labels)} * 100) AS int) AS mismatch_deviation,
  CASE WHEN extra_or_missing_flag IS NULL THEN
    CASE WHEN zeros = 0 THEN 'NA'
      WHEN substr(mismatches_code,{at},1) = '0' AND zeros = 1 THEN 'Only WE_PID mismatch'
      WHEN substr(mismatches_code,{at},1) = '0' THEN 'WE_PID and other column mismatch'
      ELSE 'Other columns mismatch' END
    WHEN extra_or_missing_flag THEN 'Record Missing from ER Output'
    ELSE 'Extra Record in ER Output' END AS mismatch_type,
  '{BATCH_ID}' AS batch_id FROM j)"""


FINAL = ", ".join(
    (*PAIR_COLUMNS, "match_status_er", "error_matrix", "src_tgt_md5_hash_column", "match_status_manual",
     "human_review", "validation_status", "mismatches_code", "extra_or_missing_flag", "mismatches_columns",
     "mismatch_deviation", "mismatch_type", "batch_id")
)
RECORD = f"""e_{S} AS {S}_eo, e_{T} AS {T}_eo, t_{S} AS {S}_tf, t_{T} AS {T}_tf, e_target_entity_id AS target_entity_id_eo,
 t_target_entity_id AS target_entity_id_tf, e_match_status_er AS match_status_er_eo,
 t_match_status_manual AS match_status_manual_tf, e_h AS src_tgt_md5_hash_column_eo,
 validation_status, mismatches_code, extra_or_missing_flag"""
PAIR = f"e_{S} AS {S}, e_{T} AS {T}"
PAIRED = "FROM j WHERE in_e AND in_t"
CLASS = """CASE WHEN NOT in_t THEN 'extra' WHEN NOT in_e THEN 'missing' WHEN validation_status = 'Match' THEN 'match'
 ELSE 'mismatch' END"""
NARROW = tuple(c for c in PAIR_COLUMNS if c != "er_rank" and not c.endswith("_score"))
SKEWED = {"er": "skewed_er", "truth": "skewed_truth"}


def _of_class(name: str) -> str:
    return f"{joined()} SELECT {RECORD} FROM j WHERE {CLASS} = '{name}'"


def statements() -> dict[str, str]:
    strings = [c for c in PAIR_COLUMNS if c != "er_rank" and not c.endswith("_score")]
    cols = ", ".join(PAIR_COLUMNS)
    blank = ", ".join(
        [f"coalesce(nullif({c},''),'null') AS {c}" for c in (*strings, "human_review")]
        + [c for c in PAIR_COLUMNS if c not in strings]
    )
    direct = ", ".join(f"{direct_bit(c)} AS bit_{c}" for c in PAIR_COLUMNS if c not in TOKENS)

    def names(compat: bool) -> str:
        bits = ", ".join(f"{token_bit(c, compat)} AS bit_{c}" for c in TOKENS)
        return f"{joined()} SELECT {PAIR}, {bits} {PAIRED}"

    counts = " UNION ALL ".join(
        [
            f"SELECT 'source' AS metric, count(*) AS rows FROM (SELECT DISTINCT {S}, {T} FROM skewed_er)",
            "SELECT 'target', count(*) FROM skewed_truth",
            *[
                f"SELECT '{c}', coalesce(sum(copies), 0) FROM weighed WHERE class = '{c}'"
                for c in ("match", "mismatch", "extra", "missing")
            ],
        ]
    )
    weigh_on = " AND ".join(
        f"j.t_{c} IS NOT DISTINCT FROM w.{c}" for c in (*PAIR_COLUMNS, "human_review")
    )
    run_counts = (
        f"{joined(**SKEWED)}, copied AS (SELECT {cols}, human_review, count(*) AS n FROM tr_in GROUP BY ALL), "
        f"weighed AS (SELECT {CLASS} AS class, coalesce(w.n, 1) AS copies FROM j LEFT JOIN copied w ON j.in_t AND {weigh_on}) {counts}"
    )
    return {
        "er_match_status": f"{with_clause('er_output')} SELECT {cols}, {STATUS} AS match_status_er FROM er_output",
        "truth_match_status": f"{with_clause('truth')} SELECT {S}, {T}, {STATUS} AS match_status_manual, human_review FROM truth",
        "truth_exception_flip": f"{with_clause('truth', 'exceptions')} SELECT {S}, {T}, "
        f"CASE WHEN ({S}, {T}) IN (SELECT ({S}, {T}) FROM exceptions) THEN {FLIPPED} ELSE {STATUS} END "
        "AS match_status_manual, human_review FROM truth",
        "truth_exception_flip_long": f"{with_clause('skewed_truth', 'long_exceptions')} SELECT t.{S}, t.{T}, er_score, "
        f"CASE WHEN x.{S} IS NOT NULL THEN {FLIPPED} ELSE {STATUS} END AS match_status_manual, human_review "
        f"FROM skewed_truth t LEFT JOIN (SELECT DISTINCT * FROM long_exceptions) x ON t.{S} = x.{S} AND t.{T} = x.{T}",
        "er_dedup": f"{sides(er='er_candidates')} SELECT {cols}, match_status_er, h AS src_tgt_md5_hash_column FROM er_first",
        "verdict_left_join": f"{sides()} SELECT e.{S}, e.{T}, e.match_status_er, t.match_status_manual, "
        f"{matrix('e.match_status_er', 't.match_status_manual')} AS error_matrix "
        f"FROM er_ranked e LEFT JOIN (SELECT *, {STATUS} AS match_status_manual FROM tr_in) t ON e.{S} = t.{S} AND e.{T} = t.{T}",
        "verdict_left_join_candidates": f"{sides(er='er_candidates')} SELECT e.{S}, e.{T}, e.match_status_er, t.match_status_manual, "
        f"{matrix('e.match_status_er', 't.match_status_manual')} AS error_matrix "
        f"FROM er_ranked e LEFT JOIN (SELECT *, {STATUS} AS match_status_manual FROM tr_in) t ON e.{S} = t.{S} AND e.{T} = t.{T}",
        "verdict_left_join_skewed": f"{sides(**SKEWED)} SELECT e.{S}, e.{T}, e.match_status_er, t.match_status_manual, "
        f"{matrix('e.match_status_er', 't.match_status_manual')} AS error_matrix "
        f"FROM er_first e LEFT JOIN (SELECT *, {STATUS} AS match_status_manual FROM tr_in) t ON e.{S} = t.{S} AND e.{T} = t.{T}",
        "verdict_left_join_hot": f"{sides(er='hot_er', truth='hot_truth')} SELECT e.{S}, e.{T}, e.match_status_er, t.match_status_manual, "
        f"{matrix('e.match_status_er', 't.match_status_manual')} AS error_matrix "
        f"FROM er_ranked e LEFT JOIN (SELECT *, {STATUS} AS match_status_manual FROM tr_in) t ON e.{S} = t.{S} AND e.{T} = t.{T}",
        "error_matrix": f"{sides(exceptions=True)} SELECT {S}, {T}, match_status_er, error_matrix FROM ers",
        "error_matrix_skewed": f"{sides(**SKEWED)} SELECT {S}, {T}, match_status_er, error_matrix FROM ers",
        "pair_key": f"{with_clause('er_output')} SELECT {S}, {T}, {KEY} AS key_columns FROM er_output",
        "row_md5": f"{with_clause('truth')} SELECT *, {KEY} AS key_columns, {MD5} AS md5_hash_concat_column FROM truth",
        "side_suffix": f"{with_clause('truth')} SELECT "
        + ", ".join(f"{c} AS {c}_tf" for c in (*PAIR_COLUMNS, "human_review"))
        + " FROM truth",
        "blank_fill": f"{with_clause('truth')} SELECT {blank} FROM truth",
        "hash_status": f"{joined()} SELECT {PAIR}, e_h AS er_hash, validation_status {PAIRED}",
        "column_bits": f"{joined()} SELECT {PAIR}, {direct} {PAIRED}",
        "name_token_bits": names(False),
        "name_token_bits_compat": names(True),
        "mismatch_code": f"{joined()} SELECT {PAIR}, mismatches_code {PAIRED}",
        "match_records": _of_class("match"),
        "mismatch_records": _of_class("mismatch"),
        "extra_records": _of_class("extra"),
        "missing_records": _of_class("missing"),
        "union_distinct": f"{joined(**SKEWED)} SELECT {RECORD}, {CLASS} AS record_class FROM j",
        "record_union": f"{joined(**SKEWED)} SELECT {RECORD}, {CLASS} AS record_class FROM j",
        "mismatching_columns": f"{explained()} SELECT {S}, {T}, mismatches_code, mismatches_columns FROM result",
        "mismatch_deviation": f"{explained()} SELECT {S}, {T}, mismatches_code, mismatch_deviation FROM result",
        "mismatch_deviation_compat": f"{explained(compat=True)} SELECT {S}, {T}, mismatches_code, mismatch_deviation FROM result",
        "code_status": f"{joined()} SELECT coalesce(e_{S}, t_{S}) AS {S}, coalesce(e_{T}, t_{T}) AS {T}, mismatches_code, CASE WHEN zeros > 0 THEN 'Mismatch' ELSE 'Match' END AS code_status FROM j",
        "mismatch_type": f"{explained()} SELECT {S}, {T}, mismatches_code, extra_or_missing_flag, mismatch_type FROM result",
        "sql_decoders": f"{explained()} SELECT {S}, {T}, mismatches_code, extra_or_missing_flag, mismatches_columns, "
        "mismatches_columns AS mismatches_list, mismatch_deviation, CASE WHEN mismatches_code LIKE '%0%' THEN 'Mismatch' ELSE 'Match' END "
        "AS code_status, mismatch_type FROM result",
        "suffix_strip": f"{joined()} SELECT {', '.join(f'e_{c} AS {c}' for c in PAIR_COLUMNS)} FROM j WHERE {CLASS} = 'match'",
        "report_view": f"{explained(exceptions=True)} SELECT {', '.join(REPORT_COLUMNS)} FROM result",
        "run_counts": run_counts,
        "run_counts_observed": run_counts,
        "saved_batches": f"WITH latest AS ({explained(er='er_candidates')} SELECT {FINAL} FROM result), "
        f"other AS ({explained()} SELECT {FINAL} FROM result) "
        f"SELECT * FROM latest UNION ALL SELECT * REPLACE ('20240202000000' AS batch_id) FROM other",
        "validate_full": f"{explained(exceptions=True)} SELECT {FINAL} FROM result",
        "validate_tables": f"{explained()} SELECT {FINAL} FROM result",
        "validate_full_compat": f"{explained(compat=True, exceptions=True)} SELECT {FINAL} FROM result",
        "validate_candidates": f"{explained(er='er_candidates')} SELECT {FINAL} FROM result",
        "validate_blanks_normalized": f"{explained(normalize=True)} SELECT {FINAL} FROM result",
        "validate_narrow": f"{explained(columns=NARROW, **SKEWED)} SELECT * FROM result",
        "validate_stored": f"{explained(**SKEWED)} SELECT {FINAL} FROM result",
        "validate_skewed": f"{explained(**SKEWED)} SELECT {FINAL} FROM result",
        "validate_skewed_compat": f"{explained(compat=True, labels=PAIR_COLUMNS, **SKEWED)} SELECT {FINAL} FROM result",
    }
