"""Column expressions: no joins, no actions, no Python workers."""

from .compare import (
    agreement_bit,
    fingerprint_status,
    mismatch_code,
    name_tokens,
    same_value,
    same_values,
    shares_token,
)
from .decode import (
    code_status,
    label_bit,
    mismatch_deviation,
    mismatch_type,
    mismatching_columns,
    mismatching_columns_text,
    zero_count,
)
from .keys import dashed_text, hashed_columns, pair_key, row_fingerprint
from .rules import error_matrix, match_status, meets_rule

__all__ = [
    "agreement_bit",
    "code_status",
    "dashed_text",
    "error_matrix",
    "fingerprint_status",
    "hashed_columns",
    "label_bit",
    "match_status",
    "meets_rule",
    "mismatch_code",
    "mismatch_deviation",
    "mismatch_type",
    "mismatching_columns",
    "mismatching_columns_text",
    "name_tokens",
    "pair_key",
    "row_fingerprint",
    "same_value",
    "same_values",
    "shares_token",
    "zero_count",
]
