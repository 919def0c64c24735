"""Columns, labels, thresholds and options of a validation run."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# ---------------------------------------------------------------------------
# Fixed values. Column order defines the bit positions of ``mismatches_code``.
# ---------------------------------------------------------------------------
PAIR_COLUMNS = (
    "source_primary_key",
    "target_primary_key",
    "source_first_name",
    "target_first_name",
    "source_last_name",
    "target_last_name",
    "source_address_line",
    "target_address_line",
    "source_city",
    "target_city",
    "source_middle_name",
    "target_middle_name",
    "source_postal_code",
    "target_postal_code",
    "source_state",
    "target_state",
    "source_suffix",
    "target_suffix",
    "target_entity_id",
    "er_score",
    "er_rank",
    "first_name_score",
    "last_name_score",
    "middle_name_score",
    "city_score",
    "address_line_score",
    "state_score",
    "postal_code_score",
    "suffix_score",
)

# The shorter label list of compat mode: 21 compared columns followed by three
# derived columns that never get a bit of their own.
COMPAT_LABELS = PAIR_COLUMNS[:21] + (
    "match_status_er",
    "match_status_manual",
    "error_matrix",
)

# Length of the all-zero code that compat mode gives to unmatched rows.
COMPAT_UNMATCHED_ZEROS = 21

# The pairs whose truth verdict compat mode flips unless told otherwise.
COMPAT_EXCEPTIONS = (
    ("4f81ac70-491d-4d07-86c1-1026563c0458", "d9a4bd4e-3b15-42dc-a9c9-c5590ae5895c"),
    ("9644f1a1-9140-4b1d-aeba-61c1ff11068f", "0922ddad-651b-4d62-9f54-8bf005d40da3"),
    ("0e32e4f7-da08-4817-8281-0ba70d2767e9", "890d5f8e-df8f-4d08-9c91-5701d1b13e63"),
)

REPORT_COLUMNS = (
    "source_primary_key",
    "target_primary_key",
    "target_entity_id",
    "human_review",
    "match_status_er",
    "match_status_manual",
    "error_matrix",
    "mismatches_code",
    "mismatches_columns",
    "mismatch_deviation",
    "mismatch_type",
    "validation_status",
    "batch_id",
)

# What a result has besides the compared columns.
RESULT_COLUMNS = (
    "match_status_er",
    "error_matrix",
    "src_tgt_md5_hash_column",
    "match_status_manual",
    "human_review",
    "validation_status",
    "mismatches_code",
    "extra_or_missing_flag",
    "mismatches_columns",
    "mismatch_deviation",
    "mismatch_type",
    "batch_id",
    "code_status",
)

# Columns that belong to a scored table but never to its fingerprint.
NOT_HASHED = ("human_review", "match_status_er", "match_status_manual", "error_matrix")

MATCHED = "Matched"
NOT_MATCHED = "NOT Matched"
MATCH = "Match"
MISMATCH = "Mismatch"
# ---------------------------------------------------------------------------


#: What the verdict rule and the choice among repeated pairs read.
RULE_COLUMNS = (
    "er_score",
    "er_rank",
    "first_name_score",
    "last_name_score",
    "middle_name_score",
    "city_score",
    "address_line_score",
    "state_score",
    "postal_code_score",
    "suffix_score",
)


@dataclass(frozen=True)
class MatchRule:
    """Thresholds of the verdict rule."""

    er_score_threshold: float = 0.8
    er_score_min: float = 0.6
    first_name_score: float = 0.12
    last_name_score: float = 0.12
    middle_name_score: float = 0.02
    city_score: float = 0.08
    address_line_score: float = 0.14
    state_score: float = 0.05
    postal_code_score: float = 0.11
    suffix_score: float = 0.0
    er_rank: int = 1


@dataclass(frozen=True)
class ValidationConfig:
    """Everything a run depends on besides its two inputs.

    ``compat`` reproduces the original tool's quirks; see README, "Two modes".
    ``hot_pair_rows`` is how many rows of one pair a single join task should handle; pairs with more
    are split, unless they are less than a ``max_hot_pairs``-th of the table. Their list
    is broadcast, and by that share it has fewer than ``max_hot_pairs`` entries.
    ``exceptions`` is a literal of the plan; give a long list as a frame instead.
    """

    columns: tuple[str, ...] = PAIR_COLUMNS
    labels: tuple[str, ...] | None = None
    key_columns: tuple[str, str] = ("source_primary_key", "target_primary_key")
    entity_column: str = "target_entity_id"
    token_columns: tuple[str, ...] = ("source_first_name", "source_last_name")
    rule: MatchRule = field(default_factory=MatchRule)
    exceptions: tuple[tuple[str, str], ...] = ()
    report_columns: tuple[str, ...] = REPORT_COLUMNS
    compat: bool = False
    normalize_blanks: bool = False
    with_code_status: bool = False
    hot_pair_rows: int = 1_000_000
    max_hot_pairs: int = 100_000

    def __post_init__(self) -> None:
        if len(self.key_columns) != 2:
            raise ValueError("a pair has exactly two key columns")
        missing = [
            c
            for c in (*self.key_columns, *self.token_columns)
            if c not in self.columns
        ]
        if missing:
            raise ValueError(f"not among the selected columns: {missing}")
        if len(set(self.columns)) != len(self.columns):
            raise ValueError("selected columns repeat")
        if self.hot_pair_rows < 1 or self.max_hot_pairs < 1:
            raise ValueError("hot_pair_rows and max_hot_pairs must be positive")
        if self.entity_column not in self.columns:
            raise ValueError(f"entity column {self.entity_column} is not among the selected columns")
        unknown = [c for c in self.report_columns if c not in (*self.columns, *RESULT_COLUMNS)]
        if unknown:
            raise ValueError(f"the result has no columns {unknown} to report")

    @classmethod
    def compatible(cls, **changes) -> ValidationConfig:
        """The configuration that mirrors the original tool's results."""
        settings = {
            "compat": True,
            "labels": COMPAT_LABELS,
            "exceptions": COMPAT_EXCEPTIONS,
            **changes,
        }
        return cls(**settings)

    def with_rule(self, **thresholds) -> ValidationConfig:
        return replace(self, rule=replace(self.rule, **thresholds))

    def but(self, **changes) -> ValidationConfig:
        return replace(self, **changes)

    @property
    def bit_labels(self) -> tuple[str, ...]:
        return self.columns if self.labels is None else self.labels

    @property
    def helper_columns(self) -> tuple[str, ...]:
        """Read from the inputs for the verdicts only: in no fingerprint, bit or result."""
        return tuple(c for c in RULE_COLUMNS if c not in self.columns)

    @property
    def unmatched_zeros(self) -> int:
        return COMPAT_UNMATCHED_ZEROS if self.compat else len(self.columns)
