"""Validation of entity-resolution output against a truth table, on Spark."""

from .config import MatchRule, ValidationConfig
from .plans import Validator, validate
from .session import tune
from .schema import PAIR_SCHEMA, TRUTH_SCHEMA

__all__ = ["MatchRule", "PAIR_SCHEMA", "TRUTH_SCHEMA", "ValidationConfig", "Validator", "tune", "validate"]
