from .validation import Validator, new_batch_id, validate

__all__ = ["Validator", "new_batch_id", "validate"]
