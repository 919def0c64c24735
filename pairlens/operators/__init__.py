"""DataFrame operators of a validation run."""
