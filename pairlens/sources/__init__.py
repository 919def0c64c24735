from .buckets import store_pairs, stored_pairs
from .sinks import report, save, save_batch
from .sql import DECODERS, register_decoders
from .tables import er_scan, fingerprinted_table, read_table, register_views, truth_scan

__all__ = [
    "DECODERS",
    "er_scan",
    "fingerprinted_table",
    "read_table",
    "register_decoders",
    "register_views",
    "report",
    "save",
    "save_batch",
    "store_pairs",
    "stored_pairs",
    "truth_scan",
]
