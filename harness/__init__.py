"""Queries that exercise the library on the driver tables, each next to its SQL twin."""

from harness import event_queries, frame_queries, pair_queries, series_queries, source_queries  # noqa: F401
from harness.registry import ORACLES, QUERIES  # noqa: F401
