"""Training-data operators. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import imatch, lines, packing, pieces, quality, secrets, simhash, suffixes, token_counts, windows

_MODULES = (lines, packing, token_counts, secrets, windows, simhash, imatch, suffixes, quality, pieces)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.ORACLES.items()}
