"""Every registered query with its SQL."""

from __future__ import annotations

from . import plans  # noqa: F401  the import registers
from .registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
