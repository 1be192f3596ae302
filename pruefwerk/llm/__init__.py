"""Operators for training-data pipelines over language-model text.

Nothing outside this package imports it; ``queries`` and ``oracle_sql`` are what the entry module adds.
"""

from .catalogue import queries
from .oracle import ORACLE

__all__ = ["oracle_sql", "queries"]


def oracle_sql() -> dict[str, str]:
    return ORACLE
