from . import reports  # noqa: F401  registers its queries and their SQL
from .catalogue import QUERIES
from .oracle import ORACLE

__all__ = ["ORACLE", "QUERIES"]
