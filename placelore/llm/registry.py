"""Queries of this subpackage and their SQL."""

from placelore.llm.oracle import ORACLE
from placelore.llm.queries import QUERIES

__all__ = ["ORACLE", "QUERIES"]
